"""The candidates of the registered dictionary build."""

import numpy as np
import pytest

from axisframe.operators import linalg, support
from axisframe.plans import dictionary, direction_queries


class _Seen(Exception):
    pass


def test_candidates_do_not_depend_on_the_number_of_documents(spark, tmp_path, monkeypatch):
    # 400 documents of 20 sources; "rare" is in 12 of 8 sources, "rarer" in 11, "narrow" in 14 of 7.
    def text(i):
        held = ["common"] + ["rare"] * (i < 160 and i % 20 < 8 and i // 20 < (2 if i % 20 < 4 else 1))
        held += ["rarer"] * (i < 11) + ["narrow"] * (i < 40 and i % 20 < 7)
        return " ".join(held)

    docs = [(i, text(i), f"src{i % 20}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")

    def caught(mentions, images, phrase_vectors, options):
        found, _ = support.candidate_phrases(mentions, options.min_mentions, options.min_class_support)
        names = {r["phrase"] for r in found.collect()}
        raise _Seen(names, names - {r["phrase"] for r in phrase_vectors.collect()})

    monkeypatch.setattr(dictionary, "build_dictionary", caught)
    try:
        direction_queries.dictionary_build(spark, str(tmp_path))
    except _Seen as seen:
        assert seen.args == ({"common", "rare"}, set())
    else:
        raise AssertionError("the query does not build a dictionary")


@pytest.mark.parametrize("gathered", [1 << 16, 7])
def test_paired_means_send_a_vector_once(spark, monkeypatch, gathered):
    monkeypatch.setattr(linalg, "GATHERED", gathered)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    pairs = sorted({(f"p{k}", f"i{i}") for k, i in zip(rng.integers(0, 9, 300), rng.integers(0, 70, 300), strict=True)})
    df = spark.createDataFrame(pairs, "phrase string, image_id string").repartition(6)
    vectors = spark.createDataFrame([*((f"i{i}", x.tolist()) for i, x in enumerate(v)), ("i65", None)],
                                    "image_id string, e array<double>")
    found = linalg.paired_means(df, vectors, "phrase", "image_id", "e", len(pairs))
    got = {r["phrase"]: r["e"] for r in found.collect()}
    for p in {p for p, _ in pairs}:
        want = np.mean([v[int(i[1:])] for q, i in pairs if q == p and int(i[1:]) < 60], axis=0)
        np.testing.assert_allclose(got[p], want, atol=1e-12)
    assert linalg.paired_means(df.where("false"), vectors, "phrase", "image_id", "e", 0).count() == 0
    assert linalg.paired_means(df, vectors.where("false"), "phrase", "image_id", "e", 1).count() == 0
