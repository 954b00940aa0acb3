"""Every position of every document trains the window network."""

import numpy as np
import pyarrow as pa

from axisframe.llm import pseudo_likelihood


def test_all_windows_train(spark):
    texts = [f"one {i} two {i % 7} three" for i in range(60)] * 2 + ["a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    default, full, part = ({r["doc_id"]: r["log_likelihood"] for r in pseudo_likelihood.score(df, **more).collect()}
                           for more in ({}, {"rate": 1}, {"rate": 32}))
    assert np.allclose([default[i] for i in full], list(full.values()))
    assert not np.allclose([part[i] for i in full], list(full.values()))


def test_windows_are_all_tokens():
    bodies = pa.array([b"a b c", b"", b"d"], pa.binary())
    types, around = pseudo_likelihood.windows(bodies, np.array([5, 6, 7]), 1)
    want, ends = pseudo_likelihood.types_of(bodies)
    rows = {(t, *a) for t, a in zip(want.tolist(), pseudo_likelihood.contexts(want, ends).tolist(), strict=True)}
    assert len(types) == 4
    assert {(t, *a) for t, a in zip(types.tolist(), around.tolist(), strict=True)} == rows


def test_training_stays_in_single_precision(monkeypatch):
    seen = []
    divide = np.divide

    def watched(*args, **more):
        out = divide(*args, **more)
        seen.append(out.dtype)
        return out

    monkeypatch.setattr(np, "divide", watched)
    rng = np.random.default_rng(3)
    around, classes = rng.integers(0, 50, (1500, 4)).astype(np.int32), rng.integers(0, 32, 1500)
    trained = pseudo_likelihood.train(pseudo_likelihood.start(), around, classes)
    assert seen and {*seen} == {np.dtype(np.float32)}
    assert all(w.dtype == np.float32 for w in trained)


def test_texts_are_split_into_words_once(spark):
    """Counts, training and scores start from the written types: each has no use for the text."""
    texts = [f"one {i} two, {'x' * i}" for i in range(40)] + [""]
    docs = spark.createDataFrame([(i, i, bytearray(t.encode())) for i, t in enumerate(texts)],
                                 "key long, h long, body binary")
    tokens = pseudo_likelihood.tokenized(docs)
    for r in tokens.collect():
        types, ends = pseudo_likelihood.types_of(pa.array([texts[r["key"]].encode()], pa.binary()))
        back, borders = pseudo_likelihood.unpacked(pa.array([bytes(r["types"])], pa.binary()))
        assert back.tolist() == types.tolist() and borders.tolist() == ends.tolist()
    counts = pseudo_likelihood.corpus_counts(tokens)
    assert counts.sum() == sum(4 if i == 0 else 5 for i in range(40))
    assert len(pseudo_likelihood.fit(tokens, counts)) == 5
