import numpy as np
import pytest

from axisframe.operators import retrieval as R
from axisframe.operators import tiles


def pair_frame(spark, image, caption):
    return spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b])
                                  for i, (a, b) in enumerate(zip(image, caption))],
                                 "pos long, image array<double>, caption array<double>")


def test_identity_pairs_are_perfect(spark):
    for row in R.paired_retrieval(pair_frame(spark, np.eye(6), np.eye(6)), (1, 5)).collect():
        assert row["recall_at_1"] == row["recall_at_5"] == row["mean_reciprocal_rank"] == 1.0


def test_ties_go_by_index(spark):
    for row in R.paired_retrieval(pair_frame(spark, np.ones((4, 2)), np.ones((4, 2))), (1, 2, 4)).collect():
        assert (row["recall_at_1"], row["recall_at_2"], row["recall_at_4"]) == (.25, .5, 1.0)
        assert row["mean_rank"] == row["median_rank"] == 2.5 and row["maximum_rank"] == 4


def test_image_to_text_recall(spark):
    ranks = R.target_rank_index_tie(pair_frame(spark, np.eye(3), np.eye(3)[[1, 1, 2]]), "image", "caption")
    # Image 0 has no matching caption; 1 ties with the first caption and loses by index.
    assert {r["pos"]: r["rank"] for r in ranks.collect()} == {0: 1, 1: 2, 2: 1}


@pytest.mark.parametrize("rows", [7, 2048])
def test_paired_ranks_do_not_depend_on_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(tiles, "block_rows", lambda width: rows)
    rng = np.random.default_rng(0)
    image = rng.normal(size=(60, 4))
    caption = image + rng.normal(size=(60, 4))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (image, caption)]
    scores = unit[0] @ unit[1].T
    want = 1 + (scores > scores.diagonal()[:, None] + 1e-12).sum(1)
    got = R.target_rank_index_tie(pair_frame(spark, image, caption), "image", "caption").orderBy("pos").collect()
    assert [r["rank"] for r in got] == list(want)


def test_zero_rows_are_refused(spark):
    with pytest.raises(Exception, match="zero-norm"):
        R.paired_ranks(pair_frame(spark, np.zeros((2, 2)), np.eye(2))).collect()


@pytest.mark.parametrize("rows", [9, 2048])
def test_compositional_ranks_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(tiles, "block_rows", lambda width: rows)
    rng = np.random.default_rng(1)
    n, c = 40, 9
    # Coarse scores make many exact ties.
    gallery = {m: rng.integers(-2, 3, (n, c)).astype(float) for m in ("a", "b")}
    profiles = spark.createDataFrame([(m, i, [float(v) for v in p[i]]) for m, p in gallery.items() for i in range(n)],
                                     "model string, image_id long, profile array<double>")
    sets = [[k for k in range(c) if rng.random() < 0.4][:5] for _ in range(n)]
    images = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "image_id long, concepts array<int>")
    schedule = {1: 2, 2: 3, 4: 1}
    from axisframe.operators.sampling import concept_rollouts
    rollouts = concept_rollouts(images, c, schedule, 3).collect()
    got = {tuple(r)[:5]: r["rank"] for r in
           R.compositional_ranks(images, profiles, c, schedule, 3).select(
               "model", "image_id", "rollout", "kind", "size", "rank").collect()}
    want = {}
    for m, p in gallery.items():
        for r in rollouts:
            for size, allowed in schedule.items():
                if r["length"] >= size and r["rollout"] < allowed:
                    s = p[:, r["seq"][:size]].sum(1)
                    own = s[r["image_id"]]
                    want[m, r["image_id"], r["rollout"], r["kind"], size] = (
                        1 + (s > own + 1e-7).sum() + 0.5 * ((abs(s - own) <= 1e-7).sum() - 1))
    assert got == want


RANKS = "model string, kind string, image_id int, rollout int, size int, rank double"


def test_curve_change_and_comparison(spark):
    rows = [("a", "true", 1, 0, 1, 6.0), ("a", "true", 1, 0, 2, 2.0), ("a", "true", 2, 0, 1, 1.0),
            ("a", "true", 2, 0, 4, 1.0), ("b", "true", 1, 0, 1, 3.0), ("b", "true", 1, 0, 2, 2.0)]
    df = spark.createDataFrame(rows, RANKS)
    curve = {(r["model"], r["size"]): r for r in R.recall_curve(df, 11).collect()}
    a1 = curve["a", 1]
    assert (a1["images"], a1["queries"], a1["recall_at_1"], a1["recall_at_10"]) == (2, 2, .5, 1.0)
    assert a1["median_rank"] == 3.5 and a1["mean_normalized_rank"] == pytest.approx(.25)
    assert a1["chance_at_5"] == pytest.approx(5 / 11)
    change = {(r["model"], r["from_size"], r["to_size"]): r for r in R.rank_change_by_length(df, [1, 2, 4]).collect()}
    # Image 2 skips size 2, so its ranks are not consecutive.
    assert set(change) == {("a", 1, 2), ("b", 1, 2)}
    assert change["a", 1, 2]["improved"] == 1.0 and change["a", 1, 2]["mean_rank_change"] == -4.0
    versus = {r["size"]: r for r in R.paired_comparison(df, "b").collect()}
    assert versus[1]["reference_better"] == 1.0 and versus[1]["mean_rank_difference"] == -3.0
    assert versus[2]["same_rank"] == 1.0 and 4 not in versus


def test_gates(spark):
    checks = spark.createDataFrame([("baseline_image", True, 0, 1e-4), ("candidate_image", True, 1, 1e-4)],
                                   "label string, all_finite boolean, zero_norm_rows long, max_abs_error double")
    metrics = spark.createDataFrame([("baseline", "d", .90), ("candidate", "d", .895)],
                                    "encoder string, direction string, recall_at_1 double")
    got = {r["gate"]: r for r in R.quality_gates(checks, metrics, 5e-4, 1.0, (1,)).collect()}
    assert got["d.recall_at_1"]["passed"] and got["d.recall_at_1"]["value"] == pytest.approx(-.5)
    assert got["normalization.baseline_image"]["passed"] and not got["normalization.candidate_image"]["passed"]
    assert not got["overall"]["passed"] and got["overall"]["value"] == pytest.approx(-.5)
    tight = {r["gate"]: r["passed"] for r in R.quality_gates(checks, metrics, 5e-4, 0.1, (1,)).collect()}
    assert not tight["d.recall_at_1"]


def test_item_and_additive_queries(spark):
    gallery = spark.createDataFrame([(1, [1.0, -2.0, 9.0]), (2, [0.0, 5.0, 1.0]), (3, [1.0, 1.0, 1.0])],
                                    "image_id int, profile array<double>")
    top = R.additive_query_topk(gallery, {0: 2.0, 1: 7.0, 2: -1.0}, 2).collect()
    assert [(r["image_id"], r["score"]) for r in top] == [(2, 15.0), (3, 5.0)]
    own = R.load_item_as_query(gallery, 1).collect()
    assert [(r["image_id"], r["score"]) for r in own] == [(1, 28.0), (3, 4.0), (2, 3.0)]
    with pytest.raises(ValueError):
        R.load_item_as_query(gallery, 99)


def test_top_concepts(spark):
    profiles = spark.createDataFrame([(1, [3.0, 1.0, 3.0, 9.0])], "image_id int, profile array<double>")
    present = spark.createDataFrame([(1, [0, 1, 2])], "image_id int, concepts array<int>")
    rows = R.top_concepts_per_image(profiles, present, 2).collect()
    assert [(r["place"], r["concept_idx"], r["score"]) for r in rows] == [(1, 0, 3.0), (2, 2, 3.0)]


@pytest.mark.parametrize("odd", [None, 1e9, 1e30, np.nan])
def test_prefix_counts_settle_close_scores_exactly(monkeypatch, odd):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(R.screening, "PIECE", 16)
    gallery = rng.normal(size=(70, 12))
    gallery[30:50] = gallery[0] + rng.choice([0.0, 9e-8, -9e-8, 4.3e-7, -4.3e-7], (20, 12)) / 8
    gallery[60:] = gallery[0]
    if odd is not None:
        gallery[5, 2] = odd
    for size in (1, 2, 5):
        prefix = np.array([rng.permutation(12)[:size] for _ in range(300)])
        own = np.array([sum(gallery[i % 70, c] for c in p) for i, p in enumerate(prefix)])
        scores = sum(gallery[:, prefix[:, k]] for k in range(size)).T
        with np.errstate(invalid="ignore"):
            greater, equal = R.prefix_counts(np.ascontiguousarray(gallery.T), prefix, own)
            gap = scores - own[:, None]
        assert (greater == (gap > 1e-7).sum(1)).all() and (equal == (abs(gap) <= 1e-7).sum(1)).all()


def test_a_tile_hands_on_one_row_a_query_however_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(tiles, "block_rows", lambda width: 8)
    rows, made = tiles.cross_tiles, []

    def counted(*args, **kwargs):
        made.append(rows(*args, **kwargs))
        return made[-1]
    monkeypatch.setattr(R, "cross_tiles", counted)
    rng = np.random.default_rng(5)
    images = spark.createDataFrame([(i, [0, 1, 2]) for i in range(60)], "image_id long, concepts array<int>")
    profiles = spark.createDataFrame([("m", i, rng.normal(size=6).tolist()) for i in range(60)],
                                     "model string, image_id long, profile array<double>")
    R.compositional_ranks(images, profiles, 6, {1: 1, 3: 1}, 0)
    # 60 images, two kinds and sizes; one block of the gallery.
    assert made[-1].count() == 240


@pytest.mark.parametrize("odd", [None, 1e12, np.inf])
def test_best_pairs_equal_a_full_sort(monkeypatch, odd):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(R.screening, "PIECE", 16)
    gallery, queries = rng.normal(size=(90, 6)), rng.normal(size=(40, 6))
    gallery[20:50] = gallery[3]
    gallery[50:60] = gallery[3] + rng.normal(size=(10, 6)) * 1e-9
    if odd is not None:
        gallery[7, 1] = odd
    items = rng.permutation(90) + 100
    row, at, score = R.best_pairs(queries, gallery, items, 5)
    scores = (queries[:, None] * gallery[None]).sum(2)
    for i in range(40):
        want = np.lexsort((items, -np.round(scores[i], 12)))[:5]
        assert list(at[row == i]) == list(want)
    assert len(row) == 200 and score == pytest.approx(scores[row, at])


def test_pair_counts_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(R.screening, "PIECE", 16)
    q = rng.normal(size=(50, 5))
    q[30:] = q[2] + rng.choice([0, 1e-9], (20, 5))
    t = q[rng.permutation(50)] + rng.choice([0, 1e-8], (50, 5))
    t[40:] = t[1]
    for at in (np.arange(50), np.arange(50) // 2):
        scores = np.einsum("ik,jk->ij", q, t)
        own = scores.diagonal().copy()
        got = R.pair_counts(q, t, own, own, at, at, True)
        assert (got[0] == R._ahead(scores, own, at, at)).all()
        assert (got[1] == R._ahead(scores.T, own, at, at)).all()


def test_paired_tiles_hand_on_one_row_a_side(spark, monkeypatch):
    monkeypatch.setattr(tiles, "block_rows", lambda width: 8)
    whole, made = tiles.cross_tiles, []

    def kept(*args, **kwargs):
        made.append(whole(*args, **kwargs))
        return made[-1]
    monkeypatch.setattr(R, "cross_tiles", kept)
    image = np.random.default_rng(8).normal(size=(60, 4))
    R.paired_ranks(pair_frame(spark, image, image), "image", "caption")
    assert made[-1].count() == 120


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_every_gallery_row_is_ranked(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(R, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(R, "RANKED_CELLS", 100)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(70, 4))
    v[40:] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = spark.createDataFrame(rows[:50], "query_id long, embedding array<double>")
    gallery = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    got = {}
    for r in R.ranked_gallery(queries, gallery).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    scores = np.einsum("ik,jk->ij", v[:50], v)
    assert sorted(got) == list(range(50))
    for i, found in got.items():
        want = np.lexsort((np.arange(70), -np.round(scores[i], 12)))
        assert [r["item_id"] for r in found] == list(want) and [r["rank"] for r in found] == list(range(1, 71))
        assert [r["score"] for r in found] == pytest.approx(scores[i][want])


def test_gallery_scores_drops_no_pair(spark):
    from axisframe.plans.catalog import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert QUERIES["gallery_scores"](spark, sf).count() == n * n
    assert "rank <=" not in ORACLES["gallery_scores"]


@pytest.mark.parametrize("name", ["concept_rollouts", "nested_prefix_scores", "target_rank_avg_tie", "recall_curve",
                                  "rank_change_by_length", "paired_comparison"])
def test_vectors_positive_nearly_everywhere_have_ranks(spark, tmp_path, name):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from axisframe.plans.catalog import ORACLES, QUERIES
    from check_parity import rows_of

    v = np.random.default_rng(10).normal(size=(40, 64)).astype(np.float32)
    for row, lacking in ((0, 13), (1, 5), (2, 1), (3, 0)):
        v[row] = np.abs(v[row])
        v[row, 20:20 + lacking] *= -1
    pq.write_table(pa.table({"vec_id": np.arange(40), "embedding": pa.array(list(v)), "label": np.arange(40) % 8}),
                   tmp_path / "embeddings.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, cur.fetchall())
