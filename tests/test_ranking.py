import numpy as np
import pandas as pd
import pytest

from axisframe.operators import ranking
from axisframe.operators.ranking import exact_percentiles, ranked, running_totals


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    # One group holds more than a third of the rows, one value half of them.
    group = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 40, 3000))
    value = np.where(rng.random(3000) < 0.5, 1.5, rng.normal(size=3000).round(2))
    return pd.DataFrame({"id": np.arange(3000), "g": group, "v": value})


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ranked(spark, frame, parts):
    got = ranked(spark.createDataFrame(frame).repartition(parts), ["v", "id"], ["g"]).toPandas()
    want = frame.sort_values(["g", "v", "id"])
    want["rank"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="id")
    assert (merged["rank_x"] == merged["rank_y"]).all() and len(merged) == 3000


def test_global_rank(spark, frame):
    got = ranked(spark.createDataFrame(frame), ["v", "id"], start=0).toPandas().sort_values(["v", "id"])
    assert list(got["rank"]) == list(range(3000))


def test_running_totals(spark, frame):
    got = running_totals(spark.createDataFrame(frame), ["v", "id"], ["g"], {"t": "id"}).toPandas()
    want = frame.sort_values(["g", "v", "id"])
    want["t"] = want.groupby("g")["id"].cumsum() - want["id"]
    merged = got.merge(want, on="id")
    assert (merged["t_x"] == merged["t_y"]).all()


def test_percentiles(spark, frame):
    got = exact_percentiles(spark.createDataFrame(frame), ["g"], "v", {"p50": .5, "p95": .95, "p0": 0.0})
    for row in got.collect():
        values = frame[frame.g == row["g"]]["v"]
        assert row["p50"] == pytest.approx(np.quantile(values, .5))
        assert row["p95"] == pytest.approx(np.quantile(values, .95))
        assert row["p0"] == values.min()
    whole = exact_percentiles(spark.createDataFrame(frame), [], "v", {"p": .37}).head()["p"]
    assert whole == pytest.approx(np.quantile(frame["v"], .37))


def test_null_groups_are_groups(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 5), (None, 9)], "g string, v int")
    placed = {(r["g"], r["v"]): r["rank"] for r in ranked(rows, ["v"], ["g"]).collect()}
    assert placed == {(None, 1): 1, (None, 2): 2, (None, 9): 3, ("a", 5): 1}
    middle = {r["g"]: r["p50"] for r in exact_percentiles(rows, ["g"], "v", {"p50": 0.5}).collect()}
    assert middle == {None: 2.0, "a": 5.0}
    totals = running_totals(rows, ["v"], ["g"], {"before": "v"})
    assert {(r["g"], r["v"]): r["before"] for r in totals.collect()}[None, 9] == 3


def test_ranked_slices(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    value = np.where(rng.random(4000) < 0.6, 1.0, rng.integers(3, 9, 4000) / 10.0).tolist()
    rows = [(f"v{i % 50:03d}", f"w{i:05d}", v) for i, v in enumerate(value)]
    spark.createDataFrame(rows, "a string, b string, v double").repartition(5).write.parquet(f"{tmp_path}/t")
    written = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(ranking, "SLICE_ROWS", 200)
    placed = ranking.ranked_slices(written, "v", ["a", "b"], name="n", start=0)
    got = {(r["a"], r["b"]): r["n"] for r in placed.collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    assert got == {(a, b): i for i, (a, b, _) in enumerate(want)}
    # the rows travel once, and the value of 60 % of them has many slices
    plan = placed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1
    sliced, slices = ranking._cut(written, "v", ["a", "b"])
    assert slices == 20 and max(r["count"] for r in sliced.groupBy("_slice").count().collect()) < 800
    for few in (written.where("false"), written.limit(1)):
        assert ranking.ranked_slices(few, "v", ["a", "b"]).count() == few.count()


def test_ranked_does_not_shuffle_for_its_offsets(spark, frame):
    df = spark.createDataFrame(frame).repartition(5)
    placed = ranked(df, ["v", "id"])
    placed.collect()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
