"""Tag rows are made once, as lists, and read once by the queries built on them."""

import pytest

from axisframe.operators import summaries, support
from axisframe.plans import inputs as I
from axisframe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_tag_rows_move_lists(spark):
    rows = I.tag_rows(spark, SF)
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    part = {r["p_partkey"]: r for r in I.table(spark, SF, "part").collect()}
    want: dict[int, set[str]] = {}
    for r in I.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey").collect():
        held = part[r["l_partkey"]]
        want.setdefault(r["l_orderkey"], set()).update({held["p_type"].lower(), *held["p_name"].split(" ")} - {""})
    got = {int(r["image_id"].split("/")[1]): r["attributes"] for r in rows.collect()}
    assert got == {k: sorted(v) for k, v in want.items() if v}
    assert I.tags(spark, SF).count() == sum(map(len, got.values()))


def test_rows_without_phrases_and_repeats(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("part", [(1, "A", "b  b"), (2, None, "c"), (3, "", ""), (4, "x", None)],
         "p_partkey long, p_type string, p_name string")
    save("lineitem", [(1, 1), (1, 1), (1, 2), (2, 3), (3, 2), (4, 4), (5, 1)], "l_orderkey long, l_partkey long")
    save("orders", [(k, 7) for k in (1, 2, 3, 4, 6)], "o_orderkey long, o_custkey long")
    save("customer", [(7, 0)], "c_custkey long, c_nationkey int")
    save("nation", [(0, "N")], "n_nationkey int, n_name string")
    got = {r["image_id"]: r["attributes"] for r in I.tag_rows(spark, str(tmp_path)).collect()}
    assert got == {"N/1": ["a", "b", "c"], "N/3": ["c"]}


@pytest.mark.parametrize("name", ["src_dictionary", "concept_priority", "tag_backed_exemplars"])
def test_tag_rows_are_joined_once(spark, monkeypatch, name):
    made, images = [], []
    rows, totals = I.tag_rows, support._support
    monkeypatch.setattr(I, "tag_rows", lambda *a: made.append(1) or rows(*a))
    monkeypatch.setattr(support, "_support", lambda u, m, unit, i: images.append(i) or totals(u, m, unit, i))
    # written: a second join would be a second call or the mentions' own images
    assert not QUERIES[name](spark, SF).isEmpty()
    assert made == [1] and images and all(i is not None for i in images)


def test_examples_read_candidates_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("n", i, f"class{i % 3}/{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "name string, pos int, image_id string").mapInArrow(
        watched, "name string, pos int, image_id string")
    got = summaries.diverse_examples(df, 5).orderBy("place").collect()
    assert [r["image_id"] for r in got] == ["class0/0", "class1/1", "class2/2", "class0/3", "class1/4"]
    assert seen.value == 60
