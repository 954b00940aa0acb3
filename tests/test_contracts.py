import hashlib

import pytest

from axisframe.operators import contracts as K

NAMES = ["red", "shiny"]
SHARD = "image_id string, status string, present array<string>, uncertain array<string>, source string"


def shards(spark, rows):
    return spark.createDataFrame(rows, SHARD)


@pytest.fixture(scope="module")
def plan(spark):
    manifest = spark.createDataFrame([(0, "cup/b"), (1, "cup/a"), (2, "jar/a")], "pos long, image_id string")
    splits = spark.createDataFrame([("cup", "train"), ("jar", "dev")], "class string, split string")
    return manifest, splits


def test_merge_orders_rows(spark, plan):
    rows = [("cup/a", "ok", ["red"], [], "s1"), ("cup/b", "ok", ["shiny"], ["red"], "s2")]
    merged, bad, counts = K.merge_label_shards(shards(spark, rows), NAMES, *plan, "train")
    assert [r["image_id"] for r in merged.collect()] == ["cup/b", "cup/a"]
    K.require_empty(bad, "shards")
    assert {r["source"]: r["rows"] for r in counts.collect()} == {"s1": 1, "s2": 1}


@pytest.mark.parametrize(("row", "rule"), [
    (("cup/a", "error", ["red"], [], "s1"), "non_success"), (("cup/a", None, ["red"], [], "s1"), "non_success"),
    (("cup/a", "ok", ["blue"], [], "s1"), "unknown_name"), (("cup/a", "ok", ["red"], ["red"], "s1"), "overlap"),
    (("cup/a", "ok", None, [], "s1"), "invalid_lists"), (("jar/a", "ok", ["red"], [], "s1"), "outside_split"),
    (("cup/b", "ok", ["red"], [], "s1"), "duplicate")])
def test_merge_violations(spark, plan, row, rule):
    rows = shards(spark, [("cup/b", "ok", ["red"], [], "s0"), row])
    merged, bad, _c = K.merge_label_shards(rows, NAMES, *plan, "train")
    if row[0] != "jar/a":
        with pytest.raises(Exception, match="cannot be merged"):
            merged.collect()
    rules = {r["rule"] for r in bad.collect()}
    assert rule in rules
    if row[0] != "cup/a":
        assert "missing" in rules
    with pytest.raises(K.ContractError):
        K.require_empty(bad, "shards")


def test_an_id_listed_twice_is_a_violation(spark, plan):
    manifest = plan[0].union(plan[0].where("pos = 0"))
    rows = shards(spark, [("cup/a", "ok", ["red"], [], "s1"), ("cup/b", "ok", ["red"], [], "s1")])
    bad = K.merge_label_shards(rows, NAMES, manifest, plan[1], "train")[1]
    assert [(r["image_id"], r["rule"], r["detail"]) for r in bad.collect()] == [("cup/b", "listed_twice", "2")]


def test_merge_test_needs_opt_in(spark, plan):
    with pytest.raises(ValueError):
        K.merge_label_shards(shards(spark, []), NAMES, *plan, "test")


def test_strict_rows(spark):
    rows = shards(spark, [("a", "ok", ["red"], [], "s"), ("b", "error", [], [], "s"), ("c", "ok", [], ["red"], "s"),
                          ("d", "ok", ["red", "red"], [], "s"), ("e", "ok", ["x"], [], "s")])
    bad = {(r["image_id"], r["rule"]) for r in K.validate_label_rows(rows, NAMES, strict=True).collect()}
    assert bad == {("b", "not_final"), ("c", "uncertain"), ("d", "repeated_positive"), ("e", "unknown_name")}


def test_fingerprint(spark):
    ids = spark.createDataFrame([(i, f"x{i}") for i in range(10)], "pos long, image_id string").repartition(3)
    text = "\n".join(f"x{i}" for i in range(10)) + "\n"

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()
    assert tuple(K.ordered_fingerprint(ids).head()) == (10, 1, sha(sha(text) + "\n"))
    level = [sha("".join(f"x{i}\n" for i in range(k, min(k + 2, 10)))) for k in range(0, 10, 2)]
    while len(level) > 1:  # two digests a node, on every length the same rule
        level = [sha("".join(d + "\n" for d in level[k:k + 2])) for k in range(0, len(level), 2)]
    assert tuple(K.ordered_fingerprint(ids, 2, 2).head()) == (10, 5, level[0])


def test_coverage_and_classes(spark):
    a = spark.createDataFrame([("cup/1",), ("jar/1",)], "image_id string")
    b = spark.createDataFrame([("cup/1",), ("pan/1",), ("pan/2",)], "image_id string")
    assert tuple(K.coverage_diff(a, b).head()) == (2, 1)
    assert {tuple(r) for r in K.class_set_equality(a, b).collect()} == {("jar", "left"), ("pan", "right")}


def test_identity_allows_absent_artifacts(spark):
    declared = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "artifact string, sha256 string")
    actual = spark.createDataFrame([("a", "1"), ("b", "9")], "artifact string, sha256 string")
    assert [r["artifact"] for r in K.artifact_identity_check(declared, actual).collect()] == ["b"]
