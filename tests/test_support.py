import hashlib
import pytest
from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.operators import joins, sampling, support

ROWS = [("apple/a.jpg", ["red", "round"]), ("apple/b.jpg", ["red"]), ("ball/a.jpg", ["round"])]
TAGS = "image_id string, attributes array<string>"


def test_support_counts_classes_equally(spark):
    got = {r["phrase"]: r for r in support.attribute_support(
        support.tag_mentions(spark.createDataFrame(ROWS, TAGS))).collect()}
    assert (got["red"]["mentions"], got["red"]["class_support"]) == (2, 1)
    assert (got["round"]["mentions"], got["round"]["class_support"]) == (2, 2)
    assert got["red"]["balanced_prevalence"] == pytest.approx(0.5)
    assert got["round"]["balanced_prevalence"] == pytest.approx(0.75)


def test_repeats_and_empty_rows_do_not_count(spark):
    rows = spark.createDataFrame([("a/1", ["x", "x"]), ("a/2", []), ("b/1", None), ("a/3", ["y"])], TAGS)
    got = {r["phrase"]: r for r in support.attribute_support(support.tag_mentions(rows)).collect()}
    assert got["x"]["mentions"] == 1
    assert got["x"]["balanced_prevalence"] == pytest.approx(0.5)


def test_statistics_rank(spark):
    rows = support.attribute_statistics(support.tag_mentions(spark.createDataFrame(ROWS, TAGS))).collect()
    assert {r["attribute"]: r["rank"] for r in rows} == {"round": 1, "red": 2}


def test_lexical_negations(spark):
    rows = spark.createDataFrame([("a/1", ["rigid", "nonregular"]), ("a/2", ["rigid", "regular"]),
                                  ("b/1", ["rigid", "regular"])], TAGS)
    kept, negated = support.candidate_phrases(support.tag_mentions(rows), 1, 1)
    assert {r["phrase"] for r in kept.collect()} == {"rigid", "regular"}
    assert [tuple(r) for r in negated.collect()] == [("nonregular", "regular")]


def test_first_matching_prefix_wins(spark):
    phrases = spark.createDataFrame([("in-door",), ("door",), ("undoor",), ("indoor",)], "phrase string")
    _kept, negated = support.exclude_lexical_negations(phrases)
    assert {tuple(r) for r in negated.collect()} == {
        ("in-door", "door"), ("undoor", "door"), ("indoor", "door")}


def test_lexical_variants(spark):
    words = ["gray", "grey", "multi-colored", "multicolored", "rigid", "lightweight", "berries", "berry",
             "glass", "glas", "toys", "toy", "lens"]
    keys = {r["phrase"]: r["variant_key"] for r in support.lexical_variant_key(
        spark.createDataFrame([(w,) for w in words], "phrase string")).collect()}
    assert keys["gray"] == keys["grey"] and keys["multi-colored"] == keys["multicolored"]
    assert keys["berries"] == "berry" and keys["toys"] == "toy"
    assert keys["glass"] == "glass" and keys["lens"] == "lens"
    assert keys["rigid"] != keys["lightweight"]


def test_image_counts_once_per_cluster(spark):
    mentions = support.tag_mentions(spark.createDataFrame(ROWS, TAGS))
    clusters = spark.createDataFrame([("red", "c"), ("round", "c")], "phrase string, cluster string")
    row = support.cluster_support(mentions, clusters).head()
    assert row["mentions"] == 3 and row["prevalence"] == pytest.approx(1.0)


@pytest.mark.parametrize(("image_id", "folder_or_stem"), [
    ("kettle/0001.png", "kettle"), ("lamp\\left.webp", "lamp"), ("spade3.png", "spade3"), ("one.two.three", "one.two"),
    ("bare", "bare"), (".dotfile", ".dotfile"), ("deep/er/still.png", "deep")])
def test_image_class(spark, image_id, folder_or_stem):
    df = spark.createDataFrame([(image_id,)], "image_id string")
    assert df.select(C.image_class("image_id")).head()[0] == folder_or_stem


@pytest.mark.parametrize(("image_id", "label"), [
    ("garden_hose12/left_view.png", "garden hose"), ("ladder.png", "ladder"), ("tea_pot7.png", "tea pot")])
def test_subject_label(spark, image_id, label):
    df = spark.createDataFrame([(image_id,)], "image_id string")
    assert df.select(C.subject_label("image_id")).head()[0] == label


def test_unknown_class_fails(spark):
    rows = spark.createDataFrame([("cup/1.jpg",)], "image_id string")
    splits = spark.createDataFrame([("jar", "train")], "class string, split string")
    with pytest.raises(Exception, match="no split is known"):
        joins.join_split(rows, splits).collect()


def test_test_split_needs_opt_in(spark):
    rows = spark.createDataFrame([("cup/1.jpg",)], "image_id string")
    splits = spark.createDataFrame([("cup", "test")], "class string, split string")
    with pytest.raises(ValueError):
        joins.filter_split(rows, splits, "test")
    assert joins.filter_split(rows, splits, "test", allow_test=True).count() == 1


def test_splits_are_half_even_and_disjoint(spark):
    classes = spark.createDataFrame([(f"c{i}",) for i in range(25)], "class string")
    rows = sampling.assign_class_splits(classes, 1).collect()
    counts = {s: sum(r["split"] == s for r in rows) for s in ("train", "dev", "test")}
    assert counts == {"train": 18, "dev": 4, "test": 3}
    assert len({r["class"] for r in rows}) == 25


def test_sample_ignores_input_order(spark):
    ids = [f"img{i}" for i in range(20)]
    one = spark.createDataFrame([(i,) for i in ids], "image_id string")
    two = spark.createDataFrame([(i,) for i in reversed(ids)], "image_id string").repartition(3)
    picked = [sorted(r[0] for r in sampling.hash_priority_sample(d, 7, 42).collect()) for d in (one, two)]
    assert picked[0] == picked[1] and len(picked[0]) == 7
    assert sampling.hash_priority_sample(one, 0, 42).count() == 20


def test_sample_by_a_hash_bound(spark):
    ids = [f"img{i}" for i in range(5000)] + ["twice"] * 3 + [None]
    rows = spark.createDataFrame([(i,) for i in ids], "image_id string")
    order = sorted((i for i in ids if i), key=lambda i: hashlib.sha256(f"7\0{i}".encode()).hexdigest())
    for limit in (1, 40, 4000, 6000):
        got = sorted(str(r[0]) for r in sampling.hash_priority_sample(rows, limit, 7).collect())
        assert got == sorted([*order[:limit - 1], "None"])
    hot = spark.createDataFrame([("one",)] * 900 + [("two",)] * 900, "image_id string")
    assert sampling.hash_priority_sample(hot, 10, 7).distinct().count() == 1


def test_rollout_eligibility_and_schedule(spark):
    images = spark.createDataFrame([(1, [0]), (2, [0, 1]), (3, [0, 1, 2, 3])],
                                   "image_id int, concepts array<int>")
    schedule = sampling.rollout_schedule([1, 2, 4], 2, {2: 3, 4: 5})
    rollouts = sampling.concept_rollouts(images, 20, schedule, 5)
    got = {r["size"]: (r["images"], r["queries"]) for r in sampling.rollout_counts(rollouts, schedule).collect()}
    assert got == {1: (3, 6), 2: (2, 6), 4: (1, 5)}
    for row in rollouts.collect():
        own = {1: {0}, 2: {0, 1}, 3: {0, 1, 2, 3}}[row["image_id"]]
        assert len(set(row["seq"])) == len(row["seq"])
        assert set(row["seq"]) <= own if row["kind"] == "true" else not set(row["seq"]) & own


def test_too_few_lacking_concepts_fail(spark):
    images = spark.createDataFrame([(1, [0, 1])], "image_id int, concepts array<int>")
    with pytest.raises(Exception, match="lacks too few"):
        sampling.concept_rollouts(images, 3, {1: 1, 2: 1}, 0).collect()


def test_schedule_rejects_unknown_sizes():
    with pytest.raises(ValueError):
        sampling.rollout_schedule([1, 2], 2, {3: 1})


def test_captions_last_wins_and_default(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "image_id string")
    captions = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("a", "", 3)],
                                     "image_id string, caption string, pos int")
    got = {r["image_id"]: r["caption"] for r in joins.caption_or_default(ids, captions, C.BASE_TEXT).collect()}
    assert got == {"a": "last", "b": "an object"}


def test_resume_counts_only_successes(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    log = spark.createDataFrame([("a", "ok", ["x"]), ("b", "error", None), ("c", "ok", [])],
                                "image_id string, status string, present array<string>")
    assert {r[0] for r in joins.resume_anti(work, log, status="ok").collect()} == {"b"}
    assert {r[0] for r in joins.resume_anti(work, log, status="ok", field="present").collect()} == {"b", "c"}


def test_manifest_diff_uses_defaults(spark):
    a = spark.createDataFrame([("p", "1"), ("q", None)], "key string, value string")
    b = spark.createDataFrame([("p", "1"), ("q", None), ("new", "x")], "key string, value string")
    assert joins.manifest_diff(a, b, defaults={"new": "x"}).count() == 0
    assert [r["key"] for r in joins.manifest_diff(a, b).collect()] == ["new"]


def test_edge_decision_contract(spark):
    edges = spark.createDataFrame([("e0", "a", "b", .9), ("e1", "a", "c", .8), ("e2", "b", "z", .7)],
                                  "edge_id string, left string, right string, text_cosine double")
    decisions = spark.createDataFrame([("e0", True), ("e1", False), ("e1", True), ("e9", True)],
                                      "edge_id string, equivalent boolean")
    phrases = spark.createDataFrame([("a",), ("b",), ("c",)], "phrase string")
    accepted, bad = joins.apply_edge_decisions(edges, decisions, phrases, weighted=True)
    assert [(r["edge_id"], r["weight"]) for r in accepted.collect()] == [("e0", .9)]
    assert {tuple(r) for r in bad.collect()} == {
        ("e1", "decided_twice"), ("e2", "undecided"), ("e9", "unknown_edge"), ("e2", "unbound_phrase")}


def test_violations_need_ids_and_ends_only(spark):
    edges = spark.createDataFrame([("e0", "a", "b"), ("e1", "y", "z"), ("e2", "b", "z")],
                                  "edge_id string, left string, right string")
    decisions = spark.createDataFrame([("e0", True), ("e1", True), ("e2", False)], "edge_id string, equivalent boolean")
    phrases = spark.createDataFrame([("a",), ("b",)], "phrase string")
    bad = joins.edge_decision_violations(edges, decisions, phrases)
    assert sorted(map(tuple, bad.collect())) == [("e1", "unbound_phrase"), ("e2", "unbound_phrase")]
    accepted = joins.accepted_edges(edges, decisions, weighted=False)
    assert sorted(map(tuple, accepted.collect())) == [("e0", "a", "b", 1.0), ("e1", "y", "z", 1.0)]


def test_frequency_report_orders(spark):
    stats = support.attribute_statistics(support.tag_mentions(spark.createDataFrame(ROWS, TAGS)))
    assert [r["attribute"] for r in support.frequency_report(stats, sort="name").collect()] == ["red", "round"]
    assert [r["attribute"] for r in support.frequency_report(stats, "RO ").collect()] == ["round"]
    assert stats.where(F.col("rank") == 1).head()["attribute"] == "round"


def test_phrases_without_singular_stay_out_of_the_join(spark):
    """A hash join sends all null keys to one task; only phrases that end like plurals may be joined."""
    words = [f"w{i}x" for i in range(3000)] + ["cities", "city", "dogs", "dog", "glass", "buss", "ties", "tie", None]
    plan = support.lexical_variant_key(spark.createDataFrame([(w,) for w in words], "phrase string"))
    got = {r["phrase"]: r["variant_key"] for r in plan.collect()}
    assert len(got) == len(words) == plan.count()
    assert {w: got[w] for w in ("cities", "dogs", "glass", "buss", "ties", "w7x", None)} == {
        "cities": "city", "dogs": "dog", "glass": "glass", "buss": "buss", "ties": "tie", "w7x": "w7x", None: None}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "outer=true" not in text and "LeftOuter" not in text


def test_cluster_support_deals_out_clusters_of_several_phrases_only(spark):
    mentions = spark.createDataFrame([("a/1", "a", "x"), ("a/1", "a", "y"), ("b/2", "b", "y"), ("a/1", "a", "z"), ("b/3", "b", "z")],
                                     "image_id string, class string, phrase string")
    clusters = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", "z")], "phrase string, cluster string")
    found = support.cluster_support(mentions, clusters)
    got = {r["cluster"]: (r["mentions"], r["class_support"]) for r in found.collect()}
    assert got == {"x": (2, 2), "z": (2, 2)}
    # The mentions of single phrases go to their counts without a distinct.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "(_size#" in plan and "= 1)" in plan
