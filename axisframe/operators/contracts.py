"""Dataset contracts: each check is a table of violations, and ``require_empty`` makes it fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.functions.columns import image_class, literal_array
from axisframe.operators.joins import join_split, manifest_diff
from axisframe.operators.scalars import with_row
from axisframe.session import materialize


class ContractError(ValueError):
    """A dataset broke a contract; the message shows some of the violations."""


def require_empty(violations: DataFrame, what: str) -> None:
    sample = violations.limit(5).collect()
    if sample:
        raise ContractError(f"{what}: {[row.asDict() for row in sample]}")


def duplicate_ids(rows: DataFrame, key: str = "image_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("uses")).where(F.col("uses") > 1)


def coverage_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row ``(missing, extra)`` of distinct ids."""
    a = actual.select("image_id").distinct().withColumn("_a", F.lit(1))
    e = expected.select("image_id").distinct().withColumn("_e", F.lit(1))
    both = a.join(e, "image_id", "full_outer")
    return both.agg(F.count(F.when(F.col("_a").isNull(), 1)).alias("missing"),
                    F.count(F.when(F.col("_e").isNull(), 1)).alias("extra"))


def _rule(name: str, condition: Column, detail: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(True)),
                  F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))


def _violations(rows: DataFrame, rules: Sequence[Column], *keep: str) -> DataFrame:
    broken = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return rows.select(*keep, F.explode(broken).alias("_v")).select(*keep, "_v.rule", "_v.detail")


def label_rules(names: Sequence[str]) -> list[Column]:
    """Sparse-label rules of one row; ``names`` is the fixed dictionary."""
    canon = literal_array(names)
    present, uncertain = F.col("present"), F.col("uncertain")
    unknown = F.array_sort(F.array_except(F.array_union(present, uncertain), canon))
    overlap = F.array_sort(F.array_intersect(present, uncertain))
    lists = present.isNotNull() & uncertain.isNotNull()
    return [
        _rule("invalid_lists", ~lists, F.lit("")),
        _rule("unknown_name", lists & (F.size(unknown) > 0), F.array_join(unknown, ",")),
        _rule("overlap", lists & (F.size(overlap) > 0), F.array_join(overlap, ",")),
    ]


def validate_label_rows(rows: DataFrame, names: Sequence[str], *, strict: bool = False
                        ) -> DataFrame:
    """``(image_id, rule, detail)``; the strict form also demands a final boolean row."""
    rules = label_rules(names)
    if strict:
        present, uncertain = F.col("present"), F.col("uncertain")
        repeated = F.size(present) != F.size(F.array_distinct(present))
        rules += [
            _rule("not_final", ~F.col("status").eqNullSafe("ok"),
                  F.coalesce("status", F.lit(""))),
            _rule("uncertain", F.coalesce(F.size(uncertain), F.lit(0)) > 0,
                  F.array_join(F.array_sort(uncertain), ",")),
            _rule("repeated_positive", present.isNotNull() & repeated, F.lit("")),
        ]
    return _violations(rows, rules, "image_id")


def merge_label_shards(shards: DataFrame, names: Sequence[str], manifest: DataFrame,
                       splits: DataFrame, split: str, *, allow_test: bool = False
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged rows in manifest order, all violations, and the row count of each shard.

    ``shards`` is the union of the shard tables with a ``source`` column; ``manifest`` is
    ``(pos, image_id)`` of unique ids; a repeated one is a violation and counts once. The merged
    rows fail when they are read while there are violations.
    """
    if split == "test" and not allow_test:
        raise ValueError("merging the test split requires allow_test=True")
    expected = (join_split(manifest, splits).where(F.col("split") == split)
                .select("pos", "image_id"))
    counts = shards.groupBy("source").agg(F.count("*").alias("rows"))
    per_row = _violations(
        shards, [_rule("non_success", ~F.col("status").eqNullSafe("ok"),
                       F.coalesce("status", F.lit(""))), *label_rules(names)], "image_id")
    repeated = duplicate_ids(shards).select(
        "image_id", F.lit("duplicate").alias("rule"), F.col("uses").cast("string").alias("detail"))
    ids = shards.select("image_id").distinct()
    outside = ids.join(expected, "image_id", "left_anti").select(
        "image_id", F.lit("outside_split").alias("rule"), F.lit("").alias("detail"))
    missing = expected.join(ids, "image_id", "left_anti").select(
        "image_id", F.lit("missing").alias("rule"), F.lit("").alias("detail"))
    twice = duplicate_ids(expected).select(
        "image_id", F.lit("listed_twice").alias("rule"), F.col("uses").cast("string").alias("detail"))
    violations = (per_row.unionByName(repeated).unionByName(outside).unionByName(missing).unionByName(twice))
    once = expected.groupBy("image_id").agg(F.min("pos").alias("pos"))
    broken = violations.select(F.lit(1).alias("_broken")).limit(1)
    checked = with_row(shards.join(once, "image_id"), broken.agg(F.count("*").alias("_broken")))
    merged = checked.withColumn("pos", F.when(F.col("_broken") == 0, F.col("pos")).otherwise(
        F.raise_error(F.lit("shards with violations cannot be merged")).cast("long"))).drop("_broken").orderBy("pos")
    return merged, violations, counts


def class_set_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """Classes covered by only one of two id sets, as ``(class, side)``; empty means equal."""
    a = left.select(image_class("image_id").alias("class")).distinct()
    b = right.select(image_class("image_id").alias("class")).distinct()
    return (a.join(b, "class", "left_anti").withColumn("side", F.lit("left"))
            .unionByName(b.join(a, "class", "left_anti").withColumn("side", F.lit("right"))))


def row_order_agreement(orders: DataFrame) -> DataFrame:
    """Positions at which named id orders disagree; ``orders`` is ``(name, pos, image_id)``."""
    names = orders.select("name").distinct().agg(F.count("*").alias("_names"))
    per = orders.groupBy("pos").agg(F.countDistinct("image_id").alias("ids"),
                                    F.count("*").alias("arrays"))
    wanted = names.collect()[0]["_names"]
    return per.where((F.col("ids") != 1) | (F.col("arrays") != wanted))


def shape_agreement(vectors: DataFrame) -> DataFrame:
    """Rows and dimensions by ``(encoder, role)`` and whether they agree as pairs need.

    All arrays must have equal row counts; an encoder's roles must share one dimension.
    """
    per = vectors.groupBy("encoder", "role").agg(
        F.count("*").alias("rows"), F.min(F.size("vector")).cast("long").alias("low"),
        F.max(F.size("vector")).cast("long").alias("high"))
    by_encoder = per.groupBy("encoder").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"))
    overall = per.agg(F.min("rows").alias("lo"), F.max("rows").alias("hi")).collect()[0]
    return per.join(by_encoder, "encoder").select(
        "encoder", "role", "rows", F.col("low").alias("min_dim"), F.col("high").alias("max_dim"),
        F.lit(overall["lo"] == overall["hi"]).alias("rows_agree"),
        (F.col("_low") == F.col("_high")).alias("dims_agree"))


def ordered_fingerprint(ids: DataFrame, chunk: int = 65_536, fan: int = 4096) -> DataFrame:
    """Digest tree over the ids in ``pos`` order, one definition for every length.

    SHA-256 cannot be merged, so a leaf is the digest of ``chunk`` ids and every level above that of
    ``fan`` digests, each id and digest followed by a newline; there is at least one such level.
    """
    def digest(place: str, value: str) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda s: s[value])
        return F.sha2(F.concat(F.array_join(parts, "\n"), F.lit("\n")), 256)

    leaves = materialize(ids.groupBy(F.floor(F.col("pos") / chunk).alias("at")).agg(
        digest("pos", "image_id").alias("d"), F.count("*").alias("n")))
    size = leaves.agg(F.sum("n").alias("ids"), F.count("*").alias("chunks"), F.max("at").alias("last")).head()
    level, last = leaves.select("at", "d"), size["last"] or 0
    while True:
        level = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(digest("at", "d").alias("d"))
        last //= fan
        if not last:
            break
    return level.select(F.lit(size["ids"]).cast("long").alias("ids"),
                        F.lit(size["chunks"]).cast("long").alias("chunks"), F.col("d").alias("sha256"))


def artifact_identity_check(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts whose checksum changed; declared but absent artifacts may be made again."""
    return (manifest_diff(declared.select(F.col("artifact").alias("key"),
                                          F.col("sha256").alias("value")),
                          actual.select(F.col("artifact").alias("key"),
                                        F.col("sha256").alias("value")))
            .where(F.col("actual").isNotNull())
            .select(F.col("key").alias("artifact"), "declared", "actual"))


def pairing_check(manifests: DataFrame) -> DataFrame:
    """Do an encoder's image and caption manifests agree? One row per encoder role.

    ``manifests`` is ``(role, side, encoder, precision, ids_sha256)``.
    """
    rows = manifests.select("ids_sha256").distinct().limit(2).collect()
    return manifests.groupBy("role").agg(
        (F.countDistinct("encoder") == 1).alias("same_encoder"),
        (F.countDistinct("precision") == 1).alias("same_precision"),
        F.lit(len(rows) == 1).alias("same_rows"))
