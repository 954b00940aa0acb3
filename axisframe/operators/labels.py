"""Diagnostics of tri-state labels. Absence of a concept means a definite no."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.functions.columns import literal_array
from axisframe.operators.contracts import duplicate_ids
from axisframe.operators.scalars import with_row


def query_concepts(rows: DataFrame, field: str = "present") -> tuple[DataFrame, DataFrame]:
    """Rows with a non-empty label list as ``query_concepts``, and ids that occur twice."""
    kept = rows.where(F.size(field) > 0).withColumn("query_concepts", F.col(field))
    return kept, duplicate_ids(kept)


def concept_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(name, present, uncertain)`` for every dictionary name, also those never used."""
    states = rows.select(F.explode(F.concat(
        F.transform("present", lambda n: F.struct(n.alias("name"), F.lit(1).alias("p"),
                                                  F.lit(0).alias("u"))),
        F.transform("uncertain", lambda n: F.struct(n.alias("name"), F.lit(0).alias("p"),
                                                    F.lit(1).alias("u"))))).alias("s")).select("s.*")
    used = states.groupBy("name").agg(F.sum("p").alias("present"), F.sum("u").alias("uncertain"))
    spark = rows.sparkSession
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    return listed.join(used, "name", "left").na.fill(0, ["present", "uncertain"])


def label_diagnostics(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows, concepts, positive and uncertain rate, fewest positives and definite labels."""
    per = concept_counts(rows, names)
    cells = F.first("rows") * F.count("*")
    return with_row(per, rows.agg(F.count("*").alias("rows"))).agg(
        F.first("rows").alias("rows"), F.count("*").alias("concepts"),
        (F.sum("present") / cells).alias("positive_rate"),
        (F.sum("uncertain") / cells).alias("uncertain_rate"),
        F.min("present").alias("min_positives"),
        F.min(F.col("rows") - F.col("uncertain")).alias("min_definite"))


def labels_per_image_stats(rows: DataFrame, field: str = "present") -> DataFrame:
    """Fewest, mean, median and most labels per image."""
    # A count is at most the dictionary size, so the exact median keeps few distinct values.
    counts = rows.select(F.size(field).cast("long").alias("n"))
    return counts.agg(F.count("*").alias("images"), F.min("n").alias("min"),
                      F.avg("n").alias("mean"), F.expr("percentile(n, 0.5)").alias("median"),
                      F.max("n").alias("max"))


def concept_usage_audit(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per concept: is it ever present, or ever present or uncertain?"""
    return concept_counts(rows, names).select(
        "name", "present", "uncertain", (F.col("present") == 0).alias("never_present"),
        (F.col("present") + F.col("uncertain") == 0).alias("never_used"))


def present_by_split(rows: DataFrame) -> DataFrame:
    """Mean present and uncertain labels per image by split."""
    return rows.groupBy("split").agg(
        F.count("*").alias("images"), F.avg(F.size("present")).alias("mean_present"),
        F.avg(F.size("uncertain")).alias("mean_uncertain"),
        F.min(F.size("present")).cast("long").alias("min_present"),
        F.max(F.size("present")).cast("long").alias("max_present"))


def to_indexes(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``present_idx`` and ``uncertain_idx`` in dictionary order."""
    listed = literal_array(names)

    def index(field: str):
        return F.transform(F.array_distinct(field), lambda n: (
            F.array_position(listed, n) - 1).cast("int"))

    return rows.withColumn("present_idx", index("present")).withColumn(
        "uncertain_idx", index("uncertain"))
