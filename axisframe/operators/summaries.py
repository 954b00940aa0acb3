"""Summaries over seeds, sweeps, runs and telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.functions.columns import image_class
from axisframe.operators.ranking import exact_percentiles, join_groups
from axisframe.session import materialize

# The query lengths whose recall the sweep averages, and the busy mark.
SWEEP_SIZES = (4, 8, 14)
BUSY_AT = 90.0


def seed_summary(metrics: DataFrame, by: Sequence[str] = ("family", "size"),
                 value: str = "value") -> DataFrame:
    """Mean and sample deviation over seeds; one seed has deviation 0."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("seeds"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sample_std"))


def cohort_sizes(ranks: DataFrame) -> DataFrame:
    """Distinct images per query length."""
    return (ranks.select("size", "image_id").distinct().groupBy("size")
            .agg(F.count("*").alias("images")))


def sweep_ranking(curves: DataFrame, sizes: Sequence[int] = SWEEP_SIZES) -> DataFrame:
    """Configs by their mean recall over the chosen lengths; input ``(config, size, recall)``."""
    wide = curves.groupBy("config").pivot("size", list(sizes)).agg(F.first("recall"))
    mean = sum((F.col(f"`{s}`") for s in sizes[1:]), F.col(f"`{sizes[0]}`")) / len(sizes)
    return wide.select("config", *[F.col(f"`{s}`").alias(f"recall_k{s}") for s in sizes],
                       mean.alias("mean_recall")).orderBy(F.col("mean_recall").desc(), "config")


def seed_paired_difference(metrics: DataFrame, a: str, b: str, critical: float) -> DataFrame:
    """Difference a - b of two objectives at equal size and seed: mean and t interval of each size.

    ``critical`` is the caller's t value for seeds - 1 degrees of freedom.
    """
    paired = metrics.where(F.col("family").isin(a, b)).groupBy("size", "seed").agg(
        F.max(F.when(F.col("family") == a, F.col("value"))).alias("a"),
        F.max(F.when(F.col("family") == b, F.col("value"))).alias("b"))
    d = paired.where("a is not null and b is not null").select(
        "size", (F.col("a") - F.col("b")).alias("d"))
    stats = d.groupBy("size").agg(F.count("*").alias("seeds"), F.avg("d").alias("mean_difference"),
                  F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sample_std"))
    half = F.lit(critical) * F.col("sample_std") / F.sqrt("seeds")
    return stats.select("*", (F.col("mean_difference") - half).alias("low"),
                        (F.col("mean_difference") + half).alias("high"))


def chart_series(summary: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Mean, deviation and cohort per family and size; families must share their cohorts.

    ``cohorts`` is ``(family, size, images)``; a mismatch fails the job.
    """
    agreed = cohorts.groupBy("size").agg(F.min("images").alias("lo"), F.max("images").alias("hi"))
    checked = agreed.select("size", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.raise_error(F.lit("families of one size were measured on different numbers of images")).cast("long")).alias("cohort"))
    return summary.join(checked, "size").select("family", "size", "mean", "sample_std", "cohort")


def telemetry_summary(samples: DataFrame, metric: str = "metric", value: str = "value"
                      ) -> DataFrame:
    """Mean, interpolated p50 and p95, maximum and busy share per metric."""
    moments = samples.where(F.col(value).isNotNull()).groupBy(metric).agg(
        F.count("*").alias("samples"), F.avg(value).alias("mean"), F.max(value).alias("max"),
        (100 * F.avg((F.col(value) >= BUSY_AT).cast("double"))).alias("busy_pct"))
    return join_groups(moments, exact_percentiles(samples, [metric], value, {"p50": .5, "p95": .95}), [metric])


def throughput_summary(rows: DataFrame, group: str = "run_id", at: str = "created_at") -> DataFrame:
    """Completed, failed and items per second of each run."""
    stamp = F.col(at).cast("timestamp").cast("double")
    seconds = F.max(stamp) - F.min(stamp)
    done = F.count(F.when(F.col("status") == "ok", 1))
    return rows.groupBy(group).agg(
        done.alias("completed"), (F.count("*") - done).alias("failed"), seconds.alias("seconds"),
        F.when(seconds > 0, F.count("*") / seconds).alias("items_per_second"))


def gallery_page(rows: DataFrame, limit: int) -> DataFrame:
    """First tagged rows by position."""
    return rows.where(F.size("attributes") > 0).orderBy("pos").limit(limit)


def diverse_examples(candidates: DataFrame, k: int, group: str = "name",
                     order: Sequence[str] = ("pos",)) -> DataFrame:
    """Per group: the first candidate of every class, then the rest in order, up to ``k``.

    At most ``k`` class leaders and ``k`` others can matter, and both are among the first ``k`` of their
    class: one pass over the candidates keeps those, by a limited window that starts in the tasks, so a
    hot concept never gathers in one task.
    """
    of_class = Window.partitionBy(group, "_class").orderBy("_key")
    rows = candidates.select(group, image_class("image_id").alias("_class"),
                             F.struct(*order, "image_id").alias("_key"))
    # Read twice below; no more rows than k for a group and class.
    first = materialize(rows.withColumn("_c", F.row_number().over(of_class)).where(F.col("_c") <= k))
    near = Window.partitionBy(group).orderBy("_key")
    leaders = (first.where(F.col("_c") == 1).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
               .select(group, "_key", F.lit(0).alias("_rest")))
    # The k first candidates include every other that can be used: fewer than k classes exist then.
    others = (first.select(group, "_key").withColumn("_n", F.row_number().over(near))
              .where(F.col("_n") <= k).select(group, "_key", F.lit(1).alias("_rest")))
    both = leaders.unionByName(others).groupBy(group, "_key").agg(F.min("_rest").alias("_rest"))
    place = Window.partitionBy(group).orderBy("_rest", "_key")
    return (both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
            .select(group, F.col("place").cast("long"), F.col("_key.image_id").alias("image_id")))
