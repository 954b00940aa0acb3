"""Writers: split routing, success/error routing and ordered, committed output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.operators.joins import join_split


def partition_by_split(rows: DataFrame, splits: DataFrame, path: str) -> DataFrame:
    """Write tag rows into one folder per split and return the counts read from the output."""
    routed = join_split(rows, splits)
    routed.write.mode("overwrite").partitionBy("split").parquet(path)
    written = rows.sparkSession.read.parquet(path)
    return written.groupBy("split").agg(F.count("*").alias("rows"))


def route_ok_error(rows: DataFrame, path: str) -> None:
    """Successes and failures in one write: the status becomes the folder (ok / error)."""
    kind = F.when(F.col("status") == "ok", "ok").otherwise("error")
    rows.withColumn("outcome", kind).write.mode("append").partitionBy("outcome").json(path)


def read_routed(spark, path: str, schema, outcome: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/outcome={outcome}")


def manifest_order(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows in manifest order; ``pos`` stays as a column, since files have no order."""
    return rows.join(manifest.select("pos", "image_id"), "image_id").orderBy("pos")


def sink_atomic(rows: DataFrame, path: str, order: Sequence[str] = ("pos",),
                fmt: str = "parquet") -> DataFrame:
    """Replace an output; Spark's commit protocol publishes it only when every task is done."""
    rows.orderBy(*order).write.mode("overwrite").format(fmt).save(path)
    return rows.sparkSession.read.format(fmt).schema(rows.schema).load(path)
