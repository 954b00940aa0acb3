"""Totals next to rows, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery.

    More than one row in ``row`` fails the job.
    """
    packed = row.select(F.struct(*row.columns).alias("_row")).scalar()
    return df.withColumn("_row", packed).select(
        *df.columns, *[F.col(f"_row.{name}").alias(name) for name in row.columns])
