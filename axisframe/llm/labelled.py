"""Bounded samples of labelled rows for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % parts, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, key: str, label: str, held_out: Column,
           bounds: dict[int, int]) -> DataFrame:
    """Rows of ``docs`` with ``y``: at most ``bounds[v]`` keys of each label ``v``, by hash order.

    ``held_out`` is a condition on the key; those rows are never taken. Null labels and keys are left
    out, of several labels of one key the largest counts, of several rows the one of smallest hash. The
    keys are bounded by ``bounds``, so they are broadcast.
    """
    usable = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out)
              .groupBy(key).agg(F.max(label).cast("int").alias("y")))
    picked = None
    for value, bound in bounds.items():
        part = usable.where(F.col("y") == value).orderBy(F.xxhash64(key), key).limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    rest = [c for c in docs.columns if c != key]
    found = docs.join(F.broadcast(picked), key).groupBy(key, "y").agg(
        F.min(F.struct(F.xxhash64(*rest).alias("_hash"), *rest)).alias("_row"))
    return found.select(key, *[F.col("_row")[c].alias(c) for c in rest], "y")
