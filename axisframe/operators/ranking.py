"""Exact positions, running totals and percentiles that survive hot groups.

A plain ``row_number().over(partitionBy(g))`` sends a whole group to one task. Here the
rows are range-sorted by ``(group, order)``, so a hot group spans many partitions, and each
partition only needs the totals of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.functions.columns import any_of, col
from axisframe.operators.scalars import with_row
from axisframe.session import materialize

#: Rows of a slice that ``ranked_slices`` aims at, slices at most, and rows of the sample per slice.
SLICE_ROWS, MOST_SLICES, SAMPLED = 1 << 20, 256, 40


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on group keys in which a NULL group is a group like any other."""
    named = right.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(named, same).drop(*[f"_of_{k}" for k in keys])


def _sorted_slices(df: DataFrame, order: Sequence[Column], within: Sequence[str]) -> DataFrame:
    placed = (df.orderBy(*[F.col(c) for c in within], *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    # Range bounds are sampled anew on every run, so the slices must be fixed once.
    return materialize(placed).withColumn("_slice", F.shiftright("_at", 33))


def _before(slices: DataFrame, within: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    totals = slices.groupBy(*within, "_slice").agg(
        F.min("_at").alias("_first"),
        *[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()])
    window = (Window.partitionBy(*within).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(
        *within, "_slice", "_first",
        *[F.coalesce(F.sum(f"_sum_{name}").over(window), F.lit(0)).alias(f"_before_{name}")
          for name in sums])


def ranked(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (),
           name: str = "rank", start: int = 1) -> DataFrame:
    """``row_number`` over ``order`` (end it with a unique key), globally or per group."""
    order = [col(c) for c in order]
    slices = _sorted_slices(df.withColumn("_one", F.lit(1).cast("long")), order, within)
    # Written, the offsets have their real size: their join then leaves the rows where they are.
    offsets = materialize(_before(slices, within, {"rows": "_one"}))
    return (join_groups(slices, offsets, [*within, "_slice"])
            .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before_rows") + start)
            .select(*df.columns, name))


def _slice_of(row: Column, bounds: Sequence[Column], low: int = 0) -> Column:
    """How many of the sorted ``bounds`` are at or below a row, by halves."""
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(row < bounds[middle], _slice_of(row, bounds[:middle], low)).otherwise(
        _slice_of(row, bounds[middle + 1:], low + middle + 1))


def _cut(written: DataFrame, value: str, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """A written table with the ``_slice`` of each row, and how many slices there are.

    Slices lie between bounds from a sample, which only sets their sizes. Bounds include the keys, so that
    equal values spread over slices too.
    """
    spark = written.sparkSession
    fields = [(-F.col(value)).alias("v"), *[F.col(k) for k in keys]]
    n = written.count()
    parts = max(-(-n // SLICE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(parts, MOST_SLICES, n // SAMPLED))
    drawn = sorted(tuple(r) for r in written.sample(min(1.0, parts * SAMPLED / max(n, 1)), 7).select(*fields).collect())
    picked = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    kinds = [written.schema[c].dataType for c in (value, *keys)]
    bounds = [F.struct(*[F.lit(x).cast(kind).alias(f) for x, kind, f in zip(b, kinds, ["v", *keys], strict=True)])
              for b in picked]
    return written.withColumn("_slice", _slice_of(F.struct(*fields), bounds)), len(bounds) + 1


def ranked_slices(written: DataFrame, value: str, keys: Sequence[str], name: str = "rank", start: int = 1,
                  slice_name: str | None = None) -> DataFrame:
    """``row_number`` by a number, descending, then by unique keys, over a table that has been written.

    The rows travel once and are not written again: what stands before a slice is counted by a pass over
    the written table. With ``slice_name`` the rows keep their slice: steps that also group or join by it
    leave the rows where the ranking has put them.
    """
    sliced, slices = _cut(written, value, keys)
    sizes = {r["_slice"]: r["n"] for r in sliced.groupBy("_slice").agg(F.count("*").alias("n")).collect()}
    before = list(accumulate([start - 1, *[sizes.get(i, 0) for i in range(slices - 1)]]))
    within = Window.partitionBy("_slice").orderBy(F.col(value).desc(), *keys)
    ahead = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_slice") + 1)
    kept = [F.col("_slice").alias(slice_name)] if slice_name else []
    # Slices are small in bytes but dear to sort and to work on: their tasks must not be merged by size.
    return sliced.repartition(slices, "_slice").withColumn(name, F.row_number().over(within) + ahead).select(*written.columns, name, *kept)


def running_totals(df: DataFrame, order: Sequence[Column | str], within: Sequence[str],
                   sums: Mapping[str, str]) -> DataFrame:
    """Exclusive running sum of each source column: the total of all earlier rows."""
    order = [col(c) for c in order]
    slices = _sorted_slices(df, order, within)
    offsets = _before(slices, within, sums)
    window = (Window.partitionBy(*within, "_slice").orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = slices.select(
        "*", *[F.coalesce(F.sum(source).over(window), F.lit(0)).alias(f"_inside_{name}")
               for name, source in sums.items()])
    joined = join_groups(inside, offsets, [*within, "_slice"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_inside_{name}") + F.col(f"_before_{name}"))
    return joined.select(*df.columns, *sums)


def exact_percentiles(df: DataFrame, within: Sequence[str], value: str,
                      fractions: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated percentiles, exact for any group size.

    Equal values are merged before the sort, so a value held by a third of the rows is one row.
    """
    present = df.where(F.col(value).isNotNull())
    # Read by the sort and by the group sizes; the merged values are never more than the rows.
    counts = materialize(present.groupBy(*within, value).agg(F.count("*").alias("_n")))
    placed = running_totals(counts, [value], within, {"_start": "_n"})
    sizes = counts.groupBy(*within).agg(F.sum("_n").alias("_size"))
    joined = join_groups(placed, sizes, within) if within else with_row(placed, sizes)
    spots = {}
    for name, fraction in fractions.items():
        position = (F.col("_size") - 1) * F.lit(float(fraction))
        spots[name] = (position, F.floor(position), F.ceil(position))

    def covers(spot: Column) -> Column:
        return (spot >= F.col("_start")) & (spot < F.col("_start") + F.col("_n"))

    needed = joined.where(any_of(covers(s) for _, low, high in spots.values()
                                 for s in (low, high)))
    picked = needed.groupBy(*within).agg(
        F.first("_size").alias("_size"),
        *[F.max(F.when(covers(low), F.col(value))).alias(f"_low_{name}")
          for name, (_, low, _high) in spots.items()],
        *[F.max(F.when(covers(high), F.col(value))).alias(f"_high_{name}")
          for name, (_, _low, high) in spots.items()])
    return picked.select(
        *within,
        *[(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}"))
           * (position - low)).alias(name)
          for name, (position, low, _high) in spots.items()])
