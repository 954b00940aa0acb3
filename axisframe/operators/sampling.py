"""Seeded splits, samples and concept rollouts. Every order is a SHA-256 priority."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.functions.columns import hash_priority
from axisframe.operators.ranking import ranked
from axisframe.session import discard, materialize

#: A bound on a hash is one of so many: its first eight hexadecimal digits.
_BOUNDS = 1 << 32


def assign_class_splits(classes: DataFrame, seed: int, train: float = 0.70, dev: float = 0.15
                        ) -> DataFrame:
    """``(class, split)``: classes in hash order, cut at the half-even rounded fractions."""
    if train <= 0 or dev <= 0 or train + dev >= 1:
        raise ValueError("fractions must be positive and leave a test split")
    names = classes.select("class").distinct()
    placed = ranked(names, [hash_priority(seed, "class"), "class"])
    size = names.agg(F.bround(F.count("*") * F.lit(train)).cast("long").alias("n_train"),
                     F.bround(F.count("*") * F.lit(dev)).cast("long").alias("n_dev"))
    cuts = size.collect()[0]
    split = (F.when(F.col("rank") <= cuts["n_train"], "train")
             .when(F.col("rank") <= cuts["n_train"] + cuts["n_dev"], "dev").otherwise("test"))
    return placed.select("class", split.alias("split"))


def split_counts(images: DataFrame) -> DataFrame:
    """Classes and images per split; input ``(image_id, class, split)``."""
    per_class = images.groupBy("split", "class").agg(F.count("*").alias("n"))
    return per_class.groupBy("split").agg(F.count("*").alias("classes"),
                                          F.sum("n").alias("images"))


def hash_priority_sample(rows: DataFrame, limit: int, seed: int, key: str = "image_id"
                         ) -> DataFrame:
    """The ``limit`` rows of smallest SHA-256(seed NUL id); a limit <= 0 means all rows.

    Hashes are even, so a bound on them leaves little more than the sample; it is doubled until it leaves
    enough. Places come from a range sort, so a large sample stays spread over its tasks.
    """
    if limit <= 0:
        return rows
    priority = hash_priority(seed, key, sep="\0")
    total = rows.count()
    bound = math.ceil((limit + 8 * math.sqrt(limit) + 32) / max(total, 1) * _BOUNDS)
    near = rows
    while bound < _BOUNDS:
        near = materialize(rows.where(priority.isNull() | (F.substring(priority, 1, 8) < f"{bound:08x}")))
        if near.count() >= limit:
            break
        discard(near)
        near, bound = rows, 2 * bound
    placed = ranked(near, [priority, key], name="_place")
    return placed.where(F.col("_place") <= limit).drop("_place")


def seeded_shuffle_limit(rows: DataFrame, limit: int, seed: int, key: str = "image_id",
                         name: str = "pos") -> DataFrame:
    """Rows with their position in a seeded shuffle, cut after the first ``limit``."""
    placed = ranked(rows, [hash_priority(seed, key, sep="\0"), key], name=name, start=0)
    return placed.where(F.col(name) < limit) if limit > 0 else placed


def rollout_schedule(sizes: Sequence[int], default: int,
                     overrides: Mapping[int, int] | None = None) -> dict[int, int]:
    """Rollouts per query size; an override must name a known size."""
    if not sizes or min(sizes) < 1 or default < 1:
        raise ValueError("sizes and rollouts must be positive")
    schedule = {size: default for size in sorted(set(sizes))}
    for size, rollouts in (overrides or {}).items():
        if size not in schedule or rollouts < 1:
            raise ValueError(f"size {size} cannot have {rollouts} rollouts")
        schedule[size] = rollouts
    return schedule


def concept_rollouts(images: DataFrame, n_concepts: int, schedule: Mapping[int, int], seed: int,
                     short_draws: bool = False) -> DataFrame:
    """``(image_id, rollout, kind, length, seq)``: nested true and random concept sequences.

    ``images`` is ``(image_id, concepts)`` with distinct concept indexes. An image is eligible
    if it has the smallest size; its random sequence draws from the concepts it lacks. One that lacks
    fewer than the largest size is an error, or with ``short_draws`` draws all it lacks, and has no
    random sequence if it lacks none. The order is made inside the row, so nothing is shuffled.
    """
    smallest, largest = min(schedule), max(schedule)
    rollouts = max(schedule.values())
    eligible = images.where(F.size("concepts") >= smallest)
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(n_concepts - 1)), F.col("concepts"))
    rows = eligible.select(
        "image_id", F.col("concepts").cast("array<int>").alias("concepts"),
        lacking.alias("lacking"),
        F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1))).alias("rollout"))

    def permuted(items: str):
        keyed = F.transform(items, lambda c: F.struct(
            hash_priority(seed, F.col("image_id"), F.col("rollout"), c).alias("h"),
            c.alias("c")))
        return F.slice(F.transform(F.array_sort(keyed), lambda s: s["c"]), 1, largest)

    drawn = permuted("lacking")
    if not short_draws:
        drawn = F.when(F.size("lacking") >= largest, drawn).otherwise(
            F.raise_error(F.lit("an image lacks too few concepts for a random draw"))
            .cast("array<int>"))
    both = rows.select("image_id", "rollout", F.explode(F.array(
        F.struct(F.lit("true").alias("kind"), permuted("concepts").alias("seq")),
        F.struct(F.lit("random").alias("kind"), drawn.alias("seq")))).alias("s"),
        F.least(F.size("concepts"), F.lit(largest)).alias("length"))
    found = both.select("image_id", "rollout", "s.kind", "length", "s.seq")
    return found.where(F.size("seq") > 0) if short_draws else found


def rollout_counts(rollouts: DataFrame, schedule: Mapping[int, int]) -> DataFrame:
    """Eligible images and queries per size."""
    sized = with_sizes(rollouts.where(F.col("kind") == "true"), schedule)
    per_image = sized.groupBy("size", "image_id").agg(F.count("*").alias("n"))
    return per_image.groupBy("size").agg(F.count("*").alias("images"), F.sum("n").alias("queries"))


def with_sizes(rollouts: DataFrame, schedule: Mapping[int, int]) -> DataFrame:
    """One row per valid (rollout, size): long enough and within the size's rollouts."""
    pairs = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(count).alias("allowed"))
                      for size, count in sorted(schedule.items())])
    return (rollouts.withColumn("_s", F.explode(pairs))
            .where((F.col("length") >= F.col("_s.size")) & (F.col("rollout") < F.col("_s.allowed")))
            .withColumn("size", F.col("_s.size")).drop("_s"))
