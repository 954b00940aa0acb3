"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.session import discard, materialize



def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"),
                    F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)).alias("h")).head()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)``; a component is named by its smallest node.

    ``edges`` is ``(src, dst)``; ``nodes`` adds isolated nodes. Each round links every node's
    larger neighbours to its smallest one, then the same downwards, so paths shrink to stars in
    a logarithmic number of rounds. A hub is only ever a group of a ``min``: its neighbours are
    never gathered in one place, and AQE splits its join partition.
    """
    ends = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    if nodes is None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    nodes = nodes.select("node").distinct()
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    stars = materialize(ends.select(high.alias("src"), low.alias("dst")).distinct())
    seen = _fingerprint(stars)
    while True:
        if not seen[0]:
            break
        both = stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        nearest = both.groupBy("src").agg(F.min("dst").alias("m")).select(
            "src", F.least("src", "m").alias("m"))
        large = (both.join(nearest, "src").where(F.col("dst") > F.col("src"))
                 .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())
        lowest = large.groupBy("src").agg(F.min("dst").alias("m"))
        down = large.join(lowest, "src").where(F.col("dst") != F.col("m")).select(
            F.col("dst").alias("src"), F.col("m").alias("dst"))
        following = materialize(down.unionByName(lowest.withColumnRenamed("m", "dst")).distinct())
        now = _fingerprint(following)
        discard(stars)
        stars = following
        if now == seen:
            break
        seen = now
    return nodes.join(stars.withColumnRenamed("src", "node"), "node", "left").select(
        "node", F.coalesce("dst", "node").alias("component"))
