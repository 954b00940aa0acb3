"""Block products: the one physical pattern behind every all-against-all operator.

Each side is cut into blocks; a pair of blocks is one tile, and a tile is walked in bounded matrix
products inside a task. Only what the operator keeps (edges, counts, scores) leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.session import materialize

BLOCK_CELLS = 1 << 19
MAX_BLOCK_ROWS = 2048
#: Bytes of vectors that a task holds of one side of its tile at most.
BLOCK_BYTES = 128 << 20


def block_rows(width: int) -> int:
    """Rows per block so that a block holds about half a million numbers."""
    return max(64, min(MAX_BLOCK_ROWS, BLOCK_CELLS // max(1, width)))


def block_count(rows: int, width: int, at_least: int = 1) -> int:
    wanted = math.ceil(rows / block_rows(width))
    return max(1, wanted, min(at_least, math.ceil(rows / 64)))


def hashed_block(key: Column, blocks: int) -> Column:
    """Even blocks for a unique key, whatever the key looks like."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def tile_parallelism(df: DataFrame, tiles: int) -> int:
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               4 * spark.sparkContext.defaultParallelism)
    return max(1, min(tiles, most))


def cogroup_tiles(left: DataFrame, right: DataFrame, keys: Sequence[str], tiles: int,
                  fn: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str
                  ) -> DataFrame:
    """Run ``fn`` once per tile key. The partition count is fixed: tiles are small in bytes but
    heavy in arithmetic, so they must not be coalesced by size."""
    parts = tile_parallelism(left, tiles)
    # Both sides may come from one table; new aliases keep their columns apart.
    a, b = (side.select(*[F.col(c).alias(c) for c in side.columns]).repartition(parts, *keys)
            for side in (left, right))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(fn, schema)


def grid_side(tasks: int, rows: int, width: int) -> int:
    """Blocks of one side of a grid: about the root of the tasks, more only to bound a block's bytes."""
    return max(1, min(math.ceil(math.sqrt(tasks)), math.ceil(rows / 64)), math.ceil(rows * width * 8 / BLOCK_BYTES))


def in_pieces(fn: Callable[[pa.Table, pa.Table], pa.Table], rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``fn`` over pieces of ``rows`` rows of both sides: what a tile computes at once stays small."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows <= rows and b.num_rows <= rows:
            return fn(a, b)
        return pa.concat_tables([fn(a.slice(i, rows), b.slice(j, rows)) for i in range(0, max(a.num_rows, 1), rows)
                                 for j in range(0, max(b.num_rows, 1), rows)])
    return run


def cross_tiles(left: DataFrame, right: DataFrame, left_key: str, right_key: str, width: int,
                fn: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str,
                within: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Every left row meets every right row of the same ``within`` key in exactly one call of ``fn``.

    ``fn`` gets pieces of a tile, or with ``whole`` the tile, which it then has to walk in pieces itself.

    The grid has a fixed number of tiles for a given number of cores, so a row is copied as often
    in a large table as in a small one; a task walks its tile in small pieces. Both sides are
    written once, as they are counted before they are dealt out.
    """
    left, right = materialize(left), materialize(right)
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    lb, rb = grid_side(tasks, left.count(), width), grid_side(tasks, right.count(), width)
    a = (left.withColumn("_lb", hashed_block(F.col(left_key), lb))
         .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))))
    b = (right.withColumn("_rb", hashed_block(F.col(right_key), rb))
         .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(lb - 1)))))
    return cogroup_tiles(a, b, [*within, "_lb", "_rb"], lb * rb,
                         fn if whole else in_pieces(fn, block_rows(width)), schema)
