"""Exact top-k by integer inner product with MaxScore.

A dimension is a query term, the rows of a piece with a component other than zero are its postings,
and the largest product within the piece bounds what the term can add. Terms whose bounds together
cannot exceed the current k-th score are non-essential: a row found in their postings only cannot enter
the result. Only essential postings are traversed; the other terms are probed, largest bound first,
for rows that can still compete. Shards are merged at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and of a query block that one task holds at most.
MOST_ROWS = 500_000
#: A term with more than this share of a piece's rows keeps its postings as a whole column.
FULL_SHARE = 0.25


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """``(row, id, vec)``: floor(scale * x) of every component, as whole numbers in doubles.

    Rows with a null key or vector, or with null or non-finite components, take no part; any finite
    size does. Rows with the same key stay separate rows, told apart by ``row``, which is fixed once the
    result has been written (``materialize``). Vectors may be empty or of unequal length: a missing
    component counts as zero.
    """
    parts = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    if df.schema[vector].dataType.elementType.typeName() in {"float", "double"}:
        # Spark's floor gives 64-bit integers; a double beyond 2^52 is whole already.
        parts = F.transform(F.col(vector), lambda x: F.when(
            F.abs(x.cast("double")) * scale < float(1 << 52), F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
            .otherwise(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall(F.col(vector), lambda x: F.coalesce(
        F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound)
            .select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
                    parts.cast("array<double>").alias("vec")))


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix, short rows filled with zeros."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)
    out[row, at] = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    return out


def _exactly(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers as floats, 64-bit integers or Python integers: what holds every sum exactly."""
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


def _number(queries: np.ndarray, vectors: np.ndarray) -> tuple[type, float]:
    """The narrowest kind of number that holds all scores and bounds, and its least value."""
    most = float(np.abs(queries).sum(1).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    if most < 1 << 53:
        return np.float64, -np.inf
    return (np.int64, np.iinfo(np.int64).min) if most < 1 << 62 else (object, -math.inf)


def _merge(best: tuple[np.ndarray, ...], found: tuple[np.ndarray, ...], rows: int, k: int, least: float
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among two lists of (query, score, id), and each query's k-th score."""
    q, score, ids = (np.concatenate(x) for x in zip(best, found, strict=True))
    _, level = np.unique(score, return_inverse=True)
    order = np.lexsort((ids, -level, q))
    q, score, ids = q[order], score[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    floor = np.full(rows, least, score.dtype)
    last = rank == k - 1
    floor[q[last]] = score[last]
    return q[keep], score[keep], ids[keep], floor


class Postings:
    """The postings of a piece's terms: whole columns of common terms, row lists of rare ones."""

    def __init__(self, vectors: np.ndarray):
        self.columns = np.ascontiguousarray(vectors.T)
        filled = self.columns != 0
        self.sizes = filled.sum(1)
        self.full = self.sizes > FULL_SHARE * len(vectors)
        self.rows = {t: np.flatnonzero(filled[t]) for t in np.flatnonzero(~self.full)}

    def traverse(self, q: np.ndarray, essential: np.ndarray) -> tuple[np.ndarray, int]:
        """What each query's essential terms give every row, and how many products that took."""
        essential = essential & (q != 0)
        score = np.zeros((len(q), self.columns.shape[1]), q.dtype)
        cells = 0
        # queries with the same essential terms go together
        sets, which = np.unique(essential & self.full, axis=0, return_inverse=True)
        which = which.ravel()
        for i, wanted in enumerate(sets):
            terms, ours = np.flatnonzero(wanted), np.flatnonzero(which == i)
            if len(terms):
                score[ours] = q[np.ix_(ours, terms)] @ self.columns[terms]
                cells += len(ours) * len(terms) * self.columns.shape[1]
        for term, rows in self.rows.items():
            ours = np.flatnonzero(essential[:, term])
            if len(ours) and len(rows):
                score[np.ix_(ours, rows)] += np.outer(q[ours, term], self.columns[term, rows])
                cells += len(ours) * len(rows)
        return score, cells


def maxscore(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
             piece: int = 2048, block: int = 256, probe: int = 8, rows: np.ndarray | None = None,
             work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of each query's k best rows of one shard, its own row left out.

    ``query_ids`` name the queries among ``rows``, the names of the vectors (their ids by default). Rows
    are walked by growing id, so a later row must beat the k-th score to enter. The numbers of products
    made are added to ``work``.
    """
    order = np.argsort(ids, kind="stable")
    rows = (ids if rows is None else rows)[order]
    vectors, ids = vectors[order], ids[order]
    out = []
    for first in range(0, len(queries), block):
        q, own = queries[first:first + block], query_ids[first:first + block]
        kind, least = _number(q, vectors)
        q = _exactly(q, kind)
        n, dims = q.shape
        best = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))
        floor = np.full(n, least, kind)
        for start in range(0, len(vectors), piece):
            v = _exactly(vectors[start:start + piece], kind)
            names = rows[start:start + piece]
            bound = np.maximum(np.maximum(q * v.max(0), q * v.min(0)), 0)
            by_bound = np.argsort(bound, axis=1, kind="stable")
            total = np.cumsum(np.take_along_axis(bound, by_bound, 1), axis=1)
            spare = (total <= floor[:, None]).sum(1)  # that many terms of smallest bound
            spared = np.zeros((n, dims), bool)
            np.put_along_axis(spared, by_bound, np.arange(dims) < spare[:, None], 1)
            score, cells = Postings(v).traverse(q, ~spared)
            # what non-essential terms can add: their bounds, or the product of the norms
            rest = np.take_along_axis(total, np.maximum(spare - 1, 0)[:, None], 1)
            rest[spare == 0] = 0
            if kind is np.float64:
                norm = np.sqrt((np.where(spared, q, 0) ** 2).sum(1))[:, None] * np.sqrt((v ** 2).sum(1))
                rest = np.minimum(rest, norm * (1 + 1e-9) + 1e-6)
            able = (score + rest > floor[:, None]) & (own[:, None] != names)
            if (floor == least).any() and len(v) > k:
                exact = np.where(able & (spare == 0)[:, None], score, least)
                at = len(v) - k
                kth = (np.sort(exact, axis=1) if kind is object else np.partition(exact, at, axis=1))[:, [at]]
                able &= (spare > 0)[:, None] | (score >= kth)
            qi, vi = np.nonzero(able)
            value, left = score[qi, vi], spare[qi]
            while left.any():
                cells += int(np.minimum(left, probe).sum())
                at = left[:, None] - 1 - np.arange(probe)
                dim = np.where(at >= 0, by_bound[qi[:, None], np.maximum(at, 0)], 0)
                value = value + np.where(at >= 0, q[qi[:, None], dim] * v[vi[:, None], dim], 0).sum(1)
                left = np.maximum(left - probe, 0)
                most = np.where(left > 0, total[qi, np.maximum(left - 1, 0)], 0)
                stay = (value + most > floor[qi]).astype(bool)
                qi, vi, value, left = qi[stay], vi[stay], value[stay], left[stay]
            if work is not None:
                work.append(cells)
            best_q, best_s, best_i, floor = _merge(best, (qi, value, ids[start:start + piece][vi]), n, k, least)
            best = best_q, best_s, best_i
        out.append((own[best[0]], best[2], best[1].astype(np.int64)))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
    return parts[0].astype(np.int64), parts[1].astype(np.int64), parts[2].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best ``vectors`` of every query, exactly.

    Both sides are ``(row, id, vec)`` as ``integer_vectors`` makes them, written once so that ``row`` is
    fixed. Shards and query blocks form a grid with a side of about the root of the number of tasks (more
    only when a block would exceed ``MOST_ROWS``), so the copies of a row do not grow with the table. A
    query leaves its own row out; another row of the same id is a candidate, and a query of its own. Equal
    scores are taken by smaller id; with fewer rows than ``k`` all are returned, and an empty side gives no
    rows. Scores are exact integers; one that no 64-bit integer holds fails the job.
    """
    spark = vectors.sparkSession
    sizes, asked = (side.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("w")).head() for side in (vectors, queries))
    width = max(sizes["w"] or 0, asked["w"] or 0, 1)
    side = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    shards = max(side, math.ceil(sizes["n"] / MOST_ROWS))
    blocks = max(side, math.ceil(asked["n"] / MOST_ROWS))

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, v, s = maxscore(dense(left.column("vec"), width), left.column("row").to_numpy(),
                               dense(right.column("vec"), width), right.column("id").to_numpy(), k,
                               rows=right.column("row").to_numpy())
        else:
            q = v = s = np.zeros(0, np.int64)
        return pa.table({"row": q, "vec_id": v, "score": s})

    left = (queries.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
            .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = (vectors.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    found = (left.groupBy("s", "b").cogroup(right.groupBy("s", "b"))
             .applyInArrow(tile, "row long, vec_id long, score long"))
    place = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.join(queries.select("row", F.col("id").alias("query_id")), "row").select(
        "query_id", "rank", "vec_id", "score")
