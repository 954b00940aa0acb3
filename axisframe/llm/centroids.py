"""k-means over integer vectors by dictionaries of subvectors.

Vectors are kept as shards. In a shard each block of neighbouring dimensions has a dictionary of its
distinct subvectors, and a vector is one code a block: nothing is lost. A round measures every
dictionary entry against the centroids once; a vector's distance is the sum of its codes' entries, and
a cluster's sum is the sum of the entries weighted by how often its vectors hold them. All arithmetic
is on integers: 64-bit where the shard's values allow it, Python's own integers where they do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import forget, release_buffers
from axisframe.session import discard, materialize, spread

#: Vectors of a shard and dimensions of a block.
SHARD, BLOCK = 16_384, 2
#: Components below this size have 64-bit distances for any width up to 1,024.
FAST = 1 << 25
#: Sums leave a task as digits of this many bits, so that Spark can add any number of them.
DIGIT = 62


def integer_vectors(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """``(id, vec)``: vectors of exactly ``width`` finite components as whole numbers ``floor(scale * x)``.

    The numbers are held as doubles, which are exact for a scale that is a power of two. Null vectors,
    other widths, null and non-finite components are left out, as is a component whose scaled value no
    double can hold (beyond 1e305, not reachable from floats). A null key stays a row; so does a
    repeated one.
    """
    # From 2^52 on every double is whole, and floor would not fit a long.
    exact = F.transform(
        F.transform(F.col(vector), lambda x: x.cast("double") * scale),
        lambda x: F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(key).alias("id"), exact.alias("vec"))
            .where(F.col("vec").isNotNull() & (F.size("vec") == width) & sound))


def encode_shards(vectors: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per shard: its ids, and a dictionary with the codes of every block of dimensions."""
    kind = vectors.schema["id"].dataType.simpleString()

    def pack(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(rows)
        entries, codes = [], []
        for at in range(0, matrix.shape[1], block):
            # Adding zero makes one of the two zeros of doubles.
            part, code = np.unique(matrix[:, at:at + block] + 0.0, axis=0, return_inverse=True)
            entries.append(part.astype("<f8").tobytes())
            codes.append(code.reshape(-1).astype("<i4").tobytes())
        key = pa.concat_arrays(ids)
        lists = [pa.array([x], pa.list_(pa.binary())) for x in (entries, codes)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays([0, len(key)], key), *lists], ["ids", "entries", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                part = batch.slice(at, shard)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                held += part.num_rows
                if held >= shard:
                    yield pack(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield pack(ids, rows)
        release_buffers()

    return vectors.mapInArrow(run, f"ids array<{kind}>, entries array<binary>, codes array<binary>")


class Shard:
    """A shard as arrays; ``exact`` tells that values are Python integers."""

    def __init__(self, entries: list[bytes], codes: list[bytes], width: int, block: int, exact: bool):
        widths = [min(block, width - at) for at in range(0, width, block)]
        tables = [np.frombuffer(e, "<f8").reshape(-1, w) for e, w in zip(entries, widths, strict=True)]
        self.exact = exact or width > 1024 or max(np.abs(t).max() for t in tables) >= FAST
        self.tables = [np.array([[int(x) for x in row] for row in t], object) if self.exact else t.astype(np.int64)
                       for t in tables]
        self.codes = [np.frombuffer(c, "<i4") for c in codes]

    def nearest(self, centroids: list[list[int]], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every vector (ties: the smaller number) and the squared distance."""
        at, partial = 0, []
        for table in self.tables:
            near = np.array([c[at:at + table.shape[1]] for c in centroids], object if self.exact else np.int64)
            at += table.shape[1]
            partial.append(sum((table[:, None, j] - near[None, :, j]) ** 2 for j in range(table.shape[1])))
        chosen, least = [], []
        for start in range(0, len(self.codes[0]), step):
            total = sum(p[c[start:start + step]] for p, c in zip(partial, self.codes, strict=True))
            best = total.argmin(1)
            chosen.append(best)
            least.append(total[np.arange(len(best)), best])
        return np.concatenate(chosen), np.concatenate(least)

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """Vectors of each cluster and their componentwise sums, from how often a cluster holds each code."""
        out = []
        for table, code in zip(self.tables, self.codes, strict=True):
            held = np.bincount(cluster * len(table) + code, minlength=k * len(table)).reshape(k, -1)
            out.append((held.astype(object) if self.exact else held) @ table)
        return np.bincount(cluster, minlength=k), np.concatenate(out, axis=1).tolist()


def _shards(batch: pa.RecordBatch, width: int, block: int, exact: bool) -> Iterator[tuple[pa.Array, Shard]]:
    for i in range(batch.num_rows):
        yield (batch.column("ids")[i].values,
               Shard(batch.column("entries")[i].as_py(), batch.column("codes")[i].as_py(), width, block, exact))


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << DIGIT) - 1))
        value, place = value >> DIGIT, place + 1


def _updated(shards: DataFrame, centroids: list[list[int]], width: int, block: int) -> list[list[int]]:
    """The next centroids. The driver gets a few numbers per centroid and dimension, whatever the input."""
    k, large = len(centroids), max(abs(x) for c in centroids for x in c) >= FAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), [[0] * width for _ in range(k)]
        for batch in batches:
            for _, shard in _shards(batch, width, block, large):
                n, sums = shard.sums(shard.nearest(centroids)[0], k)
                count += n
                for c in np.flatnonzero(n):
                    total[c] = [a + b for a, b in zip(total[c], sums[c], strict=True)]
        rows = [(c, d, *digit) for c in np.flatnonzero(count).tolist()
                for d, value in enumerate([int(count[c]), *total[c]], -1) for digit in _digits(int(value))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
            ["c", "d", "place", "digit"])
        release_buffers()

    found = (shards.mapInArrow(run, "c int, d int, place int, digit long").groupBy("c", "d", "place")
             .agg(F.sum(F.col("digit").cast("decimal(20,0)")).alias("digit")).collect())
    sums = [[0] * (width + 1) for _ in range(k)]
    for r in found:
        sums[r["c"]][r["d"] + 1] += int(r["digit"]) << (DIGIT * r["place"])
    return [[s // n for s in rest] if n else old for (n, *rest), old in zip(sums, centroids, strict=True)]


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest SHA-256 of ``prefix`` and the id in decimal.

    Vectors with a null id are never taken; equal ids go by their components.
    """
    order = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    rows = (vectors.where(F.col("id").isNotNull()).withColumn("h", order).orderBy("h", "vec").limit(k).collect())
    return [[int(x) for x in r["vec"]] for r in rows]


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 256,
            k: int = 40, rounds: int = 5, prefix: str = "2:", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per kept vector.

    Which vectors are kept: see ``integer_vectors``. ``k`` centroids start as ``first_centroids``, all of
    them if there are fewer. A round assigns every vector to the nearest centroid and replaces each
    centroid that has vectors by the floor of their mean; empty ones stay. Copies fall into one cluster.
    Distances and sums beyond a long are null. An empty table, or one without a usable id to start from,
    gives no rows. Extra columns are ignored, whatever their names.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = integer_vectors(df, key, vector, width, scale)
    centroids = first_centroids(kept, k, prefix)
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    shards = materialize(encode_shards(spread(kept), block, shard))
    for _ in range(rounds):
        centroids = _updated(shards, centroids, width, block)
    large = max(abs(x) for c in centroids for x in c) >= FAST
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, part in _shards(batch, width, block, large):
                chosen, least = part.nearest(centroids)
                # Up to 38 digits are summed exactly; a distance beyond them has no long anyway.
                exact = [Decimal(int(x)) if abs(x) < 10 ** 37 else None for x in least]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(chosen, pa.int32()), pa.array(exact, pa.decimal128(38, 0)),
                     pa.array([digests[c] for c in chosen])], [key, "cluster", "distance", "centroid_sha256"])
        release_buffers()

    placed = materialize(shards.mapInArrow(
        run, f"{key} {kind}, cluster int, distance decimal(38,0), centroid_sha256 string"))
    discard(shards)
    # At most k rows: small enough to go to every task.
    sums = placed.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count("*"), F.sum("distance")).alias("cluster_inertia"))
    whole = placed.agg(F.when(F.count("distance") == F.count("*"), F.sum("distance"))).first()[0]
    total = F.lit(int(whole) if whole is not None and whole < 2 ** 63 else None).cast("long")
    as_long = lambda c: F.expr(f"try_cast({c} as bigint)")
    return (placed.join(F.broadcast(sums), "cluster")
            .select(key, "cluster", as_long("distance").alias("distance"),
                    as_long("cluster_inertia").alias("cluster_inertia"), total.alias("inertia"), "centroid_sha256"))
