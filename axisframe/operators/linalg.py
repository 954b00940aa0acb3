"""Projections, moments, Gram matrices and other sums over embedding tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.functions import columns as C
from axisframe.functions.arrow import list_column, matrix
from axisframe.operators.ranking import exact_percentiles
from axisframe.operators.scalars import with_row
from axisframe.operators.tiles import cogroup_tiles, cross_tiles, hashed_block
from axisframe.session import materialize

# A matrix of parameters (concepts x dimensions) up to this size may be sent to every task.
MAX_BROADCAST_CELLS = 8 << 20
# Cells of a Gram matrix that one task sums: 32 MB.
STRIP_CELLS = 4 << 20
# Pairs of a block and rows of vectors that a task gathers at once, in paired means.
BLOCK_PAIRS, GATHERED = 4 << 20, 1 << 16


# ---- moving small matrices -------------------------------------------------

def small_matrix(df: DataFrame, key: str, vector: str, max_cells: int = MAX_BROADCAST_CELLS
                 ) -> tuple[list, np.ndarray] | None:
    """Keys and rows in key order, or None when the table is beyond the proven bound."""
    shape = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).collect()[0]
    if not shape["n"] or shape["n"] * (shape["d"] or 0) > max_cells:
        return None
    rows = df.select(key, vector).orderBy(key).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def vector_width(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector).alias("d")).head()
    return int(first["d"]) if first else 0


def vector_sum(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise sum per key with map-side combine."""
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col(vector)))).alias(vector))


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(vector))


def paired_means(pairs: DataFrame, vectors: DataFrame, key: str, item: str, vector: str, rows: int) -> DataFrame:
    """``(key, vector)``: the mean vector of the items that a key is paired with.

    ``pairs`` is distinct ``(key, item)`` with about ``rows`` rows, ``vectors`` is ``(item, vector)``. Items are dealt into
    blocks, and a task adds up its block's vectors by key: a vector travels once, not once a pair, and
    a key leaves a block as one sum. Pairs without a vector do not count.
    """
    blocks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_PAIRS))

    def add(held: pa.Table, known: pa.Table) -> pa.Table:
        place = pc.fill_null(pc.index_in(held.column("i"), value_set=known.column("i").combine_chunks()), -1).to_numpy()
        coded = held.column("k").combine_chunks().dictionary_encode()
        code, names, v = coded.indices.to_numpy(), coded.dictionary, matrix(known.column("v"))
        order = np.flatnonzero(place >= 0)
        order = order[np.argsort(code[order], kind="stable")]
        n, total = np.bincount(code[order], minlength=len(names)), np.zeros((len(names), max(v.shape[1], 1)))
        for low in range(0, len(order), GATHERED):
            part = order[low:low + GATHERED]
            first = np.flatnonzero(np.append(True, np.diff(code[part]) != 0))
            total[code[part][first]] += np.add.reduceat(v[place[part]], first, axis=0)
        used = np.flatnonzero(n)
        block = held.column("_b").combine_chunks().take(pa.array(order[:1].repeat(len(used))))
        return pa.table({"k": names.take(pa.array(used)), "b": block, "n": pa.array(n[used]), "v": list_column(total[used])})

    left = pairs.select(F.col(key).alias("k"), F.col(item).alias("i"), hashed_block(F.col(item), blocks).alias("_b"))
    right = vectors.where(F.col(vector).isNotNull()).select(
        F.col(item).alias("i"), C.as_doubles(vector).alias("v"), hashed_block(F.col(item), blocks).alias("_b"))
    schema = T.StructType([T.StructField("k", pairs.schema[key].dataType), T.StructField("b", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    # A key has one sum a block at most, and they are added in the order of the blocks.
    sums = cogroup_tiles(left, right, ["_b"], blocks, add, schema).groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("b", "v"))).alias("parts"), F.sum("n").alias("n"))
    total = F.aggregate(F.slice("parts", 2, blocks), F.element_at("parts", 1)["v"],
                        lambda t, x: F.zip_with(t, x["v"], lambda a, b: a + b))
    return sums.select(F.col("k").alias(key), F.transform(total, lambda x: x / F.col("n")).alias(vector))


def matrix_sums(df: DataFrame, vectors: Sequence[str],
                blocks: Callable[..., Mapping[str, np.ndarray]]) -> DataFrame:
    """Sum small matrices over all rows: ``(block, row, values)``.

    ``blocks`` maps the matrices of one Arrow batch to named 2-D sums. Each task adds its batches
    and emits one copy per block row; the copies are added by key.
    """
    names = list(vectors)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for block, value in blocks(*[matrix(batch.column(n)) for n in names]).items():
                total[block] = total[block] + value if block in total else value
        for block, value in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(value)), pa.array(np.arange(len(value), dtype=np.int32)),
                 list_column(value)], names=["block", "row", "values"])

    parts = df.select(*[C.as_doubles(n).alias(n) for n in names]).mapInArrow(
        partial, "block string, row int, values array<double>")
    return vector_sum(parts, ["block", "row"], "values")


def collect_blocks(sums: DataFrame) -> dict[str, np.ndarray]:
    """Bring reduced blocks (sized by concepts and dimensions, not by rows) to the driver."""
    found: dict[str, list] = {}
    for row in sums.orderBy("block", "row").collect():
        found.setdefault(row["block"], []).append(row["values"])
    return {name: np.array(rows) for name, rows in found.items()}


# ---- row operators ---------------------------------------------------------

def l2_normalize(df: DataFrame, vector: str = "embedding", eps: float = 1e-8,
                 guard: str = "max") -> DataFrame:
    return df.withColumn(vector, C.l2_normalize(C.as_doubles(vector), eps, guard))


def project_scores(rows: DataFrame, directions: DataFrame, vector: str = "embedding",
                   out: str = "scores", key: str = "image_id") -> DataFrame:
    """Add ``vector . direction`` for each direction, in ``concept_idx`` order.

    Directions within the broadcast bound go to the tasks; more are joined as tiles.
    """
    small = small_matrix(directions, "concept_idx", "direction")
    if small is not None:
        return _map_vectors(rows, vector, out, _Product(small[1]))
    width = vector_width(directions, "direction")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({key: left.column(key).slice(0, 0), "part": pa.array([], pa.list_(
                pa.struct([("c", pa.int32()), ("s", pa.float64())])))})
        scores = matrix(left.column("_v")) @ matrix(right.column("direction")).T
        index = np.tile(right.column("concept_idx").to_numpy().astype(np.int32), len(scores))
        cells = pa.StructArray.from_arrays([pa.array(index), pa.array(scores.ravel())], ["c", "s"])
        offsets = np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32)
        return pa.table({key: left.column(key),
                         "part": pa.ListArray.from_arrays(pa.array(offsets), cells)})

    schema = T.StructType([rows.schema[key], T.StructField("part", T.ArrayType(T.StructType([
        T.StructField("c", T.IntegerType()), T.StructField("s", T.DoubleType())])))])
    parts = cross_tiles(rows.select(key, C.as_doubles(vector).alias("_v")),
                        directions.select("concept_idx", "direction"), key, "concept_idx", width,
                        product, schema)
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.flatten(F.collect_list("part"))),
                                               lambda s: s["s"]).alias(out))
    return rows.drop(out).join(whole, key)


class _Product:
    def __init__(self, directions: np.ndarray):
        self.directions = directions

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions.T


def _map_vectors(rows: DataFrame, vector: str, out: str,
                 fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Add a vector column computed batch by batch; the other columns pass through Arrow."""
    kept = [f for f in rows.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = list_column(fn(matrix(batch.column(vector))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], value], names=[*names, out])

    # The input still holds a vector column that the output replaces.
    return rows.select(*rows.columns).mapInArrow(run, schema)


class _Gelu:
    """Exact GELU, with a one behind the vector for the next layer's bias."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        erf = np.frompyfunc(math.erf, 1, 1)(x / math.sqrt(2.0)).astype(np.float64)
        return np.hstack([0.5 * x * (1.0 + erf), np.ones((len(x), 1))])


def apply_adapter(rows: DataFrame, weights: DataFrame, vector: str = "embedding",
                  out: str = "adapted", key: str = "image_id") -> DataFrame:
    """Linear, exact GELU, linear. ``weights`` is ``(layer, row, weight ARRAY, bias)``, layers 1 and 2.

    A layer is a projection of the vector with a one behind it on the weights with their bias behind them:
    weights that fit every task go there, larger ones are met tile by tile. ``key`` names a row.
    """
    def layer(number: int) -> DataFrame:
        return weights.where(F.col("layer") == number).select(
            F.col("row").cast("int").alias("concept_idx"),
            F.concat(C.as_doubles("weight"), F.array(F.col("bias").cast("double"))).alias("direction"))

    open_ = rows.withColumn("_x", F.concat(C.as_doubles(vector), F.array(F.lit(1.0))))
    for number in (1, 2):
        open_ = project_scores(open_, layer(number), "_x", "_x" if number == 1 else out, key)
        if number == 1:
            open_ = _map_vectors(open_, "_x", "_x", _Gelu())
    return open_.drop("_x")


# ---- checks and summaries --------------------------------------------------

def embedding_checks(rows: DataFrame, vector: str = "embedding", atol: float = 5e-4) -> DataFrame:
    """Size, finiteness and norm statistics in one pass."""
    v = C.as_doubles(vector)
    measured = rows.select(F.size(vector).cast("long").alias("d"), C.all_finite(v).alias("finite"),
                           C.norm(v).alias("n"))
    error = F.abs(F.col("n") - 1.0)
    return measured.agg(
        F.count("*").alias("rows"), F.max("d").alias("dimensions"),
        (F.min("d") == F.max("d")).alias("same_dimensions"),
        F.every("finite").alias("all_finite"),
        F.count(F.when(F.col("n") == 0, 1)).alias("zero_norm_rows"),
        F.min("n").alias("norm_min"), F.avg("n").alias("norm_mean"), F.max("n").alias("norm_max"),
        F.max(error).alias("max_abs_error"),
        F.avg((error <= atol).cast("double")).alias("fraction_within_atol"))


def paired_cosine_summary(pairs: DataFrame, left: str = "image", right: str = "caption"
                          ) -> DataFrame:
    """Mean, population deviation, p05, median and p95 of each pair's cosine."""
    cosine = C.dot(C.l2_normalize(left, guard="strict"), C.l2_normalize(right, guard="strict"))
    values = pairs.select(cosine.alias("cosine"))
    moments = values.agg(F.count("*").alias("pairs"), F.avg("cosine").alias("mean"),
                         F.stddev_pop("cosine").alias("standard_deviation"))
    return with_row(moments, exact_percentiles(
        values, [], "cosine", {"p05": .05, "median": .5, "p95": .95}))


def column_moments(rows: DataFrame, vector: str = "scores") -> DataFrame:
    """``(concept_idx, mean, std)`` over all rows, population deviation, in one JVM pass."""
    stats = rows.agg(Summarizer.metrics("mean", "variance", "count")
                     .summary(array_to_vector(C.as_doubles(vector))).alias("s"))
    n = F.col("s.count")
    cells = stats.select(n.alias("n"), F.posexplode(F.arrays_zip(
        vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v")))
        .alias("concept_idx", "x"))
    pop = F.col("x.v") * (F.col("n") - 1) / F.col("n")
    return cells.select("concept_idx", F.col("x.m").alias("mean"),
                        F.sqrt(F.greatest(pop, F.lit(0.0))).alias("std"))


def _moment_arrays(moments: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = moments.orderBy("concept_idx").collect()
    return np.array([r["mean"] for r in rows]), np.array([r["std"] for r in rows])


class _Standardize:
    def __init__(self, directions, mean, scale):
        self.directions, self.mean, self.scale = directions, mean, scale

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions.T - self.mean) / self.scale


def standardized_profile(train: DataFrame, gallery: DataFrame, directions: DataFrame,
                         vector: str = "embedding", out: str = "profile",
                         eps: float = 1e-6) -> DataFrame:
    """Gallery projections in units of the train projections: (x.d - mean) / (std + eps)."""
    projected = project_scores(train.select("image_id", vector), directions, vector)
    moments = column_moments(projected)
    small = small_matrix(directions, "concept_idx", "direction")
    if small is not None:
        mean, std = _moment_arrays(moments)
        return _map_vectors(gallery, vector, out, _Standardize(small[1], mean, std + eps))
    scored = project_scores(gallery, directions, vector, out)
    row = moments.agg(F.array_sort(F.collect_list(F.struct("concept_idx", "mean", "std")))
                      .alias("_m"))
    return with_row(scored, row).withColumn(out, F.zip_with(
        out, "_m", lambda x, m: (x - m["mean"]) / (m["std"] + eps))).drop("_m")


def class_mean_profiles(rows: DataFrame, class_col: str = "class", vector: str = "scores"
                        ) -> DataFrame:
    """``(class, vector)`` mean over the images of each class, combined before the shuffle."""
    return vector_mean(rows.select(class_col, C.as_doubles(vector).alias(vector)),
                       [class_col], vector)


def phrase_usage_profiles(images: DataFrame, phrases: DataFrame, class_col: str = "class",
                          vector: str = "embedding") -> DataFrame:
    """``(class, scores)``: the class mean of image-phrase scores.

    Projection is linear, so the embeddings are averaged first: the shuffle carries
    classes x dimensions instead of images x phrases.
    """
    means = class_mean_profiles(images, class_col, vector)
    return project_scores(means, phrases, vector, "scores", key=class_col).select(
        class_col, "scores")


# ---- Gram matrices ---------------------------------------------------------

def standardize_debias(profiles: DataFrame, n_components: int, vector: str = "scores"
                       ) -> DataFrame:
    """Z-score the columns, then subtract the leading singular components.

    Components beyond the table's rank are zero, so that asking for more of them changes nothing.
    """
    # Read for the moments, by every step of the solver, and for the result.
    profiles = materialize(profiles)
    if profiles.isEmpty():
        return profiles.withColumn(vector, C.as_doubles(vector))
    mean, std = _moment_arrays(column_moments(profiles, vector))
    scale = std + 1e-8
    top = None
    if n_components > 0 and len(mean):
        top = leading_directions(
            lambda w: collect_blocks(matrix_sums(profiles, [vector], _Times(mean, scale, w)))["y"], len(mean), n_components)
    return _map_vectors(profiles, vector, vector, _Residual(mean, scale, top))


class _Times:
    """Sums of ``z^T (z w)`` over rows z in units of the columns."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, w

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        z = (x - self.mean) / self.scale
        return {"y": z.T @ (z @ self.w)}


def leading_directions(times: Callable[[np.ndarray], np.ndarray], columns: int, k: int, most: int = 96,
                       patience: int = 10) -> np.ndarray:
    """The ``k`` leading eigenvectors of a positive matrix that is known only by ``times``.

    A block Krylov iteration: every call of ``times``, which is one pass over a table, takes columns x
    (k + 6) numbers at most, and no columns x columns matrix is ever formed. A basis of ``most`` vectors
    starts again from the best of them. It ends when the residuals vanish, when the matrix has no further
    direction, or when ``patience`` passes have not made the residuals smaller.
    """
    width = min(columns, k + 6)
    most = max(most, 4 * width)
    basis = images = np.zeros((columns, 0))
    fresh = np.linalg.qr(np.random.default_rng(0).normal(size=(columns, width)))[0]
    least, still = np.inf, 0
    while True:
        basis, images = np.hstack([basis, fresh]), np.hstack([images, times(fresh)])
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        rest = images @ turn[:, :width] - (basis @ turn[:, :width]) * values[:width]
        left = float(np.linalg.norm(rest[:, :k], axis=0).max())
        least, still = (left, 0) if left < least else (least, still + 1)
        if not values[0] > 0 or left <= 1e-11 * values[0] or still == patience:
            return basis @ turn[:, :k]
        if basis.shape[1] + width > most:
            basis, images = basis @ turn[:, :2 * width], images @ turn[:, :2 * width]
            turn = np.eye(basis.shape[1])
        fresh = rest
        for _ in range(2):  # once more for what rounding left
            fresh = fresh - basis @ (basis.T @ fresh)
        q, sizes, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = q[:, sizes > 1e-12 * values[0]]
        fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
        if not fresh.shape[1]:
            return basis @ turn[:, :k]


class _Residual:
    def __init__(self, mean, scale, top):
        self.mean, self.scale, self.top = mean, scale, top

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return z if self.top is None else z - (z @ self.top) @ self.top.T


def correlation_matrix(rows: DataFrame, vector: str = "scores") -> DataFrame:
    """``(i, j, r)`` Pearson correlation of the columns; a constant column fails the job."""
    rows = materialize(rows)  # read for the moments, the size and every strip
    mean, std = _moment_arrays(column_moments(rows, vector))
    if not (std > 0).all() or not np.isfinite(std).all():
        raise ValueError("non-finite correlations: a column is constant or not finite")
    cells = gram(rows, vector, mean, std).select(F.col("row").alias("i"), F.posexplode("values").alias("j", "v"))
    return cells.select("i", "j", C.clamp(F.col("v") / rows.count(), -1.0, 1.0).alias("r"))


def gram(rows: DataFrame, vector: str, mean: np.ndarray, scale: np.ndarray, strip_cells: int = STRIP_CELLS
         ) -> DataFrame:
    """``(row, values)``: ``z^T z`` of the rows z in units of the columns, one row per column.

    The result is cut into strips of ``strip_cells`` cells at most, and a task sums one strip over
    its share of the rows, so no task holds columns x columns. A strip has a fixed number of shares
    for a given number of cores, however long the table, and their sums are added by column: the
    shuffle is columns x columns numbers per share. Every strip reads the table again, which costs
    less than its products do.
    """
    columns = len(mean)
    if not columns:
        return rows.sparkSession.createDataFrame([], "row int, values array<double>")
    wide = max(1, min(columns, strip_cells // columns))
    shares = 4 * rows.sparkSession.sparkContext.defaultParallelism
    source, strips = rows.coalesce(shares), None
    for first in range(0, columns, wide):
        sums = matrix_sums(source, [vector], _Strip(mean, scale, first, first + wide)).select(
            (F.col("row") + first).alias("row"), "values")
        strips = sums if strips is None else strips.unionByName(sums)
    return strips


class _Strip:
    """Some rows of the sums of ``z^T z``."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, first: int, end: int):
        self.mean, self.scale, self.first, self.end = mean, scale, first, end

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        z = (x - self.mean) / self.scale
        return {"strip": z[:, self.first:self.end].T @ z}


def cosine_matrix(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(left, right, cosine)`` of every ordered pair, clipped to [-1, 1]."""
    unit = vectors.select(F.col(key).alias("left"), C.l2_normalize(
        C.as_doubles(vector)).alias("v"))
    return dense_products(unit, unit.withColumnRenamed("left", "right"), "left", "right", "v",
                          clip=True).withColumnRenamed("score", "cosine")


def dense_products(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   vector: str, clip: bool = False) -> DataFrame:
    """``(left_key, right_key, score)`` for every pair; the caller asked for the dense table."""
    schema = T.StructType([left.schema[left_key], right.schema[right_key],
                           T.StructField("score", T.DoubleType())])

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({left_key: a.column(left_key).slice(0, 0),
                             right_key: b.column(right_key).slice(0, 0),
                             "score": pa.array([], pa.float64())})
        scores = matrix(a.column(vector)) @ matrix(b.column(vector)).T
        if clip:
            scores = np.clip(scores, -1.0, 1.0)
        rows, cols = np.divmod(np.arange(scores.size), scores.shape[1])
        return pa.table({left_key: a.column(left_key).take(pa.array(rows)),
                         right_key: b.column(right_key).take(pa.array(cols)),
                         "score": scores.ravel()})

    return cross_tiles(left.select(left_key, vector), right.select(right_key, vector), left_key,
                       right_key, vector_width(left, vector), product, schema)
