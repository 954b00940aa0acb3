"""Ridge regression of vectors on sparse labels by block conjugate gradients.

The normal matrix never stands in one place. It is the co-occurrence of labels, kept as sparse tiles,
less a product of two prevalence vectors; unknowns, residuals and search directions are blocks of rows of
a concepts x dimensions matrix. All right-hand sides go through the iteration together, each with its own
step. The preconditioner solves the diagonal tiles exactly, so a dictionary of one block converges at once
and larger ones need no other path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.functions.arrow import list_column, matrix
from axisframe.operators.linalg import collect_blocks, matrix_sums, vector_sum
from axisframe.session import discard, materialize

#: Concepts of a block.
BLOCK = 512
#: A right-hand side is solved once its residual is this small beside the right-hand side.
TOLERANCE = 1e-11
#: Steps without a smaller residual after which the iteration ends.
PATIENCE = 25
#: Partial products that a task adds up before it hands them on.
HELD_BLOCKS = 32


@dataclass
class NormalEquations:
    """``(S / n - p p^T + alpha) x = c`` for every dimension.

    ``tiles`` is ``(bi, bj, cells)`` of S / n, ``parts`` is ``(b, p, c)`` with the rows of a block as
    binary matrices.
    """

    tiles: DataFrame
    parts: DataFrame
    alpha: float
    width: int


def _pack(value: np.ndarray) -> bytes:
    return np.ascontiguousarray(value, "<f8").tobytes()


def _rows(value: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<f8").reshape(-1, width)


def _dense(cells: pa.ListScalar, block: int) -> np.ndarray:
    """A tile as a matrix; cells of one tile are distinct."""
    out = np.zeros((block, block))
    values = cells.values
    out[values.field("i").to_numpy(), values.field("j").to_numpy()] = values.field("v").to_numpy()
    return out


def _map_blocks(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """Map each row (a block with its matrices) to one row."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = fn(**{n: batch.column(n)[i] for n in names})
                yield pa.RecordBatch.from_pylist([row], arrow)

    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])
    return df.mapInArrow(run, schema)


def label_cells(rows: DataFrame, n_concepts: int) -> tuple[DataFrame, DataFrame]:
    """``(concept_idx, positives, uncertain)`` and the counts ``(i, j, pp, pu, up, uu)`` of rows in which
    i and j are present or uncertain; an uncertain label is not present. One pass over the label columns."""
    def known(column: str) -> Column:
        return F.filter(F.array_distinct(column), lambda k: (k >= 0) & (k < n_concepts))

    marked = rows.select(F.concat(
        F.transform(F.array_except(known("present_idx"), known("uncertain_idx")),
                    lambda k: F.struct(k.cast("int").alias("k"), F.lit(True).alias("present"))),
        F.transform(known("uncertain_idx"),
                    lambda k: F.struct(k.cast("int").alias("k"), F.lit(False).alias("present")))).alias("marks"))
    one = marked.select("marks", F.explode("marks").alias("x"))
    pair = one.select("x", F.explode("marks").alias("y"))
    counts = pair.groupBy(F.col("x.k").alias("i"), F.col("y.k").alias("j")).agg(*[
        F.count(F.when((F.col("x.present") == a) & (F.col("y.present") == b), 1)).alias(name)
        for name, a, b in (("pp", True, True), ("pu", True, False), ("up", False, True), ("uu", False, False))])
    cells = materialize(counts)
    # A label meets itself in every row that holds it.
    single = cells.where("i = j").select(F.col("i").alias("concept_idx"), F.col("pp").alias("positives"),
                                         F.col("uu").alias("uncertain"))
    every = rows.sparkSession.range(n_concepts).select(F.col("id").cast("int").alias("concept_idx"))
    return every.join(single, "concept_idx", "left").fillna(0), cells


def normal_equations(rows: DataFrame, alpha: float, n_concepts: int, eps: float, vector: str = "embedding",
                     block: int | None = None) -> tuple[NormalEquations, DataFrame, dict[str, float]]:
    """The equations, ``(concept_idx, positives, negatives, p)`` and totals of the vectors.

    Two passes over the rows: one over the labels, one that sums the vectors by label.
    """
    block = block or BLOCK
    single, cells = label_cells(rows, n_concepts)
    single = materialize(single)
    v = C.as_doubles(vector)
    # Behind the vector stand its squared norm and a one: concept -1, of all rows, has their sums.
    wide = rows.select("present_idx", "uncertain_idx", F.concat(v, F.array(C.squared_norm(v), F.lit(1.0))).alias("v"))
    kinds = F.concat(
        F.array(F.struct(F.lit(-1).alias("k"), F.lit(True).alias("present"))),
        F.transform(F.array_except("present_idx", "uncertain_idx"),
                    lambda k: F.struct(k.cast("int").alias("k"), F.lit(True).alias("present"))),
        F.transform(F.array_distinct("uncertain_idx"),
                    lambda k: F.struct(k.cast("int").alias("k"), F.lit(False).alias("present"))))
    sums = materialize(vector_sum(wide.select("v", F.explode(kinds).alias("x")).select(
        F.col("x.k").alias("concept_idx"), F.col("x.present").alias("present"), "v"), ["concept_idx", "present"], "v"))
    whole = sums.where("concept_idx = -1").head()
    if whole is None or whole["v"][-1] < 2:
        raise ValueError("at least two rows with enough certain labels are needed")
    *total, squares, n = whole["v"]
    width = len(total)
    mean = np.array(total) / n
    spread = max(squares - n * float(mean @ mean), 0.0) / (n * width)
    rms = max(np.sqrt(spread), eps)
    definite = F.lit(float(n)) - F.col("uncertain")
    prevalence = materialize(single.select(
        "concept_idx", "positives", (definite - F.col("positives")).cast("long").alias("negatives"),
        (F.col("positives") / F.greatest(definite, F.lit(1.0))).alias("p")))

    pi, pj = (prevalence.select(F.col("concept_idx").alias(k), F.col("p").alias(f"p{k}")) for k in ("i", "j"))
    value = (F.col("pp") + F.col("pu") * F.col("pj") + F.col("up") * F.col("pi") + F.col("uu") * F.col("pi") * F.col("pj"))
    tiles = materialize(
        cells.join(pi, "i").join(pj, "j")
        .groupBy(F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj"))
        .agg(F.collect_list(F.struct((F.col("i") % block).alias("i"), (F.col("j") % block).alias("j"),
                                     (value / n).alias("v"))).alias("cells")))

    held = F.slice("v", 1, width)
    present = sums.where("present and concept_idx >= 0").select("concept_idx", held.alias("with"))
    unsure = sums.where("not present").select("concept_idx", held.alias("maybe"))
    zero, centre = F.array_repeat(F.lit(0.0), width), C.literal_array(float(x) for x in mean)
    right = (prevalence.join(present, "concept_idx", "left").join(unsure, "concept_idx", "left")
             .withColumn("c", F.zip_with(
                 F.zip_with(F.coalesce("with", zero), F.coalesce("maybe", zero), lambda a, b: a + F.col("p") * b),
                 centre, lambda a, m: (a / n - F.col("p") * m) / rms)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("concept_idx")
        return pa.table({"b": table.column("b").slice(0, 1), "p": [_pack(table.column("p").to_numpy())],
                         "c": [_pack(matrix(table.column("c")))]})

    parts = materialize(right.select(F.floor(F.col("concept_idx") / block).cast("int").alias("b"), "concept_idx", "p", "c")
                        .groupBy("b").applyInArrow(pack, "b int, p binary, c binary"))
    discard(cells, sums)
    return NormalEquations(tiles, parts, alpha, width), prevalence, {
        "n": n, "mean_square": spread / rms ** 2, "dimensions": float(width)}


def _diagonal(eq: NormalEquations, block: int) -> DataFrame:
    """``(b, inverse)`` of the diagonal tiles of the whole matrix."""
    alpha = eq.alpha

    def invert(b, p, cells) -> dict:
        share = _rows(p, 1)[:, 0]
        m = len(share)
        tile = _dense(cells, block)[:m, :m] if cells.is_valid else np.zeros((m, m))
        full = tile - np.outer(share, share) + alpha * np.eye(m)
        return {"b": b.as_py(), "inverse": _pack(np.linalg.inv((full + full.T) / 2))}

    own = eq.tiles.where("bi = bj").select(F.col("bi").alias("b"), "cells")
    return _map_blocks(eq.parts.select("b", "p").join(own, "b", "left"), invert, "b int, inverse binary")


def _times(eq: NormalEquations, towards: DataFrame, along: np.ndarray, block: int) -> DataFrame:
    """``(b, q)``: the matrix times the block rows ``towards`` ``(b, d)``; ``along`` is p^T d."""
    width, alpha = eq.width, eq.alpha

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.int32()), pa.array([_pack(x) for x in held.values()], pa.binary())], ["b", "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                d = _rows(batch.column("d")[i], width)
                part = _dense(batch.column("cells")[i], block)[:, :len(d)] @ d
                b = batch.column("bi")[i].as_py()
                held[b] = held[b] + part if b in held else part
            if len(held) > HELD_BLOCKS:
                yield out()
                held.clear()
        yield out()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(_rows(x, width) for batch in batches for x in batch.column("part"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_pack(total)])], ["b", "part"])

    def close(b, p, d, part) -> dict:
        share, step = _rows(p, 1), _rows(d, width)
        sparse = _rows(part, width)[:len(step)] if part.is_valid else 0.0
        return {"b": b.as_py(), "q": _pack(sparse - share * along[None, :] + alpha * step)}

    products = eq.tiles.join(towards.withColumnRenamed("b", "bj"), "bj").select("bi", "cells", "d").mapInArrow(
        multiply, "b int, part binary")
    summed = products.groupBy("b").applyInArrow(add, "b int, part binary")
    return _map_blocks(eq.parts.select("b", "p").join(towards, "b").join(summed, "b", "left"), close, "b int, q binary")


def _totals(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Sums of arrays with one number per dimension over all blocks."""
    row = df.agg(*[vector_to_array(Summarizer.sum(array_to_vector(F.col(n)))).alias(n) for n in names]).head()
    return [np.array(row[n]) for n in names]


def solve(eq: NormalEquations, block: int | None = None) -> tuple[DataFrame, int]:
    """``(b, x, r)`` and the number of steps: block rows of the solution and what is left of ``c``."""
    block, width = block or BLOCK, eq.width
    inverse = materialize(_diagonal(eq, block))
    dots = "along array<double>, rz array<double>, rr array<double>"

    def first(b, p, c, inverse) -> dict:
        share, r = _rows(p, 1), _rows(c, width)
        z = _rows(inverse, len(share)) @ r
        return {"b": b.as_py(), "x": _pack(np.zeros_like(r)), "r": c.as_py(), "z": _pack(z), "d": _pack(np.zeros_like(r)),
                "along": (share * z).sum(0).tolist(), "rz": (r * z).sum(0).tolist(), "rr": (r * r).sum(0).tolist()}

    state = materialize(_map_blocks(eq.parts.join(inverse, "b"), first,
                                    f"b int, x binary, r binary, z binary, d binary, {dots}"))
    along_z, rz, rr = _totals(state, ["along", "rz", "rr"])
    start, goal = rr, TOLERANCE ** 2 * rr
    along, back, steps = np.zeros(width), np.zeros(width), 0
    best, still = np.inf, 0
    while (rr > goal).any():
        along = along_z + back * along
        ratio = back

        def turn(b, z, d, ratio=ratio) -> dict:
            return {"b": b.as_py(), "d": _pack(_rows(z, width) + ratio[None, :] * _rows(d, width))}

        towards = materialize(_map_blocks(state.select("b", "z", "d"), turn, "b int, d binary"))
        product = materialize(_times(eq, towards, along, block))

        def dot(b, d, q) -> dict:
            return {"b": b.as_py(), "dq": (_rows(d, width) * _rows(q, width)).sum(0).tolist()}

        dq, = _totals(_map_blocks(towards.join(product, "b"), dot, "b int, dq array<double>"), ["dq"])
        # A side that is solved to the last bit stands still.
        moving = (dq > 0) & (rr > goal)
        length = np.where(moving, rz / np.where(dq > 0, dq, 1.0), 0.0)

        def step(b, x, r, p, d, q, inverse, length=length) -> dict:
            share, way = _rows(p, 1), _rows(d, width)
            rest = _rows(r, width) - length[None, :] * _rows(q, width)
            z = _rows(inverse, len(share)) @ rest
            return {"b": b.as_py(), "x": _pack(_rows(x, width) + length[None, :] * way), "r": _pack(rest), "z": _pack(z),
                    "d": d.as_py(), "along": (share * z).sum(0).tolist(), "rz": (rest * z).sum(0).tolist(),
                    "rr": (rest * rest).sum(0).tolist()}

        following = materialize(_map_blocks(
            state.select("b", "x", "r").join(eq.parts.select("b", "p"), "b").join(towards, "b").join(product, "b")
            .join(inverse, "b"), step, f"b int, x binary, r binary, z binary, d binary, {dots}"))
        discard(state, towards, product)
        state, before, steps = following, rz, steps + 1
        along_z, rz, now = _totals(state, ["along", "rz", "rr"])
        worst = float(np.max(now / np.where(start > 0, start, 1.0)))
        best, still = (worst, 0) if worst < best else (best, still + 1)
        if still == PATIENCE:  # rounding is all that is left
            break
        rr = now
        back = np.where(moving & (before > 0), rz / np.where(before > 0, before, 1.0), 0.0)
    discard(inverse)
    return state.select("b", "x", "r"), steps


def effects(eq: NormalEquations, solution: DataFrame, block: int | None = None) -> DataFrame:
    """``(concept_idx, effect)`` from the block rows of the solution."""
    block, width = block or BLOCK, eq.width

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, b = _rows(batch.column("x")[i], width), batch.column("b")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(b * block, b * block + len(x), dtype=np.int32)), list_column(x)],
                    ["concept_idx", "effect"])

    return solution.select("b", "x").mapInArrow(unpack, "concept_idx int, effect array<double>")


def fit_sums(eq: NormalEquations, solution: DataFrame) -> dict[str, float]:
    """x^T A x without the penalty, x^T c and x^T x, summed over the dimensions."""
    width, alpha = eq.width, eq.alpha

    def sums(b, x, r, c) -> dict:
        one, left, right = (_rows(m, width) for m in (x, r, c))
        own = float((one * one).sum())
        # The matrix times x is c - r, of which alpha x is the penalty's part.
        return {"b": b.as_py(), "quadratic": float((one * (right - left)).sum()) - alpha * own,
                "linear": float((one * right).sum()), "squares": own}

    return _map_blocks(solution.join(eq.parts.select("b", "c"), "b"), sums,
                       "b int, quadratic double, linear double, squares double").agg(
        *[F.sum(n).alias(n) for n in ("quadratic", "linear", "squares")]).head().asDict()


def overlap(directions: DataFrame) -> float:
    """Mean squared product of two different unit directions, from their small dimension x dimension Gram matrix."""
    sums = collect_blocks(matrix_sums(directions, ["direction"], lambda x: {
        "g": x.T @ x, "n": np.array([[float(len(x)), float(((x * x).sum(1) ** 2).sum())]])}))
    if not sums or sums["n"][0, 0] < 2:
        return 0.0
    n, own = sums["n"][0]
    return float(((sums["g"] ** 2).sum() - own) / (n * (n - 1)))
