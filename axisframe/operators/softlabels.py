"""Soft labels: one two-component Gaussian mixture per concept, all concepts at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.operators.linalg import _map_vectors, collect_blocks, matrix_sums
from axisframe.operators.ranking import running_totals
from axisframe.session import discard, materialize

# The defaults of the mixture the reference fits.
TOLERANCE = 1e-3
MAX_ITERATIONS = 100
VARIANCE_FLOOR = 1e-6


class _Mixture:
    """Parameters ``(2, concepts)``; the object is what travels to the tasks."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, variance: np.ndarray):
        self.weight, self.mean, self.variance = weight, mean, variance

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        gap = x[None, :, :] - self.mean[:, None, :]
        with np.errstate(divide="ignore"):
            prior = np.log(self.weight)
        return (prior[:, None, :] - 0.5 * (np.log(2 * np.pi * self.variance)[:, None, :]
                                           + gap * gap / self.variance[:, None, :]))

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = self.log_parts(x)
        total = np.logaddexp(parts[0], parts[1])
        return np.exp(parts - total), total

    def statistics(self, x: np.ndarray) -> dict[str, np.ndarray]:
        share, total = self.responsibilities(x)
        # Sums around the current means keep the variances accurate for distant scores.
        gap = x[None, :, :] - self.mean[:, None, :]
        return {"n": share.sum(axis=1), "x": (share * gap).sum(axis=1),
                "xx": (share * gap * gap).sum(axis=1), "l": total.sum(axis=0, keepdims=True)}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        share, _total = self.responsibilities(x)
        upper = self.mean.argmax(axis=0)
        return np.where(upper[None, :] == 1, share[1], share[0])


def two_means(train: DataFrame, vector: str, centre: np.ndarray) -> _Mixture:
    """The best split of every concept's scores in two, as a mixture: exact, for all concepts at once.

    In one dimension two means are parted by a cut of the sorted scores, and the gain of a cut needs only
    totals on either side. Equal scores are one row; the sorted rows of a concept span many tasks. A
    concept without two different scores has both components at its mean.
    """
    middle = C.literal_array(float(x) for x in centre)
    cells = train.select(F.posexplode(F.zip_with(vector, middle, lambda x, m: x - m)).alias("c", "x"))
    values = materialize(cells.groupBy("c", "x").agg(F.count("*").cast("double").alias("n")).select(
        "c", "x", "n", (F.col("x") * F.col("n")).alias("s"), (F.col("x") * F.col("x") * F.col("n")).alias("q")))
    whole = values.groupBy("c").agg(*[F.sum(k).alias(f"{k}_all") for k in "nsq"])
    placed = running_totals(values, ["x"], ["c"], {"n_low": "n", "s_low": "s", "q_low": "q"}).join(whole, "c")
    low = {k: F.col(f"{k}_low") + F.col(k) for k in "nsq"}
    sides = placed.select("c", "x", *[low[k].alias(f"{k}0") for k in "nsq"],
                          *[(F.col(f"{k}_all") - low[k]).alias(f"{k}1") for k in "nsq"])
    gain = F.when(F.col("n1") > 0.5, F.col("s0") * F.col("s0") / F.col("n0") + F.col("s1") * F.col("s1") / F.col("n1"))
    best = sides.groupBy("c").agg(F.max_by(F.struct("n0", "s0", "q0", "n1", "s1", "q1"), F.struct(gain, -F.col("x"))).alias("b"))
    found = best.orderBy("c").collect()
    discard(values)
    n0, s0, q0, n1, s1, q1 = np.array([list(r["b"]) for r in found]).T
    n1 = np.where(n1 > 0.5, n1, 0.0)
    alone = n1 == 0
    n = np.stack([n0, np.where(alone, n0, n1)])
    mean = np.stack([s0, np.where(alone, s0, s1)]) / n
    variance = np.maximum(np.stack([q0, np.where(alone, q0, q1)]) / n - mean * mean, 0.0) + VARIANCE_FLOOR
    return _Mixture(n / n.sum(axis=0), mean + centre, variance)


def fit_mixtures(train: DataFrame, vector: str = "scores") -> tuple[_Mixture, int]:
    """EM over sufficient statistics: an iteration is one aggregate for all concepts.

    The start is the best split of the scores in two, which is deterministic. A concept stops moving once its mean log-likelihood gains less than
    the tolerance; the last step that was made is kept.
    """
    # The scores are read once per iteration. A lost executor only recomputes its part.
    train = train.select(vector).persist()
    try:
        first = collect_blocks(matrix_sums(train, [vector], lambda x: {
            "s": np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(x))])}))
        if not first:
            raise ValueError("no train rows to fit")
        total, _squares, count = first["s"]
        n = count[0]
        model = two_means(train, vector, total / n)
        previous = np.full(len(total), -np.inf)
        open_ = np.ones(len(total), dtype=bool)
        for iteration in range(1, MAX_ITERATIONS + 1):
            stats = collect_blocks(matrix_sums(train, [vector], model.statistics))
            weight = stats["n"] + 10 * np.finfo(float).eps
            shift = stats["x"] / weight
            spread = np.maximum(stats["xx"] / weight - shift * shift, 0.0) + VARIANCE_FLOOR
            model = _Mixture(np.where(open_, weight / weight.sum(axis=0), model.weight),
                             np.where(open_, model.mean + shift, model.mean),
                             np.where(open_, spread, model.variance))
            level = stats["l"][0] / n
            open_ &= np.abs(level - previous) >= TOLERANCE
            previous = level
            if not open_.any():
                return model, iteration
        return model, MAX_ITERATIONS
    finally:
        train.unpersist()


def fit_soft_labels(train: DataFrame, rows: DataFrame, vector: str = "scores",
                    out: str = "soft") -> DataFrame:
    """Posterior of the higher-mean component, fitted on train scores, for all rows."""
    model, _iterations = fit_mixtures(train, vector)
    return _map_vectors(rows, vector, out, model)
