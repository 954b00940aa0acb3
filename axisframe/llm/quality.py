"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as bytes. Filters of ``WIDTH`` bytes slide over it, every ``STRIDE`` bytes; they see a
learned code of each byte and how much of the text just before repeats itself. A chunk is two
neighbouring halves of ``HALF`` bytes, so chunks overlap by half and cover the whole document. The
largest answer of each filter in a chunk gives the chunk's logit; the mean logit of all chunks is the
document's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import keep_rows, map_arrow, text_bytes
from axisframe.llm.labelled import fold, sample

HALF, WIDTH, STRIDE, CODE, FILTERS = 256, 8, 4, 8, 24
#: The fit reads so many documents of each label at most, and so many chunks of each, evenly spread.
FIT_DOCUMENTS, FIT_CHUNKS = {0: 1500, 1: 3000}, 8
_STEPS = HALF // STRIDE
#: Halves whose filter answers are in memory at a time, and bytes of texts laid out at a time.
PIECE, SLICE_BYTES = 1024, 1 << 20
#: A place repeats if its four bytes stood one of so many bytes before; the share of the last places counts.
_LAGS, _PLACES = range(2, 25), 8
_GAP = 32


def repeats(data: np.ndarray) -> np.ndarray:
    """For each filter position, the share of the last places that repeat what is just before them."""
    wide = np.concatenate([np.zeros(_GAP, np.uint8), data, np.zeros(4, np.uint8)])
    four = np.lib.stride_tricks.as_strided(wide.view(np.uint8), (len(wide) - 3, 4), (1, 1))
    four = np.ascontiguousarray(four).view("<u4").ravel()
    n = (len(data) - WIDTH) // STRIDE + 1
    here = four[_GAP:_GAP + n * STRIDE:STRIDE]
    found = np.zeros(n, bool)
    for lag in _LAGS:
        found |= here == four[_GAP - lag:_GAP - lag + n * STRIDE:STRIDE]
    found &= here != 0
    total = np.cumsum(np.append(np.zeros(_PLACES), found))
    return ((total[_PLACES:] - total[:-_PLACES]) / _PLACES)[:n].astype(np.float32)


def led(data: np.ndarray) -> np.ndarray:
    """Zeros in front: a filter position reaches back, where a document's neighbour ends in zeros."""
    return np.concatenate([np.zeros(WIDTH - STRIDE, np.uint8), data])


@dataclass
class Network:
    code: np.ndarray     # (256, CODE)
    filters: np.ndarray  # (WIDTH * CODE + 1, FILTERS), the last row for repeats
    bias: np.ndarray     # (FILTERS,)
    out: np.ndarray      # (FILTERS + 1,)

    def windows(self, data: np.ndarray) -> np.ndarray:
        """The coded bytes under each filter position of ``led`` data."""
        coded = self.code[data].ravel()
        n = (len(data) - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(
            coded, (n, WIDTH * CODE), (STRIDE * CODE * coded.itemsize, coded.itemsize))
        return np.ascontiguousarray(view)  # overlapping rows would keep the product from BLAS

    def halves(self, data: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each half; ``data`` is whole halves."""
        out = np.empty((len(data) // HALF, self.filters.shape[1]), np.float32)
        for first in range(0, len(out), PIECE):
            before = min(first, 1)  # the half before a piece is what its first places look back on
            padded = led(data[(first - before) * HALF:(first + PIECE) * HALF])
            answers = self.windows(padded) @ self.filters[:-1] + repeats(padded)[:, None] * self.filters[-1]
            best = answers.reshape(-1, _STEPS, answers.shape[1]).max(1)[before:]
            out[first:first + PIECE] = np.maximum(best + self.bias, 0)
        return out

    def logits(self, data: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """The logit of each document; ``halves`` counts its halves in ``data``, two at least."""
        best = self.halves(data)
        starts = np.cumsum(halves) - halves
        chunk = np.maximum(best[:-1], best[1:]) @ self.out[:-1] + self.out[-1]
        last = np.zeros(len(best), bool)
        last[starts + halves - 1] = True  # a half and the next document's first half are no chunk
        chunk = np.where(last[:-1], 0, chunk)
        return np.add.reduceat(np.append(chunk, 0), starts) / (halves - 1)


def laid_out(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents as whole halves, ``_GAP`` zeros at least behind each, and how many halves each has."""
    sizes = np.diff(ends)
    halves = np.maximum(-(-(sizes + _GAP) // HALF), 2)
    starts = (np.cumsum(halves) - halves) * HALF
    out = np.zeros(int(halves.sum()) * HALF, np.uint8)
    at = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[0], ends[-1])
    out[at] = raw[ends[0]:ends[-1]]
    return out, halves


def fit(chunks: list[list[bytes]], y: np.ndarray, weights: np.ndarray, epochs: int = 6, steps: int = 500,
        batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on documents given as lists of chunks (2 * HALF bytes each) with Adam on the log loss.

    A small sample is walked more often than ``epochs`` times, until there are ``steps`` steps.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, CODE)).astype(np.float32),
                  rng.normal(0, (WIDTH * CODE) ** -0.5, (WIDTH * CODE + 1, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, np.float32), np.zeros(FILTERS + 1, np.float32))
    net.filters[-1] *= 4
    net.out[:-1] = rng.normal(0, 0.2, FILTERS)
    if not len(y):
        return net
    parts = [net.code, net.filters, net.bias, net.out]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    data = [np.frombuffer(b"".join(c.ljust(2 * HALF, b"\0") for c in doc), np.uint8) for doc in chunks]
    epochs = max(epochs, -(-steps // -(-len(y) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            owner = np.repeat(np.arange(len(rows)), [len(chunks[r]) for r in rows])
            bytes_ = np.concatenate([data[r] for r in rows])
            padded = led(bytes_)
            seen = net.windows(padded)
            again = repeats(padded)
            answers = (seen @ net.filters[:-1] + again[:, None] * net.filters[-1]).reshape(len(owner), 2 * _STEPS, FILTERS)
            top = answers.argmax(1)
            pooled = np.take_along_axis(answers, top[:, None], 1)[:, 0] + net.bias
            active = pooled > 0
            pooled = np.where(active, pooled, 0)
            share = 1 / np.bincount(owner, minlength=len(rows))
            logit = np.bincount(owner, pooled @ net.out[:-1], len(rows)) * share + net.out[-1]
            miss = (1 / (1 + np.exp(-logit)) - y[rows]) * weights[rows] / len(rows)
            back = (miss * share)[owner].astype(np.float32)
            into = back[:, None] * net.out[:-1] * active
            at = (np.arange(len(owner)) * 2 * _STEPS)[:, None] + top
            under = seen[at.ravel()].reshape(*at.shape, -1)
            d_filters = np.concatenate([np.einsum("cfk,cf->kf", under, into), [(again[at] * into).sum(0)]])
            d_under = (into[:, :, None] * net.filters[:-1].T[None]).reshape(-1, CODE)
            letters = padded[(at.ravel() * STRIDE)[:, None] + np.arange(WIDTH)].ravel()
            d_code = np.stack([np.bincount(letters, d_under[:, j], 256) for j in range(CODE)], 1)
            grads = [d_code, d_filters, into.sum(0), np.append(back @ pooled, miss.sum())]
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held_out: Column) -> Network:
    """Fit on a bounded sample; its class weights restore the share of each label in all usable rows."""
    shares = {r["y"]: r["n"] for r in labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out)
              .groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    chosen = sample(docs.select(key, text_bytes(text).alias("body")), labels, key, label, held_out, FIT_DOCUMENTS)
    size = 2 * HALF - _GAP
    room = F.greatest(F.length("body") - size, F.lit(0))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(FIT_CHUNKS - 1)), lambda i: F.least(
        F.floor(i * room / max(FIT_CHUNKS - 1, 1)), F.length("body").cast("long")).cast("int")))
    rows = chosen.select("y", F.transform(places, lambda p: F.substring("body", p + 1, F.lit(size))).alias("chunks"),
                         F.xxhash64(key).alias("o")).orderBy("o").toPandas()
    y = rows["y"].to_numpy(np.float64)
    weights = np.ones(len(y))
    for value, n in shares.items():
        if (y == value).any():
            weights[y == value] = n / sum(shares.values()) * len(y) / (y == value).sum()
    return fit([[bytes(c) for c in doc] for doc in rows["chunks"]], y, weights)


def probabilities(body: pa.Array, net: Network) -> np.ndarray:
    """The probability of label 1 of each text, given as bytes without nulls."""
    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
    data, halves = laid_out(np.frombuffer(body.buffers()[2] or b"", np.uint8), ends)
    return 1 / (1 + np.exp(-net.logits(data, halves).astype(np.float64)))


def score(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every whole text. Null and empty texts are scored as zeros only."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(probabilities(batch.column("body"), net))], ["key", "score"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    return map_arrow(source, run, f"key {kind}, score double", "body", SLICE_BYTES).withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "quality", parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``(key, held_out, score, predicted)`` of every document.

    Labels are learned only from rows whose ``fold`` is not ``held``; a row with a null key is scored
    and not held out. Without usable labels the untrained network scores.
    """
    net = train(docs, labels, key, text, label, fold(F.col(key), parts) == held)
    return score(docs, net, key, text).select(
        key, (fold(F.col(key), parts) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts as label 1, with all their columns."""
    net = train(docs, labels, key, text, label, fold(F.col(key), parts) == held)
    return keep_rows(docs, lambda body: pa.array(probabilities(body, net) >= threshold), text, SLICE_BYTES)
