"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is hidden in turn and predicted from its two neighbours on each side. The network gives
the probability of the token's class; classes are ranges of hashed tokens of about equal mass, and
within a class a token has its share of the corpus counts. The counts cover every token of every
document. The windows of all tokens train the network: groups of documents train replicas from one
start, whose weights are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import map_arrow, text_bytes
from axisframe.session import materialize

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Hashed token types (counts and classes), rows of the input table, classes, and layer sizes.
TYPES, INPUTS, CLASSES, CODE, HIDDEN = 1 << 18, 1 << 12, 32, 12, 24
#: One window in so many trains the network; a replica trains on about so many windows.
RATE, REPLICA_WINDOWS = 1, 200_000
MAX_WORDS = 200_000
REACH = (-2, -1, 1, 2)
SLICE_BYTES = 2 << 20


class _Types(dict):
    """Hashed type of a word, from 1; 0 stands outside a document."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % (TYPES - 1) + 1
        return value


_TYPES = _Types()


def types_of(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token types of all texts in one array, and the borders between the texts."""
    of = _TYPES.__getitem__
    parts = [np.array(list(map(of, TOKEN.findall(v.as_py().decode("utf-8", "replace").lower()))), np.int32)
             for v in bodies]
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([0, *map(len, parts)])


def tokenized(docs: DataFrame) -> DataFrame:
    """``(key, h, types)`` of ``(key, h, body)``: counts, training and scores read the types of a text, as bytes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        types, ends = types_of(batch.column("body"))
        place = pa.py_buffer((ends * types.itemsize).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, place, pa.py_buffer(types)])
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), packed], ["key", "h", "types"])

    kind = docs.schema["key"].dataType.simpleString()
    return map_arrow(docs, run, f"key {kind}, h long, types binary", "body", SLICE_BYTES)


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``types_of`` gave for the texts of a slice of ``tokenized``."""
    values = [np.frombuffer(v.as_buffer(), np.int32) for v in packed]
    return np.concatenate([np.zeros(0, np.int32), *values]), np.cumsum([0, *map(len, values)])


def contexts(types: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The neighbours of every token, 0 beyond its text's ends."""
    n = len(types)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    low, high = ends[row], ends[row + 1]
    out = np.zeros((n, len(REACH)), np.int32)
    for j, away in enumerate(REACH):
        at = np.arange(n) + away
        inside = (at >= low) & (at < high)
        out[inside, j] = types[at[inside]]
    return out


def start(seed: int = 11) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = ((INPUTS, CODE), (CODE * len(REACH), HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
    return [rng.normal(0, 0.1 if len(s) > 1 else 0, s).astype(np.float32) for s in shapes]


def _forward(weights: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, w1, b1, w2, b2 = weights
    seen = code.take((around % INPUTS).ravel(), axis=0).reshape(len(around), -1)
    hidden = seen @ w1
    hidden += b1
    np.tanh(hidden, out=hidden)
    logits = hidden @ w2
    logits += b2
    logits -= logits.max(1, keepdims=True)
    return seen, hidden, logits


def train(weights: list[np.ndarray], around: np.ndarray, classes: np.ndarray, batch: int = 512,
          rate: float = 0.01) -> list[np.ndarray]:
    """One pass of Adam over windows and the classes of their hidden tokens."""
    weights = [w.copy() for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    column = np.arange(CODE)
    for step, i in enumerate(range(0, len(classes), batch), 1):
        ids, y = around[i:i + batch] % INPUTS, classes[i:i + batch]
        seen, hidden, p = _forward(weights, ids)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = p @ weights[3].T
        back *= 1 - hidden * hidden
        d_seen = back @ weights[1].T
        cells = (ids.reshape(-1, 1) * CODE + column).ravel()
        d_code = np.bincount(cells, d_seen.ravel(), INPUTS * CODE).astype(np.float32).reshape(INPUTS, CODE)
        grads = [d_code, seen.T @ back, back.sum(0), hidden.T @ p, p.sum(0)]
        # a Python number: numpy's would turn every update into doubles
        pace = float(rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            g *= g
            v += 0.001 * (g - v)
            size = np.sqrt(v)
            size += 1e-8
            np.divide(m, size, out=size)
            size *= pace
            w -= size
    return weights


def corpus_counts(tokens: DataFrame) -> np.ndarray:
    """Tokens of each type in all documents of ``tokenized``; tasks count first, the table of types is of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TYPES, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("types"))[0], minlength=TYPES)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["type", "n"])

    rows = tokens.select("types").mapInArrow(run, "type int, n long").groupBy("type").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(TYPES)
    counts[rows["type"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return counts


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every type, and the log of its share in the class; a type never seen counts half."""
    mass = counts + 0.5
    mass[0] = 0
    order = np.argsort(-mass, kind="stable")
    before = np.cumsum(mass[order]) - mass[order]
    of = np.empty(TYPES, np.int32)
    of[order] = np.minimum(before / max(mass.sum(), 1) * CLASSES, CLASSES - 1)
    held = np.bincount(of, mass, CLASSES)
    with np.errstate(divide="ignore"):
        return of, np.log(mass) - np.log(np.maximum(held, 1e-300))[of]


def windows(bodies: pa.Array, h: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Types and neighbours of one token in ``rate`` of every text, chosen and mixed by hash."""
    return mixed_windows(*types_of(bodies), h, rate)


def mixed_windows(types: np.ndarray, ends: np.ndarray, h: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of texts whose types are known."""
    around = contexts(types, ends)
    mixed = (np.arange(len(types)) + np.repeat(h, np.diff(ends))).astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mine = np.flatnonzero(mixed % np.uint64(rate) == 0)
    mine = mine[np.argsort(mixed[mine] >> np.uint64(20), kind="stable")]
    return types[mine], around[mine]


def fit(tokens: DataFrame, counts: np.ndarray, rate: int = RATE) -> list[np.ndarray]:
    """Train replicas on the windows of ``tokenized`` texts and average them, a fixed number at a time."""
    of = classes_of(counts)[0]
    begun = start()
    replicas = max(1, int(np.ceil(counts.sum() / rate / REPLICA_WINDOWS)))
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((begun, of))
    sizes = [w.size for w in begun]

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weights, classes = shared.value
        rows = rows.sort_values("h")
        types, ends = unpacked(pa.array(rows["types"], pa.binary()))
        types, around = mixed_windows(types, ends, rows["h"].to_numpy(np.int64), rate)
        trained = train(weights, around, classes[types])
        flat = np.concatenate([w.ravel() for w in trained])
        return pd.DataFrame({"replica": [key[0]], "n": [len(types)], "weights": [flat]})

    def average(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(float)
        flat = np.average(np.stack(rows["weights"].to_numpy()), axis=0, weights=n + 1e-9).astype(np.float32)
        return pd.DataFrame({"replica": [key[0]], "n": [int(n.sum())], "weights": [flat]})

    schema = "replica long, n long, weights array<float>"
    # Documents go to the replicas, as windows would be many times their size.
    models = materialize(tokens.select("h", "types", F.pmod(F.xxhash64("key", "h"), F.lit(replicas)).alias("replica"))
                         .groupBy("replica").applyInPandas(learn, schema))
    while replicas > 1:
        replicas = -(-replicas // 16)
        models = models.withColumn("replica", F.pmod("replica", F.lit(replicas))).groupBy("replica").applyInPandas(
            average, schema)
    row = models.head()
    if row is None:
        return begun
    flat = np.array(row["weights"], np.float32)
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, np.cumsum(sizes)[:-1]), begun, strict=True)]


def log_probabilities(types: np.ndarray, ends: np.ndarray, weights: list[np.ndarray], of: np.ndarray,
                      share: np.ndarray, step: int = 16_384) -> np.ndarray:
    """log P(token | both sides) of every token."""
    around = contexts(types, ends)
    out = np.empty(len(types))
    for i in range(0, len(types), step):
        logits = _forward(weights, around[i:i + step])[2]
        mine = types[i:i + step]
        own = logits[np.arange(len(mine)), of[mine]]
        out[i:i + step] = (own - np.log(np.exp(logits, out=logits).sum(1))) + share[mine]
    return out


def score(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE) -> DataFrame:
    """``(key, n_tokens, log_likelihood, mean_log_probability)`` of every whole text.

    A null, empty or blank text has no tokens, likelihood zero and a null mean. Rows with a null or
    repeated key are scored like others; an empty table gives no rows.
    """
    docs = df.select(F.col(key).alias("key"), text_bytes(text).alias("body")).select(
        "key", F.xxhash64("body").alias("h"), "body")
    # Splitting texts into words is dear: it is done once.
    tokens = materialize(tokenized(docs))
    counts = corpus_counts(tokens)
    of, share = classes_of(counts)
    shared = df.sparkSession.sparkContext.broadcast((fit(tokens, counts, rate), of, share.astype(np.float32)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        types, ends = unpacked(batch.column("types"))
        value = log_probabilities(types, ends, *shared.value)
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)
        total = np.bincount(row, value, len(size))
        mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(size, pa.int64()), pa.array(total), mean],
                                          ["key", "n_tokens", "log_likelihood", "mean_log_probability"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(tokens.select("key", "types"), run,
                     f"key {kind}, n_tokens long, log_likelihood double, mean_log_probability double",
                     "types", SLICE_BYTES).withColumnRenamed("key", key)
