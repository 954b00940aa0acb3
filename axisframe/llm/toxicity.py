"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, lowered. The field has two labels and scores a token by its word and its
first letters; a label pair has a transition weight. Token labels come from the document labels: in a
toxic document of the sample, a token is toxic if its word or beginning is found in toxic documents far
more often than chance allows. Marginals of the forward-backward recursion give spans and, through
a small calibration, the document's score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import map_arrow, text_bytes
from axisframe.llm.labelled import fold, sample
from axisframe.session import discard, materialize

TOKEN = re.compile(r"[^\W\d_]+")
#: The fit reads so many documents of each label at most.
FIT_DOCUMENTS = {0: 2500, 1: 1500}
FEATURES = 1 << 16
#: Tokens of a piece, and how many pieces with and without toxic tokens the fit takes of a document at
#: most, evenly spread over it.
PIECE, PIECES = 64, 6
#: Twice the log-likelihood ratio that a word or beginning must reach to mark tokens as toxic.
EVIDENCE = 25.0
#: A task remembers the scores of so many words.
MAX_WORDS = 400_000
SLICE_BYTES = 24 << 20


def lowered(text: str) -> str:
    """The text in lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def units(word: str) -> list[str]:
    """The features of a word: itself and its beginnings of three to seven letters."""
    return ["=" + word, *(word[:n] for n in range(3, 8) if n <= len(word))]


def _slot(unit: str) -> int:
    return zlib.crc32(unit.encode()) % FEATURES


@dataclass
class Field:
    weights: np.ndarray      # of a feature, for toxic over clean
    move: np.ndarray         # move[a, b]: from label a to label b
    start: float             # of a toxic first token
    shape: np.ndarray        # calibration: offset, largest log-odds, log count

    def emission(self, word: str) -> float:
        return float(sum(self.weights[_slot(u)] for u in units(word)))


def _advance(odds: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log-odds of the next label from those of this one."""
    return np.logaddexp(move[0, 1], move[1, 1] + odds) - np.logaddexp(move[0, 0], move[1, 0] + odds)


def marginals(emissions: np.ndarray, ends: np.ndarray, field: Field) -> np.ndarray:
    """Log-odds of the toxic label at every token; ``ends`` are the borders of the sequences.

    Forward and backward messages are log-odds, so two labels need one number. All sequences go
    in step, longest first, and a step works on those that still have tokens.
    """
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], ends[:-1][order]
    ahead, back = np.zeros(len(emissions)), np.zeros(len(emissions))
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # sequences longer than the step
    message = np.full(len(size), field.start)
    for step in range(steps):
        at = first[:alive[step]] + step
        ahead[at] = message[:alive[step]] + emissions[at]
        message[:alive[step]] = _advance(ahead[at], field.move)
    message = np.zeros(len(size))
    for step in range(steps - 1, -1, -1):
        at = first[:alive[step]] + step
        back[at] = message[:alive[step]]
        message[:alive[step]] = _advance(back[at] + emissions[at], field.move.T)
    return ahead + back


def telling(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """The units that ``a`` of ``n1`` toxic and ``b`` of ``n0`` other documents hold, where that is no chance."""
    a, b = F.col("a"), F.col("b")
    p, q, r = a / n1, F.greatest(b, F.lit(1e-9)) / n0, (a + b) / (n0 + n1)
    likelihood = (a * F.log(p / r) + b * F.log(q / r)
                  + F.when(a < n1, (n1 - a) * F.log((1 - p) / (1 - r))).otherwise(0.0)
                  + F.when(b < n0, (n0 - b) * F.log((1 - q) / (1 - r))).otherwise(0.0))
    return counts.where((a > 0) & ((a / n1 > 20 * (b + 0.5) / n0) | ((a > 3) & (b == 0)))).where(2 * likelihood >= EVIDENCE)


def pieces_of(words: list[str], toxic: bool, bad: set[str], piece: int = PIECE, most: int = PIECES
              ) -> list[tuple[list[str], list[bool]]]:
    """Spread pieces of a document with their token labels: toxic ones hold a token that tells."""
    marks = [toxic and not bad.isdisjoint(units(w)) for w in words]
    cuts = range(0, len(words), piece)
    hot = [c for c in cuts if any(marks[c:c + piece])]
    cold = [c for c in cuts if not any(marks[c:c + piece])]
    taken = [part[i * len(part) // most] if len(part) > most else part[i]
             for part in (hot, cold) for i in range(min(most, len(part)))]
    return [(words[c:c + piece], marks[c:c + piece]) for c in taken]


def fit(pieces: list[tuple[list[str], list[bool]]], epochs: int = 30, rate: float = 0.3) -> Field:
    """Train on marked pieces: the gradient is what the marks hold less what is expected."""
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, np.array([-2.0, 1.0, 0.0]))
    y = np.concatenate([np.zeros(0), *(np.asarray(m, float) for _, m in pieces)])
    ends = np.cumsum([0, *(len(w) for w, _ in pieces)])
    table: dict[str, array] = {}
    slots, lengths = array("i"), array("i")
    for words, _ in pieces:
        for word in words:
            known = table.get(word)
            if known is None:
                known = table[word] = array("i", [_slot(u) for u in units(word)])
            slots.extend(known)
            lengths.append(len(known))
    slots, owner = np.frombuffer(slots, np.int32), np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    if not len(y):
        return field
    follows = np.ones(len(y), bool)
    follows[ends[:-1][np.diff(ends) > 0]] = False
    here = np.flatnonzero(follows)
    scale = np.zeros(FEATURES)
    move_scale = np.zeros((2, 2))
    for _ in range(epochs):
        emissions = np.bincount(owner, field.weights[slots], len(y))
        odds = marginals(emissions, ends, field)
        p = 1 / (1 + np.exp(-odds))
        miss = y - p
        gradient = np.bincount(slots, miss[owner], FEATURES) - 0.05 * field.weights
        scale += gradient ** 2
        field.weights += rate * gradient / np.sqrt(scale + 1e-6)
        # pairs: what is marked less the pairwise marginals, from messages of both sides
        ahead, back = _messages(emissions, ends, field)
        pair = np.stack([np.zeros(len(here)) + field.move[0, 0], field.move[0, 1] + back[here],
                         ahead[here - 1] + field.move[1, 0], ahead[here - 1] + field.move[1, 1] + back[here]])
        pair = np.exp(pair - pair.max(0))
        pair /= pair.sum(0)
        seen = np.array([((1 - y[here - 1]) * (1 - y[here])).sum(), ((1 - y[here - 1]) * y[here]).sum(),
                         (y[here - 1] * (1 - y[here])).sum(), (y[here - 1] * y[here]).sum()])
        step = (seen - pair.sum(1)).reshape(2, 2) - 0.05 * field.move
        move_scale += step ** 2
        field.move += rate * step / np.sqrt(move_scale + 1e-6)
        starts = ends[:-1][np.diff(ends) > 0]
        field.start += rate * float(miss[starts].mean())
    return field


def _messages(emissions: np.ndarray, ends: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds with the token's own score, and backward log-odds with it."""
    total = marginals(emissions, ends, field)
    size = np.diff(ends)
    back = np.zeros(len(emissions))
    order = np.argsort(-size, kind="stable")
    size, first = size[order], ends[:-1][order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")
    message = np.zeros(len(size))
    for step in range(steps - 1, -1, -1):
        at = first[:alive[step]] + step
        back[at] = message[:alive[step]]
        message[:alive[step]] = _advance(back[at] + emissions[at], field.move.T)
    return total - back, back + emissions


def summaries(odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per sequence: one, the largest log-odds, and the log of one more than the tokens expected toxic."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    top = np.full(n, -12.0)
    np.maximum.at(top, owner, odds)
    sure = np.where(odds > 0, 1 / (1 + np.exp(-np.abs(odds))), 0)
    return np.stack([np.ones(n), np.clip(top, -12, 12), np.log1p(np.bincount(owner, sure, n))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the prior is the starting point."""
    start = w.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - ridge * (w - start))
    return w


def _tokens(batch: pa.RecordBatch) -> list[list[str]]:
    return [TOKEN.findall(lowered((v.as_py() or b"").decode("utf-8", "replace"))) for v in batch.column("body")]


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held_out: Column) -> Field:
    """The field of a sample of labelled documents.

    Whole texts stay in the tasks: Spark counts the units by label, and the driver gets the telling units,
    at most twelve marked pieces a document, and three numbers a document for the calibration.
    """
    chosen = materialize(sample(docs.select(key, text_bytes(text).alias("body")), labels, key, label, held_out,
                                FIT_DOCUMENTS).select(F.xxhash64(key).alias("o"), "y", "body"))
    sizes = dict(chosen.groupBy("y").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [{u for w in set(words) for u in units(w)} for words in _tokens(batch)]
        sizes = np.array([len(f) for f in found], np.int64)
        y = np.repeat(batch.column("y").to_numpy(zero_copy_only=False), sizes)
        return pa.RecordBatch.from_arrays([pa.array([u for f in found for u in f], pa.string()), pa.array(y, pa.int32())],
                                          ["unit", "y"])

    bad: set[str] = set()
    if n0 and n1:
        counts = map_arrow(chosen, held, "unit string, y int", "body", SLICE_BYTES).groupBy("unit").agg(
            F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        bad = {r["unit"] for r in telling(counts, n1, n0).select("unit").collect()}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, at, words, marks = [], [], [], []
        toxic = batch.column("y").to_pylist()
        for row, tokens in enumerate(_tokens(batch)):
            for n, (some, labels_) in enumerate(pieces_of(tokens, bool(toxic[row]), bad)):
                of.append(row)
                at.append(n)
                words.append(some)
                marks.append(labels_)
        return pa.RecordBatch.from_arrays(
            [batch.column("o").take(pa.array(of, pa.int64())), pa.array(at, pa.int32()),
             pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.bool_()))], ["o", "n", "words", "marks"])

    rows = map_arrow(chosen, cut, "o long, n int, words array<string>, marks array<boolean>", "body", SLICE_BYTES)
    names: dict[str, str] = {}  # one object per distinct word
    field = fit([([names.setdefault(w, w) for w in r["words"]], r["marks"])
                 for r in rows.orderBy("o", "n").toLocalIterator()])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _summaries_of(_tokens(batch), _Scores(field))
        return pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), *(pa.array(x[:, i]) for i in (1, 2))],
                                          ["o", "y", "top", "sure"])

    seen = map_arrow(chosen, measure, "o long, y int, top double, sure double", "body", SLICE_BYTES).orderBy("o").toPandas()
    discard(chosen)
    if len(seen):
        x = np.column_stack([np.ones(len(seen)), seen["top"], seen["sure"]])
        field.shape = _logistic(x, seen["y"].to_numpy(float), field.shape)
    return field


class _Scores(dict):
    """Emissions by word, worked out on first use and forgotten together when there are too many."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = self.field.emission(word)
        return value


def _odds_of(tokens: list[list[str]], scores: _Scores) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of all tokens of some documents, and the borders of the documents."""
    of = scores.__getitem__
    parts = [np.fromiter(map(of, words), float, len(words)) for words in tokens]
    ends = np.cumsum([0, *map(len, parts)])
    return marginals(np.concatenate([np.zeros(0), *parts]), ends, scores.field), ends


def _summaries_of(tokens: list[list[str]], scores: _Scores) -> np.ndarray:
    return summaries(*_odds_of(tokens, scores))


def tag(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, spans)``: the score of every whole text and its toxic spans.

    A span is ``(start, end)`` in characters: neighbouring tokens that are toxic rather than not. Texts
    that are null, empty or without letters have no spans and the score of no evidence.
    """
    scores = _Scores(field)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [lowered((v.as_py() or b"").decode("utf-8", "replace")) for v in batch.column("body")]
        odds, ends = _odds_of([TOKEN.findall(value) for value in texts], scores)
        x = summaries(odds, ends)
        prob = 1 / (1 + np.exp(-x @ field.shape))
        spans = []
        for value, a, b, top in zip(texts, ends, ends[1:], x[:, 1], strict=False):
            found: list[list[int]] = []
            if top > 0:
                last = -2
                for i, match in enumerate(TOKEN.finditer(value)):
                    if odds[a + i] > 0:
                        if i == last + 1:
                            found[-1][1] = match.end()
                        else:
                            found.append([match.start(), match.end()])
                        last = i
            spans.append([{"start": s, "end": e} for s, e in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prob), pa.array(spans, kind)],
                                          ["key", "score", "spans"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    return map_arrow(source, run, f"key {kind}, score double, spans array<struct<start:int,end:int>>",
                     "body", SLICE_BYTES).withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "toxic", parts: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """``(key, held_out, score, predicted, spans)`` of every document.

    Labels are learned only from rows whose ``fold`` is not ``held``; a row with a null key is scored
    and not held out. Without usable labels the field has no weights and nothing is predicted toxic.
    """
    field = train(docs, labels, key, text, label, fold(F.col(key), parts) == held)
    return tag(docs, field, key, text).select(
        key, (fold(F.col(key), parts) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
