"""Benchmark decontamination: q-gram lemma filter and banded alignment.

An item of n characters that stands in a text with at most e edits keeps n - q + 1 - q * e of its
q-grams there, on diagonals (text place less item place) that differ by at most e. Shared q-grams are
counted in diagonal bands that overlap by e, so some band holds all of them; bands with enough are
aligned within the band, and alignments within the budget are leaks. The lemma needs q * (e + 1) <= n:
items too short for the usual q have their own, smaller one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import keep_rows, map_arrow, text_bytes
from axisframe.llm.suffix_dedup import _BASE, _powers

Q = 10
RATE = 0.08
#: Shorter items are no evidence and are not looked for.
SHORTEST = 3
#: Items are handed to the tasks in blocks of about so many characters; each block is one pass.
BLOCK_CHARS = 4_000_000
_SLOT_BITS = 22
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def characters(text: str) -> np.ndarray:
    """Code points of a text, lowered and with all white space as blanks; places stay as they are."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    out[(out >= 9) & (out <= 13) | (out == 0xA0)] = 32
    return out


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at every place."""
    n = len(chars)
    if n < q:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(chars * _powers(_BASE, n), out=sums[1:])
    out = (sums[q:] - sums[:-q]) * _powers(pow(_BASE, -1, 1 << 64), n - q + 1)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def gram_size(length: int, q: int, rate: float) -> int:
    """The largest q up to the given one of which an item within its budget keeps a q-gram."""
    return min(q, max(1, length // (math.floor(rate * length) + 1)))


@dataclass
class Index:
    """The q-grams of a block of items, for which one q holds, with their places."""

    q: int
    ids: list
    items: list[np.ndarray]
    size: np.ndarray
    budget: np.ndarray
    need: np.ndarray      # q-grams that a band must share
    seen: np.ndarray      # a bit for the first bits of each hash
    keys: np.ndarray
    first: np.ndarray     # where the places of a key start
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: list[str], q: int, rate: float) -> Index:
        items = [characters(t) for t in texts]
        size = np.array([len(x) for x in items], np.int64)
        budget = np.floor(rate * size).astype(np.int64)
        hashes = [grams(x, q) for x in items]
        lengths = [len(h) for h in hashes]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(items)), lengths)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in lengths)])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        seen = np.zeros(1 << _SLOT_BITS, bool)
        seen[keys >> np.uint64(64 - _SLOT_BITS)] = True
        return cls(q, ids, items, size, budget, size - q + 1 - q * budget, seen, keys,
                   np.append(first, len(flat)), item[order], place[order])


def candidates(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, index: Index
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, item, lowest diagonal)`` of the bands with enough shared q-grams."""
    hit = np.flatnonzero(index.seen[hashes >> np.uint64(64 - _SLOT_BITS)])
    key = np.searchsorted(index.keys, hashes[hit])
    key = np.minimum(key, max(len(index.keys) - 1, 0))
    true = index.keys[key] == hashes[hit] if len(index.keys) else np.zeros(len(hit), bool)
    hit, key = hit[true], key[true]
    times = index.first[key + 1] - index.first[key]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    entry = np.repeat(index.first[key], times) + nth
    item, diagonal, doc = index.item[entry], np.repeat(at[hit], times) - index.place[entry], np.repeat(doc[hit], times)
    place = index.place[entry]
    # pairs with too few shared q-grams in all need no bands
    pair = doc * len(index.items) + item
    names, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (count >= index.need[names % max(len(index.items), 1)])[inverse]
    item, diagonal, doc, place = item[enough], diagonal[enough], doc[enough], place[enough]
    step = index.budget[item] + 16
    band = diagonal // step
    also = diagonal - band * step < index.budget[item]  # the band before reaches here too
    rows = np.concatenate([np.stack([doc, item, band, place], 1), np.stack([doc, item, band - 1, place], 1)[also]])
    rows = np.unique(rows, axis=0) if len(rows) else rows
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))
    start = np.flatnonzero(fresh)
    shared = np.diff(np.append(start, len(rows)))
    doc, item, band = rows[start, 0], rows[start, 1], rows[start, 2]
    keep = shared >= index.need[item]
    return doc[keep], item[keep], (band * (index.budget[item] + 16))[keep]


def align(chars: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, diagonal: np.ndarray,
          index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distance, start, end)`` of each item's best place within its band, in ``chars[low:high]``.

    Row i of the table is the item's i-th character, a column is a diagonal; the start of the text is
    free. A cell holds its cost and, in its low bits, the column where its path began.
    """
    reach = index.budget[item]
    left = diagonal - reach
    width = int((reach * 3 + 16).max())
    rows = int(index.size[item].max())
    letters = np.zeros((len(item), rows), np.uint32)
    for i, k in enumerate(item):
        letters[i, :index.size[k]] = index.items[k]
    columns = np.arange(width)
    cost = np.int64(1) << 20
    far = cost * (1 << 20)
    cell = np.broadcast_to(columns, (len(item), width)).astype(np.int64)
    begin = left[:, None] + columns
    room = high - low
    cell = np.where((begin >= 0) & (begin <= room[:, None]), cell, far)
    best = np.full(len(item), far)
    end = np.zeros(len(item), np.int64)
    for i in range(1, rows + 1):
        at = begin + i  # text characters used
        inside = (at >= 1) & (at <= room[:, None])
        letter = chars[np.where(inside, low[:, None] + at - 1, 0)]
        step = np.where(inside, cell + cost * (letter != letters[:, [i - 1]]), far)
        skip = np.concatenate([cell[:, 1:], np.full((len(item), 1), far)], 1) + cost
        step = np.where((at >= 0) & (at <= room[:, None]), np.minimum(step, skip), far)
        step = np.minimum.accumulate(step - columns * cost, axis=1) + columns * cost
        cell = np.where((at >= 0) & (at <= room[:, None]), step, far)
        done = index.size[item] == i
        if done.any():
            column = cell[done].argmin(1)
            best[done] = cell[done][np.arange(len(column)), column]
            end[done] = left[done] + column + i
    return best // cost, left + best % cost, end


def leaks_in(texts: list[str], block: list[Index]) -> list[tuple[int, object, int, int, int]]:
    """``(row, item, start, end, distance)`` of the leaks in some texts."""
    parts = [characters(t) for t in texts]
    return [(row, index.ids[k], start, end, distance) for index in block
            for row, k, start, end, distance in _leaks_of(parts, index)]


def _leaks_of(parts: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    q = index.q
    ends = np.cumsum([0, *map(len, parts)])
    chars = np.concatenate([np.zeros(0, np.uint32), *parts])
    hashes = grams(chars, q)
    doc = np.repeat(np.arange(len(parts)), np.diff(ends))[:len(hashes)]
    place = np.arange(len(hashes)) - ends[doc]
    inside = place + q <= np.diff(ends)[doc]
    doc, item, diagonal = candidates(hashes[inside], place[inside], doc[inside], index)
    found = set()
    for i in range(0, len(doc), 2048):
        d, k = doc[i:i + 2048], item[i:i + 2048]
        distance, start, end = align(chars, ends[d], ends[d + 1], k, diagonal[i:i + 2048], index)
        good = distance <= index.budget[k]
        found.update(zip(d[good].tolist(), k[good].tolist(), start[good].tolist(), end[good].tolist(),
                         distance[good].tolist(), strict=True))
    return sorted(found)


def indexes(benchmark: DataFrame, item: str, text: str, q: int, rate: float) -> list:
    """Broadcast lists of indexes of the items, one list for about ``BLOCK_CHARS`` characters."""
    total = benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).head()[0]
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    items = benchmark.where(F.length(text) >= SHORTEST).select(
        F.col(item).alias("id"), F.col(text).alias("body"),
        F.pmod(F.xxhash64(item, text), F.lit(blocks)).alias("block")).distinct()
    out = []
    for block in range(blocks):
        of_size: dict[int, list] = {}
        for row in items.where(F.col("block") == block).collect():
            of_size.setdefault(gram_size(len(row["body"]), q, rate), []).append(row)
        built = [Index.build([r["id"] for r in rows], [r["body"] for r in rows], size, rate)
                 for size, rows in sorted(of_size.items())]
        out.append(benchmark.sparkSession.sparkContext.broadcast(built))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` without leaks, with all their columns."""
    for index in indexes(benchmark, item, item_text, q, rate):
        def free(body: pa.Array, index=index) -> pa.Array:
            found = leaks_in([v.as_py().decode("utf-8", "replace") for v in body], index.value)
            kept = np.ones(len(body), bool)
            kept[[row for row, *_ in found]] = False
            return pa.array(kept)

        docs = keep_rows(docs, free, text)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """``(key, item, start, end, distance)``: where items of ``benchmark`` stand in ``docs``.

    Offsets are characters. An item leaks where it stands with at most ``rate`` of its length in edits;
    of a document's places on neighbouring diagonals each best one is a row. Items that are null or
    shorter than ``SHORTEST`` characters, and texts that are null or empty, have no leaks; items with a null id
    and documents with a null key are looked up like others; a repeated row repeats its leaks. The items
    are walked in blocks of a fixed size, one pass over the documents each.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, key), (benchmark, item)))
    source = docs.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    out = None
    for index in indexes(benchmark, item, item_text, q, rate):
        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            texts = [v.as_py().decode("utf-8", "replace") for v in batch.column("body")]
            found = leaks_in(texts, index.value)
            row, names, start, end, distance = zip(*found, strict=True) if found else ((),) * 5
            return pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row, pa.int64())), pa.array(list(names), _ARROW.get(item_kind)),
                 *(pa.array(x, pa.int32()) for x in (start, end, distance))],
                ["key", "item", "start", "end", "distance"])

        part = map_arrow(source, run, f"key {kind}, item {item_kind}, start int, end int, distance int", "body")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item})
