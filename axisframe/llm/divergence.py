"""How far the sources of a language differ in their terms: in-mapper stripes.

A task folds whole documents into stripes: per language and term the number of documents and the count
in every source. It hands its stripes on when it holds many and at its end; Spark merges them by
language and term. A merged stripe holds all that a term adds to any divergence, so the second pass
walks the merged stripes once and emits partial sums per pair of sources and the best terms per source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm.common import forget, release_buffers, text_bytes
from axisframe.session import materialize

#: A term is a run of letters: A-Z, a-z and every character beyond ASCII, all of whose UTF-8 bytes are.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Cells (a term's count in a source) that a task holds before it hands its stripes on.
CELLS = 400_000
#: Bytes of a text that are folded at a time.
PIECE = 4 << 20
#: Sources of one side of a block of pairs, and sums that a task holds before it hands them on.
SIDE, SUMS = 256, 1 << 20

_CELL = "struct<source:string,n:long>"


def terms(body: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text with A-Z lowered, in pieces that end where a term ends."""
    at = 0
    while at < len(body):
        end = at + piece
        while end < len(body) and TERM.match(body, end - 1, end) and TERM.match(body, end, end + 1):
            end += 1
        # Lowering bytes changes A-Z alone.
        yield TERM.findall(body[at:end].lower())
        at = end


class Stripes:
    """By language, ``term -> {source: count}``, with the number of documents under the source null.

    The term null counts the documents themselves.
    """

    def __init__(self) -> None:
        self.table: dict[str, dict[bytes | None, dict[str | None, int]]] = {}
        self.cells = 0

    def add(self, body: bytes, lang: str, source: str) -> None:
        counts: Counter[bytes | None] = Counter()
        for piece in terms(body):
            counts.update(piece)
        counts[None] = 1
        table = self.table.setdefault(lang, {})
        stripe_of, new = table.get, 0
        for term, n in counts.items():
            stripe = stripe_of(term)
            if stripe is None:
                table[term] = {None: 1, source: n}
                new += 1
            else:
                stripe[None] += 1
                if source in stripe:
                    stripe[source] += n
                else:
                    stripe[source] = n
                    new += 1
        self.cells += new

    def take(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """All stripes, a few thousand a batch; the table is empty afterwards."""
        for lang, table in self.table.items():
            found = iter(table.items())
            while part := list(islice(found, rows)):
                stripes = [stripe for _, stripe in part]
                n_docs = [stripe.pop(None) for stripe in stripes]
                ends = np.cumsum([0, *map(len, stripes)], dtype=np.int32)
                cells = pa.StructArray.from_arrays(
                    [pa.array(list(chain.from_iterable(stripes)), pa.string()),
                     pa.array(list(chain.from_iterable(s.values() for s in stripes)), pa.int64())], ["source", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(part)), pa.array([term for term, _ in part], pa.binary()).cast(pa.string()),
                     pa.array(n_docs, pa.int64()), pa.ListArray.from_arrays(ends, cells)],
                    ["lang", "term", "n_docs", "cells"])
        self.table, self.cells = {}, 0


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
            most: int = CELLS) -> DataFrame:
    """``(lang, term, n_docs, cells)``: the stripes of the whole table, one row per language and term.

    The row with a null term counts the documents of the language and of its sources. Null text, lang
    and source are read as ''. A task hands on at most one row per language and term each time it holds
    ``most`` cells, so a very common term is a few rows per task before the merge.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = Stripes()
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.add(*(x.as_py() for x in row))
                if held.cells >= most:
                    yield from held.take()
        yield from held.take()
        release_buffers()

    read = docs.select(text_bytes(text).alias("body"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                                                         for c, n in ((lang, "lang"), (source, "source"))])
    spilled = read.mapInArrow(run, f"lang string, term string, n_docs long, cells array<{_CELL}>")
    # One shuffle by (lang, term): the sums by source below stay inside its partitions.
    merged = spilled.repartition("lang", "term")
    cells = merged.select("lang", "term", F.explode(F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("source"), F.col("n_docs").alias("n"))),
        "cells")).alias("cell"))
    counted = cells.groupBy("lang", "term", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"))
    return counted.groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("n_docs"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("cells"))


def shares(count: np.ndarray, total: np.ndarray | int, n_terms: int, prior: int) -> np.ndarray:
    """``1 + floor(10^9 (count + prior) / (total + prior n_terms))``, exact for totals up to 9 * 10^15."""
    below = total + prior * n_terms
    rest = count + prior
    out = rest // below  # one if a single term holds everything, else zero
    rest = rest - out * below
    for _ in range(3):  # long division, three digits at a time
        rest = rest * 1000
        digits = rest // below
        out = out * 1000 + digits
        rest = rest - digits * below
    return out + 1


class Partials:
    """What one task's merged stripes add to the divergences of the sources."""

    def __init__(self, prior: int, top: int) -> None:
        self.prior, self.top = prior, top
        self.names: dict[str, list[str]] = {}
        self.sums: dict[tuple[str, int, int], np.ndarray] = {}
        self.best: dict[tuple[str, str], list[tuple[int, str]]] = {}

    def add(self, lang: str, groups: list[dict], n_terms: int, words: np.ndarray, cells: pa.ListArray) -> None:
        """Terms ``words`` of a language, with their counts by source."""
        names = self.names[lang] = [g["source"] for g in groups]
        place = {s: i for i, s in enumerate(names)}
        flat = cells.flatten()
        row = np.repeat(np.arange(len(words)), np.diff(cells.offsets.to_numpy()))
        column = np.fromiter(map(place.__getitem__, flat.field("source").to_pylist()), np.int64, len(flat))
        count = np.zeros((len(words), len(names)), np.int64)
        count[row, column] = flat.field("n").to_numpy()
        total = np.array([g["n"] for g in groups], np.int64)
        share = shares(count, total, n_terms, self.prior)
        excess = share - shares(count.sum(1), int(total.sum()), n_terms, self.prior)[:, None]
        for j, name in enumerate(names):
            above = np.flatnonzero((count[:, j] > 0) & (excess[:, j] > 0))
            if len(above):
                self._rank((lang, name), excess[above, j], words[above])
        for a in range(0, len(names), SIDE):
            for b in range(a, len(names), SIDE):
                block = np.array([np.abs(share[:, i, None] - share[:, b:b + SIDE]).sum(0)
                                  for i in range(a, min(a + SIDE, len(names)))])
                held = self.sums.get((lang, a, b))
                self.sums[lang, a, b] = block if held is None else held + block

    def _rank(self, group: tuple[str, str], value: np.ndarray, words: np.ndarray) -> None:
        if len(value) > self.top:
            least = np.partition(value, len(value) - self.top)[len(value) - self.top]
            value, words = value[value >= least], words[value >= least]
        # Python orders strings by code points, which is the order of their UTF-8 bytes.
        found = self.best.get(group, []) + list(zip((-value).tolist(), words.tolist(), strict=True))
        self.best[group] = sorted(found)[:self.top]

    def full(self) -> bool:
        return sum(x.size for x in self.sums.values()) + self.top * len(self.best) > SUMS

    def take(self) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), block in self.sums.items():
            names = self.names[lang]
            left, right = np.divmod(np.arange(block.size), block.shape[1])
            once = a + left < b + right
            yield _rows(lang, [names[a + i] for i in left[once]], "pair", [names[b + i] for i in right[once]],
                        block.reshape(-1)[once])
        for (lang, source), found in self.best.items():
            yield _rows(lang, [source] * len(found), "term", [w for _, w in found], [-v for v, _ in found])
        self.sums, self.best = {}, {}


def _rows(lang: str, sources: list[str], part: str, items: list[str], values) -> pa.RecordBatch:
    n = len(sources)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(sources, pa.string()), pa.array([part] * n, pa.string()),
         pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                least_docs: int = 30, prior: int = 5, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every language and source.

    A language keeps its terms found in at least ``least_docs`` of its documents. A group (a source of a
    language, or the language) gives a kept term the share ``1 + floor(10^9 (count + prior) / (N + prior V))``,
    with N the group's count of kept terms and V their number. Part ``pair``: the other sources of the
    language by the summed difference of shares (0 without kept terms), all of them. Part ``term``: the
    ``top`` kept terms found in the source whose share exceeds the language's, by that excess. Ranks start
    at 1, larger values first, ties by item in UTF-8 order. Null text, lang and source are read as '';
    repeated rows are documents of their own; extra columns are ignored; an empty table gives no rows.
    """
    merged = materialize(stripes(docs, text, lang, source))
    kept = merged.where(F.col("term").isNotNull() & (F.col("n_docs") >= least_docs))
    counts = (kept.select("lang", F.explode("cells").alias("cell"))
              .groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n")))
    groups = merged.where(F.col("term").isNull()).select("lang", F.explode("cells.source").alias("source"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = groups.join(counts, ["lang", "source"], "left").select(
        "lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("group"))
    # One row per language: its sources in order, their totals and the number of kept terms.
    profiles = materialize(
        totals.groupBy("lang").agg(F.sort_array(F.collect_list("group")).alias("groups"))
        .join(sizes, "lang", "left").select("lang", "groups", F.coalesce("n_terms", F.lit(0)).alias("n_terms")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = Partials(prior, top)
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for one in dict.fromkeys(langs.tolist()):
                part = batch.filter(pa.array(langs == one))
                held.add(one, part.column("groups")[0].as_py(), part.column("n_terms")[0].as_py(),
                         part.column("term").to_numpy(zero_copy_only=False), part.column("cells"))
            if held.full():
                yield from held.take()
        yield from held.take()
        release_buffers()

    partial = materialize(kept.select("lang", "term", "cells").join(profiles, "lang").mapInArrow(
        run, "lang string, source string, part string, item string, value long"))
    sources = profiles.select("lang", "groups", F.posexplode("groups.source").alias("at", "source"))
    pairs = sources.select("lang", "source", F.explode(F.slice(
        "groups.source", F.col("at") + 2, F.size("groups"))).alias("item"))
    summed = (pairs.join(partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")),
                         ["lang", "source", "item"], "left")
              .select("lang", F.lit("pair").alias("part"), F.coalesce("value", F.lit(0)).alias("value"),
                      F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("item").alias("item")),
                                        F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
              .select("lang", "x.source", "part", "x.item", "value"))
    # A group has one row per other source, and at most ``top`` terms per task.
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return (summed.unionByName(partial.where("part = 'term'")).withColumn("rank", F.row_number().over(order).cast("int"))
            .where((F.col("part") == "pair") | (F.col("rank") <= top)))
