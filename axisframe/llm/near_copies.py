"""Near copies by SimHash fingerprints and the exact Jaccard similarity of word shingles.

SimHash fingerprints of the same shingles come first: texts whose fingerprints differ in few bits are
candidates. Two texts of similarity 0.8 may differ in far more bits, so a prefix filter finds the rest:
with the shingles of all texts in one order, two texts of similarity 0.8 or more share a shingle among
the first n - ceil(0.8 n) + 1 of each, so joining on those loses no pair. Any order does; shingles that
a sample of the texts holds often come last, so that few texts meet by them. Texts that share a shingle
with many others are first compared with a few of them only, then with all that are still in another
component. Every candidate is first held against a bound from the marks of both texts, which rules out
most pairs and no similar one, and is then verified by the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm import simhash
from axisframe.llm.common import map_arrow, text_bytes
from axisframe.operators.graph import connected_components
from axisframe.session import discard, materialize

WORDS = 5
#: Least similarity, as a fraction: sizes and overlaps are compared in whole numbers.
LEAST = (4, 5)
#: A larger bucket is compared with CENTRES of its members before the rest.
SMALL_BUCKET, CENTRES = 32, 4
#: For the order alone: one text in SAMPLED is counted, shingles of OFTEN such texts come last, at most MOST_OFTEN.
SAMPLED, OFTEN, MOST_OFTEN = 16, 3, 200_000
#: Least and most bits of a text's marks; between them, one for each shingle at least.
MARK_BITS = (512, 32_768)


def words_of(text: bytes) -> list[bytes]:
    """Words as in ``simhash.fingerprint``: A-Z lowered, cut at ASCII white space."""
    return text.lower().split()


def text_id(text: bytes) -> int:
    """64-bit hash of the words; texts with the same words are one text."""
    return xxhash.xxh3_64_intdigest(b" ".join(words_of(text)))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of all shingles; with fewer words the whole sequence is the one
    shingle, without words there is none."""
    parts = words_of(text)
    if not parts:
        return np.zeros(0, np.uint64)
    width = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(parts) - width + 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)],
                              np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have at least the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def marks(grams: np.ndarray) -> bytes:
    """For each place of a bit map whether an odd number of shingles falls on it; a power of two of places.

    The marks of two sets differ in no more places than there are shingles in one set alone. Folding
    the halves of a map over each other gives the marks of half the places.
    """
    bits = min(max(MARK_BITS[0], 1 << (len(grams) - 1).bit_length()), MARK_BITS[1])
    odd = np.bincount((grams & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Marks, one row each, as ``width`` words of 64 bits; their own width is that times a power of two."""
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def possible(n: np.ndarray, other: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``other`` shingles may be similar if at least ``apart`` are in one of them alone."""
    return (LEAST[1] - LEAST[0]) * (n.astype(np.int64) + other) >= (LEAST[0] + LEAST[1]) * apart.astype(np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _named(df: DataFrame, key: str, text: str, *columns: str) -> DataFrame:
    """``columns`` of ``df`` as ``row``, its key as ``k`` and the id of its text as ``sid``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [_signed(text_id(t.as_py())) for t in batch.column("body")]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(ids, pa.int64())],
                                          ["row", "k", "sid"])

    rows = df.select(F.struct(*columns).alias("row"), F.col(key).alias("k"), text_bytes(text).alias("body"))
    return map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, "
                     f"k {df.schema[key].dataType.simpleString()}, sid long", "body")


def _often(texts: DataFrame) -> np.ndarray:
    """Shingles that many sampled texts hold, rarest first."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t.as_py()) for t in batch.column("body")]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["g"])

    sample = texts.where(F.pmod(F.xxhash64("sid"), F.lit(SAMPLED)) == 0)
    counted = map_arrow(sample, run, "g long", "body").groupBy("g").agg(F.count("*").alias("n"))
    rows = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "g").limit(MOST_OFTEN).toPandas()
    return rows["g"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def prefix(grams: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the common order; ``often`` is sorted and ``rank`` its place from 1."""
    n = len(grams)
    take = n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0
    place = np.zeros(n, np.int64)
    if len(often) and n:
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        known = often[at] == grams
        place[known] = rank[at[known]]
    return grams[np.lexsort((grams, place))[:take]]


def prefixes(texts: DataFrame, often: np.ndarray) -> DataFrame:
    """``(bucket, n, sid)`` for every shingle of every text's prefix."""
    order = np.argsort(often)
    shared = texts.sparkSession.sparkContext.broadcast((often[order], order + 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py()) for t in batch.column("body")]
        first = [prefix(s, *shared.value) for s in sets]
        times = list(map(len, first))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(first).view(np.int64)),
             pa.array(np.repeat(np.array(list(map(len, sets)), np.int32), times)),
             pa.array(np.repeat(batch.column("sid").to_numpy(), times))], ["bucket", "n", "sid"])

    return map_arrow(texts, run, "bucket long, n int, sid long", "body")


def _runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The columns of whole runs of equal ``bucket``, many runs at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        bucket = columns[0]
        if not len(bucket):
            continue
        if bucket[0] == bucket[-1] and (not held or held[-1][0][-1] == bucket[0]):
            held.append(columns)
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        held.append([c[:cut] for c in columns])
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[c[cut:] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _fits(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return small.astype(np.int64) * LEAST[1] >= large.astype(np.int64) * LEAST[0]


def _batch(bucket, n, left, right) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int32()),
                                       pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                      ["bucket", "n", "src", "dst"])


def cards(texts: DataFrame) -> DataFrame:
    """``(sid, fp, n, marks)`` of every text: its SimHash fingerprint, number of shingles and marks."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [t.as_py() for t in batch.column("body")]
        sets = [shingles(t) for t in bodies]
        fps = np.array([simhash.fingerprint(t, WORDS) for t in bodies], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("sid"), pa.array(fps), pa.array(list(map(len, sets)), pa.int32()),
             pa.array(list(map(marks, sets)), pa.binary())], ["sid", "fp", "n", "marks"])

    return map_arrow(texts, run, "sid long, fp long, n int, marks binary", "body")


def fingerprint_pairs(known: DataFrame) -> DataFrame:
    """``(src, dst)`` candidates whose SimHash fingerprints link; texts of one fingerprint form a star."""
    first = materialize(known.groupBy("fp").agg(F.min("sid").alias("first")))
    same = known.join(first, "fp").where(F.col("sid") > F.col("first")).select(
        F.col("first").alias("src"), F.col("sid").alias("dst"))
    near = simhash.links(first.select("fp"))
    one, two = (first.select(F.col("fp").alias(end), F.col("first").alias(name))
                for end, name in (("src", "a"), ("dst", "b")))
    linked = near.join(one, "src").join(two, "dst").select(F.least("a", "b").alias("src"),
                                                           F.greatest("a", "b").alias("dst"))
    return same.unionByName(linked)


def likely(pairs: DataFrame, known: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """The distinct pairs ``(src, dst)`` that the marks of both texts do not rule out.

    Pairs within one component of ``joined``, ``(node, component)``, go too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(m.as_py(), np.uint64) for m in batch.column(c)] for c in ("a", "b"))
            apart = [int(np.bitwise_count(folded(x, min(len(x), len(y))) ^ folded(y, min(len(x), len(y)))).sum())
                     for x, y in zip(a, b, strict=True)]
            may = possible(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), np.array(apart, np.int64))
            yield batch.select(["src", "dst"]).filter(pa.array(may))

    distinct = pairs.select("src", "dst").distinct()
    if joined is not None:
        for end, name in (("src", "_s"), ("dst", "_d")):
            distinct = distinct.join(joined.select(F.col("node").alias(end), F.col("component").alias(name)), end, "left")
        distinct = distinct.where(F.coalesce("_s", "src") != F.coalesce("_d", "dst"))
    both = (distinct.join(known.select(F.col("sid").alias("src"), F.col("n").alias("n_a"), F.col("marks").alias("a")), "src")
            .join(known.select(F.col("sid").alias("dst"), F.col("n").alias("n_b"), F.col("marks").alias("b")), "dst"))
    return both.select("src", "dst", "n_a", "n_b", "a", "b").mapInArrow(run, "src long, dst long")


def _first_pairs(batches: Iterator[pa.RecordBatch], small: int, centres: int) -> Iterator[pa.RecordBatch]:
    """All pairs of small buckets; of others pairs with a few members, and the members themselves."""
    for bucket, n, sid in _runs(batches):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
        length = end - begin
        left, right, large = [], [], np.repeat(length > small, length)
        for a, b in zip(begin[length > small], end[length > small], strict=True):
            for c in a + (b - a) * (2 * np.arange(centres) + 1) // (2 * centres):
                near = _fits(np.minimum(n[a:b], n[c]), np.maximum(n[a:b], n[c]))
                right.append(sid[a:b][near])
                left.append(np.full(len(right[-1]), sid[c]))
        inside = np.repeat((length > 1) & (length <= small), length)
        held = [x[~large & inside] for x in (bucket, n, sid)]
        for away in range(1, min(small, len(held[0]))):
            near = (held[0][away:] == held[0][:-away]) & _fits(held[1][:-away], held[1][away:])
            left.append(held[2][:-away][near])
            right.append(held[2][away:][near])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
            none = pa.nulls(ends.shape[1])
            yield _batch(none.cast(pa.int64()), none.cast(pa.int32()), ends[0], ends[1])
        if large.any():
            yield _batch(bucket[large], n[large], sid[large], sid[large])


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket in different components that may be similar; rows come sorted by bucket and size."""
    for bucket, n, sid, component, mark in _runs(batches):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)])), strict=True):
            if (component[a:b] == component[a]).all():
                continue
            for first, end, rows in _levels(mark[a:b]):
                # The rows of one width meet those after them, of the next width at most.
                for i in range(first, end):
                    rest = slice(a + i + 1, a + first + len(rows))
                    near = np.flatnonzero((component[rest] != component[a + i]) & _fits(n[a + i], n[rest]))
                    apart = np.bitwise_count(rows[i - first + 1:][near] ^ rows[i - first]).sum(axis=1, dtype=np.int64)
                    other = sid[rest][near[possible(n[a + i], n[rest][near], apart)]]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, sid[a + i])),
                                                          pa.array(np.maximum(other, sid[a + i]))], ["src", "dst"])


def _levels(mark: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last row of each width, and the marks of these and of the next width's rows, equally wide.

    Sizes, and with them widths, ascend; similar sets are of one width or of neighbouring ones.
    """
    size = np.fromiter(map(len, mark), np.int64, len(mark))
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(mark)]
    blocks = [np.frombuffer(b"".join(mark[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(cuts, cuts[1:], strict=False)]
    for k, rows in enumerate(blocks):
        width = rows.shape[1]
        if k + 1 < len(blocks) and blocks[k + 1].shape[1] == 2 * width:
            rows = np.concatenate([rows, folded(blocks[k + 1], width)])
        yield cuts[k], cuts[k + 1], rows


def verified(pairs: DataFrame, texts: DataFrame, keep: int = 64) -> DataFrame:
    """The pairs ``(src, dst)`` of text ids that have the least similarity.

    Texts travel instead of their shingles, which are larger; a task keeps the last ``keep`` sets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def grams(sid: int, body: pa.Scalar) -> np.ndarray:
            if sid not in held:
                if len(held) >= keep:
                    held.pop(next(iter(held)))
                held[sid] = shingles(body.as_py())
            return held[sid]

        for batch in batches:
            src, dst, a, b = batch.columns
            yes = [similar(grams(src[i].as_py(), a[i]), grams(dst[i].as_py(), b[i])) for i in range(batch.num_rows)]
            yield batch.select(["src", "dst"]).filter(pa.array(yes, pa.bool_()))

    pairs = materialize(pairs.select("src", "dst").distinct())
    both = (pairs.join(texts.select(F.col("sid").alias("src"), F.col("body").alias("a")), "src")
            .join(texts.select(F.col("sid").alias("dst"), F.col("body").alias("b")), "dst"))
    found = materialize(both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long"))
    discard(pairs)
    return found


def links(texts: DataFrame, small: int = SMALL_BUCKET, centres: int = CENTRES) -> DataFrame:
    """``(src, dst)`` edges among the texts ``(sid, body)``: the same components as all pairs of the
    least similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_pairs(batches, small, centres)

    known = materialize(cards(texts))
    edges = verified(likely(fingerprint_pairs(known), known), texts)
    joined = materialize(connected_components(edges))
    buckets = prefixes(texts, _often(texts)).repartition("bucket").sortWithinPartitions("bucket", "n", "sid")
    first = materialize(buckets.mapInArrow(run, "bucket long, n int, src long, dst long"))
    edges = edges.unionByName(verified(likely(first.where("bucket is null"), known, joined), texts))
    large = first.where("bucket is not null").select("bucket", "n", F.col("src").alias("sid"))
    if large.isEmpty():
        discard(first, known, joined)
        return edges
    discard(joined)
    joined = materialize(connected_components(edges))
    rest = (large.join(joined, large.sid == joined.node, "left")
            .join(known.select(F.col("sid").alias("_sid"), "marks"), F.col("sid") == F.col("_sid"))
            .select("bucket", "n", "sid", F.coalesce("component", "sid").alias("component"), "marks"))
    pairs = (rest.repartition("bucket").sortWithinPartitions("bucket", "n", "sid")
             .mapInArrow(_other_pairs, "src long, dst long"))
    more = verified(pairs, texts)
    discard(first, known, joined)
    return edges.unionByName(more)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL_BUCKET,
                centres: int = CENTRES) -> DataFrame:
    """``df`` with one row of each component over pairs of the least similarity, that of the smallest
    key, and all columns.

    Texts with the same words are alike, texts without words among them. Rows with a null key stay and
    link nothing. Of several rows with the smallest key one stays, by the id of its text.
    """
    keyed = df.where(F.col(key).isNotNull())
    first = materialize(_named(keyed, key, text, key).groupBy("sid").agg(F.min("k").alias("first")))
    whole = _named(keyed, key, text, text).select("k", "sid", "row")
    texts = materialize(whole.join(first.select("sid", F.col("first").alias("k")), ["sid", "k"], "left_semi")
                        .dropDuplicates(["sid", "k"]).select("sid", text_bytes(f"row.{text}").alias("body")))
    edges = materialize(links(texts, small, centres))
    discard(texts)
    joined = connected_components(edges)
    of = first.join(joined, first.sid == joined.node, "left").select(
        "sid", "first", F.coalesce("component", "sid").alias("component"))
    stay = materialize(of.groupBy("component").agg(F.min(F.struct("first", "sid")).alias("s"))
                       .select(F.col("s.first").alias("k"), F.col("s.sid").alias("sid")))
    kept = _named(keyed, key, text, *df.columns).join(stay.hint("shuffle_hash"), ["k", "sid"], "left_semi")
    return kept.dropDuplicates(["k", "sid"]).select("row.*").unionByName(df.where(F.col(key).isNull()))
