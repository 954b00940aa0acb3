"""Removal of repeated byte strings with suffix arrays.

Every window of ``length`` bytes is routed by its anchor: the smallest hash of the grams inside it.
Equal windows have equal anchors, wherever they start, so a window can only repeat inside its
anchor's group; consecutive windows with one anchor travel as one run of text. Runs of equal text are
merged first. The rest is sorted: shards of whole anchor groups get a suffix array by
Larsson-Sadakane refinement and common prefixes by Kasai's rule, and neighbours that share ``length``
bytes are repeats. A group too large for a shard is cut into several, which are merged afterwards by
binary search in their sorted windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import map_arrow, text_bytes
from axisframe.session import materialize

LENGTH = 200
GRAM = 24
#: Windows of one run at most; a longer stretch with one anchor is several runs.
RUN_WINDOWS = 1 << 16
#: Text bytes of one shard at most, but for a single run.
SHARD_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64; kept in the Python worker."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of ``length`` bytes of a text (uint8), and whether it stands first."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(text * _powers(_BASE, n), out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * _powers(pow(_BASE, -1, 1 << 64), n - gram + 1)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    width = length - gram + 1
    m = len(grams)
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = grams
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    values = np.minimum(back[:m - width + 1], ahead[width - 1:m])
    return values, values == grams[:len(values)]


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int, step: int = 4 << 20
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, windows, anchor)`` of the runs of the documents ``data[ends[i]:ends[i + 1]]``."""
    docs, starts, counts, values = [], [], [], []
    last = int(ends[-1])
    for low in range(int(ends[0]), last, step):
        part = data[low:min(low + step + length - 1, last)]
        if len(part) < length:
            break
        value, leaves = anchors(part, length, gram)
        at = np.arange(low, low + len(value))
        doc = np.searchsorted(ends, at, "right") - 1
        inside = at + length <= ends[doc + 1]
        at, doc, value, leaves = at[inside], doc[inside], value[inside], leaves[inside]
        if not len(at):
            continue
        fresh = np.ones(len(at), bool)
        # where an anchor leaves the window, its next occurrence starts a run of its own
        fresh[1:] = (value[1:] != value[:-1]) | leaves[:-1] | (np.diff(at) != 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        pieces = -(-size // RUN_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + nth * RUN_WINDOWS, np.repeat(size, pieces) - nth * RUN_WINDOWS
        docs.append(doc[first])
        starts.append(at[first] - ends[doc[first]])
        counts.append(np.minimum(size, RUN_WINDOWS))
        values.append(value[first].view(np.int64))
    if not docs:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in (docs, starts, counts, values))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` bytes at least.

    Larsson and Sadakane: suffixes are first grouped by their first eight bytes; only groups still
    unsorted are refined, by the rank of what follows, and the known depth doubles each time.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i:i + n]
    # zeros stand past the end: of equal keys the later, shorter suffix comes first
    order = n - 1 - np.argsort(key[::-1], kind="stable")
    ranked = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    known = 8
    while known < depth:
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + known < n, rank[np.minimum(at + known, n - 1)], -1) + 1
        pair = rank[at] * (n + 1) + after
        inner = np.argsort(pair, kind="stable")
        order[slots] = at[inner]
        pair = pair[inner]
        fresh[slots[1:]] |= pair[1:] != pair[:-1]
        # ranks of the refined groups: their first slot
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order[slots]] = head[slots]
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray,
                    most: int) -> np.ndarray:
    """For windows in suffix order, how many bytes (``most`` at most) each shares with the one before.

    Kasai's rule: what follows a suffix shares with its own neighbour at least one byte less, so the
    comparison goes on where it stopped. All runs (``starts``, ``counts`` windows each) go forward in
    step; a neighbour that ends its run starts the comparison anew.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    slot = np.full(n, -1, np.int64)
    slot[order] = np.arange(len(order))
    shared = np.zeros(len(order), np.int64)
    by_size = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_size], counts[by_size]
    held = np.zeros(len(starts), np.int64)
    before = np.full(len(starts), -1, np.int64)
    live = len(starts)
    for step in range(int(counts[0]) if len(counts) else 0):
        while counts[live - 1] <= step:
            live -= 1
        at = starts[:live] + step
        place = slot[at]
        other = np.where(place > 0, order[place - 1], -1)
        # the rule holds if the former neighbour's successor is a window too, and sorted before this
        former = slot[np.minimum(before[:live] + 1, n - 1)]
        sure = (before[:live] >= 0) & (former >= 0) & (former < place)
        same = np.where(sure & (other >= 0), np.maximum(held[:live] - 1, 0), 0)
        todo = np.flatnonzero((other >= 0) & (same < most))
        while len(todo):
            a, b = at[todo] + same[todo], other[todo] + same[todo]
            left = np.ascontiguousarray(words[a]).view("<u8").ravel()
            right = np.ascontiguousarray(words[b]).view("<u8").ravel()
            differ = left ^ right
            more = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
            same[todo] = np.minimum(same[todo] + more, most)
            todo = todo[(more == 8) & (same[todo] < most)]
        same = np.minimum(same, np.where(other >= 0, n - other, 0))
        shared[place] = same
        held[:live], before[:live] = same, other
    return shared


def repeated_windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, weights: np.ndarray,
                     length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one shard in suffix order, their group of equal windows, and whether it repeats.

    ``weights`` tells how many times a run's text occurs in all.
    """
    order = suffix_array(text, length)
    total = int(counts.sum())
    run = np.repeat(np.arange(len(starts)), counts)
    window = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
    owner = np.full(len(text), -1, np.int64)
    owner[window] = run
    order = order[owner[order] >= 0]
    shared = common_prefixes(text, order, starts, counts, length)
    group = np.cumsum(shared < length) - 1
    many = np.bincount(group, weights[owner[order]]) >= 2
    return order, group, many[group]


_RUN = "doc {kind}, h long, start int, windows int, anchor long, rhash long, times int"
_SPAN = "doc {kind}, h long, low int, high int"


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of ``(doc, h, body)``, with a hash of their text.

    A text that repeats itself every few bytes has a run for every period: equal runs that follow each
    other are one row, which counts its ``times``.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        body = batch.column("body")
        ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
        raw = body.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        doc, start, windows, anchor = runs_of(data, ends, length, gram)
        view = memoryview(raw) if raw is not None else b""
        low = ends[doc] + start if len(doc) else doc
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(view[a:b]) for a, b in
                           zip(low.tolist(), (low + windows + length - 1).tolist(), strict=True)], np.uint64)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = ((hashes[1:] != hashes[:-1]) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                     | (windows[1:] != windows[:-1]) | (start[1:] != start[:-1] + windows[:-1]))
        first = np.flatnonzero(fresh)
        times = np.diff(np.append(first, len(doc)))
        row = pa.array(doc[first])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc").take(row), batch.column("h").take(row), pa.array(start[first], pa.int32()),
             pa.array(windows[first], pa.int32()), pa.array(anchor[first], pa.int64()),
             pa.array(hashes[first].view(np.int64)), pa.array(times, pa.int32())],
            ["doc", "h", "start", "windows", "anchor", "rhash", "times"])

    kind = docs.schema["doc"].dataType.simpleString()
    return map_arrow(docs, run, _RUN.format(kind=kind), "body")


def _sort_shards(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sort the runs of a partition, which come in the order of ``shard``, and find their repeats.

    Rows out: a repeated stretch of a document (``digest`` null), or one window of a split group with
    its digest, for the merge; there ``doc`` is null if its group has been found to repeat already.
    """
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        text = rows.column("run").combine_chunks()
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        raw = memoryview(text.buffers()[2])[int(ends[0]):int(ends[-1])]
        data = np.frombuffer(raw, np.uint8)
        starts = ends[:-1] - ends[0]
        counts = np.diff(ends) - length + 1
        weights = rows.column("n").to_numpy()
        order, group, many = repeated_windows(data, starts, counts, weights, length)
        run = np.searchsorted(starts, order, "right") - 1
        split = rows.column("split").to_numpy(zero_copy_only=False)
        offset = pa.array(rows.column("start").to_numpy() - starts)  # from the shard to the document

        def spans(low: np.ndarray, high: np.ndarray, of: pa.Array, digests: list | None) -> pa.RecordBatch:
            doc, h = (rows.column(c).combine_chunks().take(of) for c in ("doc", "h"))
            place = [pc.add(pa.array(x), offset.take(of)).cast(pa.int32()) for x in (low, high)]
            digest = pa.nulls(len(of), pa.binary()) if digests is None else pa.array(digests, pa.binary())
            return pa.RecordBatch.from_arrays([doc, h, *place, digest], ["doc", "h", "low", "high", "digest"])

        hits = np.sort(order[many & (weights[run] == 1)])
        owner = np.searchsorted(starts, hits, "right") - 1
        cut = np.flatnonzero((np.diff(hits) != 1) | (np.diff(owner) != 0)) + 1
        first, last = np.append(0, cut)[:len(hits)], np.append(cut, len(hits))[:len(hits)] - 1
        yield spans(hits[first], hits[last] + length, pa.array(owner[first]), None)
        head = np.ones(len(group), bool)
        head[1:] = group[1:] != group[:-1]
        sent = head & split[run]
        if sent.any():
            at, of, known = order[sent], run[sent], many[sent] | (weights[run[sent]] > 1)
            digests = [hashlib.blake2b(raw[a:a + length], digest_size=16).digest() for a in at.tolist()]
            yield spans(at, at + length, pa.array(of, mask=known), digests)

    held: list[pa.Table] = []
    size, last = 0, None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in ("shard", "h", "start")], 1)
        if not len(place):
            continue
        # equal rows of the table have cut the same run twice
        fresh = np.append(last is None or (place[0] != last).any(), (place[1:] != place[:-1]).any(1))
        batch, last = batch.filter(pa.array(fresh)), place[-1]
        for cut in _groups(batch):
            new = held and cut.column("shard")[0] != held[-1].column("shard")[-1]
            if new and (size >= shard_bytes or cut.column("split")[0].as_py() or held[-1].column("split")[-1].as_py()):
                yield from solve(pa.concat_tables(held))
                held, size = [], 0
            held.append(pa.Table.from_batches([cut]))
            size += cut.column("run").nbytes
    if held:
        yield from solve(pa.concat_tables(held))


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut between its shards."""
    if batch.num_rows:
        cuts = [0, *(np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of split groups, sorted by digest: each is looked up by binary search among the others."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        digest = np.frombuffer(b"".join(rows.column("digest").to_pylist()), ">u8").reshape(-1, 2)
        place = np.cumsum(np.append(False, (digest[1:] != digest[:-1]).any(1)))
        times = np.searchsorted(place, place, "right") - np.searchsorted(place, place, "left")
        open_ = ~rows.column("low").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        return rows.filter(pa.array((times > 1) & open_)).drop_columns(["digest"]).combine_chunks()

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        last = rows.column("digest")[-1].as_py()
        keep = rows.num_rows
        while keep and rows.column("digest")[keep - 1].as_py() == last:
            keep -= 1
        if keep:
            held.append(rows.slice(0, keep))
            yield from solve(pa.concat_tables(held)).to_batches()
            held = []
        elif held and held[-1].column("digest")[-1].as_py() != last:
            yield from solve(pa.concat_tables(held)).to_batches()
            held = []
        held.append(rows.slice(keep))
    if held:
        yield from solve(pa.concat_tables(held)).to_batches()


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc, h, low, high)``: stretches of bytes covered by repeated windows, for ``(doc, h, body)``.

    Stretches of one document may overlap; their union is what repeats.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    runs = find_runs(docs, length, gram)
    # anchors that occur once cannot repeat; partial counts leave the map side
    # written, so that the join reads both sides from exchanges and a hot anchor's runs can be split
    often = materialize(runs.groupBy("anchor").agg(F.sum("times").alias("all")).where(F.col("all") > 1)
                        .select("anchor"))
    able = materialize(runs.join(often, "anchor"))
    merged = able.groupBy("anchor", "rhash").agg(
        F.sum("times").alias("n"), F.min(F.struct("doc", "h", "start", "windows")).alias("at"))
    merged = materialize(merged)
    whole = (able.join(merged.where(F.col("n") > 1).select("anchor", "rhash"), ["anchor", "rhash"])
             .select("doc", "h", F.col("start").alias("low"),
                     (F.col("start") + F.col("windows") * F.col("times") + F.lit(length - 1)).alias("high")))
    groups = (merged.groupBy("anchor").agg(
        F.count("*").alias("texts"), F.sum(F.col("at.windows") + F.lit(length)).alias("bytes"))
        .where(F.col("texts") > 1).select("anchor", F.ceil(F.col("bytes") / shard_bytes).alias("shards")))
    part = F.pmod(F.col("rhash"), F.col("shards"))
    wanted = merged.join(groups, "anchor").select(
        "at.*", "n", F.xxhash64("anchor", part).alias("shard"), (F.col("shards") > 1).alias("split"))
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "windows", "n", "shard", "split")).alias("runs"))
    cut = F.transform("runs", lambda r: F.struct(
        r.start.alias("start"), r.n.alias("n"), r.shard.alias("shard"), r.split.alias("split"),
        F.substring("body", r.start + 1, r.windows + F.lit(length - 1)).alias("run")))
    same = docs.doc.eqNullSafe(lists.doc) & (docs.h == lists.h)
    texts = (docs.join(lists.hint("shuffle_hash"), same).select(docs.doc, docs.h, cut.alias("cut"))
             .select("doc", "h", F.explode("cut").alias("r")).select("doc", "h", "r.*"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sort_shards(batches, length, shard_bytes)

    found = materialize(texts.repartition("shard").sortWithinPartitions("shard", "h", "start").mapInArrow(
        sort, _SPAN.format(kind=kind) + ", digest binary"))
    split = found.where(F.col("digest").isNotNull())
    crossed = split.repartition("digest").sortWithinPartitions("digest").mapInArrow(
        _merge_shards, _SPAN.format(kind=kind))
    return whole.unionByName(found.where(F.col("digest").isNull()).drop("digest")).unionByName(crossed).distinct()


def identified(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, h, body)``: a row is known by its key and a hash of its text; equal rows share both."""
    return df.select(F.col(key).alias("doc"), text_bytes(text).alias("body")).select(
        "doc", F.xxhash64("body").alias("h"), "body")


def cover(size: int, spans: list[dict] | None) -> tuple[np.ndarray, int, int]:
    """``(kept mask, bytes removed, runs removed)`` of a text of ``size`` bytes."""
    if not spans:
        return np.ones(size, bool), 0, 0
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, [s["low"] for s in spans], 1)
    np.add.at(depth, [s["high"] for s in spans], -1)
    kept = np.cumsum(depth[:-1]) == 0
    starts = ~kept & np.concatenate(([True], kept[:-1]))
    return kept, int(size - kept.sum()), int(starts.sum())


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc, h, body, spans)``; a document's spans are as many as its length allows."""
    lists = spans.groupBy("doc", "h").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    same = docs.doc.eqNullSafe(lists.doc) & (docs.h == lists.h)
    return docs.join(lists.hint("shuffle_hash"), same, "left").select(docs.doc, docs.h, "body", "spans")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` of every row after removing repeats.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else goes, the first
    place included. A null text is empty, texts shorter than ``length`` keep all, equal rows repeat
    each other, and rows with a null key take part like any other.
    """
    docs = identified(df, key, text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
            raw = body.as_py()
            kept, removed, pieces = cover(len(raw), spans)
            left = np.frombuffer(raw, np.uint8)[kept].tobytes() if removed else raw
            rows.append((len(raw), removed, pieces, hashlib.sha256(left).hexdigest()))
        sizes, removed, pieces, shas = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(pieces, pa.int64()), pa.array(shas)],
            ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(with_spans(docs, repeated_spans(docs, length)).drop("h"), run,
                     f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
                     "body").withColumnRenamed("doc", key)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with repeats cut out of its texts, all rows and columns kept.

    A character goes if any of its bytes goes, so that what is left is text again; a null text becomes
    empty.
    """
    docs = identified(df, key, text)
    lists = repeated_spans(docs, length).groupBy("doc", "h").agg(
        F.collect_list(F.struct("low", "high")).alias("spans"))
    packed = df.select(F.struct(*(df[c] for c in df.columns if c != text)).alias("row"), F.col(key).alias("doc"),
                       text_bytes(text).alias("body")).withColumn("h", F.xxhash64("body"))
    same = packed.doc.eqNullSafe(lists.doc) & (packed.h == lists.h)
    joined = packed.join(lists.hint("shuffle_hash"), same, "left").select("row", "body", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
            raw = np.frombuffer(body.as_py(), np.uint8)
            kept, removed, _ = cover(len(raw), spans)
            if removed:
                char = np.cumsum((raw & 0xC0) != 0x80)
                kept &= ~np.isin(char, char[~kept])
            texts.append(raw[kept].tobytes().decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "kept"])

    row = joined.schema["row"].dataType.simpleString()
    done = map_arrow(joined, run, f"row {row}, kept string", "body")
    return done.select(*(F.col("kept").alias(text) if c == text else F.col(f"row.`{c}`") for c in df.columns))
