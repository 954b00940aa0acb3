"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into six blocks. Two fingerprints that differ in at most four bits agree in two
of the blocks at least, so each of the 15 pairs of blocks is a join key and no link is missed. Equal
fingerprints are one row before the join. Rows that share a key are verified by their Hamming
distance; a bucket hands on the edges of a spanning forest of its links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import map_arrow, text_bytes
from axisframe.operators.graph import connected_components
from axisframe.session import materialize

#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: A bucket with more members is split once more, by blocks of the bits that its key leaves open.
SPLIT_BUCKET = 50_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42, step: int = 65_536) -> int:
    """SimHash of the word shingles of a text: a bit is set if over half of the hashes set it.

    A-Z are lowered and words are split at ASCII white space. With fewer words than a shingle has,
    the whole sequence is the one shingle; without words the fingerprint is zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    width = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(parts) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), step):
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(starts[i:i + step], ends[i:i + step], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += bits[j:j + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(key, fp)``: one row per row of ``df``; ``fp`` is the fingerprint as a signed 64-bit number.

    A null text has no words.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t.as_py(), words) for t in batch.column("body")], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values.view(np.int64))], ["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    return map_arrow(source, run, f"key {kind}, fp long", "body").withColumnRenamed("key", key)


def _forest(members: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among one bucket's fingerprints."""
    left, right = [], []
    unseen = members
    while len(unseen) > 1:
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            near = np.bitwise_count(unseen ^ at) <= most
            if near.any():
                found = unseen[near]
                unseen = unseen[~near]
                queue.extend(found)
                left.append(np.full(len(found), at, np.uint64))
                right.append(found)
    return left, right


def bucket_edges(batches: Iterator[pa.RecordBatch], most: int, small: int = 64) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal ``bucket``; the rows come sorted by it. Only the open run is carried on."""
    def links(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        fp = fp.view(np.uint64)  # bits of a signed number are counted without its sign
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
        length = end - begin
        for a, b in zip(begin[length > small], end[length > small], strict=True):
            more = _forest(fp[a:b], most)
            left += more[0]
            right += more[1]
        inside = np.repeat(length <= small, length)
        bucket, fp = bucket[inside], fp[inside]
        for away in range(1, min(small, len(fp))):
            same = bucket[away:] == bucket[:-away]
            if not same.any():
                break
            near = same & (np.bitwise_count(fp[away:] ^ fp[:-away]) <= most)
            left.append(fp[:-away][near])
            right.append(fp[away:][near])
        none = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([none, *ends]).view(np.int64)) for ends in (left, right)], ["src", "dst"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        bucket, fp = (batch.column(c).to_numpy() for c in ("bucket", "fp"))
        if not len(bucket):
            continue
        if bucket[0] == bucket[-1] and (not held or held[-1][0][-1] == bucket[0]):
            held.append((bucket, fp))
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        held.append((bucket[:cut], fp[:cut]))
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = [(bucket[cut:], fp[cut:])]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _keys(blocks: tuple[tuple[int, int], ...], agree: int, base):
    """For each choice of ``agree`` blocks one number made of ``base``, the choice and the blocks' bits."""
    keys = []
    for i, chosen in enumerate(combinations(blocks, agree)):
        bits = [F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1) for first, width in chosen]
        keys.append(F.xxhash64(base, F.lit(i), *bits))
    return F.array(*keys)


def links(fps: DataFrame, most: int = 4, split_bucket: int = SPLIT_BUCKET) -> DataFrame:
    """``(src, dst)`` edges among distinct fingerprints ``fp``: the same components as all links of at
    most ``most`` differing bits.

    A bucket key is a hash of the blocks chosen; a collision only adds rows to verify. Buckets of more
    than ``split_bucket`` members are split by five blocks of all 64 bits under the same bucket, which
    again loses no pair, so that a hot key spreads over many tasks.
    """
    if not 0 <= most <= 4:
        raise ValueError("blocks are laid out for up to four differing bits")
    keyed = fps.select("fp", F.explode(_keys(BLOCKS, 2, F.lit(0))).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = keyed.join(sizes, "bucket")
    fifths = tuple((13 * i, min(13, 64 - 13 * i)) for i in range(5))
    shared = shared.select("fp", F.explode(F.when(F.col("n") <= split_bucket, F.array("bucket")).otherwise(
        _keys(fifths, 1, F.col("bucket")))).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bucket_edges(batches, most)

    return (shared.repartition("bucket").sortWithinPartitions("bucket", "fp").select("bucket", "fp")
            .mapInArrow(run, "src long, dst long").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
                    most: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of ``df``; the fingerprint in hex digits.

    Keys, rows and ties as in ``components``.
    """
    return components(df, key, text, words, most).select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``df``.

    ``component_id`` is the smallest key reachable over links of at most ``most`` differing bits,
    equal fingerprints included. Rows with a null key are returned with a null component and link
    nothing; rows of a repeated key each have their own fingerprint; an empty table gives no rows.
    """
    docs = materialize(fingerprints(df, key, text, words))
    first = materialize(docs.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("first")))
    joined = connected_components(links(first.select("fp"), most))
    linked = joined.join(first, joined.node == first.fp)
    named = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    moved = joined.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    of = first.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return docs.join(of, "fp", "left").select(
        key, "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """``df`` with one row of each component, that of the smallest key, and all columns.

    Of several rows with that key the smallest fingerprint stays, of equal ones any, as they are equal
    in key and fingerprint. Rows with a null key stay.
    """
    found = components(df, key, text, words, most)
    stay = materialize(found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("k"))
                       .agg(F.min("fp").alias("f")))
    marked = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_bytes(text).alias("body"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t.as_py(), words) for t in batch.column("body")], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("k"), pa.array(values.view(np.int64))], ["row", "k", "f"])

    row, kind = df.schema.simpleString(), df.schema[key].dataType.simpleString()
    named = map_arrow(marked, run, f"row {row}, k {kind}, f bigint", "body")
    kept = named.join(stay.hint("shuffle_hash"), ["k", "f"], "left_semi").dropDuplicates(["k", "f"])
    return kept.select("row.*").unionByName(df.where(F.col(key).isNull()))
