"""Top-k search, SimHash components and removal of repeats against brute force."""

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.llm import simhash, suffix_dedup, topk
from axisframe.session import materialize

WORDS = "ash birch cedar elm fir hazel ivy juniper larch maple oak pine rowan sorrel thyme willow yew".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


# top-k

@pytest.mark.parametrize(("rows", "k", "piece"), [(300, 20, 64), (50, 60, 16), (1, 5, 8), (200, 7, 1000)])
def test_maxscore_equals_brute_force(rows, k, piece):
    rng = np.random.default_rng(rows)
    vectors = np.floor(64 * rng.normal(0, 0.15, (rows, 12)))
    vectors[rows // 2:] = vectors[:rows - rows // 2]  # ties
    ids = rng.permutation(rows * 3)[:rows]
    asked = ids % 2 == 0
    got = topk.maxscore(vectors[asked], ids[asked], vectors, ids, k, piece=piece, block=7)
    want = set()
    for q, own in zip(vectors[asked], ids[asked], strict=True):
        ranked = sorted((-int(q @ v), int(i)) for v, i in zip(vectors, ids, strict=True) if i != own)
        want |= {(int(own), i, -s) for s, i in ranked[:k]}
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want


@pytest.mark.parametrize(("scale", "k"), [(1 << 25, 5), (1 << 29, 4), (1 << 40, 3)])
def test_large_components_are_exact(scale, k):
    rng = np.random.default_rng(k)
    vectors = np.floor(rng.normal(0, 1, (150, 6)) * [scale, 3, 0, 1, scale, 1])
    asked = vectors.copy()
    asked[:, 4] = asked[:, 0]
    vectors[:, 4] = -vectors[:, 0]  # large products that cancel
    vectors[::7, 4] += 1
    ids = np.arange(150) // 2
    rows = np.arange(150) + 1000
    got = topk.maxscore(asked[::20], rows[::20], vectors, ids, k, piece=32, rows=rows)
    want = []
    for own in rows[::20]:
        q = [int(x) for x in asked[own - 1000]]
        scores = [(-sum(a * int(b) for a, b in zip(q, v, strict=True)), int(i)) for v, i, r in zip(vectors, ids, rows, strict=True)
                  if r != own]
        want += [(int(own), i, -s) for s, i in sorted(scores)[:k]]
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_python_integers_where_bounds_are_huge():
    big = float(1 << 70)
    vectors = np.array([[big, 1.0, 0.0], [0.0, 5.0, 0.0], [0.0, 7.0, big], [0.0, -2.0, 0.0]])
    got = topk.maxscore(np.array([[0.0, 3.0, 0.0]]), np.array([9]), vectors, np.array([4, 3, 2, 1]), 2)
    assert [x.tolist() for x in got] == [[9, 9], [2, 3], [21, 15]]
    with pytest.raises(OverflowError):
        topk.maxscore(np.array([[1.0, 0.0, 0.0]]), np.array([9]), vectors, np.array([4, 3, 2, 1]), 2)


def test_non_essential_terms_are_not_multiplied():
    rng = np.random.default_rng(3)
    spread = 200.0 * 0.6 ** np.arange(24)
    vectors = np.floor(rng.normal(0, 1, (4000, 24)) * spread)
    sparse = vectors * (rng.random(vectors.shape) < 0.05)
    for table in (vectors, sparse):
        work: list[int] = []
        got = topk.maxscore(table[:40], np.arange(40), table, np.arange(4000), 10, piece=500, work=work)
        assert sum(work) < 0.8 * 40 * table.size
        for own in range(40):
            order = sorted((-int(table[own] @ v), i) for i, v in enumerate(table) if i != own)[:10]
            mine = got[0] == own
            assert sorted(zip(got[1][mine].tolist(), got[2][mine].tolist(), strict=True)) == sorted((i, -s) for s, i in order)


def test_top_k_edge_rows(spark):
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (5, [1.0]), (6, []), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    vectors = materialize(topk.integer_vectors(df, "vec_id", "embedding"))
    assert sorted(r["id"] for r in vectors.collect()) == [0, 0, 1, 5, 6, 20]
    found = topk.top_k(vectors, vectors.where("id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    # a row of the same id is a candidate, and a query of its own
    zero = [(0, 1, 5, 32 * 64), (0, 2, 0, 32 * 32 + 16 * 16), (0, 3, 1, 32 * 32 - 16 * 32)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted([
        *zero, *zero, (20, 1, 1, 2048), (20, 2, 5, 2048), (20, 3, 0, 512)])
    huge = spark.createDataFrame([(0, [3e9, 1.0]), (1, [-2.0, 0.5]), (2, [2.0, -1e30])], "vec_id long, embedding array<double>")
    vectors_2 = materialize(topk.integer_vectors(huge, "vec_id", "embedding"))
    assert sorted(r["vec"][1] for r in vectors_2.collect()) == [-64e30, 32.0, 64.0]
    assert topk.top_k(vectors.where("id < 0"), vectors, 3).count() == 0
    assert topk.top_k(vectors, vectors.where("id < 0"), 3).count() == 0


# SimHash

def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\n\t\x0b\x1cZ.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_hash_equals_spark(spark):
    text = "Ünder the old oak tree"
    got = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) AS h").head()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_pigeonhole_keys_lose_no_pair():
    spans = [set(range(first, first + width)) for first, width in simhash.BLOCKS]
    assert set().union(*spans) == set(range(64)) and sum(map(len, spans)) == 64
    rng = np.random.default_rng(0)
    for _ in range(2000):
        flipped = set(rng.choice(64, rng.integers(0, 5), replace=False).tolist())
        assert sum(not flipped & s for s in spans) >= 2


def brute_components(fps, keys):
    group = {k: k for k in keys}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k
    for (a, x), (b, y) in combinations(list(zip(keys, fps, strict=True)), 2):
        if (x ^ y).bit_count() <= 4:
            a, b = sorted((root(a), root(b)))
            group[b] = a
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("split", [2, 10_000])
def test_links_keep_components(spark, split):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for base in fps[:12]:  # chains and a dense group
        at = base
        for _ in range(4):
            at ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            fps.append(at)
    fps += [fps[0] ^ (1 << b) for b in range(64)] + [fps[1] ^ 31]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r["src"], r["dst"]) for r in simhash.links(df, 4, split_bucket=split).collect()]
    for a, b in edges:
        assert 0 < ((a ^ b) % (1 << 64)).bit_count() <= 4
    order = {f: i for i, f in enumerate(signed)}
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for a, b in edges:
        x, y = sorted((root(order[a]), root(order[b])))
        group[y] = x
    want = brute_components(fps, list(range(len(fps))))
    assert [root(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]


def test_near_duplicates_edge_rows(spark):
    rng = np.random.default_rng(1)
    a, b = prose(rng, 200), prose(rng, 150)
    rows = [(9, a), (3, a.upper()), (5, a + "\t"), (5, b), (7, None), (8, "  "), (None, b), (11, "one two"), (12, "ONE  two")]
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    have = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect())
    name = {t: f"{slow_fingerprint(t or ''):016x}" for _, t in rows}
    assert have == Counter({(9, name[a], 3): 1, (3, name[a], 3): 1, (5, name[a], 3): 1, (5, name[b], 5): 1,
                            (7, "0" * 16, 7): 1, (8, "0" * 16, 7): 1, (None, name[b], None): 1,
                            (11, name["one two"], 11): 1, (12, name["one two"], 11): 1})
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = simhash.one_of_each(df.unionByName(df.where("doc_id = 3")))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 5, 7, 11]


# removal of repeats

def brute_removal(texts, length=200):
    starts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])[:len(gone)]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(8)
    passage, line = prose(rng, 60), prose(rng, 25)
    texts = [prose(rng, 120) + passage + prose(rng, 90), passage, "é" + passage[3:] + "ß" * 120, prose(rng, 300)]
    texts += [prose(rng, 40) + line + prose(rng, 40) for _ in range(12)]
    texts += [texts[3]] * 3 + ["x" * 199, "x" * 200, "ab" * 700, "-" * 900, "", None, "\0" * 450, line + "\0" * 210]
    texts.append(texts[0][5:] + texts[4])
    return texts


@pytest.mark.parametrize("shard", [1 << 21, 700])
def test_repeats_equal_brute_force(spark, shard):
    texts = corpus()
    df = spark.createDataFrame([(i % 24, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    docs = suffix_dedup.identified(df)
    spans = suffix_dedup.repeated_spans(docs, shard_bytes=shard)
    rows = suffix_dedup.with_spans(docs, spans).collect()
    got = Counter()
    for r in rows:
        raw = bytes(r["body"])
        kept, removed, pieces = suffix_dedup.cover(len(raw), [s.asDict() for s in r["spans"] or []])
        got[r["doc"], len(raw), removed, pieces,
            hashlib.sha256(np.frombuffer(raw, np.uint8)[kept].tobytes()).hexdigest()] += 1
    want = brute_removal([(t or "").encode() for t in texts])
    assert got == Counter((i % 24, *w) for i, w in enumerate(want))


def test_a_text_of_short_period_makes_few_runs(spark):
    texts = ["Is onhe. " * 300, "before " + "Is onhe. " * 200 + "after", "-" * 900, "abc" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = suffix_dedup.find_runs(suffix_dedup.identified(df), 200, 24).collect()
    most = Counter(r["doc"] for r in runs)
    assert max(most.values()) <= 12
    for i, t in enumerate(texts):
        assert sum(r["windows"] * r["times"] for r in runs if r["doc"] == i) == len(t) - 199
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(df).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts])))


def test_digest_rows_and_whole_rows(spark):
    texts = corpus()
    df = spark.createDataFrame([(None if i == 2 else i, t, "k", i) for i, t in enumerate(texts)],
                               "doc_id long, text string, row string, n_chars int")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(df).collect()}
    want = dict(zip([None if i == 2 else i for i in range(len(texts))],
                    brute_removal([(t or "").encode() for t in texts]), strict=True))
    assert got == want
    cut = suffix_dedup.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(texts)
    assert {r["n_chars"]: r["text"] for r in cut.collect()}[3] == ""
    assert suffix_dedup.digests(df.where("false")).count() == 0


@given(st.lists(st.sampled_from([b"a", b"b", b"\0", b"ab", b"aab"]), min_size=1, max_size=120))
@settings(max_examples=100, deadline=None)
def test_suffix_order_and_common_prefixes(parts):
    raw = b"".join(parts)
    text = np.frombuffer(raw, np.uint8)
    order = suffix_dedup.suffix_array(text, 16)
    assert sorted(order.tolist()) == list(range(len(raw)))
    cut = [raw[i:i + 16] for i in order]
    assert cut == sorted(cut)
    windows = len(raw) - 12 + 1
    if windows > 0:
        mine = order[order < windows]
        shared = suffix_dedup.common_prefixes(text, mine, np.array([0]), np.array([windows]), 12)
        for i in range(1, len(mine)):
            a, b = raw[mine[i - 1]:], raw[mine[i]:]
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[i] == min(same, 12)
