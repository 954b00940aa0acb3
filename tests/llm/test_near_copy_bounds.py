"""The fingerprint step of the near-duplicate stage, and the bound that spares pairs of a shared shingle."""

import numpy as np
import pyarrow as pa

from axisframe.llm import near_copies


def test_marks_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 90, 511, 513, 1500, 40_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (1.0, 0.95, 0.9, 0.89, 0.85, 0.5):
            same = a[:round(share * len(a))]
            b = np.unique(np.concatenate([same, rng.integers(0, 2**64, n - len(same), dtype=np.uint64)]))
            x, y = (np.frombuffer(near_copies.marks(s), np.uint64) for s in (a, b))
            width = min(len(x), len(y))
            apart = np.bitwise_count(near_copies.folded(x, width) ^ near_copies.folded(y, width)).sum(keepdims=True)
            assert apart[0] <= len(np.setxor1d(a, b))
            assert near_copies.possible(np.array([len(a)]), len(b), apart)[0] or not near_copies.similar(a, b)


def test_texts_that_share_one_shingle_make_no_pairs():
    rng = np.random.default_rng(4)
    common = np.array([7], np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, n - 1, dtype=np.uint64)]))
            for n in sorted(rng.integers(450, 600, 300))]
    sets.append(np.unique(np.concatenate([sets[-1][:-5], rng.integers(0, 2**64, 5, dtype=np.uint64)])))
    ids = np.arange(len(sets))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(sets), np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(ids),
         pa.array(ids), pa.array([near_copies.marks(s) for s in sets], pa.binary())],
        ["bucket", "n", "sid", "component", "marks"])
    found = [(x, y) for b in near_copies._other_pairs(iter([rows])) for x, y in zip(*b.to_pydict().values(), strict=True)]
    assert found == [(299, 300)]


def test_fingerprints_link_copies_before_the_prefix_filter(spark):
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(900)]
    base = list(rng.choice(word, 400))
    copies = [" ".join(base[:i] + ["new"] + base[i + 1:]) for i in (3, 150, 390)]
    other = [" ".join(rng.choice(word, 400)) for _ in range(20)]
    texts = [" ".join(base), *copies, *other]
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "sid long, body binary")
    known = near_copies.cards(df)
    pairs = near_copies.likely(near_copies.fingerprint_pairs(known), known)
    linked = {tuple(r) for r in near_copies.verified(pairs, df).collect()}
    assert linked and {i for p in linked for i in p} <= {0, 1, 2, 3}
    joined = spark.createDataFrame([(i, 0) for i in range(4)], "node long, component long")
    both = spark.createDataFrame([(0, 1), (2, 3), (1, 20)], "src long, dst long")
    assert near_copies.likely(both, known, joined).count() == 0
    assert near_copies.likely(both, known).count() == 2
