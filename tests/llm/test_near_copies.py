"""The near-duplicate stage against brute force on exact Jaccard similarities."""

from itertools import combinations

import corpus_pipeline
import numpy as np

from axisframe.llm import near_copies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    group = {k: k for k, _ in rows}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k
    for (a, x), (b, y) in combinations([(k, grams(t)) for k, t in rows], 2):
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((root(a), root(b)))
            group[b] = a
    return {root(k) for k, _ in rows}


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(word, 30))
    texts = []
    for n in (6, 12, 60, 200, 400):
        for _ in range(4):
            base = list(rng.choice(word, n))
            texts.append(" ".join(base))
            for share in (0.01, 0.015, 0.02, 0.03, 0.05):  # copies from about 0.95 down to below 0.8
                copy = [str(rng.choice(word)) if rng.random() < share else w for w in base]
                texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(word, 20)) + " " + line for _ in range(50)]
    texts += [line, line.upper() + "\t", "one two", "ONE  two", None, "  ", "one"]
    return [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def test_stage_equals_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(brute(rows))


def test_large_buckets_lose_no_pair(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.one_of_each(df, small=1, centres=1)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(brute(rows))


def test_repeated_and_null_keys(spark):
    rows = [(None, "a b"), (3, "A b"), (3, "a  b"), (3, "c d"), (5, "c d"), (7, "e")]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower().split()[0]) for r in got) == [
        (0, "a"), (3, "a"), (3, "c"), (7, "e")]
