"""Centroid clusters, perplexity rules and source divergences against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.llm import centroids, divergence, perplexity

# centroid clusters


def slow_clusters(rows, width, scale, k, rounds, prefix="2:"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{prefix}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c
                 for j, c in enumerate(cents)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in final:
        inertia[c] += d
    def long(x):
        return x if x < 2 ** 63 else None
    return sorted(((i, c, long(d), long(inertia[c]), long(sum(inertia.values())),
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in final), key=repr)


def clusters(df, **options):
    return sorted(map(tuple, centroids.cluster(df, **options).collect()), key=repr)


@pytest.mark.parametrize(("block", "shard"), [(2, 7), (3, 1000), (8, 16), (1, 5)])
def test_clusters_equal_brute_force(spark, block, shard):
    rng = np.random.default_rng(block)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 8), 1)]) for i in rng.permutation(90)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies
    rows += [(300, None), (301, [0.1] * 7), (302, []), (303, [float("nan")] + [0.0] * 7), (304, [None] * 8),
             (305, [float("-inf")] + [0.0] * 7), (None, [0.25] * 8), (7, [0.5] * 8), (306, [-0.0] * 8), (307, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, ids int")
    want = slow_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
                          for i, v in rows], 8, 256, 9, 3)
    assert clusters(df, width=8, k=9, rounds=3, block=block, shard=shard) == want


def test_clusters_of_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 14)]) for i in range(40)]
    rows += [(90, [1e300, 0.0, 1.0, -1e300]), (91, [2.0 ** 60, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters(df, width=4, k=5, rounds=3, shard=10) == slow_clusters(rows, 4, 256, 5, 3)


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [r[1] for r in clusters(df, width=2, k=40)] == [0, 0]
    assert clusters(df.where("vec_id > 5"), width=2) == []
    assert clusters(df, width=3) == []


# perplexity rules

def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


TEXTS = ["", None, "  \n\t ", "one", "a b c d e f g h " * 9, "línea\nlínea\n línea\n\n\n", "x # y$ <b> ||", "\x85word w \x1f",
         "é" * 50, "up and down the old road we go " * 40 + "home"]


def slow_model(texts):
    """Modified Kneser-Ney by counting in plain dictionaries; a function from (context, byte) to a share."""
    three = Counter()
    for t in texts:
        b = b"\n\n" + (t or "").encode()
        three.update(b[i - 2:i + 1] for i in range(2, len(b)))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def discounts(counts):
        n = Counter(counts.values())
        if not (n[1] and n[2]):
            return [0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        found = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
        return [min(max(d, 0), i) for i, d in enumerate(found, 1)]

    levels = [(c, discounts(c)) for c in (one, two, three)]

    def share(gram):
        if not gram:
            return 1 / 256
        counts, d = levels[len(gram) - 1]
        rivals = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        left = sum(d[min(n, 3) - 1] for n in rivals) / sum(rivals)
        n = counts.get(gram, 0)
        own = max(n - d[min(n, 3) - 1], 0) / sum(rivals) if n else 0.0
        return own + left * share(gram[1:])
    return share


def test_base_rules_and_bits_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = TEXTS + [" ".join(rng.choice(["ash", "birch", "cedar", "Über", "elm\n"], 30)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, gram int")
    grams = perplexity.model(df)
    rows = perplexity.scored(df, perplexity.sorted_arrays(grams)).collect()
    share = slow_model(texts)
    for r in rows:
        text = texts[r["key"]]
        assert tuple(r[2:7]) == slow_base(text), text
        if not text:
            assert r["bits"] is None
            continue
        b = b"\n\n" + text.encode()
        assert r["bits"] == pytest.approx(np.mean([-math.log2(share(b[i - 2:i + 1])) for i in range(2, len(b))]), abs=1e-9)


def test_shares_of_a_context_sum_to_one():
    share = slow_model(["the cat sat on the mat", "the dog"])
    assert sum(share(b"th" + bytes([c])) for c in range(256)) == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words_of_any_sequence(words):
    assert perplexity.repeated_words(words) == slow_base(b" ".join(words).decode())[4]


def test_rules_reject_outliers_of_their_language_only(spark):
    rng = np.random.default_rng(11)
    plain = [(i, " ".join(rng.choice("oak elm ash fir yew pine rowan maple".split(), 60)), "en") for i in range(150)]
    other = [(1000 + i, " ".join(rng.choice("ДУБ ЕЛЬ КЛЁН ЛИПА ИВА".split(), 60)), "ru") for i in range(60)]
    strange = [(2000, "".join(chr(int(c)) for c in rng.integers(33, 127, 300))+ " {} q} [x ]" * 1 + " ".join(map(chr, range(64, 96))), "en"),
               (2001, other[0][1][::-1], "en")]
    short = [(3000, "oak elm", "en"), (3001, None, "en"), (3002, "", None), (None, plain[0][1], "en"), (0, plain[0][1], "en")]
    rows = [(*r, "s", 1.0) for r in plain + other + strange + short]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, bits double")
    found = perplexity.rules(df).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert not kept & {2000, 2001, 3000, 3001, 3002}
    assert {r[0] for r in plain + other} - kept == set() and None in kept
    assert all(r["base_failed"] == (r["doc_id"] in (3000, 3001, 3002)) for r in found)
    assert perplexity.rules(df.where("false")).count() == 0


# divergence of sources

def slow_divergences(rows, least, prior, top):
    terms = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, df in docs.items():
        kept = [t for t, n in df.items() if n >= least]
        mine = {s: c for (a, s), c in counts.items() if a == lang}

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + prior) // (total + prior * len(kept)) for t in kept}

        whole = shares(sum(mine.values(), Counter()))
        each = {s: shares(c) for s, c in mine.items()}
        for s, p in each.items():
            pairs = sorted((-sum(abs(p[t] - each[o][t]) for t in kept), o) for o in each if o != s)
            marks = sorted((whole[t] - p[t], t) for t in kept if mine[s][t] and p[t] > whole[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", marks))
                    for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found_divergences(df, **options):
    return sorted(map(tuple, divergence.divergences(df, **options)
                      .select("lang", "source", "part", "item", "value", "rank").collect()))


def divergence_rows(n=240):
    rng = np.random.default_rng(2)
    words = [f"w{a}" for a in "abcdefghijklmnop"] + ["Élan", "naïve", "日本", "ÉTÉ", "it's"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 5)}")
            for _ in range(n)]
    return rows + [rows[0]] * 100 + [(None, None, None), ("", "xx", "quiet"), ("1 2 3", "xx", "still"), (None, "en", "mute"),
                                     ("wa " * 500, "en", "loud"), ("wa", "en", None)]


@pytest.mark.parametrize("side", [2, 256])
def test_divergences_equal_brute_force(spark, monkeypatch, side):
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    monkeypatch.setattr(divergence, "SIDE", side)
    assert found_divergences(df, least_docs=9, prior=5, top=4) == slow_divergences(rows, 9, 5, 4)


def test_stripes_do_not_depend_on_spills(spark):
    rows = divergence_rows(60)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    def table(most):
        return sorted((r["lang"], r["term"] or "", r["n_docs"], sorted((c["source"], c["n"]) for c in r["cells"]))
                      for r in divergence.stripes(df, most=most).collect())
    assert table(5) == table(10 ** 6)


def test_divergences_without_rows_or_kept_terms(spark):
    df = spark.createDataFrame([("a b", "en", "s"), ("c", "en", "t")], "text string, lang string, source string")
    assert found_divergences(df) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert found_divergences(df.where("false")) == []


def test_terms_of_long_texts_in_pieces():
    text = "Abc dÉ\x7ff ghi[" * 400
    assert [w.decode() for w in sum(divergence.terms(text.encode(), 7), [])] == ["abc", "dÉ", "f", "ghi"] * 400


def test_shares_are_exact_for_large_counts():
    count = np.array([[10 ** 15, 3], [7, 0]])
    total = np.array([2 * 10 ** 15 + 7, 3])
    want = [[1 + 10 ** 9 * (int(c) + 5) // (int(t) + 10) for c, t in zip(row, total, strict=True)] for row in count]
    assert divergence.shares(count, total, 2, 5).tolist() == want
