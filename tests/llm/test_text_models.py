"""Classifiers, language-model scores, decontamination, tokenizers and chat formatting."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from axisframe.llm import bpe, chat, decontaminate, pseudo_likelihood, quality, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SYLLABLES = "ba de ki lo mu na pe ri so tu va wo".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n))


# byte-level BPE

@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return bpe.Codec(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80) | st.text(alphabet="ab 'st1\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_tiktoken(codec, reference, text):
    text = text.encode("utf-8", "replace").decode()
    ids, decimals = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert decimals == " ".join(map(str, ids))
    assert "".join(codec.decode(ids, 3)) == text


def test_long_pieces_and_forgotten_states(codec, reference, monkeypatch):
    monkeypatch.setattr(codec.merges, "bounds", bpe.Bounds(50, 100, 5))
    for text in ("a" * 20_000, "thequickbrown" * 900, "é" * 6000, " " * 9000 + "x"):
        assert codec.encode(text)[0].tolist() == reference.encode_ordinary(text)


def test_round_trip_with_ids_in_narrow_bounds(spark, reference):
    texts = ["", None, "Hello  wörld\n", "a" * 3000, "Hello  wörld\n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.round_trip(df, "doc_id", RANKS, public_tokenizers.PATTERN, with_ids=True,
                          bounds=bpe.Bounds(20, 30, 2)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@given(st.binary(max_size=40), st.integers(1, 4))
def test_utf8_stream(raw, step):
    stream = bpe.Utf8Stream()
    parts = [stream.feed(raw[i:i + step]) for i in range(0, len(raw), step)] + [stream.close()]
    if b"\xef\xbf\xbd" not in raw:
        try:
            assert "".join(parts) == raw.decode()
        except UnicodeDecodeError:
            assert "�" in "".join(parts)


def test_bpe_rows(spark, reference):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "naïve 🎉"), (3, None), (4, "")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in bpe.round_trip(df, "doc_id", RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for k, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    ids = bpe.encode(df, "doc_id", RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, "doc_id", RANKS)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(df.where("false"), "doc_id", RANKS, public_tokenizers.PATTERN).count() == 0


# token counts

def unigram(pieces):
    worst = min(s for _, s in pieces)
    return Tokenizer(models.Unigram([("<unk>", worst), *pieces, *((f"<0x{i:02X}>", worst) for i in range(256))], 0, True))


@given(st.text(alphabet="abc ▁é\n", max_size=40),
       st.dictionaries(st.text(alphabet="abcé▁", min_size=1, max_size=4), st.integers(-9, -1), min_size=1, max_size=25))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_tokenizer(text, scores):
    pieces = [(p, float(s)) for p, s in scores.items()]
    n, _ = token_counts.Counter(pieces).total(text)
    shown = token_counts.BLANK + text.replace(" ", token_counts.BLANK)
    assert n == (len(unigram(pieces).encode(shown, add_special_tokens=False).ids) if text else 0)


def test_count_rows(spark):
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    texts = [prose(rng, 300), "", None, "日本 🎉", "a\n\n b"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, pieces).collect()}
    ref = unigram(pieces)
    assert got == {i: len(ref.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
                   for i, t in enumerate(texts)}


# decontamination

def distance_in(item, text):
    """Least edits of an item anywhere in a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def test_leaks_with_edits_are_found():
    rng = np.random.default_rng(3)
    items = [prose(rng, n) for n in (6, 12, 30, 50)]
    q = min(decontaminate.gram_size(len(i), decontaminate.Q, decontaminate.RATE) for i in items)
    index = decontaminate.Index.build([10, 11, 12, 13], items, q, decontaminate.RATE)
    assert (index.need >= 1).all()
    for trial in range(60):
        k = trial % 4
        text = list(items[k])
        for _ in range(rng.integers(0, index.budget[k] + 2)):
            place, kind = rng.integers(len(text)), rng.integers(3)
            text[place:place + (kind < 2)] = ["z"] if kind else []
        whole = prose(rng, 20) + " " + "".join(text).upper() + "\n" + prose(rng, 15)
        found = decontaminate.leaks_in(["", whole, prose(rng, 40)], [index])
        low = whole.lower().replace("\n", " ")
        least = distance_in(items[k], low)
        mine = [f for f in found if f[1] == 10 + k]
        assert bool(mine) == (least <= index.budget[k])
        assert all(f[0] == 1 for f in mine)
        if mine:
            row, _, start, end, distance = min(mine, key=lambda f: f[4])
            assert distance == least == distance_in(items[k], low[start:end])


@pytest.mark.parametrize("length", [*range(3, 27), 37, 38, 39, 40])
def test_short_items_have_their_whole_budget(length):
    rng = np.random.default_rng(length)
    letters = list("abcdefghij klm")
    item = "".join(rng.choice(letters, length))
    q = decontaminate.gram_size(length, decontaminate.Q, decontaminate.RATE)
    index = decontaminate.Index.build(["it"], [item], q, decontaminate.RATE)
    assert index.budget[0] == int(0.08 * length) and index.need[0] >= 1 and q <= decontaminate.Q
    texts = []
    for trial in range(12):
        text = list(item)
        for _ in range(trial % (int(index.budget[0]) + 2)):
            place, kind = rng.integers(len(text)), rng.integers(3)
            text[place:place + (kind < 2)] = ["z"] if kind else []
        texts.append("".join(rng.choice(letters, rng.integers(0, 30))) + "".join(text) + "".join(rng.choice(letters, 9)))
    found = decontaminate.leaks_in(texts, [index])
    assert {f[1] for f in found} == {"it"}
    for row, text in enumerate(texts):
        assert any(f[0] == row for f in found) == (distance_in(item, text) <= index.budget[0]), (item, text)


def test_items_of_all_sizes_in_one_pass(spark):
    bench = spark.createDataFrame([(1, "zq"), (2, "xyz"), (3, "kitten sits on"), (4, "m" * 25)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "zq is too short"), (2, "An XYZ"), (3, "the kitten sit on it"), (4, "m" * 23 + "!"), (5, None)],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(2, 2, 0), (3, 3, 1), (4, 4, 2)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 5]


def test_leak_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = [(1, prose(rng, 20)), (1, "short"), (None, prose(rng, 20)), (2, None), (3, prose(rng, 25)), (3, prose(rng, 25))]
    docs = [(7, "x " + items[0][1]), (7, "x " + items[0][1]), (None, items[2][1] + " y"), (8, None), (9, prose(rng, 80)), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in docs], "doc_id long, text string, item_id int, body int")
    want = sorted([(7, 1, 2, 2 + len(items[0][1]), 0)] * 2 + [(None, None, 0, len(items[2][1]), 0)], key=repr)
    for chars in (4_000_000, 60):  # one block, many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = decontaminate.leaks(df, bench)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [8, 9, 10]
    assert decontaminate.leaks(df, bench.where("false")).count() == 0
    assert decontaminate.leaks(df.where("false"), bench).count() == 0


# classifiers

def labelled(spark, marks, label):
    """Documents in which ``marks(rng)`` makes the texts of label 1."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(160):
        y = int(i % 4 == 0)
        rows.append((i, marks(rng, y), "en", "label"))
        labels.append((i, y))
    rows += [(900, None, None, None), (901, "", "en", "x"), (None, prose(rng, 10), "en", "x")]
    labels += [(None, 1), (901, None), (5000, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, y string"),
            spark.createDataFrame(labels, f"doc_id long, {label} int"))


def held_out_accuracy(rows, held, parts):
    picked = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 160]
    for r in picked:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    tested = [r for r in picked if r["held_out"]]
    return sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in tested) / len(tested)


def test_quality(spark):
    docs, labels = labelled(spark, lambda rng, y: prose(rng, 120) if y else "%%% ".join(
        prose(rng, 120).split(" ")), "quality")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 163 and held_out_accuracy(rows, 0, 5) > 0.9
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == 163


def test_quality_score_depends_on_the_text_alone():
    rng = np.random.default_rng(1)
    texts = [prose(rng, n).encode() for n in (1, 3, 50, 400, 37)] + [b"", b"z" * 256, b"z" * 512]
    net = quality.fit([[t[:400]] for t in texts], np.arange(len(texts)) % 2, np.ones(len(texts)), steps=5)
    import pyarrow as pa
    together = quality.probabilities(pa.array(texts, pa.binary()), net)
    alone = [quality.probabilities(pa.array([t], pa.binary()), net)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5), (together, alone)


def test_toxicity(spark):
    def text(rng, y):
        words = prose(rng, 60).split(" ")
        if y:
            words[int(rng.integers(60))] = f"grumf{rng.choice(SYLLABLES)}"
        return " ".join(words)
    docs, labels = labelled(spark, text, "toxic")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 163 and held_out_accuracy(rows, 2, 4) > 0.95
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        if r["predicted"] and r["doc_id"] is not None:
            assert any(texts[r["doc_id"]][s["start"]:s["end"]].startswith("grumf") for s in r["spans"])
    assert toxicity.classify(docs.where("false"), labels).count() == 0
    assert not any(r["predicted"] for r in toxicity.classify(docs, labels.where("false")).collect())


def test_toxic_offsets_are_places_of_the_text(spark):
    field = toxicity.Field(np.zeros(toxicity.FEATURES), np.zeros((2, 2)), 0.0, np.array([-2.0, 1.0, 0.0]))
    field.weights[[toxicity._slot(u) for u in toxicity.units("grumf")]] = 3.0
    texts = ["\u0130\u0130\u0130 grumf you", "GRUMF", None, "", "\u0130" * 40 + " a Grumf, grumf b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["spans"]]
            for r in toxicity.tag(docs, field).collect()}
    assert rows[0] == ["grumf"] and rows[1] == ["GRUMF"] and rows[2] == rows[3] == []
    assert rows[4] == ["Grumf, grumf"]


def test_pieces_of_the_fit_are_spread():
    words = [f"w{i}" for i in range(64 * 40)]
    bad = {"=w" + str(i) for i in range(64, 64 * 40, 128)}  # a toxic token in every other piece
    got = toxicity.pieces_of(words, True, bad)
    starts = [int(w[0][1:]) // 64 for w, _ in got]
    assert starts[:6] == [1, 7, 13, 21, 27, 33] and len(got) == 12 and max(starts[6:]) > 30
    assert not any(any(m) for _, m in toxicity.pieces_of(words, False, bad))
    assert toxicity.pieces_of([], True, bad) == []


def test_telling_units_equal_the_plain_formula(spark):
    n1, n0 = 40, 70
    cells = [(f"u{a}-{b}", a, b) for a in (0, 1, 4, 9, 20, 40) for b in (0, 1, 3, 70)]
    want = set()
    for name, a, b in cells:
        if a and (a / n1 > 20 * (b + 0.5) / n0 or (a > 3 and not b)):
            p, q, r = a / n1, max(b, 1e-9) / n0, (a + b) / (n0 + n1)
            total = a * np.log(p / r) + b * np.log(q / r)
            total += (n1 - a) * np.log((1 - p) / (1 - r)) if a < n1 else 0
            total += (n0 - b) * np.log((1 - q) / (1 - r)) if b < n0 else 0
            if 2 * total >= toxicity.EVIDENCE:
                want.add(name)
    counts = spark.createDataFrame(cells, "unit string, a long, b long")
    assert {r["unit"] for r in toxicity.telling(counts, n1, n0).collect()} == want and 0 < len(want) < len(cells)


def test_a_repeated_id_gives_one_sample_row_whatever_the_order(spark):
    from axisframe.llm.labelled import sample
    rows = [(1, "one"), (1, "two"), (1, None), (2, "b")]
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    got = [sorted(map(tuple, sample(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "doc_id",
                                    "toxic", F.lit(False), {0: 9, 1: 9}).collect()))
           for n, r in ((1, rows), (3, rows[::-1]))]
    assert got[0] == got[1] and [(r[0], r[2]) for r in got[0]] == [(1, 1), (2, 0)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(9)
    field = toxicity.Field(np.zeros(1), rng.normal(size=(2, 2)), 0.4, np.zeros(3))
    ends = np.array([0, 3, 3, 7, 8])
    emissions = rng.normal(size=8)
    got = toxicity.marginals(emissions, ends, field)
    for a, b in zip(ends, ends[1:], strict=False):
        mass = np.zeros((b - a, 2))
        for path in range(1 << (b - a)):
            tags = [path >> i & 1 for i in range(b - a)]
            total = sum(emissions[a + i] for i, t in enumerate(tags) if t) + (field.start if tags and tags[0] else 0)
            total += sum(field.move[x, y] for x, y in zip(tags, tags[1:], strict=False))
            for i, t in enumerate(tags):
                mass[i, t] += np.exp(total)
        if b > a:
            assert np.allclose(got[a:b], np.log(mass[:, 1] / mass[:, 0]))


# pseudo-likelihood

def test_pseudo_likelihood(spark):
    rng = np.random.default_rng(7)
    phrases = ["the red fox ran over the old bridge", "a cold wind came down from the high hill"]
    rows = [(i, " ".join(rng.choice(phrases, 30))) for i in range(60)]
    words = " ".join(phrases).split()
    rows += [(100, " ".join(rng.choice(words, 240))), (101, None), (102, "  "), (None, "fox"), (0, rows[0][1])]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, h int")
    got = pseudo_likelihood.score(df, rate=1).collect()
    assert len(got) == len(rows)
    mean = {r["doc_id"]: r["mean_log_probability"] for r in got}
    assert mean[101] is None and mean[102] is None
    assert mean[100] < min(mean[i] for i in range(60)) - 0.3  # shuffled words are less likely
    assert sum(r["doc_id"] == 0 for r in got) == 2
    assert pseudo_likelihood.score(df.where("false")).count() == 0


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "TYPES", 200)
    counts = np.random.default_rng(0).integers(0, 9, 200).astype(float)
    of, share = pseudo_likelihood.classes_of(counts)
    types = np.array([5, 9, 7, 1, 4], np.int32)
    total = np.zeros(5)
    for t in range(1, 200):
        for place in range(5):
            changed = types.copy()
            changed[place] = t
            total[place] += np.exp(pseudo_likelihood.log_probabilities(
                changed, np.array([0, 5]), pseudo_likelihood.start(), of, share)[place])
    assert np.allclose(total, 1, atol=1e-4)


# chat formatting

def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (3, 1, "assistant", "b"),
              (3, 0, "user", "a"), (None, 0, "user", "x"), (4, 0, "user", "only")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "ok"), (2, 0, "user", ""),
                (3, 0, "user", "a"), (5, 0, None, "late")]
    got = {r["pair_id"]: r for r in chat.format_preferences(
        spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["n_prompt_turns"] == 1
    assert got[1]["chosen"] == "<|assistant|>\nyes<|end|>\n"
    assert got[1]["chosen_mask"] == "0" * 14 + "1" * 11
    assert got[1]["rejected"] == "<|assistant|>\nno<|end|>\n<|user|>\nok<|end|>\n"
    assert got[1]["rejected_mask"] == "0" * 14 + "1" * 10 + "0" * 19
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert (got[3]["n_prompt_turns"], got[3]["rejected"]) == (1, "")
    assert (got[4]["prompt"], got[4]["chosen"]) == ("", "<|user|>\nonly<|end|>\n")
    assert got[5]["rejected"] == "<||>\nlate<|end|>\n"
    empty = spark.createDataFrame([], schema)
    assert chat.format_preferences(empty, empty).count() == 0
