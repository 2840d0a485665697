"""Language identification, spelling variants and vector codes against brute force, and on odd inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkprep.llm import langid, spelling, vectorcodes
from tests.llm.test_llm import SF, needs_tables, odd, rows  # noqa: F401
from tests.oracle import ROOT

# ---- language identification

TINY = [
    (1, "en", "the cat sat on the mat the end"), (2, "fr", "le chat dort sur le lit le soir"), (3, "en", "the dog and the cat ran"), (4, "fr", "la nuit le chien et le chat"),
    (5, None, "the the the"), (6, "en", None), (7, "fr", ""),
]


def brute_model(texts, longest=5):
    """{(lang, size, token): relative frequency} without any bound."""
    words = Counter((lang, w) for lang, t in texts for w in re.findall(r"[a-zà-ÿ]+", t.lower()))
    totals = Counter()
    for (lang, _), n in words.items():
        totals[lang] += n
    known = {k: n for k, n in words.items() if n >= 2}
    share = {(lang, 0, w): n / totals[lang] for (lang, w), n in known.items()}
    grams, sums = Counter(), Counter()
    for (lang, w), n in known.items():
        for size in range(1, longest + 1):
            for k in range(len(w) + 3 - size):
                grams[lang, size, f" {w} "[k:k + size]] += n
                sums[lang, size] += n
    return share | {k: n / sums[k[:2]] for k, n in grams.items()}


def brute_gain(word, share, lang, langs, longest=5):
    gain = lambda size, token: max(7 + math.log10(share[lang, size, token]), 0) if (lang, size, token) in share else 0.0
    if any((x, 0, word) in share for x in langs):
        return gain(0, word)
    for size in range(longest, 0, -1):
        grams = [f" {word} "[k:k + size] for k in range(len(word) + 3 - size)]
        known = [g for g in grams if any((x, size, g) in share for x in langs)]
        if known:
            return sum(gain(size, g) for g in known) / len(known)
    return 0.0


def test_scores_against_brute_force(spark):
    df = spark.createDataFrame(TINY, "doc_id long, lang string, text string")
    model = langid.learned(df)
    share = brute_model([(lang, t) for _, lang, t in TINY if lang and t])
    langs = model["langs"]
    assert langs == ["fr", "en"]  # 15 words against 14
    for text in ("the cat", "le chat noir", "then chats", "zzz", "the le the", "chien ran Chienne"):
        words = langid.text_words(text)
        got = langid.scores(words, model, {})
        want = [sum(brute_gain(w, share, lang, langs) for w in words) / len(words) for lang in langs]
        assert np.allclose(got, want)


def test_letters():
    assert langid.text_words("Été 2² x_y 日本 l'Eau") == ["été", "x", "y", "日本", "l", "eau"]
    assert langid.text_words("12 ² _ !") == langid.text_words(None) == []


def test_bound_of_the_model(spark):
    df = spark.createDataFrame([(1, "en", " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(1000) for _ in range(1 + k % 7)))], "doc_id long, lang string, text string")
    model = langid.learned(df, most=50)
    assert 0 < len(model["tokens"][0]) <= 50 and sum(map(len, model["tokens"][1:])) <= 50


def test_language_id_on_odd_rows(spark, odd):
    out = langid.language_id(odd)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if r["doc_id"] in (1, 2, 12) or (r["doc_id"] is None and r["score"] == 0) else "en")
    assert langid.language_id(odd.limit(0)).count() == 0
    untaught = langid.language_id(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r) for r in untaught.select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_language_is_no_input_of_a_prediction(spark):
    """Held-out rows get the same prediction whatever their language says."""
    df = spark.createDataFrame([(k, "en" if k % 2 else "fr", TINY[k % 2][2]) for k in range(60)], "doc_id long, lang string, text string")
    plain = {r["doc_id"]: tuple(r) for r in langid.language_id(df).collect()}
    swapped = df.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert {r["doc_id"]: tuple(r) for r in langid.language_id(swapped).collect()} == plain


@needs_tables
def test_held_out_accuracy(spark):
    sf_dir = f"{ROOT}/sf0.01"
    got = entry.queries()["op11_language_id"](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.99


# ---- spelling variants


def brute_words(docs, least=5):
    out = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(counts):
    form, n_near = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts[form[w]] if form[w] else None))
    return out


def variant_docs():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÉÿ×÷abc"]
    docs = []
    for key in range(400):
        words = []
        for _ in range(30):
            w = stems[min(int(rng.expovariate(0.12)), len(stems) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("ABé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:]])
            words.append(w)
        docs.append((key, rng.choice([" ", ", ", "1", "日"]).join(words)))
    return docs + [(500 + k, "planets " * 50 + "planetz " * 8 + "planatz") for k in range(6)]  # a chain


@pytest.mark.parametrize("size", [10**6, 40])
def test_variants_against_brute_force(spark, size):
    docs = variant_docs()
    got = rows(spelling.group_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), size=size))
    want = brute_variants(brute_words(docs))
    assert len(got) == len(want) > 200
    assert set(got) == want
    assert any(r[1] != r[2] and r[1] for r in want)  # a chain of forms


def test_trie_nodes_over_ranges():
    """Equal prefixes of two words or more get equal numbers in all ranges, different ones different numbers."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(300)})
    cuts = [words[30], words[31], words[90]]
    edges = {p: -1 - k for k, p in enumerate(sorted({c[:d] for c in cuts for d in range(len(c) + 1)}))}
    bounds = ["", *cuts, "d"]
    number = {}
    for part in range(4):
        ours = [w for w in words if bounds[part] <= w < bounds[part + 1]]
        ranks, nodes = spelling.number_nodes(ours, part, edges)
        assert ranks == sorted(ranks)
        for w, path in zip(ours, nodes):
            assert len(path) == len(w) + 1
            for d, node in enumerate(path):
                if node is not None:
                    assert number.setdefault(node, w[:d]) == w[:d]
                else:
                    assert sum(x.startswith(w[:d]) for x in words) == 1
    assert len(set(number.values())) == len(number)


def test_very_long_words(spark):
    """Linear in the length of a word."""
    long = "ab" * 200_000
    df = spark.createDataFrame([(k, f"{long} {long}x" if k < 30 else long[:-1]) for k in range(36)], "doc_id long, text string")
    got = {len(r["word"]): (len(r["form"] or ""), r["n"], r["n_near"]) for r in spelling.group_variants(df, typo_every=None).collect()}
    assert got == {400_000: (0, 30, 2), 400_001: (0, 30, 1), 399_999: (400_000, 6, 1)}


def test_variants_on_odd_rows(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert set(rows(spelling.group_variants(odd))) == brute_variants(brute_words(docs))
    assert spelling.group_variants(odd.limit(0)).count() == 0
    plain = spelling.group_variants(odd, least_length=1, least_count=1, typo_every=None)
    assert {r["word"] for r in plain.collect()} >= {"one", "a" * 50_000, "x"}
    with pytest.raises(ValueError):
        spelling.group_variants(odd, ratio=1)


# ---- vector codes


def brute_codes(table, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cells = [[[math.floor(4096 * x) for x in v[p * len(v) // parts:(p + 1) * len(v) // parts]] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cells[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cells]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                ours = [c[p] for c, code in zip(cells, codes) if code[p][1] == k]
                if ours:
                    books[p][k] = [sum(col) // len(ours) for col in zip(*ours)]
    codes = assign()
    text = ",".join(str(x) for book in books for e in book for x in e)
    by_label = Counter()
    for (_, _, label), code in zip(kept, codes):
        by_label[label] += sum(d for d, _ in code)
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in code), sum(d for d, _ in code), by_label[label], hashlib.sha256(text.encode()).hexdigest())
         for (i, _, label), code in zip(kept, codes)), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error long"


@pytest.mark.parametrize("n", [300, 9, 1])
def test_codes_against_brute_force(spark, n):
    rng = random.Random(n)
    table = [(k * 3, [rng.choice([-1.0, 0.0, 0.3, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(n)]
    table += [(None, table[0][1], 1), (0, table[0][1], None), (5, None, 1), (6, [1.0] * 15 + [None], 1), (7, [math.nan] * 16, 2), (8, [math.inf] * 16, 2)]
    rng.shuffle(table)
    df = spark.createDataFrame([(*r, "c", 1) for r in table], VECTORS).repartition(4)
    got = vectorcodes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(rows(got), key=str) == brute_codes(table)


def test_bounds_prune_and_keep_ties():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    cells = centres[rng.integers(0, 16, 5000)] + rng.integers(-60, 60, (5000, 8))
    book = centres.copy()
    book[9] = book[2]  # a tie for every row: the lower index wins
    pivots = book[:4]
    code, best, done = vectorcodes.nearest(cells, vectorcodes.distances(cells, pivots).astype(np.float32).astype(float), book, pivots)
    full = np.square(cells[:, None] - book[None]).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert done < 0.5 * full.size


def test_codes_on_odd_vectors(spark):
    table = [(1, [0.5] * 16, 1), (2, [0.25] * 16, 1), (3, [], 1), (4, [1.0] * 8, 1), (5, [1.0] * 12, 2), (6, [1e300] * 16, 2), (7, None, 3)]
    got = {r["vec_id"]: r for r in vectorcodes.compress(spark.createDataFrame([(*r, "c", 1) for r in table], VECTORS)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert [got[k]["code"] for k in (1, 2)] == ["00" * 8, "01" * 8]
    assert all(got[k]["code"] is None and got[k]["error"] is None for k in (3, 4, 5, 6))
    assert (got[1]["label_error"], got[5]["label_error"]) == (0, None)
    none = spark.createDataFrame([], VECTORS)
    assert vectorcodes.compress(none).count() == 0
    bad = vectorcodes.compress(spark.createDataFrame([(3, [], 1, "c", 1)], VECTORS)).collect()
    assert [tuple(r) for r in bad] == [(3, None, None, None, None)]
    with pytest.raises(ValueError):
        vectorcodes.compress(none, entries=300)
