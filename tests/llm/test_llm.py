"""Dealt operators against brute-force versions, and on odd inputs."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkprep.llm import (
    common, decontaminate, linededup, quality, secretscan, sentencepiece_sa, shards, simhash, substrings, urlfilter, weaklabels,
)
from tests.oracle import ROOT

SF = f"{ROOT}/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
WORDS = [f"w{k}" for k in range(4000)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(f"long{k}", 12) for k in range(3000))
#: NULL id and text, empty and blank texts, a very long one, repeated rows, ties, and clashing column names.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, ids string, leaks string, score string, rule string"
ODD = [
    (None, None), (1, ""), (2, " \n\t "), (3, LONG), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (6, prose(6, 80)), (7, prose(6, 80)), (8, prose(8, 80)),
    (9, "x " * 500), (10, "a" * 50_000), (11, "日本 ### '\"\\ \u0000 😀"), (12, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, 6, "i", "l", "s", "r") for i, t in ODD], ODD_SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- URL filters

def brute_rule(url):
    host, path = urlfilter.split_url(url)
    fits = []
    for text, verdict in urlfilter.HOST_RULES:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else None


def test_url_rules(spark):
    urls = [
        None, "", "net/x", "http://", "https://NET/", "https://a.Example.NET/en/x?q#f", "https://badexample.net/en/", "http://x.example.com/de/1", "http://x.org/fr/#t",
        "http://x.net", "http://x.net?a=/", "a://b://c.net/", "http://ads-track.example.com/a", "http://x.com/login", "http://x.org/fr", "http://x.com/?sessionid=1",
        "http://x.example.com/de", "HTTP://X.ORG/fr/?login", "http://x.com/a\nb", "http://é.net/",
    ]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    got = urlfilter.judge_urls(df, keep=["page_id"]).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        url = urls[r["page_id"] % len(urls)]
        want = brute_rule(url)
        assert (r["host"], r["path"]) == urlfilter.split_url(url)
        assert r["rule"] == (want[0] if want else None)
        if want:
            assert r["verdict"] == want[1]
    by_url = {urls[r["page_id"] % len(urls)]: r["verdict"] for r in got}
    assert by_url["http://ads-track.example.com/a"] == by_url["http://x.com/login"] == by_url["http://x.com/?sessionid=1"] == "block"
    assert by_url[None] == "allow"
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_rules_in_several_passes_agree(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"http://h{k % 7}.example.{t}/{p}/{k}") for k in range(40) for t in ("net", "org", "com") for p in ("en", "de", "fr")], "page_id long, url string")
    whole = sorted(rows(urlfilter.judge_urls(df)))
    monkeypatch.setattr(urlfilter, "RULES_PER_PASS", 2)
    assert sorted(rows(urlfilter.judge_urls(df))) == whole


# ---- Shards

def test_shards_balance_and_number_rows(spark):
    data = [(k, prose(k, 20 + k % 37)) for k in range(1500)] + [(5000 + k, "hot " * 30) for k in range(900)]
    got = shards.shard_rows(spark.createDataFrame(data, "doc_id long, text string"), bundles=32).collect()
    by = {s: [r for r in got if r["shard"] == s] for s in range(24)}
    assert len(got) == len(data) and sum(map(len, by.values())) == len(data)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) < 1.05 * sum(sizes) / 24 and min(sizes) > 0.95 * sum(sizes) / 24
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_shards_of_one_row_repeated(spark):
    """Thousands of copies of a row, id included, are spread like different rows."""
    data = [(None, "hot " * 75)] * 4000 + [(k, prose(k, 1)) for k in range(2000)]
    got = shards.shard_rows(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    sizes, counts = Counter(), Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert len({(r["shard"], r["slot"]) for r in got}) == 6000 and len(sizes) == 24
    assert max(sizes.values()) < 1.06 * sum(sizes.values()) / 24 and min(sizes.values()) > 0.94 * sum(sizes.values()) / 24


def test_shards_on_odd_rows(spark, odd):
    import zlib

    got = shards.shard_rows(odd).collect()
    assert len(got) == len(ODD) and len({(r["shard"], r["slot"]) for r in got}) == len(ODD)
    want = Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert shards.shard_rows(odd.limit(0)).count() == 0


# ---- SimHash

def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k in range(len(fps)):
        low[find(k)] = min([x for x in (low.get(find(k)), ids[k]) if x is not None], default=None)
    return [low[find(k)] for k in range(len(fps))]


@pytest.mark.parametrize("tile", [4, 8192])
def test_simhash_against_brute_force(spark, odd, tile):
    more = [(100 + k, prose(k // 3, 60) + f" {k % 3}") for k in range(60)]
    df = odd.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("fp", F.lit(1).cast("long")))
    data = ODD + more
    fps = [brute_fingerprint(t, 4) for _, t in data]
    want = Counter(zip([i for i, _ in data], [f"{f:016x}" for f in fps], brute_components([i for i, _ in data], fps, 4)))
    assert Counter(rows(simhash.near_duplicates(df, tile=tile))) == want
    kept = simhash.keep_one(df, tile=tile)
    assert kept.columns == df.columns
    named = {c for *_, c in want}
    assert {r["doc_id"] for r in kept.collect()} == named and kept.count() == len(named)
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def five_word_sets(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("tile", [16, 8192])
def test_near_copies_by_exact_similarity(spark, odd, tile):
    rng, data = random.Random(4), []
    for k in range(60):
        words = prose(f"near{k}", 150).split()
        data.append((len(data), " ".join(words)))
        for spots in ([20 * k % 150], [30, 90], [10, 60, 110], [15, 45, 75, 105]):
            copy = list(words)
            for i in spots:
                copy[i] = f"new{rng.random()}"
            data.append((len(data), " ".join(copy)))
    sets = [five_word_sets(t) for _, t in data]
    root = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r["doc_id"] for r in simhash.keep_one_similar(spark.createDataFrame(data, "doc_id long, text string"), tile=tile).collect()}
    want = set(root)
    assert want <= got and len(got - want) <= 0.02 * (len(data) - len(want))
    # The default fingerprint radius leaves most of them.
    assert len(got) < simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).count()
    kept = simhash.keep_one_similar(odd, tile=tile)
    assert kept.columns == odd.columns and simhash.keep_one_similar(odd.limit(0)).count() == 0
    assert Counter(r["text"] for r in kept.collect()).keys() >= {LONG, "one", ODD[9][1]}


@pytest.mark.parametrize("tile", [40, 8192])
def test_sets_meet_those_of_similar_size(spark, tile):
    """All pairs within the radii whose sizes allow the similarity are candidates, and tiles of other sizes do not meet."""
    rng = np.random.default_rng(9)
    fp, fp2 = (rng.integers(0, 2**63, 30)[rng.integers(0, 30, 900)] ^ (1 << rng.integers(0, 62, 900)) for _ in "ab")
    size = np.floor(np.exp(rng.uniform(0, 9, 900))).astype(int)
    rows = [(int(a), int(b), int(n), k, k) for k, (a, b, n) in enumerate(zip(fp, fp2, size))]
    df = spark.createDataFrame(rows, "fp long, fp2 long, size long, root long, node long")
    apart = lambda x, y: np.bitwise_count((x[:, None] ^ x[None]).view(np.uint64)).astype(int)
    one = apart(fp, fp)
    near = (one <= 16) & (one + apart(fp2, fp2) <= 60) & (np.minimum.outer(size, size) >= 0.8 * np.maximum.outer(size, size))
    want = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    got = [(min(r), max(r)) for r in simhash.candidates(df, 16, 60, 0.8, tile, None).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    met = simhash.sized_tiles(df, 0.8, tile, ["fp", "size", "node"]).selectExpr("x", "y", "size(node) AS n").groupBy("x", "y").agg(F.max("n"), F.min("n")).collect()
    assert tile > 900 or sum(a * b for _, _, a, b in met) < 0.3 * 900 * 900 / 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + k) for k in range(200)] + [(k, k + 1) for k in range(2000, 2060)] + [(7, 7), (None, 1)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long"))))
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)
    assert len(got) == len(near)


# ---- Quality rules

def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = Counter(runs)
    inside = {k + j for k, r in enumerate(runs) if count[r] > 1 for j in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(re.findall("[A-Z]", text)), text.count("!"),
    )


def test_text_statistics_against_brute_force(spark, odd):
    texts = [t for _, t in ODD] + ["a b c a b c d", "a b\na b\n\n \n \nx\r\na b", "a a a a", "b " * 3, "#é#|\u2028 x", "a\u00a0b c", "l\nl\nl\nm\nl"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in quality.statistics(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute_stats(t), (k, t and t[:40])


def test_decision_list_learns_planted_rules():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    found = quality.learn(x, bad, ["a", "b", "c"])
    fresh = rng.random((2000, 3))
    truth = (fresh[:, 0] > 0.8) & (fresh[:, 1] < 0.5) | (fresh[:, 2] > 0.95)
    assert np.mean((found.match(fresh, ["a", "b", "c"]) > 0) == truth) > 0.98
    assert quality.learn(np.zeros((0, 3)), np.zeros(0, bool), ["a", "b", "c"]).rules == []


def test_decision_list_as_a_column(spark):
    """The conditional expression gives row by row what the list gives."""
    rng = np.random.default_rng(12)
    x = rng.random((600, 3)).round(1)
    rules = quality.DecisionList([[("a", ">=", 0.5), ("b", "<", 0.3)], [("b", ">=", 0.9)], [("a", "<", 0.2), ("c", ">=", 0.4), ("b", "<", 0.8)]])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, a double, b double, c double")
    got = dict(rows(df.select("k", rules.column({c: F.col(c) for c in "abc"}))))
    assert [got[k] for k in range(600)] == rules.match(x, list("abc")).tolist() and set(got.values()) == {0, 1, 2, 3}


def test_quality_verdicts_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_verdicts(odd, labels).collect()
    assert len(got) == len(ODD) and all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)
    assert quality.quality_verdicts(odd.limit(0), labels.limit(0)).count() == 0


@needs_tables
def test_quality_rules_keep_good_documents(spark):
    sf = f"{ROOT}/sf0.01"
    got = entry.queries()["op9_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.9


# ---- Weak labels

def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.9
    votes = np.stack([np.where(good, np.where(rng.random(20_000) < 0.003, 0, 1), np.where(rng.random(20_000) < h, 0, 1)) for h in (0.9, 0.7, 0.5)], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 2
    code = votes @ 3 ** np.arange(3)
    codes, count = np.unique(code, return_counts=True)
    model = weaklabels.em(weaklabels.unpack(codes, 3), count.astype(float), ["a", "b", "c"])
    assert abs(model.prior - 0.9) < 0.03 and np.allclose(model.says_bad[:, 0], [0.9, 0.7, 0.5], atol=0.08)


@needs_tables
def test_weak_labels_on_labelled_documents(spark):
    sf = f"{ROOT}/sf0.01"
    got = entry.queries()["op10_weak_labels"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in got if r["quality"] == 0]) < 0.1


def test_weak_labels_on_odd_rows(spark, odd):
    got = weaklabels.classify(odd)
    assert len(got.columns) == len(set(got.columns))
    found = got.collect()
    assert len(found) == len(ODD) and not any(r["kept"] for r in found if not (r["text"] or "").strip())
    assert weaklabels.classify(odd.limit(0)).count() == 0


# ---- Line dedup

def test_line_templates(spark):
    def doc(k):
        return "\n".join([prose(f"a{k}", 9), f"Page {k} of {k + 7} printed by the system", prose(f"b{k}", 9), "All rights reserved here", prose(f"c{k}", 9)])

    data = [(k, doc(k)) for k in range(30)] + [(100 + k, "All rights reserved here") for k in range(3)] + [(200 + k, prose("copy", 9) + "\n" + prose("copy2", 9)) for k in range(40)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for k in range(30):
        assert got[k]["text"] == "\n".join([prose(f"a{k}", 9), prose(f"b{k}", 9), prose(f"c{k}", 9)]) and got[k]["n_dropped"] == 2
    assert got[100]["text"] == "All rights reserved here"  # nothing but recurring lines
    assert got[200]["n_dropped"] == 0  # copies of one text count once


@pytest.mark.parametrize("n", [50, 50_000])
def test_line_templates_at_any_size(spark, n):
    data = [(k, f"own text{k}\nPrinted by the user {WORDS[k % 100]} for office {WORDS[100 + k // 100 % 100]} of this house\nSeen on 2024-{k % 12}-{k % 28} at our web server") for k in range(n)]
    got = linededup.drop_recurring(spark.createDataFrame(data, "doc_id long, text string"))
    assert got.where(F.col("text") == F.concat(F.lit("own text"), "doc_id")).count() == n


def test_recurring_lines_of_any_share_and_length(spark):
    data = [(k, f"{prose(f'm{k}', 5)}\nHome\nAbout us\nAll rights reserved here by the maker of it") for k in range(12)]
    data += [(20 + k, "\n" * k + "Home\nAbout us") for k in range(3)] + [(30, "Only here")]
    got = {r["doc_id"]: r for r in linededup.drop_recurring(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[k]["text"] == prose(f"m{k}", 5) and got[k]["n_dropped"] == 3 for k in range(12))
    assert sum(got[k]["n_dropped"] == 0 for k in range(20, 23)) == 1 and sum(not got[k]["text"].strip() for k in range(20, 23)) == 2
    assert got[30]["text"] == "Only here"


def test_recurring_lines_on_odd_rows(spark, odd):
    got = linededup.drop_recurring(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(ODD)
    assert linededup.drop_recurring(odd.limit(0)).count() == 0


def test_line_dedup_on_odd_rows(spark, odd):
    got = linededup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(ODD)
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


# ---- Decontamination

def levenshtein_part(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_of_parts():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 90))], [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        assert decontaminate.best_match(a, b)[0] == levenshtein_part(a, b)


def edited(words, share, rng):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "new"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return out


def test_leaks_recall_and_precision(spark):
    rng = random.Random(9)
    items = [(k, prose(f"item{k}", rng.randrange(15, 60))) for k in range(60)] + [(200, None), (201, ""), (202, "...")]
    docs, truth = [], {}
    for k in range(400):
        body = prose(f"doc{k}", rng.randrange(5, 300)).split()
        hit = k % 60 if k < 300 else None
        if hit is not None:
            at = rng.randrange(len(body))
            body[at:at] = edited(items[hit][1].split(), [0, 0.05, 0.1][k % 3], rng)
        docs.append((k, ", ".join(body).upper() if k % 2 else " ".join(body)))
        truth[k] = {i for i, t in items if t and t != "..." and levenshtein_part(t.lower().split(), docs[-1][1].lower().replace(",", "").split()) <= len(t.split()) * 0.2}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.with_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r["doc_id"]: {h["item"] for h in r["leaks"]} for r in found}
    want, hits = sum(map(len, truth.values())), sum(len(truth[k] & got[k]) for k in truth)
    assert all(got[k] <= truth[k] for k in truth)
    assert want >= 290 and hits >= 0.97 * want
    assert all(got[k] == truth[k] for k in truth if k < 300 and k % 3 == 0)


@pytest.mark.parametrize("words", [3, 5, 6, 8, 14, 30])
def test_leaks_of_every_length_with_edited_words(words):
    """Recall with as many replaced words as are allowed, short items included."""
    rng = random.Random(words)
    items = [prose(f"short{words}-{k}", words).encode().split() for k in range(150)]
    sketches = decontaminate.build(items)
    texts = []
    for item in items:
        body = [w.decode() for w in item]
        for at in rng.sample(range(words), decontaminate.allowed(words, 0.2)):
            body[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join([prose(f"a{len(texts)}", 20), *body, prose(f"b{len(texts)}", 20)]))
    found = decontaminate.search(texts, items, sketches, 0.2)
    hits = sum(any(hit[0] == k for hit in hits) for k, hits in enumerate(found))
    assert hits >= 0.9 * len(items) and (hits == len(items) or words > 5)


def test_leaks_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, prose(6, 80)), (2, "one"), (3, None)], "item_id long, text string")
    got = decontaminate.with_leaks(odd, items)
    assert got.columns == odd.columns
    by = {r["doc_id"]: {h["item"] for h in r["leaks"]} for r in got.collect() if r["doc_id"] is not None}
    assert by[6] == by[7] == {1} and by[4] == by[5] == {2} and not by[1] and not by[12]
    assert decontaminate.with_leaks(odd.limit(0), items).count() == 0
    assert all(r["leaks"] == [] for r in decontaminate.with_leaks(odd, items.limit(0)).collect())


# ---- Substring dedup

def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, doc = rng.integers(0, 2**63, 200).astype(np.uint64), np.sort(rng.integers(0, 4, 200))
        key, want = [(int(x) >> 24, i) for i, x in enumerate(v)], set()
        for c in range(200):
            left = right = c
            while left > 0 and doc[left - 1] == doc[c] and key[left - 1] > key[c]:
                left -= 1
            while right < 199 and doc[right + 1] == doc[c] and key[right + 1] > key[c]:
                right += 1
            if right - left + 1 >= 9:
                want.add((left, c, right))
        assert set(zip(*(x.tolist() for x in substrings.compact_windows(v, doc, 9)))) == want


def test_verify_finds_every_passage():
    """Several passages of a pair are found, changed ones and repeats included, and none where the parts are too different."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**62, 400).astype(np.uint64), rng.integers(0, 2**62, 300).astype(np.uint64)
    assert substrings.verify(a, b, 0.8, 46) == [] == substrings.verify(a[:0], b, 0.8, 46)
    b[10:70], b[100:150], b[200:245] = a[320:380], a[20:70], a[200:245]
    b[40] = 1
    assert substrings.verify(a, b, 0.8, 46) == [(20, 70, 100, 150), (320, 380, 10, 70)]


def test_repeated_passages(spark):
    rng = random.Random(8)
    passage, near = prose("p", 60), prose("q", 120).split()
    data = [(k, f"{prose(f'x{k}', rng.randrange(40, 200))} {passage} {prose(f'y{k}', 70)}") for k in range(40)]
    for k in range(100, 120):
        words = list(near)
        words[rng.randrange(120)] = "changed"
        data.append((k, f"{prose(f'x{k}', 90)} {' '.join(words)} {prose(f'y{k}', 90)}"))
    data += [(k, prose(f"clean{k}", 200)) for k in range(200, 240)] + [(300, prose("same", 70)), (301, prose("same", 70)), (302, "short"), (303, "short"), (304, None)]
    got = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(got) == {*range(40), *range(100, 120), 300, 301}
    assert all(got[k]["class_id"] == 0 for k in range(40)) and all(got[k]["class_id"] == 100 for k in range(100, 120)) and got[301]["class_id"] == 300
    texts = dict(data)
    for k in range(40):
        assert any(passage in " ".join(texts[k].split()[p["from_word"]:p["to_word"]]) for p in got[k]["passages"])


def test_every_text_of_a_shared_run_is_linked(spark):
    """Texts with one passage are all linked, whichever key leads it, and where a text holds a min-hash twice."""
    rng = random.Random(3)
    passage, other = prose("p", 50), prose("o", 55)
    data = [(k, f"{prose(f'x{k}', rng.randrange(20, 90))} {passage} {prose(f'y{k}', 60)}") for k in range(30)]
    data += [(k, f"{prose(f'x{k}', 30)} {other} {prose(f'y{k}', 25)} {passage if k < 105 else ''}") for k in range(100, 110)]
    broken = passage.split()
    data += [(200, f"{' '.join(broken[:30])} {prose('z', 40)} {' '.join(broken[20:])} {prose('zz', 30)} {passage}")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.repeated_passages(df).collect()}
    assert set(got) == {*range(30), *range(100, 110), 200} and {r["class_id"] for r in got.values()} == {0}
    want = {**{k: 35 for k in range(30)}, **{k: 40 for k in range(100, 105)}, **{k: 9 for k in range(105, 110)}, 200: 35}
    assert {k: r["n_links"] for k, r in got.items()} == want
    texts = dict(data)
    for k, r in got.items():
        words = texts[k].split()
        assert any((passage if k < 105 or k == 200 else other) in " ".join(words[p["from_word"]:p["to_word"]]) for p in r["passages"])


def test_all_pairs_of_an_edited_passage_are_verified(spark):
    """Texts whose shared passage has no unbroken run of 50 words are linked to each other, not to the smallest and largest key only."""
    rng, texts = random.Random(12), []
    words = prose("q", 84).split()
    for k in range(24):
        edited = list(words)
        edited[40 + k % 8] = f"changed{k}"
        # A shingle of the passage stands alone in other texts, so the leaders of its min-hash need not hold the passage.
        texts.append(f"{prose(f'x{k}', rng.randrange(50, 120))} {' '.join(edited)} {prose(f'y{k}', 60)}")
        texts.append(f"{prose(f'z{k}', 60)} {' '.join(words[3 * k:3 * k + 6])} {prose(f'w{k}', 60)}")
    texts.append(f"{prose('v', 70)} {texts[0]} {prose('u', 90)} {' '.join(texts[2].split()[30:])}")  # the passage at two places
    found = {}
    for text in texts:
        tokens = substrings.shingles(text)
        for f in range(substrings.FUNCTIONS):
            v = substrings.mixed(tokens, 1000 + f)
            for left, c, right in zip(*substrings.compact_windows(v, np.zeros(len(v), np.int64), 46)):
                found.setdefault(text, []).append((f, int(v[c]), int(c), int(left), int(right)))
    want = set()
    for s, t in ((s, t) for s in texts for t in texts if s < t):
        met = []
        for f, v, c, left, right in found[s]:
            for g, w, o, low, high in found[t]:
                x, y = max(left, low + c - o), min(right, high + c - o)
                if v == w and y - x + 1 >= 23:
                    met.append((f, x, y, x - c + o, y - c + o))
        runs = []
        for f, x, y, low, high in sorted(met):
            near = [r for r in runs if r[1] <= y and x <= r[2]]
            runs = [r for r in runs if r not in near] + [tuple(g(c) for g, c in zip((lambda c: set().union(*c), min, max, min, max), zip(({f}, x, y, low, high), *near)))]
        cut = lambda text, x, y: substrings.shingles(text)[max(x - 46, 0):y + 47]
        if any(len(f) > 1 and substrings.verify(cut(s, ax, ay), cut(t, bx, by), 0.8, 46) for f, ax, ay, bx, by in runs):
            want.add(frozenset((s, t)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {substrings.text_key(t): t for t in texts}
    pairs = substrings.passage_pairs(df).collect()
    assert {frozenset((keys[r["a"]], keys[r["b"]])) for r in pairs} == want and len(want) > 80
    linked = {r["doc_id"]: r["n_links"] for r in substrings.repeated_passages(df).collect()}
    runs = lambda t: {tuple(t.split()[i:i + 50]) for i in range(len(t.split()) - 49)}
    unbroken = [runs(t) for t in texts]
    for i, s in enumerate(texts):
        others = {j for j, t in enumerate(texts) if j != i and (frozenset((s, t)) in want or unbroken[i] & unbroken[j])}
        assert linked.get(i, 0) == len(others)


def test_link_counts_against_brute_force(spark):
    rng = random.Random(4)
    member = {(rng.randrange(12), rng.randrange(60)) for _ in range(150)} | {(50, k) for k in (70, 71)}
    df = spark.createDataFrame(sorted(member), "class long, key long")
    want = {k: len({b for c, a in member if a == k for d, b in member if d == c} - {k}) for k in {k for _, k in member}}
    for block in (8, 1000):
        assert {r["key"]: r["n_links"] for r in substrings.link_counts(df, block).collect()} == want


def test_links_of_components_meet_once(spark):
    """Class lists and members of a component that fits a block go to one place, however many components there are."""
    member = [(10 * g + c, 100 * g + k) for g in range(40) for k in range(12) for c in range(4) if (k + c) % 3]
    df = spark.createDataFrame(member, "class long, key long")
    roots = spark.createDataFrame([(100 * g + k, 100 * g) for g in range(40) for k in range(12)], "node long, root long")
    for block, times in ((64, 1), (8, 4)):
        _, kinds, lists, members = substrings.link_blocks(df, roots, block)
        several = kinds.where(F.size("classes") > 1).selectExpr("sum(size(classes))").first()[0]
        assert several <= lists.count() <= times * several and members.count() <= times * len(member)
    want = {k: len({b for c, a in member if a == k for d, b in member if d == c} - {k}) for k in {k for _, k in member}}
    for given in (roots, None):
        assert {r["key"]: r["n_links"] for r in substrings.link_counts(df, 64, given).collect()} == want


def test_unions_of_classes_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        rows = np.unique(rng.integers(0, [12, 40], (120, 2)), axis=0)
        lists = np.unique(rng.integers(0, [15, 14], (60, 2)), axis=0)
        lists = lists[rng.permutation(len(lists))]
        kind, n = substrings.class_unions(lists[:, 0], lists[:, 1], rows[:, 0], rows[:, 1])
        want = {k: len(set(rows[np.isin(rows[:, 0], lists[lists[:, 0] == k, 1]), 1])) for k in lists[:, 0]}
        assert dict(zip(kind, n)) == {k: v for k, v in want.items() if v}


def test_repeated_passages_on_odd_rows(spark, odd):
    got = {r["doc_id"]: r["class_id"] for r in substrings.repeated_passages(odd).collect()}
    assert got == {6: 6, 7: 6}
    assert substrings.repeated_passages(odd.limit(0)).count() == 0


# ---- SentencePiece

needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece_sa.MODEL), reason="the tokenizer is not here")


@needs_model
def test_ids_equal_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
    rng = random.Random(1)
    signs = ["a", "b", "e", "t", "h", " ", "  ", "\n", "▁", "é", "日", "😀", "\t", "1", "0", ".", "!", "###", "the ", "ing", "\u0301", "x" * 5, "-" * 9, " " * 7, "\u0000"]
    fuzz = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, 10, 60, 400, 3000]))) for _ in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(fuzz)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentencepiece_sa.decode(sentencepiece_sa.encode(df, round_trip="same")).collect()}
    for k, t in enumerate(fuzz):
        assert got[k]["ids"] == sp.encode(t)
        assert got[k]["same"] == ("▁" not in t) and (("▁" in t) or got[k]["decoded"] == t)
    odd_rows = sentencepiece_sa.encode(odd, round_trip="score").collect()
    assert Counter((r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in odd_rows) == Counter((i, None if t is None else tuple(sp.encode(t))) for i, t in ODD)
    assert sentencepiece_sa.encode(odd.limit(0)).count() == 0


# ---- Secret scan

def secret_docs():
    rng = random.Random(11)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out, truth = [], set()
    for k in range(300):
        body, kind = prose(k, 30), k % 6
        token = hexes(40)
        line = {
            0: f'token = "{token}"', 1: f"commit {token}", 2: f"card {rng.randrange(10**15, 10**16)}", 3: "antidisestablishmentarianism followed", 4: f"mail {hexes(20)}@mail.example.com",
            5: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        }[kind]
        out.append((k, body + " " + line + " " + body, "src"))
        if kind in (0, 5):
            truth.add((k, token if kind == 0 else line))
    return out, truth


def test_secrets_and_false_positives(spark):
    data, truth = secret_docs()
    got = {(r["doc_id"], r["secret"]) for r in secretscan.scan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got == truth


def test_short_secrets_and_logins_in_urls(spark):
    data, truth = secret_docs()
    key = "ghp_" + "a1B2c3D4e5F6" * 3
    planted = {
        1001: (f'the password = "hunter2!Xy" {prose("s1", 9)}', "hunter2!Xy"), 1002: (f"open postgres://user:pw9@host/db {prose('s2', 9)}", "pw9"),
        1003: (f"db_password: Zx7 {prose('s3', 9)}", "Zx7"), 1004: (f"clone https://{key}@github.com {prose('s4', 9)}", f"//{key}"),
    }
    docs = spark.createDataFrame(data + [(k, t, "s") for k, (t, _) in planted.items()], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["secret"]) for r in secretscan.scan(docs).collect()}
    assert got == truth | {(k, v) for k, (_, v) in planted.items()}


def test_secret_scan_on_odd_rows(spark, odd):
    assert {r["doc_id"] for r in secretscan.scan(odd).collect()} <= {i for i, _ in ODD}
    assert secretscan.scan(odd.limit(0)).count() == 0


# ---- Pipeline

@needs_tables
@needs_model
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        now = spark.createDataFrame(after.collect(), after.schema)
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    fps = [brute_fingerprint(t, 4) for t in texts.values()]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(fps) for b in fps[:k])
    end = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in end} == set(texts) and all(r["round_trip"] for r in end)


def test_families_of_candidates_share_blocks(spark):
    """A family of texts that are all candidates of each other sends each set to few groups, not to each of its pairs; no pair is lost."""
    nodes = [7 * k - 100 for k in range(60)]
    pairs = {(a, b) for i, a in enumerate(nodes) for b in nodes[:i]} | {(5000, 6000), (9000, 8000)}
    sets = spark.createDataFrame([(n, list(range(n % 5, 40))) for n in {n for p in pairs for n in p}], "node long, set array<long>")
    table = spark.createDataFrame(sorted(pairs), "a long, b long")
    for how, most in (({}, 60), ({"elements": 800}, 60 * 8), ({"most": 10}, 60 * 14)):
        got = simhash.blocks(table, sets, **how).collect()
        assert len(got) == len(pairs) and {(r["a"], r["b"]) for r in got} == pairs
        sent = {(n, r["x"], r["y"]) for r in got for n in (r["a"], r["b"])}
        assert len([s for s in sent if s[0] in nodes]) <= most
        assert len({r["x"] for r in got}) > 1


def test_verified_pairs_against_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join(base[:k] + [f"z{i}x{j}" for j in range(80 - k)]) for i, k in enumerate(list(range(40, 80, 3)) + [80, 79, 78])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 0 < len(want) < len(pairs)
    rows = spark.createDataFrame(list(enumerate(texts)), "__node long, text string")
    got = simhash.verified(spark.createDataFrame(pairs, "a long, b long"), rows, "text", 5, 0.8).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
