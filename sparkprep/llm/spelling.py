"""Spelling variants: exact neighbours at one edit by pairs of trie nodes.

The nodes of the trie of all words (prefixes) and of the trie of the reversed words (suffixes) are numbered. A word around
a skipped position is a pair of integers (prefix node, suffix node), and so is a word around a gap between positions. Two
words with the same pair around a skipped position differ by a replaced code point; a word with a skipped position and
one with a gap, by an inserted one. So a group of equal pairs holds at most as many words as there are code points in
the alphabet, plus one, and nothing needs to be verified.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of a word, A-Z, a-z and U+00C0 to U+00FF, in Latin-1; every other character becomes a question mark there.
RUN = rb"[A-Za-z\xC0-\xFF]{%d,}"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: One run in so many loses a code point, chosen by CRC-32 of id and run.
TYPO_EVERY = 199
#: A form must be so many times as frequent as the word.
RATIO = 5
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Words of one range of the sorted words, about; and the most ranges.
RANGE = 20_000
MOST_RANGES = 4096
#: Code points of a cut between ranges at most; nodes deeper than that lie within one range.
CUT = 64


def text_words(text: str, least: int) -> list[bytes]:
    """The maximal runs of letters with at least `least` code points, A-Z lower-cased, as Latin-1."""
    return re.findall(RUN % least, text.encode("latin-1", "replace").lower())


def typed(word: bytes, crc: int, every: int | None) -> bytes:
    """`word`, or where `every` divides the CRC-32 that goes on from `crc` over it, without the code point at CRC mod length."""
    if every is None:
        return word
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), crc)
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1:]


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int | None = TYPO_EVERY,
) -> DataFrame:
    """(word, n) over all whole texts; words are counted in the tasks before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1)):
                if not (content := body.as_py()):
                    continue
                crc = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for word, n in Counter(text_words(content, least_length)).items():
                    word = typed(word, crc, typo_every)
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) > HELD:
                    yield passed()
        yield passed()

    counted = df.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def cut_points(words: DataFrame, n: int, size: int = RANGE) -> list[str]:
    """Strings that cut the `n` distinct sorted words into ranges of about `size`; heads of words, chosen from a hash sample of about 50 a range."""
    ranges = min(-(-n // size), MOST_RANGES)
    if ranges < 2:
        return []
    share = max(n // (50 * ranges), 1)
    sample = sorted(r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select(F.substring("word", 1, CUT)).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def number_nodes(words: list[str], part: int, edges: dict[str, int]) -> tuple[list[int], list[list[int | None]]]:
    """Ranks of the sorted distinct `words` of a range, and the nodes of each word's prefixes, from the empty one to itself.

    Nodes that may go on in another range are those in `edges`, which has their numbers; all others are numbered here. A
    node that only one word passes through is None: no other word can share a pair with it.
    """
    base = part << 40
    fresh, before = base, ""
    path: list[int] = []
    crowd: dict[int, int] = {}
    paths = []
    for word in words:
        same = 0
        if path:
            most = min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del path[same + 1:]
        for depth in range(len(path), len(word) + 1):
            node = edges.get(word[:depth]) if depth <= CUT else None
            if node is None:
                node, fresh = fresh, fresh + 1
                crowd[node] = 0
            path.append(node)
        for node in path:
            if node >= 0:
                crowd[node] += 1
        paths.append(path.copy())
        before = word
    return list(range(base, base + len(words))), [[v if v < 0 or crowd[v] > 1 else None for v in p] for p in paths]


def numbered(words: DataFrame, cuts: list[str], columns: list[str]) -> DataFrame:
    """(rank, nodes) beside the `columns` (`word` first): trie nodes of all prefixes; ranks follow the order of code points."""
    # A prefix of words on both sides of a cut is a prefix of the cut.
    edges = {p: -1 - k for k, p in enumerate(sorted({c[:d] for c in cuts for d in range(len(c) + 1)}))}
    kinds = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(cuts, w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *columns])

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        rank, nodes = number_nodes(table.column("word").to_pylist(), table.column("part")[0].as_py(), edges)
        return pa.table([pa.array(rank, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), *(table.column(c) for c in columns)], names=["rank", "nodes", *columns])

    placed = words.select(*columns).mapInArrow(place, f"part int, {kinds}")
    return placed.groupBy("part").applyInArrow(number, f"rank long, nodes array<long>, {kinds}")


def ranked(words: DataFrame, size: int = RANGE) -> DataFrame:
    """(rank, nodes, word, n, ends) of the table of distinct words (word, n): the nodes of all prefixes and of all suffixes, reversed."""
    n = words.count()
    back = words.select(F.reverse("word").alias("word"))
    forward = numbered(words, cut_points(words, n, size), ["word", "n"])
    backward = numbered(back, cut_points(back, n, size), ["word"]).select(F.reverse("word").alias("word"), F.col("nodes").alias("ends"))
    return forward.join(backward, "word").select("rank", "nodes", "word", "n", "ends")


def node_pairs(words: DataFrame) -> DataFrame:
    """(before, after, kind, n, rank) from `ranked`: the node pairs of each word around its skipped positions (kinds 0, 1) and gaps (2).

    Kind 1 is a skipped position that doesn't repeat the code point before it: leaving out any code point of a run gives
    the same word, and is counted once. Pairs with a node of one word only are not made.
    """
    both = words.withColumn("size", F.length("word")).withColumn("letters", F.split("word", ""))
    pairs = """concat(
      transform(sequence(0, size - 1), i -> named_struct('before', nodes[i], 'after', ends[size - 1 - i],
        'kind', IF(i > 0 AND letters[i] = letters[greatest(i - 1, 0)], 0, 1))),
      transform(sequence(0, size), i -> named_struct('before', nodes[i], 'after', ends[size - i], 'kind', 2)))"""
    met = F.explode(F.filter(F.expr(pairs), lambda p: p["before"].isNotNull() & p["after"].isNotNull()))
    return both.select("rank", "n", met.alias("p")).select("p.before", "p.after", "p.kind", "n", "rank")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(rank, n_near, best): the number of words at one edit, and the most frequent of them, ties to the smaller rank, as (n, -rank)."""
    word = F.struct("n", (-F.col("rank")).alias("low"), "kind")
    crowd = pairs.groupBy("before", "after").agg(F.collect_list(word).alias("m")).where(F.size("m") > 1)
    by_kind = crowd.select(
        "m", F.reverse(F.array_sort(F.filter("m", lambda x: x["kind"] < 2))).alias("skips"),
        F.array_max(F.filter("m", lambda x: x["kind"] == 1)).alias("longer"), F.size(F.filter("m", lambda x: x["kind"] == 1)).alias("n_longer"),
        F.array_max(F.filter("m", lambda x: x["kind"] == 2)).alias("shorter"),
    )
    # Replaced: the other skips of the pair. Inserted: the gap's word and the skips that count once.
    first, second = F.get("skips", F.lit(0)), F.get("skips", F.lit(1))
    near = by_kind.select(F.explode("m").alias("w"), "skips", "longer", "n_longer", "shorter").select(
        (-F.col("w.low")).alias("rank"),
        F.when(F.col("w.kind") == 2, F.col("n_longer"))
        .otherwise(F.size("skips") - 1 + F.when((F.col("w.kind") == 1) & F.col("shorter").isNotNull(), 1).otherwise(0)).alias("k"),
        F.when(F.col("w.kind") == 2, F.col("longer")).otherwise(F.greatest(
            F.when(first["low"] == F.col("w.low"), second).otherwise(first), F.when(F.col("w.kind") == 1, F.col("shorter")))).alias("best"),
    ).where("k > 0")
    return near.groupBy("rank").agg(F.sum("k").cast("long").alias("n_near"), F.max(F.struct("best.n", "best.low")).alias("best"))


def roots(steps: DataFrame) -> DataFrame:
    """(rank, root) of the rows (rank, form): where the steps end. Counts grow along them, so they never close a ring."""
    now = cut_lineage(steps.select("rank", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        nxt = cut_lineage(now.join(ahead, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = nxt.select("rank", "root")
        if not nxt.where("moved").limit(1).count():
            return now


def group_variants(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    typo_every: int | None = TYPO_EVERY, size: int = RANGE,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, at least `least_length` code points and `least_count`
    occurrences in all texts. Every `typo_every`-th distinct run of a text, by CRC-32 of `id:run`, loses a code point first (None:
    no run does; a NULL id counts as the empty string). `n_near` is the number of words that differ by one inserted, deleted
    or replaced code point; `form` the most frequent of them, ties to the smallest in code-point order, if it occurs at
    least `ratio` times as often, else NULL; `root` the end of the chain of forms. NULL and empty texts have no words;
    repeated rows count each time; other columns are ignored; a table without words gives an empty one.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms can run in rings")
    words = cut_lineage(ranked(cut_lineage(word_counts(df, id_col, text, least_length, least_count, typo_every)), size))
    near = neighbours(node_pairs(words))
    own = cut_lineage(words.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.low")).alias("form")))
    ends = roots(own.where("form IS NOT NULL"))
    names = words.select(F.col("rank").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    tops = words.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    changed = own.where("form IS NOT NULL").join(names, "form").join(ends, "rank").join(tops, "root").select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    same = own.where("form IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return changed.unionByName(same)
