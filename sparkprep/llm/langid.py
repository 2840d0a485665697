"""Language identification, word first with backoff to character n-grams.

A known word is scored by the logarithm of its relative frequency in each language; an unseen word by its longest
character n-grams of which any is known, down to single characters. A text takes the language with the best mean over
its words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Longest character n-grams; words are padded with one space on either side.
LONGEST = 5
#: A word must occur so often in a language to be known there.
LEAST = 2
#: Entries (language, word) and (language, n-gram) of a model at most, which bounds what is sent to the tasks.
MOST = 200_000
#: Minus log10 of the relative frequency that a word or n-gram counts with in a language that doesn't know it.
PENALTY = 7.0
#: Steps of relative frequency for each factor of two, at which a model is cut to its bound.
STEPS = 16
#: Distinct words that a task counts before it passes them on; unseen words whose n-grams a task remembers.
HELD = 200_000
UNDETERMINED = "und"


def text_words(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case."""
    found = re.findall(r"[^\W\d_]+", text.lower()) if text else []
    if text and not text.isascii():  # numbers such as "²" are word characters but no letters
        found = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found]
        found = [w for w in found if w]
    return found


def word_grams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[k:k + size] for k in range(len(padded) - size + 1)]


def counted(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, size, token, n) of all words, size 0, with the total as token ''; words are counted in the tasks before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([0] * len(seen), pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "size", "token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text_words(body.as_py())
                for word, n in Counter(words).items():
                    seen[name, word] += n
                seen[name, ""] += len(words)
                if len(seen) > HELD:
                    yield passed()
        yield passed()

    sent = df.select(F.col(f"`{lang}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(work, "lang string, size int, token string, n long")
    return sent.groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(lang, size, token, n) of the n-grams of known words, with the totals of each size as token ''."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, int, str]] = Counter()
            for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in range(1, longest + 1):
                    grams = word_grams(word, size)
                    for g in grams:
                        seen[name, size, g] += n
                    seen[name, size, ""] += n * len(grams)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "size", "token", "n"])

    made = words.select("lang", "token", "n").mapInArrow(work, "lang string, size int, token string, n long")
    return made.groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, least: int, most: int) -> DataFrame:
    """(lang, size, token, n, share): tokens by falling relative frequency, in steps, as many steps as `most` rows hold."""
    totals = counts.where("token = ''").select("lang", "size", F.col("n").alias("total"))
    share = counts.where((F.col("token") != "") & (F.col("n") >= least)).join(totals, ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))
    stepped = share.withColumn("step", F.floor(-F.log2("share") * STEPS))
    room, last = most, -1
    for r in sorted(stepped.groupBy("step").count().collect()):  # at most 64 * STEPS rows
        room -= r["count"]
        if room < 0:
            break
        last = r["step"]
    return stepped.where(F.col("step") <= last).select("lang", "size", "token", "n", "share")


def learned(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> dict:
    """A model of the rows of `df` with a language.

    Words are counted over all rows. The most frequent (language, word) pairs are known words, and their n-grams with
    their counts give the n-gram model; each has `most` entries at most. `langs` are sorted by falling number of words, then name.
    """
    counts = cut_lineage(counted(df.where(F.col(f"`{lang}`").isNotNull()), text, lang))
    totals = {r["lang"]: r["n"] for r in counts.where("token = ''").orderBy(F.desc("n"), "lang").limit(most).collect()}
    words = cut_lineage(most_frequent(counts, least, most))
    grams = most_frequent(cut_lineage(gram_counts(words, longest)), 1, most)
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    number = {name: k for k, name in enumerate(langs)}
    token_rows: list[dict[str, int]] = [{} for _ in range(longest + 1)]
    entries = sorted((r["size"], r["token"], number[r["lang"]], r["share"]) for r in words.unionByName(grams).collect())  # at most 2 * most rows
    start, which, gain = [], np.zeros(len(entries), np.int32), np.zeros(len(entries))
    for k, (size, token, name, share) in enumerate(entries):
        if token_rows[size].setdefault(token, len(start)) == len(start):
            start.append(k)
        which[k], gain[k] = name, max(PENALTY + np.log10(share), 0.0)
    return {"langs": langs, "tokens": token_rows, "start": np.array([*start, len(entries)], np.int64), "lang": which, "gain": gain}


def scores(words: list[str], model: dict, seen: dict[str, list[int]]) -> np.ndarray:
    """Mean over the words of what each language's score gains over the penalty; `seen` remembers the n-grams of unseen words."""
    known, rows, weights = model["tokens"][0], [], []
    for word, n in Counter(words).items():
        row = known.get(word)
        if row is not None:
            rows.append(row)
            weights.append(n)
            continue
        found = seen.get(word)
        if found is None:
            found = []
            for size in range(len(model["tokens"]) - 1, 0, -1):
                table = model["tokens"][size]
                found = [r for r in map(table.get, word_grams(word, size)) if r is not None]
                if found:
                    break
            if len(seen) >= HELD:
                seen.clear()
            if len(word) < 64:
                seen[word] = found
        rows += found
        weights += [n / len(found)] * len(found)
    if not rows:
        return np.zeros(len(model["langs"]))
    start = model["start"]
    first = start[rows]
    size = start[np.array(rows) + 1] - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(model["lang"][at], model["gain"][at] * np.repeat(weights, size), len(model["langs"])) / len(words)


def predicted(text: str | None, model: dict, seen: dict[str, list[int]]) -> tuple[str, float]:
    """(language, its share of 10 ^ mean gain); `und` and 0 without letters or without languages."""
    words = text_words(text)
    if not words or not model["langs"]:
        return UNDETERMINED, 0.0
    gains = scores(words, model, seen)
    best = int(np.argmax(gains))  # the first of equal ones: the language with more words
    return model["langs"][best], float(1 / np.power(10.0, gains - gains[best]).sum())


def identify(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all others than these) with lang_pred and score of each whole text, in one narrow pass."""
    names = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by `most` of `learned`

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, seen = sent.value, {}
        for batch in batches:
            out = [predicted(t.as_py(), ours, seen) for t in batch.column(len(names))]
            langs, score = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, schema)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether CRC-32 of the id as text leaves the remainder `fold`; a NULL id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds == fold


def language_id(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row, learned from the rows that aren't held out and have a language.

    All of these rows are counted; the model keeps the `most` most frequent words and n-grams. Prediction reads the text
    only. `lang_pred` is a learned language, or `und` with score 0 where a text is NULL or has no letter, or nothing was
    learned. `score` lies between 0 and 1: 1 / number of languages where none is better. Ties go to the language with more
    words, then the smaller name. Repeated rows stay, other columns are ignored, an empty table gives an empty one.
    """
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("body"), F.col(f"`{lang}`").alias("lang"), held_out(id_col).alias("held_out"))
    model = learned(named.where(~F.col("held_out")), "body", "lang", longest, least, most)
    return identify(named, model, "body", ["id", "held_out"]).withColumnRenamed("id", id_col)
