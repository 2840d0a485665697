"""Quality rules: statistics of whole texts and a learned decision list.

Sequential covering grows conjunctions of thresholds on labelled statistics and prunes them on rows set aside; the
ordered rules become one conditional Spark expression.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
#: Labelled rows that a fit uses at most; a hash of the id chooses them.
FIT_ROWS = 20_000


def repeat_words(words: list[bytes]) -> int:
    """Words inside a run of three words that the text holds at least twice, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= again
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers named in STATS, over the whole text; all zero for NULL."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    bare = raw.translate(None, SPACES)
    return (
        len(words), len(bare.decode()), len(raw) - len(raw.translate(None, SYMBOLS)), again, repeat_words(words),
        len(raw) - len(raw.translate(None, UPPER)), raw.count(b"!"),
    )


def statistics(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, *STATS) for every row, in one narrow pass; NULL and empty texts give zeros."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k].copy()) for k in range(len(STATS)))], names=[id_col, *STATS])

    return df.select(id_col, F.col(text).cast("string").alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS))


def ratios() -> dict[str, Column]:
    """What rules may test, from the columns STATS."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n,
        "repeated": F.col("n_repeat_words") / n, "dup_lines": F.col("n_dup_lines").cast("double"),
        "upper": F.col("n_upper") / n, "marks": F.col("n_marks") / n,
    }


@dataclass
class DecisionList:
    """Ordered conjunctions of (feature, ">=" or "<", threshold); the first that holds rejects, else the row is kept."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def column(self, features: dict[str, Column]) -> Column:
        """Number of the first rule that holds, from 1; 0 where none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for name, op, at in rule:
                test = test & (features[name] >= F.lit(at) if op == ">=" else features[name] < F.lit(at))
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def match(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.zeros(len(x), int)
        for k, rule in enumerate(self.rules, 1):
            out[(out == 0) & covered(x, rule, names)] = k
        return out


def covered(x: np.ndarray, rule: list[tuple[str, str, float]], names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, at in rule:
        v = x[:, names.index(name)]
        hit &= v >= at if op == ">=" else v < at
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[tuple[str, str, float]]:
    """Add the test with the largest information gain on the bad rows still covered, until only bad rows are."""
    rule: list[tuple[str, str, float]] = []
    hit = np.ones(len(x), bool)
    while len(rule) < most and (~bad & hit).any() and (bad & hit).any():
        base = np.log2(bad[hit].mean())
        best = (1e-9, None)
        for j, name in enumerate(names):
            v, y = x[hit, j], bad[hit]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            at = np.nonzero(v[1:] > v[:-1])[0] + 1  # rows below each possible threshold
            if not len(at):
                continue
            below = np.cumsum(y)[at - 1]
            for op, pos, size in (("<", below, at), (">=", y.sum() - below, len(v) - at)):
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-12) / size) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float((v[at[k]] + v[at[k] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = covered(x, rule, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 5, most_tests: int = 4, most_rules: int = 20) -> DecisionList:
    """Sequential covering: two thirds of the rows grow a rule, the last third prunes it.

    Pruning drops final tests while (bad - good) / (bad + good) on the pruning rows doesn't fall. A rule whose precision
    on the pruning rows is below `precision`, or that covers fewer than `least` bad rows, is not taken, and the bad rows
    that it was grown from are set aside.
    """
    part = np.arange(len(x)) % 3 == 2
    out = DecisionList()
    left = np.ones(len(x), bool)
    aside = np.zeros(len(x), bool)

    def value(rule):
        hit = covered(x, rule, names) & part & left
        return (np.sum(hit & bad) - np.sum(hit & ~bad)) / max(hit.sum(), 1)

    for _ in range(2 * most_rules):
        grow = left & ~part & ~aside
        if len(out.rules) == most_rules or not (bad & grow).any():
            break
        rule = _grow(x[grow], bad[grow], names, most_tests)
        while len(rule) > 1 and value(rule[:-1]) >= value(rule):
            rule = rule[:-1]
        hit = covered(x, rule, names) & left
        test = hit & part
        if not rule:
            break
        if np.sum(hit & bad) < least or np.sum(test & bad) < precision * max(test.sum(), 1):
            aside |= hit & bad
        else:
            out.rules.append(rule)
            left &= ~hit
    return out


def fit_sample(labels: DataFrame, id_col: str, target: str, rows: int) -> DataFrame:
    """(id, target) of about `rows` labelled ids at most, chosen by a hash; ids with several labels take the smallest."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(id_col).agg(F.min(target).alias(target))
    n = clean.count()
    share = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * rows / max(n, 1)))
    return clean if n <= rows else clean.where(share)


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", target: str = "quality", rows: int = FIT_ROWS, **how) -> DecisionList:
    """A decision list for rows with target 0, from labelled statistics; without labelled rows it has no rules."""
    features = ratios()
    names = list(features)
    picked = stats.join(fit_sample(labels, id_col, target, rows), id_col).select(
        F.xxhash64(id_col).alias("h"), *[features[c].alias(c) for c in names], (F.col(target) == 0).alias("bad")
    )
    found = np.array(sorted(tuple(r) for r in picked.collect()), float).reshape(-1, len(names) + 2)
    return learn(found[:, 1:-1], found[:, -1] > 0, names, **how)


def quality_verdicts(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50, max_repeated: int = 50, rows: int = FIT_ROWS,
) -> DataFrame:
    """(id_col, *STATS, base_failed, rule, kept) for every row.

    `base_failed`: fewer than `min_words` words, or more than `max_repeated` percent of them in repeated runs. `rule` is
    the number of the learned rule that rejects the row, 0 if none. `kept` is false if the base or a rule rejects. The fit
    takes at most `rows` labelled rows; statistics cover every text. NULL and empty texts fail the base.
    """
    stats = cut_lineage(statistics(df, id_col, text))
    rules = fit_rules(stats, labels, id_col, rows=rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    rule = rules.column(ratios())
    return stats.select(id_col, *STATS, failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))
