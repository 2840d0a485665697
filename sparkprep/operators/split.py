"""Sampling and splitting with reproducible, key-based randomness (X*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import hash_rank, null_safe_join, row_rank, top_per_group

TAKE_LIMIT = 100_000


def cap_rows(df: DataFrame, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if fewer) in a seeded hash order of the key."""
    if n <= TAKE_LIMIT:
        return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return hash_rank(df, [], [key], seed, "__rank").where(F.col("__rank") <= n).drop("__rank")


def sample_share(df: DataFrame, key: str, share: float, minimum: int = 50, seed: int = 42) -> DataFrame:
    """max(share * rows, minimum) rows without replacement."""
    n = max(int(df.count() * share), minimum)
    return cap_rows(df, key, n, seed)


def _ranked(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, order: Sequence[str] | None) -> DataFrame:
    if order is not None:
        return row_rank(df, by, [*order, *key], "__rank")
    return hash_rank(df, by, key, seed, "__rank")


def stratified_split(
    df: DataFrame,
    y: str | None,
    key: Sequence[str],
    test_share: float = 0.2,
    seed: int = 42,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add `split` = 'train' / 'test' with the same share of every class in the test part.

    Rows are taken in a seeded hash order of the key, or in the given order. y=None splits plainly.
    """
    by = [y] if y else []
    ranked = _ranked(df, by, key, seed, order)
    if by:
        sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
        ranked = null_safe_join(ranked, sizes, by, "inner")
    else:
        ranked = ranked.withColumn("__n", df.agg(F.count(F.lit(1))).scalar())
    in_test = F.col("__rank") <= F.round(F.col("__n") * F.lit(test_share))
    return ranked.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("__rank", "__n")


def holdout(df: DataFrame, y: str | None, key: Sequence[str], share: float = 0.15, seed: int = 42) -> DataFrame:
    """Single hold-out part; plain when a class has only one row."""
    if y and df.groupBy(y).count().agg(F.min("count")).first()[0] < 2:
        y = None
    return stratified_split(df, y, key, share, seed)


def folds(
    df: DataFrame,
    y: str | None,
    key: Sequence[str],
    k: int = 5,
    seed: int = 42,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add a fold number 0..k-1. Stratified by class when every class has at least k rows."""
    if y and df.groupBy(y).count().agg(F.min("count")).first()[0] < k:
        y = None
    if y is None and order is None:
        return df.withColumn("fold", F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), F.lit(k)).cast("int"))
    ranked = _ranked(df, [y] if y else [], key, seed, order)
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def cap_per_class(df: DataFrame, y: str, order: str, n: int = 100) -> DataFrame:
    """The first n rows of every class."""
    return top_per_group(df, [y], [F.col(order)], n, "__rank").drop("__rank")


def split_ids(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Distinct ids with part = 'memory' (the given share) or 'test'."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    out = stratified_split(ids, None, [key], 1.0 - share, seed)
    return out.select(key, F.when(F.col("split") == "test", "test").otherwise("memory").alias("part"))
