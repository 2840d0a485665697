"""Set operations and joins on small keys (U*, J1, J2, S7, S11, S12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_keep_last(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of tables with one row per key: the one from the last table that has it."""
    out: DataFrame | None = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("__source", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    rest = [c for c in parts[0].columns if c not in key]
    picked = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "__source").alias("__row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in parts[0].columns])


def ordered_union(*lists: Column) -> Column:
    """Concatenated lists without repeats; the first occurrence keeps its place."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default: Column, out: str) -> DataFrame:
    """Left join with a map table of unique keys; keys it does not hold get the default."""
    joined = df.join(mapping.select(key, F.col(value).alias("__value")), key, "left")
    return joined.withColumn(out, F.coalesce("__value", default)).drop("__value")


def member_of(df: DataFrame, keys: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """Keep rows by membership. NULL is no member: dropped by the plain form, kept by the negated one."""
    return df.join(keys.select(key).distinct(), key, "left_anti" if negate else "left_semi")


def merge_new(existing: DataFrame, incoming: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """All existing rows plus incoming rows with a new key, one for each: the first by `order_by`, else any one of them.

    Columns may have any type, maps included.
    """
    row = F.struct(*[c for c in incoming.columns if c != key])
    first = incoming.groupBy(key).agg((F.min_by(row, order_by) if order_by else F.first(row)).alias("__row"))
    fresh = first.select(key, "__row.*").join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def remaining(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct ids that are not done yet."""
    return ids.select(key).distinct().join(done.select(key), key, "left_anti")


def select_catalog(df: DataFrame, existing: DataFrame, n: int = 150) -> DataFrame:
    """The first n usable datasets: 50 < rows < 100000, under 200 features, at most 20 classes, not known."""
    usable = (
        (F.col("n_rows") > 50) & (F.col("n_rows") < 100_000) & (F.col("n_features") < 200)
        & (F.coalesce("n_classes", F.lit(0)) <= 20)
    )
    return df.where(usable).join(existing.select("did"), "did", "left_anti").orderBy("did").limit(n)
