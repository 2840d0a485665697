"""Order-dependent results without sending a whole group, or the whole table, to one task.

A window over a class or dataset puts each group in one task, and a global window puts everything in
one task. The functions here cut the order column into ranges first: ranges are summarised (a tiny
table), the summaries are accumulated, and each range is finished on its own. A group that holds a
third of all rows is thereby spread over all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quantile cut points fitted per order column; each interval is split further on wide clusters.
RANGES = 64
TEXT_RANGES = 256
_BUCKET = "__range"
_WITHIN = "__within"


def range_goal(spark: SparkSession) -> int:
    """How many ranges a group should be cut into: a few per shuffle partition of the session."""
    return max(RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL; key columns are kept once."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def cut_points(df: DataFrame, col: str, parts: int = RANGES) -> list:
    """Values that split `col` into ranges of similar size; for numbers with the smallest and largest.

    They only decide how work is spread, so an approximate quantile (numbers, times) or a hash-ordered
    sample of distinct values (text) is enough. Only these few values reach the driver.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        picked = (
            df.select(col).where(F.col(col).isNotNull()).distinct()
            .orderBy(F.xxhash64(col)).limit(parts - 1).collect()
        )
        return sorted({r[0] for r in picked}, key=lambda s: s.encode())
    probs = [i / parts for i in range(parts + 1)]
    cuts = df.select(F.percentile_approx(F.col(col).cast("double"), probs, 1000)).first()[0]
    return sorted(set(cuts or []))


def range_of(x: Column, cuts: Sequence) -> Column:
    """Number of cut points below x, by binary search in plain CASE expressions."""
    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts))


def with_range(df: DataFrame, col: str, spread: DataFrame | None = None, cuts: list | None = None) -> DataFrame:
    """Add an order-preserving range number of a column.

    Numbers: quantile intervals, each split evenly into as many pieces as the session's shuffle width
    asks for. Text: intervals between sampled values. `spread` is a cheaper table with the same values
    in that column, for the cut points, when `df` itself is costly to compute twice; `cuts` are known ones.
    """
    source, x = df if spread is None else spread, F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(_BUCKET, F.when(x.isNull(), -1).otherwise(range_of(x, cut_points(source, col, TEXT_RANGES))))
    x = x.cast("double")
    cuts = cut_points(source, col) if cuts is None else cuts
    if len(cuts) < 2:
        return df.withColumn(_BUCKET, F.lit(0))
    interval = F.when(x.isNull(), -1).otherwise(range_of(x, cuts[1:-1]))
    pieces = -(-range_goal(df.sparkSession) // RANGES)
    if pieces == 1:
        return df.withColumn(_BUCKET, interval)
    low = F.array(*[F.lit(v) for v in cuts[:-1]])
    width = F.array(*[F.lit(b - a) for a, b in zip(cuts, cuts[1:])])
    at = F.greatest(F.lit(1), F.col("__interval") + 1)
    piece = F.floor((x - F.element_at(low, at)) / F.element_at(width, at) * pieces)
    inside = F.greatest(F.lit(0), F.least(F.lit(pieces - 1), piece))
    return df.withColumn("__interval", interval).withColumn(
        _BUCKET, (F.col("__interval") * pieces + F.coalesce(inside, F.lit(0))).cast("long")).drop("__interval")


def with_hash_range(df: DataFrame, hash_col: str) -> DataFrame:
    """Ranges of a 64-bit hash column: its leading bits, no pass over the data needed."""
    bits = (range_goal(df.sparkSession) - 1).bit_length()
    return df.withColumn(_BUCKET, F.shiftright(F.col(hash_col), 64 - bits))


def _ranges(df: DataFrame, order: str, hashed: bool, spread: DataFrame | None = None) -> DataFrame:
    return with_hash_range(df, order) if hashed else with_range(df, order, spread)


def cuts_and_hot(df: DataFrame, col: str) -> tuple[list | None, list]:
    """Cut points of a number or time (None for text), and values that may fill a range of their own, from one pass.

    Numbers: values that several quantiles share. Text: values that are frequent among rows chosen by hash.
    """
    if isinstance(df.schema[col].dataType, T.StringType):
        picked = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, df.count() // (64 * RANGES)))) == 0
        hot = df.where(picked & F.col(col).isNotNull()).groupBy(col).count().where(f"count >= {64 // 2}").select(col).limit(2 * RANGES).collect()
        return None, sorted((r[0] for r in hot), key=lambda v: v.encode())
    probs = [i / RANGES for i in range(RANGES + 1)]
    found = df.select(F.percentile_approx(F.col(col).cast("double"), probs, 1000)).first()[0] or []
    # Beyond 2^53 a double stands for several long numbers.
    return sorted(set(found)), sorted({a for a, b in zip(found, found[1:]) if a == b and abs(a) < 2**53})


def with_tie_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ranges of the first order column; the rows of a hot value, and NULLs, are cut again by the second one.

    So no range is large because many rows tie. The columns `__range` and `__within` together follow the order.
    """
    second = df.schema[order[1]].dataType if len(order) > 1 else None
    if not isinstance(second, (T.NumericType, T.StringType, T.TimestampType)):
        return with_range(df, order[0]).withColumn(_WITHIN, F.lit(0).cast("long"))
    cuts, hot = cuts_and_hot(df, order[0])
    value = F.col(order[0]) if cuts is None else F.col(order[0]).cast("double")
    is_hot = value.isin(hot) if hot else F.lit(False)
    tied = value.isNull() | F.coalesce(is_hot, F.lit(False))
    outer = with_range(df, order[0], cuts=cuts).withColumnRenamed(_BUCKET, "__outer")
    inner = with_range(outer, order[1], df.where(tied).select(order[1]))
    # A range may hold rows before, of and after a hot value.
    place = range_of(value, hot) if hot else F.lit(0)
    at = F.when(is_hot, 2 * place + 1).otherwise(2 * place).cast("long")
    return inner.withColumn(_WITHIN, F.struct(at.alias("a"), F.when(tied, F.col(_BUCKET)).otherwise(F.lit(0)).cast("long").alias("b"))).drop(
        _BUCKET).withColumnRenamed("__outer", _BUCKET)


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: dict[str, str],
    *,
    descending: bool = False,
    inclusive: bool = True,
    spread: DataFrame | None = None,
) -> DataFrame:
    """Add running totals of columns, per group and in the order of a column without ties.

    `sums` maps new column names to summed columns. With inclusive=False a row does not count itself.
    """
    by = list(by)
    ranged = _ranges(df, order, False, spread)
    totals = ranged.groupBy(*by, _BUCKET).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    step = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, _BUCKET, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inner_order = F.col(order).desc() if descending else F.col(order).asc()
    inner = (
        Window.partitionBy(*by, _BUCKET).orderBy(inner_order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = null_safe_join(ranged, offsets, [*by, _BUCKET], "inner")
    out = joined.select(
        *[c for c in df.columns],
        *[
            (F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"__o_{n}")).alias(n)
            for n, c in sums.items()
        ],
    )
    return out


def row_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    *,
    hashed: bool = False,
) -> DataFrame:
    """Add the 1-based row number inside each group, ascending by `order`.

    The first order column decides the ranges; rows that tie in it in large numbers are cut into ranges of
    the second one. Set hashed=True when the first is a 64-bit hash.
    """
    by = list(by)
    ranged = with_hash_range(df, order[0]).withColumn(_WITHIN, F.lit(0)) if hashed else with_tie_ranges(df, order)
    parts = [_BUCKET, _WITHIN]
    sizes = ranged.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, *parts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*by, *parts).orderBy(*order)
    joined = null_safe_join(ranged, offsets, [*by, *parts], "inner")
    return joined.select(
        *df.columns, (F.row_number().over(inner).cast("long") + F.col("__o")).alias(name)
    )


def hash_rank(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, name: str = "rank") -> DataFrame:
    """Row number inside each group in a seeded pseudo-random order that depends on the key only."""
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(k) for k in key], F.lit(seed)))
    return row_rank(hashed, by, ["__h", *key], name, hashed=True).drop("__h")


def forward_fill(df: DataFrame, col: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Replace NULL in `col` by the last value before it, in the order of a unique column."""
    by = list(by)
    ranged = _ranges(df, order, False)
    present = F.col(col).isNotNull()
    tails = ranged.groupBy(*by, _BUCKET).agg(
        F.max_by(F.when(present, F.col(col)), F.when(present, F.col(order))).alias("__last")
    )
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, _BUCKET, F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    inner = Window.partitionBy(*by, _BUCKET).orderBy(order)
    joined = null_safe_join(ranged, carried, [*by, _BUCKET], "inner")
    filled = F.coalesce(F.last(col, ignorenulls=True).over(inner), F.col("__carry"))
    return joined.withColumn("__filled", filled).select(
        *[F.col("__filled").alias(c) if c == col else F.col(c) for c in df.columns]
    )


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first k rows of each group.

    Spark trims every map task to k rows per group before the shuffle (window group limit), so a hot
    group costs k rows per task, not all its rows. The limit rule only fires for small k; larger k goes
    through salted groups first.
    """
    by = list(by)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(RANGES)))
        local = Window.partitionBy(*by, "__salt").orderBy(*order)
        df = salted.withColumn("__l", F.row_number().over(local)).where(F.col("__l") <= k).drop("__l", "__salt")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def few_values(df: DataFrame, col: str, limit: int = RANGES) -> list | None:
    """The distinct non-null values in ascending order if there are at most `limit`, else None.

    Only limit + 1 values are fetched, whatever the size of the column.
    """
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    values = [r[0] for r in rows]
    return sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v)


def dense_index(df: DataFrame, col: str, name: str = "index") -> DataFrame:
    """Distinct non-null values of a column with their 0-based position in ascending order."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    return row_rank(distinct, [], [col], "__r").select(col, (F.col("__r") - 1).cast("int").alias(name))
