"""Profiling: column statistics, correlations, class balance, fingerprints (A*, C8, C9, P13)."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import null_safe_join
from .quantiles import exact_quantiles, grouped_quantiles
from .sums import merge_sums, task_sums, vector_sums

# Tasks get the functions of this module by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS_PER_PASS = 150
PAIRS_PER_PASS = 150
FINGERPRINT_SIZE = 10


# ---- column types -------------------------------------------------------------------------------

def column_types(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column names by kind: numeric, categorical (text, boolean), datetime."""
    kinds: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": []}
    for field in df.schema.fields:
        if field.name in exclude:
            continue
        if isinstance(field.dataType, T.NumericType):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            kinds["categorical"].append(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["datetime"].append(field.name)
    return kinds


# ---- per-column statistics ----------------------------------------------------------------------

def per_column(
    df: DataFrame,
    cols: Sequence[str],
    stats: dict[str, Callable[[str], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Any set of aggregates for many columns, one output row per column (and group).

    All aggregates of up to COLUMNS_PER_PASS columns share one pass; wider tables take a few passes
    instead of one plan too large to compile.
    """
    out: DataFrame | None = None
    cols = list(cols)
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        batch = cols[start:start + COLUMNS_PER_PASS]
        aggs = [fn(c).alias(f"{i}__{s}") for i, c in enumerate(batch) for s, fn in stats.items()]
        row = df.groupBy(*by).agg(*aggs)
        entries = [
            F.struct(
                F.lit(c).alias("column"), F.lit(start + i).alias("position"),
                *[F.col(f"{i}__{s}").alias(s) for s in stats],
            )
            for i, c in enumerate(batch)
        ]
        part = row.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no columns given")
    return out


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(
        df, cols, {"missing": lambda c: F.count_if(F.col(c).isNull()), "rows": lambda c: F.count(F.lit(1))}
    )


def missing_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: null cells, all cells, their ratio and the percentage with two decimals."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    cells = F.count(F.lit(1)) * F.lit(len(cols))
    return df.agg(nulls.alias("null_cells"), cells.alias("cells")).select(
        "null_cells", "cells",
        F.coalesce(F.try_divide("null_cells", "cells"), F.lit(0.0)).alias("missing_rate"),
        F.round(F.coalesce(F.try_divide("null_cells", "cells"), F.lit(0.0)) * 100, 2).alias("missing_pct"),
    )


def table_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: size, null counts of columns that have any, column kinds, distinct target values."""
    kinds = column_types(df)
    pairs = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing")) for c in df.columns
    ]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(target).alias("target_unique"),
        F.array(*pairs).alias("__m"),
    ).select(
        "rows",
        F.lit(len(df.columns)).alias("cols"),
        F.filter("__m", lambda e: e["missing"] > 0).alias("missing"),
        F.array(*[F.lit(c) for c in kinds["numeric"]]).alias("numeric_cols"),
        F.array(*[F.lit(c) for c in kinds["categorical"]]).alias("categorical_cols"),
        F.lit(target).alias("target"),
        "target_unique",
    )


def unique_ratio(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and their ratio to the rows.

    The exact form counts on (column, value) pairs, which are combined before the shuffle.
    """
    if approximate:
        counted = per_column(
            df, cols,
            {"n_unique": lambda c: F.approx_count_distinct(c), "rows": lambda c: F.count(F.lit(1))},
        )
    else:
        long = cells(df, cols)
        distinct = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        n = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
        base = per_column(df, cols, {"rows": lambda c: F.count(F.lit(1))})
        counted = base.join(n, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    return counted.select(
        "column", "position", "n_unique", "rows",
        F.coalesce(F.try_divide("n_unique", "rows"), F.lit(0.0)).alias("ratio"),
    )


def cells(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per kept columns, column name and value as text."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.*")


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return (
        df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, col)
    )


def value_shares(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """`value_counts` with each value's share of the non-null values of its group."""
    counts = value_counts(df, col, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    return _attach(counts, totals, by).select(*by, col, "n", (F.col("n") / F.col("__total")).alias("share"))


def class_distribution(df: DataFrame, y: str) -> DataFrame:
    """Share of every class (3 decimals) and the largest / smallest class ratio (2 decimals)."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    ratio = counts.agg(F.max("n") / F.min("n")).scalar()
    return counts.select(
        y, "n", F.round(F.col("n") / total, 3).alias("share"), F.round(ratio, 2).alias("imbalance_ratio")
    )


def majority(df: DataFrame, y: str) -> DataFrame:
    """Most frequent class, the smallest on ties, and its share."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min_by(y, F.struct(-F.col("n"), F.col(y))).alias("majority_class"),
        (F.max("n") / F.sum("n")).alias("majority_share"),
    )


def majority_baseline(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Accuracy on `test` of always predicting the most frequent class of `train`."""
    winner = majority(train, y).select("majority_class").scalar()
    return test.agg(
        F.max(winner).alias("majority_class"),
        F.avg(F.when(F.col(y) == winner, 1.0).otherwise(0.0)).alias("baseline_accuracy"),
    )


def class_stats(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Classes, entropy in nats, normalised entropy and majority share of the target, per group."""
    counts = df.where(F.col(y).isNotNull()).groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("n").alias("__total"),
        F.sum(n * F.ln(n)).alias("__nlogn"),
        F.max("n").alias("__max"),
    ).select(
        *by, "n_classes",
        F.greatest(F.lit(0.0), F.ln("__total") - F.try_divide("__nlogn", "__total")).alias("entropy"),
        F.try_divide("__max", "__total").alias("majority_share"),
    ).withColumn(
        "entropy_norm",
        F.least(F.lit(1.0), F.col("entropy") / F.ln(F.greatest("n_classes", F.lit(2)).cast("double"))),
    )


def smoothed_entropy(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """-sum p*ln(p + 1e-10), the form used in meta-feature rows."""
    counts = df.where(F.col(y).isNotNull()).groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("t"))
    if by:
        shares = null_safe_join(counts, totals, list(by), "inner")
    else:
        shares = counts.withColumn("t", totals.scalar())
    p = F.col("n") / F.col("t")
    return shares.groupBy(*by).agg((-F.sum(p * F.ln(p + 1e-10))).alias("target_entropy"))


def problem_type(n_distinct: Column, threshold: int = 10) -> Column:
    return F.when(n_distinct < threshold, "classification").otherwise("regression")


def task_type(n_distinct: Column, is_text: bool | Column = False) -> Column:
    """0 binary, 2 multiclass, 1 regression; NULL (no target) counts as regression."""
    text = F.lit(is_text) if isinstance(is_text, bool) else is_text
    return (
        F.when(n_distinct.isNull(), 1).when(n_distinct <= 2, 0)
        .when((n_distinct <= 20) | text, 2).otherwise(F.lit(1))
    )


# ---- moments and correlations -------------------------------------------------------------------

def corrected_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population form; NULL below three values."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def skewness_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    base = per_column(
        df, cols, {"n": lambda c: F.count(c), "g1": lambda c: F.skewness(F.col(c).cast("double"))}, by
    )
    return base.withColumn("g1_corrected", corrected_skewness(F.col("g1"), F.col("n")))


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL when either is constant."""
    a, b = a.cast("double"), b.cast("double")
    both_a, both_b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(both_a, both_b), F.stddev_pop(both_a) * F.stddev_pop(both_b))


def corr_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Correlations of given column pairs in long form, many pairs per pass."""
    out: DataFrame | None = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        batch = pairs[start:start + PAIRS_PER_PASS]
        row = df.groupBy(*by).agg(
            *[pair_corr(F.col(a), F.col(b)).alias(f"__{i}") for i, (a, b) in enumerate(batch)]
        )
        entries = [
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"__{i}").alias("corr"))
            for i, (a, b) in enumerate(batch)
        ]
        part = row.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no column pairs given")
    return out


def corr_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Upper triangle of the correlation matrix: one pass of aggregates for few pairs, products of blocks for many."""
    pairs = list(combinations(cols, 2))
    return corr_pairs(df, pairs, by) if len(pairs) <= PAIRS_PER_PASS else corr_products(df, cols, by)


def corr_products(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`corr_pairs` of all pairs in two passes whatever the number of columns.

    The first pass gives the means of each group, the second multiplies blocks of centred rows and of their NULL masks, so
    each pair counts the rows where both are present. Sums of a column's pairs are merged apart from the others'.
    """
    by, cols = list(by), list(cols)
    k = len(cols)
    vectors = df.select(*by, F.array(*[F.col(c).cast("double") for c in cols]).alias("__vec"))
    means = vector_sums(vectors, by, "__vec").select(*by, F.zip_with("sums", "counts", lambda s, n: F.coalesce(F.try_divide(s, n), F.lit(0.0))).alias("__mean"))
    centred = _attach(vectors, means, by) if by else vectors.withColumn("__mean", means.select("__mean").scalar())

    def make(_, columns: list[np.ndarray]) -> dict:
        x, mean = columns
        there = ~np.isnan(x)
        mask, x = there.astype(float), np.where(there, x - mean, 0.0)
        x2 = x * x
        six = np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, x2.T @ mask, mask.T @ x2, x.T @ x])
        return {(a,): six[:, a, a + 1:].T.ravel() for a in range(k - 1)}

    sums = merge_sums(task_sums(centred, by, ["__vec", "__mean"], make, [T.StructField("__a", T.IntegerType())]), [*by, "__a"])
    one = F.transform(F.sequence(F.lit(0), F.lit(k) - F.col("__a") - 2), lambda i: F.struct(
        (F.col("__a") + 1 + i).alias("b"), F.slice("sums", 6 * i + 1, 6).alias("v")))
    names = F.array(*[F.lit(c) for c in cols])
    n, sa, sb, qa, qb, ab = (F.col("e.v")[i] for i in range(6))
    va, vb = qa - sa * sa / n, qb - sb * sb / n
    # What is left of a constant column after its mean was subtracted is rounding.
    corr = F.when((n > 0) & (va > 1e-12 * qa) & (vb > 1e-12 * qb), (ab - sa * sb / n) / F.sqrt(va * vb))
    return sums.select(*by, "__a", F.explode(one).alias("e")).select(
        *by, F.element_at(names, F.col("__a") + 1).alias("col_a"), F.element_at(names, F.col("e.b") + 1).alias("col_b"), corr.alias("corr"))


def corr_with(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Absolute correlation of each column with the target, largest first."""
    return (
        corr_pairs(df, [(c, y) for c in cols])
        .select(F.col("col_a").alias("column"), F.abs("corr").alias("abs_corr"))
        .orderBy(F.col("abs_corr").desc_nulls_last(), "column")
    )


def mean_abs_corr(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return corr_long(df, cols, by).groupBy(*by).agg(
        F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("mean_abs_corr")
    )


def variation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coefficient of variation per column, limited to [-10, 10]."""
    base = per_column(df, cols, {
        "mean": lambda c: F.avg(c), "sd": lambda c: F.stddev_samp(F.col(c).cast("double")),
    })
    return base.withColumn("cv", variation_of(F.col("mean"), F.col("sd")))


def variation_of(mean: Column, sd: Column) -> Column:
    ratio = F.coalesce(sd, F.lit(0.0)) / (F.abs(mean) + 1e-8)
    return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), ratio))


# ---- distributions ------------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, cols: Sequence[str], **kw) -> dict[str, tuple[float, float, float, float]]:
    """q1, q3 and the outlier bounds q1 - 1.5*iqr, q3 + 1.5*iqr per column."""
    quarts = exact_quantiles(df, cols, [0.25, 0.75], **kw)
    return {
        c: (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        for c, (q1, q3) in quarts.items() if q1 is not None
    }


def class_quartiles(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Five-number summary of each column per class."""
    names = ["min", "q1", "median", "q3", "max"]
    return grouped_quantiles(df, [y], cols, [0, 0.25, 0.5, 0.75, 1], names)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    bounds = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    lo, hi = bounds
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(col).cast("double") - lo) / width), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(col).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"),
                (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), "n")
    )


def with_normality_p(df: DataFrame, n: str = "n", g1: str = "g1", kurtosis: str = "k", out: str = "p_value") -> DataFrame:
    """p-value of the D'Agostino-Pearson omnibus test (1973), kurtosis part by Anscombe-Glynn (1983).

    Takes the count, population skewness and excess kurtosis; NULL below 20 values or for a constant
    column. Each formula step is a column of its own so that it is computed once.
    """
    n_, y, w, a, x, b, d = (F.col(f"__{v}") for v in ("n", "y", "w", "a", "x", "b", "d"))
    beta = 3 * (n_ * n_ + 27 * n_ - 70) * (n_ + 1) * (n_ + 3) / ((n_ - 2) * (n_ + 5) * (n_ + 7) * (n_ + 9))
    mean = 3 * (n_ - 1) / (n_ + 1)
    var = 24 * n_ * (n_ - 2) * (n_ - 3) / ((n_ + 1) * (n_ + 1) * (n_ + 3) * (n_ + 5))
    spread = F.sqrt(6 * (n_ + 3) * (n_ + 5) / (n_ * (n_ - 2) * (n_ - 3)))
    third = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1.0 / 3.0))
    steps = [
        {"__n": F.greatest(F.col(n), F.lit(20)).cast("double")},
        {"__y": F.col(g1) * F.sqrt((n_ + 1) * (n_ + 3) / (6 * (n_ - 2))), "__w": -1 + F.sqrt(2 * (beta - 1)),
         "__x": (F.col(kurtosis) + 3 - mean) / F.sqrt(var), "__b": 6 * (n_ * n_ - 5 * n_ + 2) / ((n_ + 7) * (n_ + 9)) * spread},
        {"__y": y * F.sqrt((w - 1) / 2), "__a": 6 + (8 / b) * (2 / b + F.sqrt(1 + 4 / (b * b)))},
        {"__d": 1 + x * F.sqrt(2 / (a - 4))},
        {"__z1": F.ln(y + F.sqrt(y * y + 1)) / F.sqrt(0.5 * F.ln(w)), "__z2": (1 - 2 / (9 * a) - third) / F.sqrt(2 / (9 * a))},
        {out: F.when((F.col(n) >= 20) & F.col(g1).isNotNull(), F.exp(-(F.col("__z1") * F.col("__z1") + F.col("__z2") * F.col("__z2")) / 2))},
    ]
    made = df
    for step in steps:
        made = made.withColumns(step)
    return made.drop(*[f"__{v}" for v in ("n", "y", "w", "a", "x", "b", "d", "z1", "z2")])


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Normality test per column and the scaler it suggests; short columns are standard."""
    base = per_column(df, cols, {
        "n": lambda c: F.count(c),
        "g1": lambda c: F.skewness(F.col(c).cast("double")),
        "k": lambda c: F.kurtosis(F.col(c).cast("double")),
    })
    scaler = F.when((F.col("n") < 20) | (F.col("p_value") > 0.05), "standard").otherwise("robust")
    return with_normality_p(base).withColumn("scaler", scaler).drop("g1", "k")


# ---- vectors ------------------------------------------------------------------------------------

def mean_vector(df: DataFrame, by: Sequence[str], vec: str, out: str = "mean_vector") -> DataFrame:
    """Element-wise mean of array columns per group, over the values that are there; groups without vectors have no row."""
    named = df.select(*by, F.col(vec).cast("array<double>").alias("__vec")).where(F.size("__vec") > 0)
    sums = vector_sums(named, by, "__vec")
    return sums.select(*by, F.zip_with("sums", "counts", lambda s, n: F.try_divide(s, n)).alias(out))


# ---- fingerprints -------------------------------------------------------------------------------

def fingerprints(
    df: DataFrame,
    features: Sequence[str],
    target: str | None,
    by: Sequence[str] = (),
) -> DataFrame:
    """A ten-number description of each dataset (group of rows) as array<float>, with its sizes.

    0 ln(1+rows)/10, 1 ln(1+features)/10, 2 ln(1+rows/features)/10, 3 mean skewness/5 in [-1, 1],
    4 share of columns with |skewness| > 1, 5 mean |correlation|, 6 tanh of the mean coefficient of
    variation, 7 ln(1+classes)/5, 8 normalised class entropy, 9 share of missing cells. One pass gives
    all moments, one more the class counts, for all datasets together.
    """
    by, features = list(by), list(features)
    numeric = [c for c in column_types(df.select(*features))["numeric"]]
    pairs = list(combinations(numeric, 2))
    inline = len(pairs) <= PAIRS_PER_PASS
    aggs = [
        F.count(F.lit(1)).alias("n_samples"),
        sum((F.count_if(F.col(c).isNull()) for c in features), F.lit(0)).alias("__nulls"),
    ]
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        aggs += [F.skewness(x).alias(f"__g{i}"), F.avg(x).alias(f"__m{i}"), F.stddev_samp(x).alias(f"__s{i}")]
    if inline:
        aggs += [pair_corr(F.col(a), F.col(b)).alias(f"__r{i}") for i, (a, b) in enumerate(pairs)]
    base = df.groupBy(*by).agg(*aggs)
    if target is not None:
        base = _attach(base, class_stats(df, target, by).select(*by, "n_classes", "entropy_norm"), by)
    else:
        base = base.withColumns({"n_classes": F.lit(None).cast("long"), "entropy_norm": F.lit(None).cast("double")})
    if not inline:
        base = _attach(base, mean_abs_corr(df, numeric, by).withColumnRenamed("mean_abs_corr", "__corr"), by)

    n = F.col("n_samples").cast("double")
    f = len(features)
    zero = F.lit(0.0)
    if numeric:
        g = F.array_compact(F.array(*[F.col(f"__g{i}") for i in range(len(numeric))]))
        cv = F.array_compact(F.array(*[variation_of(F.col(f"__m{i}"), F.col(f"__s{i}")) for i in range(len(numeric))]))
        skew = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _mean(g) / 5))
        high = F.size(F.filter(g, lambda v: F.abs(v) > 1)) / F.lit(float(len(numeric)))
        spread = F.tanh(_mean(cv))
        if len(numeric) == 1:
            corr = zero
        elif inline:
            corr = _mean(F.transform(
                F.array_compact(F.array(*[F.col(f"__r{i}") for i in range(len(pairs))])), lambda v: F.abs(v)
            ))
        else:
            corr = F.col("__corr")
    else:
        skew = high = corr = spread = zero
    dims = [
        F.log1p(n) / 10,
        F.lit(math.log1p(f) / 10),
        F.log1p(n / max(f, 1)) / 10,
        skew, high, corr, spread,
        F.log1p(F.col("n_classes").cast("double")) / 5,
        F.col("entropy_norm"),
        F.try_divide(F.col("__nulls").cast("double"), n * max(f, 1)),
    ]
    clean = [F.coalesce(F.nanvl(d, zero), zero).cast("float") for d in dims]
    return base.select(
        *by, F.array(*clean).alias("embedding"),
        task_type(F.col("n_classes"), target is not None and isinstance(df.schema[target].dataType, T.StringType)).alias("task_type"),
        "n_samples", F.lit(f).cast("long").alias("n_features"),
    )


def fingerprints_of(tables: dict[str, tuple[DataFrame, Sequence[str], str | None]]) -> DataFrame:
    """`fingerprints` of whole tables with columns of their own, {name: (table, features, target)}, in one job for all.

    A row becomes its dataset's name, an array of its numeric values, its number of NULLs and its target as text, so rows of
    all schemas share two passes: means, then sums of powers and products per dataset.
    """
    union: DataFrame | None = None
    for name, (df, features, target) in tables.items():
        numeric = column_types(df.select(*features))["numeric"]
        part = df.select(
            F.lit(name).alias("dataset"), F.lit(len(features)).cast("long").alias("n_features"), F.lit(len(numeric)).alias("__p"),
            F.lit(target is not None and isinstance(df.schema[target].dataType, T.StringType)).alias("__text"), F.lit(target is not None).alias("__labelled"),
            F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("__vec"),
            sum((F.col(c).isNull().cast("int") for c in features), F.lit(0)).cast("double").alias("__nulls"),
            (F.col(target).cast("string") if target is not None else F.lit(None).cast("string")).alias("__y"))
        union = part if union is None else union.unionByName(part)
    if union is None:
        raise ValueError("no tables given")
    facts = ["dataset", "n_features", "__p", "__text", "__labelled"]
    mean = F.zip_with("sums", "counts", lambda s, n: F.coalesce(F.try_divide(s, n), F.lit(0.0)))
    means = vector_sums(union, ["dataset"], "__vec").select("dataset", mean.alias("__mean"))
    centred = union.join(means, "dataset")

    def make(key: tuple, columns: list[np.ndarray]) -> dict:
        x, mean, nulls = columns[0][:, :key[2]], columns[1][:, :key[2]], columns[2]
        there = ~np.isnan(x)
        mask, d = there.astype(float), np.where(there, x - mean, 0.0)
        powers = [mask.sum(axis=0), np.where(there, mean, 0.0).sum(axis=0), d.sum(axis=0), (d * d).sum(axis=0), (d**3).sum(axis=0)]
        six = [mask.T @ mask, d.T @ mask, mask.T @ d, (d * d).T @ mask, mask.T @ (d * d), d.T @ d]
        return {(): np.concatenate([[len(x), nulls.sum()], np.array(powers).ravel(), np.array(six).ravel()])}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_moments(np.array(v), p) for v, p in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.list_(pa.float64()))], names=[*facts, "m"])

    sums = merge_sums(task_sums(centred, facts, ["__vec", "__mean", "__nulls"], make), facts)
    found = sums.mapInArrow(describe, T.StructType([*[sums.schema[c] for c in facts], T.StructField("m", T.ArrayType(T.DoubleType()))]))
    classes = class_stats(union.where("__labelled"), "__y", ["dataset"]).select("dataset", "n_classes", "entropy_norm")
    n, f = F.col("m")[0], F.col("n_features").cast("double")
    zero = F.lit(0.0)
    dims = [F.log1p(n) / 10, F.log1p(f) / 10, F.log1p(n / F.greatest(f, F.lit(1.0))) / 10, *[F.col("m")[i] for i in range(2, 6)],
            F.log1p(F.col("n_classes").cast("double")) / 5, F.col("entropy_norm"), F.try_divide(F.col("m")[1], n * F.greatest(f, F.lit(1.0)))]
    return found.join(classes, "dataset", "left").select(
        "dataset", F.array(*[F.coalesce(F.nanvl(d, zero), zero).cast("float") for d in dims]).alias("embedding"),
        task_type(F.col("n_classes"), F.col("__text")).alias("task_type"), n.cast("long").alias("n_samples"), "n_features")


def _moments(sums: np.ndarray, p: int) -> list[float]:
    """Rows, NULLs, and the mean skewness, share of skewed columns, mean |correlation| and spread of a dataset from its sums."""
    rows, nulls = sums[:2]
    n, shift, s1, s2, s3 = sums[2:2 + 5 * p].reshape(5, p)
    six = sums[2 + 5 * p:].reshape(6, p, p)
    skew, spread, corr = [], [], []
    for j in range(p):
        if n[j] == 0:
            continue
        m1 = s1[j] / n[j]
        m2, m3 = s2[j] / n[j] - m1**2, s3[j] / n[j] - 3 * m1 * s2[j] / n[j] + 2 * m1**3
        constant = m2 <= 1e-12 * (s2[j] / n[j])
        if not constant:
            skew.append(m3 / m2**1.5)
        sd = 0.0 if constant or n[j] < 2 else (m2 * n[j] / (n[j] - 1)) ** 0.5
        spread.append(min(10.0, max(-10.0, sd / (abs(shift[j] / n[j] + m1) + 1e-8))))
        for b in range(j + 1, p):
            k, sa, sb, qa, qb, ab = six[:, j, b]
            if k > 0:
                va, vb = qa - sa * sa / k, qb - sb * sb / k
                if va > 1e-12 * qa and vb > 1e-12 * qb:
                    corr.append(abs((ab - sa * sb / k) / (va * vb) ** 0.5))
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return [rows, nulls, min(1.0, max(-1.0, mean(skew) / 5)), sum(abs(g) > 1 for g in skew) / p if p else 0.0, mean(corr), math.tanh(mean(spread))]


def _mean(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v), F.size(arr).cast("double"))


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group results; for one single group the other row comes in as a scalar subquery."""
    if by:
        return null_safe_join(left, right, by, "left")
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("__row", row).select("*", "__row.*").drop("__row")


def meta_features(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Eleven named numbers per dataset: sizes, column mix, missing, skewness, correlation, classes."""
    by, features = list(by), list(features)
    kinds = column_types(df.select(*features))
    numeric = kinds["numeric"]
    f = len(features)
    n_aggs = [F.count(F.lit(1)).alias("n_samples"),
              sum((F.count_if(F.col(c).isNull()) for c in features), F.lit(0)).alias("__nulls")]
    for i, c in enumerate(numeric):
        n_aggs.append(corrected_skewness(F.skewness(F.col(c).cast("double")), F.count(c)).alias(f"__g{i}"))
    base = df.groupBy(*by).agg(*n_aggs)
    base = _attach(base, class_stats(df, y, by).select(*by, "n_classes", "majority_share"), by)
    base = _attach(base, smoothed_entropy(df, y, by), by)
    if len(numeric) > 1:
        base = _attach(base, mean_abs_corr(df, numeric, by), by)
    else:
        base = base.withColumn("mean_abs_corr", F.lit(0.0))
    skew = _mean(F.array_compact(F.array(*[F.col(f"__g{i}") for i in range(len(numeric))]))) if numeric else F.lit(0.0)
    return base.select(
        *by, "n_samples", F.lit(f).cast("long").alias("n_features"),
        F.lit(len(numeric) / max(f, 1)).alias("num_ratio"),
        F.lit((f - len(numeric)) / max(f, 1)).alias("cat_ratio"),
        F.try_divide(F.col("__nulls").cast("double"), F.col("n_samples") * F.lit(float(max(f, 1)))).alias("missing_rate"),
        F.coalesce(skew, F.lit(0.0)).alias("skewness_mean"),
        F.col("mean_abs_corr").alias("mean_corr"),
        "n_classes", (F.col("n_classes") == 2).alias("is_binary"),
        "target_entropy", F.col("majority_share").alias("majority_class_ratio"),
    )


def profile_row(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Health summary: first ten columns, missing percent, sizes, class shares, imbalance."""
    shares = class_distribution(df, y)
    entries = shares.agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct(F.col(y).cast("string"), F.col("share")))).alias("class_distribution"),
            F.max("imbalance_ratio").alias("imbalance_ratio"),
        )
    ).scalar()
    base = missing_rate(df, features)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return base.select(
        F.array(*[F.lit(c) for c in list(features)[:10]]).alias("sample_columns"),
        F.col("missing_pct").alias("missing_data_pct"),
        F.lit(len(features)).alias("num_features"),
        rows.alias("num_samples"),
        entries["class_distribution"].alias("class_distribution"),
        entries["imbalance_ratio"].alias("imbalance_ratio"),
    )


# ---- plans over sizes and cardinalities ---------------------------------------------------------

def encoding_plan(
    df: DataFrame,
    cats: Sequence[str],
    *,
    max_onehot: int = 5000,
    low: float = 0.01,
    high: float = 0.1,
    high_strategy: str = "hash",
) -> DataFrame:
    """How to encode each categorical column, with a cap on the total number of one-hot columns.

    One-hot columns are moved to frequency encoding, largest first, until the total fits. The window
    runs over columns of the table, not over its rows.
    """
    stats = unique_ratio(df, cats)
    first = F.when(F.col("ratio") < low, "onehot").when(F.col("ratio") <= high, "frequency").otherwise(high_strategy)
    planned = stats.withColumn("strategy", first)
    width = F.when(F.col("strategy") == "onehot", F.col("n_unique")).otherwise(F.lit(0))
    largest_first = Window.orderBy(F.when(F.col("strategy") == "onehot", 0).otherwise(1), F.col("n_unique").desc(), "position")
    before = largest_first.rowsBetween(Window.unboundedPreceding, -1)
    remaining = F.sum(width).over(Window.partitionBy()) - F.coalesce(F.sum(width).over(before), F.lit(0))
    return planned.withColumn("__left", remaining).select(
        "column", "n_unique", "ratio",
        F.when((F.col("strategy") == "onehot") & (F.col("__left") > max_onehot), "frequency")
        .otherwise(F.col("strategy")).alias("strategy"),
    )


def size_category(rows: Column, small: int = 50_000, medium: int = 200_000) -> Column:
    return F.when(rows < small, "small").when(rows <= medium, "medium").otherwise("large")


def feature_level(category: Column) -> Column:
    return F.when(category == "small", "full").when(category == "medium", "medium").otherwise("light")


def interaction_limit(category: Column) -> Column:
    return F.when(category == "small", 5).when(category == "medium", 2).otherwise(0)
