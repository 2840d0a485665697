"""Cleaning, imputation, leak checks and column hygiene (C*, P*)."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import (
    NAME_CHARS_DELETED, NAME_CHARS_REPLACED, NAME_CHARS_UNDERSCORED, clean_value, number_or,
)
from .ordering import dense_index, few_values, forward_fill
from .profile import cells, column_types, corr_with, per_column, unique_ratio
from .quantiles import exact_quantiles, isolated
from .sums import merge_sums, task_sums

# Tasks get the split search by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- rows ---------------------------------------------------------------------------------------

def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"Target column '{name}' not found. Available columns: {df.columns}")


def feature_columns(df: DataFrame, target: str, keys: Sequence[str] = ()) -> list[str]:
    require_column(df, target)
    return [c for c in df.columns if c != target and c not in keys]


def dedupe_first(df: DataFrame, features: Sequence[str], order_by: str) -> DataFrame:
    """Keep the first row (smallest `order_by`) among rows with equal features, NULL equal to NULL.

    An aggregate rather than a window: copies are reduced inside every map task, so a value that fills
    a third of the table costs one row per task in the shuffle.
    """
    features = list(features)
    rest = [c for c in df.columns if c not in features]
    kept = df.groupBy(*features).agg(F.min_by(F.struct(*rest), F.col(order_by)).alias("__row"))
    return kept.select(*[F.col(c) if c in features else F.col(f"__row.{c}").alias(c) for c in df.columns])


def minimum_rows(df: DataFrame, by: str, minimum: int = 50) -> DataFrame:
    """Rows of groups that have at least `minimum` rows."""
    large = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum).select(by)
    return df.join(large, by, "left_semi")


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; rows with a NULL key stay."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def forward_fill_target(df: DataFrame, y: str, order: str) -> DataFrame:
    return forward_fill(df, y, order)


# ---- names and values ---------------------------------------------------------------------------

def clean_name(name: str, rule: str = "replace") -> str:
    """'replace': every unsafe character or space becomes '_'. 'delete': brackets and quotes go,
    ':' and ',' become '_'."""
    if rule == "replace":
        return re.sub(NAME_CHARS_REPLACED, "_", name)
    if rule == "delete":
        return re.sub(NAME_CHARS_UNDERSCORED, "_", re.sub(NAME_CHARS_DELETED, "", name))
    raise ValueError("rule must be 'replace' or 'delete'")


def clean_names(df: DataFrame, rule: str = "replace") -> DataFrame:
    names = [clean_name(c, rule) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after cleaning: {names}")
    return df.toDF(*names)


def sanitize_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clean_value(F.col(c)) for c in cols})


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in float columns becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


# ---- column removal -----------------------------------------------------------------------------

def id_columns(df: DataFrame, target: str) -> list[str]:
    """Columns named 'id' or '*_id' whose values are mostly distinct."""
    named = [c for c in df.columns if c != target and (c.lower() == "id" or c.lower().endswith("_id"))]
    if not named:
        return []
    rows = unique_ratio(df, named).where(F.col("ratio") > 0.5).orderBy("position").collect()
    return [r["column"] for r in rows]


def drop_id_columns(df: DataFrame, target: str) -> DataFrame:
    return df.drop(*id_columns(df, target))


def variance_table(df: DataFrame, cols: Sequence[str], minimum: float = 1e-6) -> DataFrame:
    base = per_column(df, cols, {"variance": lambda c: F.var_samp(F.col(c).cast("double"))})
    return base.withColumn("constant", F.coalesce(F.col("variance") < minimum, F.lit(False)))


def constant_columns(df: DataFrame, cols: Sequence[str], minimum: float = 1e-6) -> list[str]:
    rows = variance_table(df, cols, minimum).where("constant").orderBy("position").collect()
    return [r["column"] for r in rows]


_INT_SIZES = [("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)]


def downcast_plan(df: DataFrame) -> dict[str, str]:
    """Smallest integer type for each long column, float for each double column."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    plan = {f.name: "float" for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    if longs:
        row = df.agg(*[f(c).alias(f"{c}__{n}") for c in longs for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for c in longs:
            lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
            if lo is None:
                continue
            plan[c] = next(t for t, bits in _INT_SIZES if -(1 << bits - 1) <= lo and hi < (1 << bits - 1))
    return {c: plan[c] for c in df.columns if c in plan}


def widened(df: DataFrame, plan: dict[str, str]) -> dict[str, str]:
    """The plan with larger integer types where these rows hold values that the planned one cannot, as in rows it was not made on."""
    sizes = [t for t, _ in _INT_SIZES]
    narrow = [c for c, t in plan.items() if t in sizes[:-1] and c in df.columns and isinstance(df.schema[c].dataType, T.IntegralType)]
    if not narrow:
        return plan
    needed = downcast_plan(df.select([F.col(f"`{c}`").cast("bigint").alias(c) for c in narrow]))
    return {c: max(t, needed[c], key=sizes.index) if c in needed else t for c, t in plan.items()}


def downcast(df: DataFrame, plan: dict[str, str] | None = None) -> DataFrame:
    plan = downcast_plan(df) if plan is None else widened(df, plan)
    return df.withColumns({c: F.col(c).cast(t) for c, t in plan.items()}) if plan else df


# ---- filling ------------------------------------------------------------------------------------

def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties; no row for an all-null column.

    Counts (column, value) pairs first, so no single buffer holds all distinct values.
    """
    counts = (
        cells(df, cols).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def fit_fill(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], all_null: str | None = None
) -> dict[str, object]:
    """Median per numeric and mode per categorical column, as a mapping for `fill`.

    Fit on the training part, apply to every part.
    """
    fills: dict[str, object] = {}
    for c, (m,) in exact_quantiles(df, numeric, [0.5]).items():
        if m is not None:
            fills[c] = float(m)
    if categorical:
        found = {r["column"]: r["mode"] for r in modes(df, categorical).collect()}
        booleans = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
        for c in categorical:
            value = found.get(c, all_null)
            if value is not None:
                fills[c] = value == "true" if c in booleans else value
    return fills


def fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Replace NULL by the fitted values; an integer column is widened when its median is not whole."""
    out = {}
    for c, v in fills.items():
        x = F.col(c)
        if isinstance(v, float) and isinstance(df.schema[c].dataType, T.IntegralType) and not v.is_integer():
            x = x.cast("double")
            out[c] = F.coalesce(x, F.lit(v))
        else:
            out[c] = F.coalesce(x, F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(out) if out else df


def constant_fill(df: DataFrame, cols: Sequence[str], value: str = "missing") -> DataFrame:
    return df.fillna(value, subset=list(cols))


def label_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Replace values by their 0-based position in ascending order; NULL stays NULL.

    A handful of values becomes an expression; many values are ranked in ranges and joined.
    """
    out = out or col
    values = few_values(df, col)
    if values is not None:
        position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)) - 1 if values else F.lit(None)
        return df.withColumn(out, F.when(F.col(col).isNotNull(), position).cast("int"))
    index = dense_index(df, col, "__index")
    joined = df.join(index, col, "left")
    return joined.withColumn(out, F.col("__index")).drop("__index").select(
        *df.columns, *([out] if out not in df.columns else [])
    )


def to_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All columns as numbers without NULLs: medians, label positions, and 0 for what cannot be read.

    Dates and timestamps become seconds since 1970.
    """
    kinds = column_types(df, exclude=keep)
    filled = fill(df, fit_fill(df, kinds["numeric"], kinds["categorical"], all_null="missing"))
    for c in kinds["categorical"]:
        filled = label_index(filled.withColumn(c, F.col(c).cast("string")), c)
    known = {*kinds["numeric"], *kinds["categorical"], *keep}
    times = {f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    seconds = lambda c: F.coalesce(F.col(c).cast("timestamp").cast("double"), F.lit(0.0))
    rest = {c: seconds(c) if c in times else number_or(F.col(c).cast("string")) for c in df.columns if c not in known}
    return (filled.withColumns(rest) if rest else filled).select(*df.columns)


# ---- leaks --------------------------------------------------------------------------------------

def leaky_columns(df: DataFrame, cols: Sequence[str], y: str, limit: float = 0.95) -> DataFrame:
    """Absolute correlation with a numeric target and whether it is suspiciously high."""
    return corr_with(df, cols, y).withColumn("leaky", F.coalesce(F.col("abs_corr") > limit, F.lit(False)))


def _bin_sums(df: DataFrame, cols: Sequence[str], edges: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per column a row for each bin, the first for NULL: positives, rows, and sums of a 10-bit hash of the value and its square."""
    vectors = df.select(F.array(F.col("__y"), *[F.col(c) for c in cols]).alias("v"))

    def make(_, columns: list[np.ndarray]) -> dict:
        y, out = columns[0][:, 0], {}
        for i, cut in enumerate(edges):
            x = columns[0][:, i + 1]
            at = np.where(np.isnan(x), 0, 1 + np.searchsorted(cut, x))
            h = ((np.where(x == 0, 0, x).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(float)
            out[(i,)] = np.concatenate([np.bincount(at, w, len(cut) + 2) for w in (y, None, h, h * h)]).astype(float)
        return out

    found = merge_sums(task_sums(vectors, [], ["v"], make, [T.StructField("column", T.IntegerType())]), ["column"]).collect()  # a row a column
    by_column = {r["column"]: np.array(r["sums"]).reshape(4, -1).T for r in found}
    return [by_column.get(i, np.zeros((len(cut) + 2, 4))) for i, cut in enumerate(edges)]


def class_histogram(df: DataFrame, cols: Sequence[str], y: str, grid: int = 1024, share: int = 256, rounds: int = 4) -> dict[str, np.ndarray]:
    """Per column (positives, rows) of bins in the order of their values, NULL first, over all rows with a target.

    Bins are a grid between the smallest and the largest value; the smallest and largest value of either class have
    bins of their own, so a band that holds all positives, however rare, is cut off exactly. A bin of several values with more
    than one `share`-th of a class is cut into 64, until none is left or for `rounds` passes. All columns share a pass.
    """
    base = df.where(F.col(y).isNotNull()).select((F.col(y) > 0).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(cols)])
    base = nan_to_null(base)
    names = [f"__c{i}" for i in range(len(cols))]
    row = base.agg(*[f(F.when(F.col("__y") == v, F.col(c))).alias(f"{c}_{f.__name__}{v}") for c in names for f in (F.min, F.max) for v in (0, 1)]).first()
    edges = []
    for c in names:
        ends = sorted({v for f in ("min", "max") for k in (0, 1) if (v := row[f"{c}_{f}{k}"]) is not None and np.isfinite(v)})
        lines = [ends[0] + (ends[-1] - ends[0]) * i / grid for i in range(1, grid)] if ends else []
        edges.append(np.unique([*lines, *isolated(ends)]))
    for last in range(rounds - 1, -1, -1):
        sums = _bin_sums(base, names, edges)
        more = False
        for i, (cut, bins) in enumerate(zip(edges, sums)):
            pos, n, h, h2 = bins[1:].T
            total = bins.sum(axis=0)
            crowded = (pos * share > total[0]) | ((n - pos) * share > total[1] - total[0])
            several = n * h2 - h * h > 0.25 * n  # by whole numbers: not all hashes are one
            wide = [k for k in np.nonzero(crowded & several)[0] if 0 < k < len(cut)]
            if wide and last:
                lines = [cut[k - 1] + (cut[k] - cut[k - 1]) * m / 64 for k in wide for m in range(1, 64)]
                edges[i], more = np.unique([*cut, *lines]), True
        if not more:
            break
    return {c: bins[:, :2] for c, bins in zip(cols, sums)}


def tree_leaves(pos: np.ndarray, n: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """(positives, rows) of the leaves of a greedy Gini tree over bins in order; the first of equally good cuts wins."""
    total, rows = pos.sum(), n.sum()
    if depth and len(pos) > 1:
        left, size = pos.cumsum()[:-1].astype(float), n.cumsum()[:-1].astype(float)
        pure = lambda p, m: (p * p + (m - p) * (m - p)) / m
        score = np.round((pure(left, size) + pure(total - left, rows - size)) / rows, 12)
        at = int(score.argmax())
        if score[at] > np.round(pure(float(total), float(rows)) / rows, 12) + 1e-12:
            return tree_leaves(pos[:at + 1], n[:at + 1], depth - 1) + tree_leaves(pos[at + 1:], n[at + 1:], depth - 1)
    return [(int(total), int(rows))]


def leaf_auc(leaves: list[tuple[int, int]]) -> float | None:
    """AUC of scoring each row by its leaf's share of positives, leaves of one share tied; None with one class only."""
    by_share: dict[float, list[int]] = {}
    for pos, n in leaves:
        seen = by_share.setdefault(round(pos / n, 12), [0, 0])
        seen[0] += pos
        seen[1] += n - pos
    above = won = negatives = 0
    for share in sorted(by_share, reverse=True):
        pos, neg = by_share[share]
        won += neg * (above + pos / 2)
        above, negatives = above + pos, negatives + neg
    return won / (above * negatives) if above and negatives else None


def tree_auc(df: DataFrame, cols: Sequence[str], y: str, depth: int = 3) -> DataFrame:
    """(column, auc) of a decision tree of one column for a 0/1 target, over all rows.

    Counts of classes by bins (`class_histogram`), a thousand or two a column, are all that the split search needs. NULL is
    the lowest bin. A table with one class of target only gives NULL.
    """
    out = []
    for c, bins in class_histogram(df, cols, y).items():
        bins = bins[bins[:, 1] > 0]
        out.append((c, leaf_auc(tree_leaves(bins[:, 0], bins[:, 1], depth)) if len(bins) else None))
    return df.sparkSession.createDataFrame(out, "column string, auc double")


def leaky_by_auc(df: DataFrame, cols: Sequence[str], y: str, limit: float = 0.98) -> DataFrame:
    """(column, auc, leaky): columns of which a depth-3 tree alone tells the classes apart."""
    return tree_auc(df, cols, y).withColumn("leaky", F.coalesce(F.col("auc") > limit, F.lit(False)))


def audit_equation(df: DataFrame, lhs: Column, rhs: Column, atol: float = 1e-4, rtol: float = 1e-5) -> DataFrame:
    """How many rows break lhs = rhs within the tolerance; a missing side breaks it too."""
    off = F.coalesce(F.abs(lhs - rhs) > atol + rtol * F.abs(rhs), F.lit(True))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(off).alias("mismatches")).withColumn(
        "mismatch_pct", F.coalesce(F.try_divide(F.col("mismatches") * 100.0, "total"), F.lit(0.0))
    )
