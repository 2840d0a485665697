"""Feature engineering as fit / apply pairs.

Fitting runs aggregates on the training rows and keeps small results: column lists, numbers per
column, and value maps as DataFrames. Applying only adds column expressions and joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations, permutations
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vx
from ..functions.scalars import word_count
from ..session import cut_lineage
from . import profile
from .clean import clean_names, constant_columns, downcast_plan, fit_fill, widened
from .ordering import top_per_group
from .quantiles import exact_quantiles, quantile_bin
from .sums import merge_sums, task_sums

RARE = "_RARE"
ONEHOT_LIMIT = 5000
VECTOR_SIZE = 100
RATIO_EPS = 1e-5


# ---- F1 text, F2 dates --------------------------------------------------------------------------

def text_columns(df: DataFrame, cats: Sequence[str], min_length: float = 30) -> list[str]:
    """Categorical columns whose values are longer than 30 characters on average."""
    texts = [c for c in cats if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return []
    stats = profile.per_column(df, texts, {"length": lambda c: F.avg(F.length(c))})
    return [r["column"] for r in stats.where(F.col("length") > min_length).orderBy("position").collect()]


def text_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace text columns by their length and word count; missing text counts as empty."""
    new: dict[str, Column] = {}
    for c in cols:
        new[f"{c}_length"] = F.length(F.coalesce(c, F.lit("")))
        new[f"{c}_word_count"] = word_count(F.col(c))
    return df.withColumns(new).drop(*cols) if new else df


def datetime_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace dates by year, month, day, weekday (Monday = 0) and the month on a circle."""
    new: dict[str, Column] = {}
    for c in cols:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        t = F.try_to_timestamp(F.col(c)) if is_text else F.col(c)
        angle = F.lit(2 * math.pi) * F.month(t) / 12
        new.update({
            f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.day(t), f"{c}_weekday": F.weekday(t),
            f"{c}_month_sin": F.sin(angle), f"{c}_month_cos": F.cos(angle),
        })
    return df.withColumns(new).drop(*cols) if new else df


# ---- F3-F5 categories ---------------------------------------------------------------------------

def frequent_values(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> dict[str, list[str]]:
    """Values that make up at least `threshold` of a column's non-null rows: at most 1/threshold each."""
    if not cols:
        return {}
    counts = (
        profile.cells(df, cols).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("t"))
    rows = counts.join(totals, "column").where(F.col("n") >= F.col("t") * threshold).select("column", "value").collect()
    kept: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        kept[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in kept.items()}


def group_rare(df: DataFrame, kept: dict[str, list[str]]) -> DataFrame:
    """Values outside the kept set, also ones never seen, become '_RARE'; NULL stays NULL."""
    out = {}
    for c, values in kept.items():
        x = F.col(c).cast("string")
        out[c] = F.when(x.isNull() | x.isin(values), x).otherwise(RARE)
    return df.withColumns(out) if out else df


def target_encoding(
    df: DataFrame, col: str, y: str, fold: Column, smoothing: float = 10.0
) -> DataFrame:
    """(value, encoding): mean over a value's rows of its smoothed target mean in the other folds.

    One shuffle: sums per (value, fold), then per value, where other-fold sums are totals minus own.
    A value seen in one fold only has no encoding.
    """
    target = F.col(y).cast("double")
    overall = df.agg(F.avg(target)).scalar()
    per_fold = (
        df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"), fold.alias("fold"))
        .agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    )
    total = per_fold.groupBy("value").agg(
        F.sum("s").alias("S"), F.sum("n").alias("N"), F.collect_list(F.struct("s", "n")).alias("parts"), F.max(overall).alias("g"))

    def encoded(e: Column) -> Column:
        n = F.col("N") - e["n"]
        weight = n / (n + smoothing)
        return F.when(n > 0, weight * F.try_divide(F.col("S") - e["s"], n) + (1 - weight) * F.col("g"))

    usable = F.filter("parts", lambda e: F.col("N") - e["n"] > 0)
    rows = F.aggregate(usable, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    value = F.aggregate(usable, F.lit(0.0), lambda a, e: a + encoded(e) * e["n"])
    return total.select("value", F.try_divide(value, rows).alias("encoding")).where(F.col("encoding").isNotNull())


def frequency_encoding(df: DataFrame, col: str) -> DataFrame:
    """(value, encoding): share of all rows that have the value."""
    n = df.agg(F.count(F.lit(1))).scalar()
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("value", (F.col("n") / n).alias("encoding"))


def apply_encoding(df: DataFrame, col: str, encoding: DataFrame, default: Column, out: str | None = None) -> DataFrame:
    """Replace a column by its encoding; unknown values get the default."""
    out = out or col
    mapped = encoding.select(F.col("value").alias(col), F.col("encoding").alias("__encoding"))
    joined = df.join(mapped, col, "left").withColumn(out, F.coalesce("__encoding", default)).drop("__encoding")
    return joined.select(*df.columns, *([out] if out not in df.columns else []))


# ---- F6-F9, F14, F15 numbers --------------------------------------------------------------------

def yeo_johnson(x: Column, lam: float) -> Column:
    x = x.cast("double")
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def _power(x: np.ndarray, lam: float) -> np.ndarray:
    """`yeo_johnson` of an array without NaN."""
    out = np.empty_like(x)
    up = x >= 0
    a, b = np.log1p(x[up]), np.log1p(-x[~up])
    out[up] = a if abs(lam) < 1e-12 else np.expm1(lam * a) / lam
    out[~up] = -b if abs(lam - 2) < 1e-12 else -np.expm1((2 - lam) * b) / (2 - lam)
    return out


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], steps: Sequence[tuple[float, float]] = ((0.25, 3.0), (0.025, 0.25), (0.0025, 0.025))) -> dict[str, float]:
    """Maximum-likelihood lambda per column, on grids of (step, reach) around the best so far.

    A pass per grid serves all columns: tasks add up the likelihood's sums for every lambda of every column, so the number of
    passes doesn't depend on the number of columns.
    """
    cols = list(cols)
    if not cols:
        return {}
    best = {c: 1.0 for c in cols}
    numbers = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("__vec"))
    head = numbers.first()
    if head is None:
        return best
    # Any value of the column near the others keeps the sums of squares precise.
    near = np.nan_to_num(np.array([v if v is not None else 0.0 for v in head["__vec"]]))
    for step, reach in steps:
        points = int(round(reach / step))
        grids = [[round(best[c] + i * step, 6) for i in range(-points, points + 1)] for c in cols]

        def make(_, columns: list[np.ndarray], grids: list[list[float]] = grids) -> dict:
            out = {}
            for i, grid in enumerate(grids):
                x = columns[0][:, i]
                x = x[np.isfinite(x)]
                sums = [len(x), (np.sign(x) * np.log1p(np.abs(x))).sum()]
                for lam in grid:
                    y = _power(x, lam) - _power(near[i:i + 1], lam)[0]
                    sums += [y.sum(), (y * y).sum()]
                out[(i,)] = np.array(sums, float)
            return out

        for r in merge_sums(task_sums(numbers, [], ["__vec"], make, [T.StructField("column", T.IntegerType())]), ["column"]).collect():  # a row a column
            (n, s), pairs = r["sums"][:2], np.array(r["sums"][2:]).reshape(-1, 2)
            if n == 0:
                continue
            with np.errstate(all="ignore"):
                variance = pairs[:, 1] / n - np.square(pairs[:, 0] / n)
                scores = np.where((variance > 0) & np.isfinite(variance), -n / 2 * np.log(variance) + (np.array(grids[r["column"]]) - 1) * s, -np.inf)
            top = max(zip(scores.tolist(), grids[r["column"]]))
            if top[0] > -math.inf:
                best[cols[r["column"]]] = top[1]
    return best


def skewed_columns(df: DataFrame, cols: Sequence[str], threshold: float = 1.0) -> list[str]:
    if not cols:
        return []
    rows = profile.skewness_table(df, cols).where(F.abs("g1_corrected") > threshold).orderBy("position").collect()
    return [r["column"] for r in rows]


def fit_log_shift(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Shift that makes each column non-negative."""
    if not cols:
        return {}
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: max(0.0, -(row[c] or 0.0)) for c in cols}


def log_shifted(x: Column, shift: float) -> Column:
    return F.log1p(x.cast("double") + shift)


def fit_caps(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """IQR bounds of the columns that have a spread and at least one value outside."""
    bounds = {c: b[2:] for c, b in profile.iqr_bounds(df, cols).items() if b[1] > b[0]}
    if not bounds:
        return {}
    row = df.agg(*[F.bool_or((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]).first()
    return {c: bounds[c] for c in bounds if row[c]}


def cap(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    out = {}
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        out[c] = F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
    return df.withColumns(out) if out else df


def choose_scalers(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    if not cols:
        return {}
    return {r["column"]: r["scaler"] for r in profile.normality(df, cols).select("column", "scaler").collect()}


def fit_scales(df: DataFrame, scalers: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(center, spread) per column: mean and population sd, or median and interquartile range."""
    standard = [c for c, s in scalers.items() if s == "standard"]
    robust = [c for c, s in scalers.items() if s == "robust"]
    unknown = set(scalers.values()) - {"standard", "robust"}
    if unknown:
        raise ValueError(f"unknown scalers: {sorted(unknown)}")
    out: dict[str, tuple[float, float]] = {}
    if standard:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in standard for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        out.update({c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 1.0) for c in standard})
    for c, (q1, q2, q3) in exact_quantiles(df, robust, [0.25, 0.5, 0.75]).items():
        out[c] = (0.0, 1.0) if q2 is None else (q2, (q3 - q1) or 1.0)
    return {c: out[c] for c in scalers}


def scale(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    new = {c: (F.col(c).cast("double") - m) / s for c, (m, s) in scales.items()}
    return df.withColumns(new) if new else df


# ---- F10-F13 column combinations ----------------------------------------------------------------

def correlated_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns that correlate too strongly with any earlier column."""
    if len(cols) < 2:
        return []
    worst = profile.corr_long(df, cols).groupBy("col_b").agg(F.max(F.abs("corr")).alias("m"))
    found = {r["col_b"] for r in worst.where(F.col("m") > threshold).collect()}
    return [c for c in cols if c in found]


def strongest_columns(df: DataFrame, cols: Sequence[str], y: str, n: int) -> list[str]:
    return [r["column"] for r in profile.corr_with(df, cols, y).limit(n).collect()]


def product_pairs(top: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(top, 2))


def ratio_pairs(top: Sequence[str]) -> list[tuple[str, str]]:
    return list(permutations(top, 2))


def add_products(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    new = {f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in pairs}
    return df.withColumns(new) if new else df


def add_ratios(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    new = {f"{a}__div__{b}": F.try_divide(F.col(a).cast("double"), F.col(b).cast("double") + RATIO_EPS) for a, b in pairs}
    return df.withColumns(new) if new else df


def add_squares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    new = {f"{c}__squared": F.col(c) * F.col(c) for c in cols}
    return df.withColumns(new) if new else df


# ---- plans: steps in order, each with its own settings ------------------------------------------

@dataclass(frozen=True)
class Rows:
    """What a step may know of the training rows besides the rows: key, target, and the numeric columns that were given."""

    key: tuple[str, ...]
    target: str
    given: tuple[str, ...]

    def columns(self, x: DataFrame, kind: str) -> list[str]:
        return profile.column_types(x, exclude=[*self.key, self.target])[kind]


@dataclass(frozen=True)
class Step:
    """`learn` finds something small on training rows, `change` applies it to any rows. `store`: rows are stored after it."""

    name: str
    learn: Callable[[DataFrame, Rows], Any]
    change: Callable[[DataFrame, Any], DataFrame]
    store: Callable[[Any], bool] = lambda found: False


def drop_constant() -> Step:
    def learn(x: DataFrame, rows: Rows) -> list[str]:
        numeric = rows.columns(x, "numeric")
        return constant_columns(x, numeric) if numeric else []

    return Step("constant", learn, lambda x, found: x.drop(*found))


def describe_texts() -> Step:
    return Step("texts", lambda x, rows: text_columns(x, rows.columns(x, "categorical")), text_statistics)


def split_dates() -> Step:
    return Step("dates", lambda x, rows: rows.columns(x, "datetime"), datetime_parts)


def merge_rare(share: float = 0.01) -> Step:
    return Step("rare", lambda x, rows: frequent_values(x, rows.columns(x, "categorical"), share), group_rare)


def encode_values(plan: dict[str, str] | None = None, distinct: float = 0.05, folds: int = 5, seed: int = 42) -> Step:
    """Categories as numbers: `plan` names 'frequency' or 'target' for a column ('onehot' and 'hash' are left to the
    preprocessor); without a plan, columns whose share of distinct values is above `distinct` take the target's means."""

    def learn(x: DataFrame, rows: Rows) -> dict[str, tuple[DataFrame, float]]:
        cats = rows.columns(x, "categorical")
        if plan is not None:
            ways = {c: plan[c] for c in cats if plan.get(c) in ("frequency", "target")}
        else:
            wide = profile.unique_ratio(x, cats).where(F.col("ratio") > distinct).orderBy("position").collect() if cats else []
            ways = {r["column"]: "target" for r in wide}
        if not ways:
            return {}
        mean = x.agg(F.avg(rows.target)).first()[0]
        fold = F.pmod(F.xxhash64(*[F.col(k) for k in rows.key], F.lit(seed)), F.lit(folds))
        return {
            c: (cut_lineage(target_encoding(x, c, rows.target, fold)), mean) if way == "target" else (cut_lineage(frequency_encoding(x, c)), 0.0)
            for c, way in ways.items()}

    def change(x: DataFrame, found: dict[str, tuple[DataFrame, float]]) -> DataFrame:
        for c, (values, unknown) in found.items():
            x = apply_encoding(x, c, values, F.lit(unknown))
        return x

    return Step("encodings", learn, change, bool)


def make_symmetric(skew: float = 1.0) -> Step:
    def learn(x: DataFrame, rows: Rows) -> dict[str, float]:
        return fit_yeo_johnson(x, skewed_columns(x, [c for c in rows.given if c in x.columns], skew))

    return Step("powers", learn, lambda x, found: x.withColumns({c: yeo_johnson(F.col(c), lam) for c, lam in found.items()}) if found else x)


def cap_outliers() -> Step:
    return Step("caps", lambda x, rows: fit_caps(x, rows.columns(x, "numeric")), cap)


def choose_scaling() -> Step:
    """Scalers for the preprocessor; rows stay as they are."""
    return Step("scalers", lambda x, rows: choose_scalers(x, rows.columns(x, "numeric")), lambda x, found: x)


def drop_correlated(limit: float = 0.95) -> Step:
    return Step("correlated", lambda x, rows: correlated_columns(x, rows.columns(x, "numeric"), limit), lambda x, found: x.drop(*found))


def _strongest(x: DataFrame, rows: Rows, top: int) -> list[str]:
    numeric = rows.columns(x, "numeric")
    return strongest_columns(x, numeric, rows.target, top) if top > 1 and len(numeric) > 1 else []


def multiply(top: int = 5) -> Step:
    return Step("products", lambda x, rows: product_pairs(_strongest(x, rows, top)), add_products)


def divide(top: int = 3) -> Step:
    return Step("ratios", lambda x, rows: ratio_pairs(_strongest(x, rows, top)), add_ratios)


def square(top: int = 5) -> Step:
    return Step("squares", lambda x, rows: [c for c in rows.given if c in x.columns][:top], add_squares)


def narrow_types() -> Step:
    def change(x: DataFrame, found: dict[str, str]) -> DataFrame:
        # Rows may hold larger values than those that the types were found on.
        return x.withColumns({c: F.col(c).cast(t) for c, t in widened(x, found).items() if c in x.columns})

    return Step("types", lambda x, rows: downcast_plan(x.drop(*rows.key, rows.target)), change)


def steps_for(level: str = "full", encodings: dict[str, str] | None = None) -> list[Step]:
    """Steps of a level of effort: 'off' none, 'light' tidy columns only, 'medium' shapes them as well, 'full' also combines them."""
    tidy = [drop_constant(), describe_texts(), split_dates(), merge_rare(), encode_values(encodings)]
    shape = [make_symmetric(), cap_outliers(), choose_scaling(), drop_correlated()]
    combine = [multiply(), divide(), square()]
    by_level = {"off": [], "light": [*tidy, narrow_types()], "medium": [*tidy, *shape, narrow_types()], "full": [*tidy, *shape, *combine, narrow_types()]}
    if level not in by_level:
        raise ValueError(f"level must be one of {list(by_level)}")
    return by_level[level]


@dataclass(frozen=True)
class FeaturePlan:
    """Steps with what each has found on the training rows; `plan["caps"]` gives a step's finding."""

    learned: tuple[tuple[Step, Any], ...]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], steps: Sequence[Step] | None = None) -> FeaturePlan:
        """Learn all steps (default: those of the level 'full') from training rows. `key` identifies rows and decides their fold."""
        x = df.select(*key, *features, F.col(target).cast("double").alias(target))
        rows = Rows(tuple(key), target, tuple(c for c in features if c in profile.column_types(x)["numeric"]))
        learned = []
        for step in steps_for() if steps is None else steps:
            found = step.learn(x, rows)
            learned.append((step, found))
            x = step.change(x, found)
            if step.store(found):
                x = cut_lineage(x)
        return cls(tuple(learned))

    def __getitem__(self, name: str) -> Any:
        return next(found for step, found in self.learned if step.name == name)

    def apply(self, df: DataFrame) -> DataFrame:
        """The engineered columns for any rows with the same features; other columns pass through."""
        for step, found in self.learned:
            df = step.change(df, found)
        return clean_names(df)


# ---- F16-F19 preprocessing for models -----------------------------------------------------------

def categories(df: DataFrame, col: str, limit: int = ONEHOT_LIMIT) -> list[str]:
    """Levels of a column for one-hot encoding, NULL as 'missing'; refuses more than `limit`."""
    value = F.coalesce(F.col(col).cast("string"), F.lit("missing")).alias("v")
    rows = df.select(value).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"'{col}' has more than {limit} levels; use frequency, target or hash encoding")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level; a value outside the levels is 0 everywhere."""
    value = F.coalesce(F.col(col).cast("string"), F.lit("missing"))
    return df.withColumns({f"{col}_{v}": (value == v).cast("int") for v in levels}).drop(col)


def is_dense_embedding(numeric: Sequence[str], categorical: Sequence[str]) -> bool:
    """Many numeric columns and no others: a precomputed embedding that must not be rescaled."""
    return not categorical and len(numeric) >= 50


def _text(value: str) -> str:
    """A text literal for SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fit_preprocessor(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    scalers: dict[str, str] | None = None,
    encodings: dict[str, str] | None = None,
    out: str = "features",
    hash_size: int = 2048,
) -> PipelineModel:
    """A pipeline of built-in stages: median fill and scaling, one-hot or hashing, one vector column.

    The fitted numbers are written into a SQLTransformer, so the model saves and loads like any other.
    """
    from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler

    numeric, categorical = list(numeric), list(categorical)
    if is_dense_embedding(numeric, categorical):
        return PipelineModel([VectorAssembler(inputCols=numeric, outputCol=out, handleInvalid="keep")])
    encodings = encodings or {}
    onehot = [c for c in categorical if encodings.get(c, "onehot") == "onehot"]
    hashed = [c for c in categorical if encodings.get(c) == "hash"]
    left = [c for c in categorical if c not in onehot and c not in hashed]
    if left:
        raise ValueError(f"encode these columns first, or plan them as onehot or hash: {left}")
    fills = fit_fill(df, numeric, [])
    plan = {c: (scalers or {}).get(c, "standard") for c in numeric}
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c, 0.0)))) for c in numeric}) if numeric else df
    scales = fit_scales(filled, plan)
    parts, inputs = [], []
    for i, (c, (m, s)) in enumerate(scales.items()):
        parts.append(f"(coalesce(cast({_quoted(c)} AS double), {float(fills.get(c, 0.0))!r}D) - ({m!r}D)) / {s!r}D AS __n{i}")
        inputs.append(f"__n{i}")
    for i, c in enumerate(onehot):
        parts.append(f"coalesce(cast({_quoted(c)} AS string), 'missing') AS __c{i}")
    for i, c in enumerate(hashed):
        parts.append(f"concat({_text(c + '=')}, coalesce(cast({_quoted(c)} AS string), 'missing')) AS __h{i}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")] if parts else []
    if onehot:
        # One pass finds the columns that may have too many levels; only those are counted exactly.
        many = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(onehot)]).first()
        for n, c in zip(many, onehot):
            if n > 0.9 * ONEHOT_LIMIT:
                categories(df, c)
        stages += [
            StringIndexer(inputCols=[f"__c{i}" for i in range(len(onehot))], outputCols=[f"__i{i}" for i in range(len(onehot))],
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"__i{i}" for i in range(len(onehot))], outputCols=[f"__o{i}" for i in range(len(onehot))],
                          dropLast=True, handleInvalid="error"),
        ]
        # The indexer's extra 'unseen' level is the dropped last one, so unseen values are all zeros.
        inputs += [f"__o{i}" for i in range(len(onehot))]
    if hashed:
        stages.append(FeatureHasher(inputCols=[f"__h{i}" for i in range(len(hashed))], outputCol="__hashed", numFeatures=hash_size))
        inputs.append("__hashed")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


# ---- F20 selection, F21 level -------------------------------------------------------------------

def mutual_information(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10, bin_target: bool = False) -> DataFrame:
    """Mutual information (nats) of each quantile-binned column with the target, largest first; NULL is a bin.

    One shuffle of (column, bin, class) counts covers all columns.
    """
    wanted = [*cols, y] if bin_target else list(cols)
    cuts = exact_quantiles(df, wanted, [i / bins for i in range(1, bins)])

    def bin_of(c: str) -> Column:
        return quantile_bin(F.col(c), cuts[c])

    label = bin_of(y).cast("string") if bin_target else F.col(y).cast("string")
    entries = [F.struct(F.lit(c).alias("column"), bin_of(c).alias("bin")) for c in cols]
    joint = (
        df.where(F.col(y).isNotNull()).select(label.alias("label"), F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.column", "e.bin", "label").agg(F.count(F.lit(1)).alias("n"))
    )

    # At most bins x classes rows per column from here on.
    def total(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy("column", *keys)).cast("double")

    n = F.col("n").cast("double")
    shares = joint.select("column", n.alias("n"), total().alias("t"), total("bin").alias("b"), total("label").alias("l"))
    mi = F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("b") * F.col("l"))))
    return shares.groupBy("column").agg(F.greatest(F.lit(0.0), mi).alias("mi")).orderBy(F.col("mi").desc(), "column")


def select_features(df: DataFrame, cols: Sequence[str], y: str, k: int = 10, **kw) -> list[str]:
    return [r["column"] for r in mutual_information(df, cols, y, **kw).limit(min(k, len(cols))).collect()]


LEVELS = ["off", "light", "medium", "full"]


def level_number(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in LEVELS]), level), F.lit(1)) - 1


def level_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]), (number + 1).cast("int"))


def capped_level(requested: Column, safe: Column, best_score: Column) -> Column:
    """Feature level to use. A fixed request is only capped; 'auto' starts at the safe level, goes one
    step down (not below light) for a strong baseline and one up, within the cap, for a weak one."""
    cap_no, asked = level_number(safe), level_number(requested)
    auto = (
        F.when(best_score >= 0.85, F.greatest(F.lit(1), cap_no - 1))
        .when(best_score < 0.65, F.least(cap_no, cap_no + 1)).otherwise(cap_no)
    )
    return level_name(F.when(requested == "auto", auto).otherwise(F.least(asked, cap_no)))


# ---- F22-F24 vectors ----------------------------------------------------------------------------

def fit_pca(df: DataFrame, vec: str, size: int = VECTOR_SIZE):
    """PCA model of centered vectors; None when the vectors are not longer than `size`."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if dim is None or dim <= size:
        return None
    return Pipeline(stages=[
        StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False),
        PCA(k=min(size, n, dim), inputCol="__c", outputCol="__p"),
    ]).fit(df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("__v")))


def reduce_vectors(df: DataFrame, vec: str, model, size: int = VECTOR_SIZE, out: str = "reduced") -> DataFrame:
    """Vectors projected by the model and padded with zeros to `size`."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return df.withColumn(out, vx.pad_to(F.col(vec), size))
    made = model.transform(df.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>"))))
    return made.withColumn(out, vx.pad_to(vector_to_array("__p"), size)).drop("__v", "__c", "__p")


def text_vectors(df: DataFrame, text: str, hash_size: int = 256, size: int = VECTOR_SIZE, out: str = "vector") -> DataFrame:
    """TF-IDF of hashed tokens, reduced by PCA and padded."""
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=r"\s+"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=hash_size),
        IDF(inputCol="__tf", outputCol="__idf"),
    ]
    source = df.withColumn("__text", F.coalesce(text, F.lit("")))
    made = Pipeline(stages=stages).fit(source).transform(source).withColumn("__dense", vector_to_array("__idf"))
    flat = cut_lineage(made.drop("__text", "__tokens", "__tf", "__idf"))
    return reduce_vectors(flat, "__dense", fit_pca(flat, "__dense", size), size, out).drop("__dense")


def pooled_vectors(df: DataFrame, item: str, part: str, vec: str, parts: int | None = None) -> DataFrame:
    """One vector per item: the mean of all its part vectors, or of the first `parts`."""
    if parts is None:
        return profile.mean_vector(df, [item], vec)
    first = top_per_group(df.select(item, part, vec), [item], [F.col(part)], parts, "__rank")
    return profile.mean_vector(first, [item], vec)
