"""Models of many datasets at once, from sufficient statistics.

All datasets lie in one table. A fold's training statistics are the dataset's minus the fold's own, so one shuffle of sums
per dataset and fold serves naive Bayes and the linear models, whose validation error follows from the same sums.
Trees of all datasets and folds grow together, one pass and one shuffle of histograms for each level. No step loops over
datasets, and a dataset with a third of all rows is summed in all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, scratch_path
from . import clean
from . import evaluate as ev
from .ordering import forward_fill, null_safe_join, row_rank
from .profile import cells, fingerprints, problem_type
from .quantiles import grouped_quantiles
from .sums import merge_sums, task_sums

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Models whose fits come from grouped statistics, and the passes over the rows that one fit stands for.
PASSES = {"naive_bayes": 1, "ridge": 1, "sgd_reg": 1, "lasso": 1, "elastic": 1, "dt_clf": 5, "dt_reg": 5}
GROUPED = {
    "classification": ["naive_bayes", "dt_clf"],
    "regression": ["ridge", "sgd_reg", "lasso", "elastic", "dt_reg"],
}
#: Seconds that a value of a row takes in a pass. Fits share their passes, so a single fit has no measured time.
SECONDS_PER_VALUE = 1e-8
#: Penalties against the sum of squared errors (ridge) or half their mean (lasso, elastic; share of the absolute part).
PENALTIES = {"ridge": ("sum", 1.0, 0.0), "sgd_reg": ("mean", 1e-4, 0.0), "lasso": ("mean", 1.0, 1.0), "elastic": ("mean", 1.0, 0.5)}
MAX_CLASSES = 10
BINS = 32
DEPTH = 5
#: Of the quantile cuts; below so many rows they are exact.
ACCURACY = 10_000
SMOOTHING = 1e-9
_NODE = 1 << 12


@dataclass(frozen=True)
class Datasets:
    """Columns of a table that holds many datasets: which one a row belongs to, target, key and features."""

    by: str
    y: str
    key: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]


# ---- preparation: P7, P3, C5, C1, C2, C3, C8, C6 ------------------------------------------------

def grouped_modes(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """(by, column, mode): the most frequent value per dataset and column, the smallest on ties."""
    counts = cells(df, cols, [by]).where("value IS NOT NULL").groupBy(by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by, "column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def fill_within(df: DataFrame, s: Datasets, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """NULLs become the dataset's own median or most frequent value; a column without values stays NULL."""
    for cols, found, value, kind in (
        (numeric, lambda c: grouped_quantiles(df, [s.by], c, [0.5], ["v"]), "v", "double"),
        (categorical, lambda c: grouped_modes(df, s.by, c), "mode", None),
    ):
        if cols:
            fills = found(list(cols)).groupBy(s.by).agg(F.map_from_entries(F.collect_list(F.struct("column", value))).alias("__fill"))
            df = null_safe_join(df, fills, [s.by], "left").withColumns({
                c: F.coalesce(F.col(c).cast(kind) if kind else F.col(c), F.try_element_at("__fill", F.lit(c)).cast(kind or df.schema[c].dataType))
                for c in cols}).drop("__fill")
    return df


def cleaned(df: DataFrame, s: Datasets, minimum: int = 50) -> DataFrame:
    """Rows of datasets with at least `minimum` rows: text without unsafe characters, targets filled forward, copies
    removed, features filled within the dataset. Steps that nothing needs are left out after one count."""
    rows = clean.minimum_rows(df.select(s.by, *s.key, *s.features, s.y), s.by, minimum)
    texts = [c for c in s.categorical if isinstance(rows.schema[c].dataType, T.StringType)]
    rows = clean.nan_to_null(clean.sanitize_values(rows, texts) if texts else rows)
    gaps = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*s.features, s.y]]).first()
    if gaps[s.y]:
        rows = forward_fill(rows, s.y, s.key[0], [s.by]).where(F.col(s.y).isNotNull())
    rows = clean.dedupe_first(rows, [s.by, *s.features], s.key[0])
    if gaps[s.y] or any(gaps):
        rows = cut_lineage(rows)
    return fill_within(rows, s, [c for c in s.numeric if gaps[c]], [c for c in s.categorical if gaps[c]])


def md5_order(key: Sequence[str]) -> Column:
    """The leading 64 bits of the MD5 of the key as text, as a long in the same order; other engines can repeat it."""
    text = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return (F.conv(F.substring(text, 1, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def model_rows(rows: DataFrame, s: Datasets, cv: int = 3) -> DataFrame:
    """(dataset, problem, classes, label, fold, x) of cleaned rows.

    A dataset with fewer than ten distinct targets is a classification: labels are positions in their order as text, and
    folds deal every class out in turn if each has `cv` rows. Text targets become positions in a regression as well. `x` has
    the numeric columns and the share of each category's value, standardised within the dataset (constant: 0).
    """
    distinct = cut_lineage(rows.groupBy(s.by, s.y).agg(F.count(F.lit(1)).alias("n")))
    sizes = distinct.groupBy(s.by).agg(F.count(F.lit(1)).alias("__distinct"), F.min("n").alias("__least"), F.sum("n").alias("__rows"))
    kinds = sizes.withColumn("problem", problem_type(F.col("__distinct"), MAX_CLASSES))
    few = null_safe_join(distinct, kinds.where("problem = 'classification'").select(s.by), [s.by], "left_semi")
    values = few.groupBy(s.by).agg(F.sort_array(F.collect_list(F.col(s.y).cast("string"))).alias("__values"))
    facts = null_safe_join(kinds, values, [s.by], "left").withColumnRenamed(s.by, "dataset")
    out = null_safe_join(rows.withColumnRenamed(s.by, "dataset"), facts, ["dataset"], "inner")
    position = F.array_position("__values", F.col(s.y).cast("string")) - 1
    if isinstance(rows.schema[s.y].dataType, T.StringType):
        many = distinct.join(kinds.where("problem = 'regression'").select(s.by), s.by, "left_semi")
        ranks = row_rank(many.withColumnRenamed(s.by, "dataset"), ["dataset"], [s.y], "__rank").select("dataset", s.y, "__rank")
        out = null_safe_join(out, ranks, ["dataset", s.y], "left")
        other = F.col("__rank") - 1
    else:
        other = F.col(s.y)
    out = out.withColumn("label", F.coalesce(position.cast("double"), other.cast("double")))
    for c in s.categorical:
        share = out.groupBy("dataset", c).agg((F.count(F.lit(1)) / F.max("__rows")).alias(f"__share_{c}"))
        out = null_safe_join(out, share, ["dataset", c], "left")
    stratum = F.when((F.col("problem") == "classification") & (F.col("__least") >= cv), F.col("label"))
    ranked = row_rank(out.withColumns({"__stratum": stratum, "__h": md5_order(s.key)}), ["dataset", "__stratum"], ["__h", *s.key], "__place", hashed=True)
    raw = [*[F.col(c).cast("double") for c in s.numeric], *[F.col(f"__share_{c}") for c in s.categorical]]
    named = cut_lineage(ranked.select(
        "dataset", "problem", F.when(F.col("problem") == "classification", F.col("__distinct")).otherwise(0).cast("int").alias("classes"), "label",
        ((F.col("__place") - 1) % cv).cast("int").alias("fold"), *[c.alias(f"__x{i}") for i, c in enumerate(raw)]))
    stats = named.groupBy("dataset").agg(*[f(f"__x{i}").alias(f"{n}{i}") for i in range(len(raw)) for n, f in (("__m", F.avg), ("__s", F.stddev_pop))])
    joined = null_safe_join(named, stats, ["dataset"], "inner")
    scaled = [F.coalesce(F.try_divide(F.col(f"__x{i}") - F.col(f"__m{i}"), F.when(F.col(f"__s{i}") > 1e-12 * F.abs(f"__m{i}"), F.col(f"__s{i}"))), F.lit(0.0)) for i in range(len(raw))]
    return cut_lineage(joined.select("dataset", "problem", "classes", "label", "fold", F.array(*scaled).alias("x")))


# ---- naive Bayes and linear models --------------------------------------------------------------

def fold_sums(rows: DataFrame, cv: int) -> DataFrame:
    """(dataset, classes, fold, class, sums): count, sums and sums of squares of x by class, or the products of (1, x, y)."""

    def make(key: tuple, columns: list[np.ndarray]) -> dict:
        fold, label, x = columns
        out = {}
        for f in range(cv):
            ours = fold == f
            if key[1]:
                for c in np.unique(label[ours]):
                    part = x[ours & (label == c)]
                    out[f, int(c)] = np.concatenate([[len(part)], part.sum(axis=0), np.square(part).sum(axis=0)])
            elif ours.any():
                z = np.column_stack([np.ones(ours.sum()), x[ours], label[ours]])
                out[f, 0] = (z.T @ z).ravel()
        return out

    more = [T.StructField("fold", T.IntegerType()), T.StructField("class", T.IntegerType())]
    return merge_sums(task_sums(rows, ["dataset", "classes"], ["fold", "label", "x"], make, more), ["dataset", "classes", "fold", "class"])


def descent(gram: np.ndarray, target: np.ndarray, n: float, penalty: float, share: float) -> np.ndarray:
    """Coefficients that minimise squared errors / 2n + penalty * (share * |b| + (1 - share) / 2 * b^2), by coordinates."""
    b = np.zeros(len(target))
    for _ in range(1000):
        before = b.copy()
        for j in range(len(b)):
            if gram[j, j] > 0:
                rho = (target[j] - gram[j] @ b + gram[j, j] * b[j]) / n
                b[j] = np.sign(rho) * max(abs(rho) - penalty * share, 0.0) / (gram[j, j] / n + penalty * (1 - share))
        if np.abs(b - before).max(initial=0) <= 1e-10 * max(1.0, np.abs(b).max(initial=0)):
            break
    return b


def linear_error(train: np.ndarray, test: np.ndarray, penalty: tuple[str, float, float]) -> float:
    """Mean squared error on the rows of `test` of a linear model of the rows of `train`, both as products of (1, x, y)."""
    n, p = train[0, 0], len(train) - 2
    mean = train[0, 1:p + 1] / n
    spread = np.sqrt(np.maximum(np.diag(train)[1:p + 1] / n - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    # (1, x, y) to (1, standardised x, centred y) of the training rows.
    turn = np.eye(p + 2)
    turn[0, 1:p + 1], turn[0, p + 1] = -mean / spread, -train[0, p + 1] / n
    turn[range(1, p + 1), range(1, p + 1)] = 1 / spread
    ours, held = turn.T @ train @ turn, turn.T @ test @ turn
    kind, weight, share = penalty
    gram, target = ours[1:p + 1, 1:p + 1], ours[1:p + 1, p + 1]
    if share == 0:
        b = np.linalg.lstsq(gram + (weight if kind == "sum" else weight * n) * np.eye(p), target, rcond=None)[0]
    else:
        b = descent(gram, target, n, weight, share)
    b = np.concatenate([[0.0], -b, [1.0]])
    return max(float(b @ held @ b), 0.0) / test[0, 0]


def linear_scores(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """(dataset, fold, model, score): minus the RMSE of the fold, from the sums alone."""
    kind = sums.schema["dataset"].dataType.simpleString()
    penalties = {n: PENALTIES[n] for n in names}

    def solve(table: pa.Table) -> pa.Table:
        parts = {f: np.array(v) for f, v in zip(table.column("fold").to_pylist(), table.column("sums").to_pylist())}
        size = round(len(next(iter(parts.values()))) ** 0.5)
        parts = {f: v.reshape(size, size) for f, v in parts.items()}
        whole = sum(parts.values())
        found = [(f, n, -linear_error(whole - part, part, p) ** 0.5) for f, part in sorted(parts.items()) if whole[0, 0] > part[0, 0] for n, p in penalties.items()]
        first = table.column("dataset").slice(0, 1).combine_chunks()
        return pa.table([pa.concat_arrays([first] * len(found)) if found else first.slice(1), pa.array([r[0] for r in found], pa.int32()),
                         pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.float64())], names=["dataset", "fold", "model", "score"])

    return sums.where("classes = 0").groupBy("dataset").applyInArrow(solve, f"dataset {kind}, fold int, model string, score double")


def bayes_models(sums: DataFrame) -> DataFrame:
    """(dataset, fold, bayes): per class with rows outside the fold its label, log prior, and means and variances of x.

    The smallest variance counts as 1e-9 of the fold's largest one. At most ten classes a dataset meet here.
    """
    kind = sums.schema["dataset"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        parts = list(zip(table.column("fold").to_pylist(), table.column("class").to_pylist(), (np.array(v) for v in table.column("sums").to_pylist())))
        out = []
        for fold in sorted({f for f, _, _ in parts}):
            train: dict[int, np.ndarray] = {}
            for f, c, v in parts:
                if f != fold:
                    train[c] = train.get(c, 0) + v
            if not train:
                continue
            whole, p = sum(train.values()), (len(parts[0][2]) - 1) // 2
            spread = lambda v: np.maximum(v[p + 1:] / v[0] - (v[1:p + 1] / v[0]) ** 2, 0)
            floor = SMOOTHING * max(spread(whole).max(initial=0), 1e-300)
            out.append((fold, [{"label": float(c), "prior": float(np.log(v[0] / whole[0])), "mean": v[1:p + 1] / v[0], "variance": spread(v) + floor} for c, v in sorted(train.items())]))
        first = table.column("dataset").slice(0, 1).combine_chunks()
        entry = pa.list_(pa.struct([("label", pa.float64()), ("prior", pa.float64()), ("mean", pa.list_(pa.float64())), ("variance", pa.list_(pa.float64()))]))
        return pa.table([pa.concat_arrays([first] * len(out)) if out else first.slice(1), pa.array([f for f, _ in out], pa.int32()), pa.array([m for _, m in out], entry)], names=["dataset", "fold", "bayes"])

    shape = f"dataset {kind}, fold int, bayes array<struct<label:double,prior:double,mean:array<double>,variance:array<double>>>"
    return sums.where("classes > 0").groupBy("dataset").applyInArrow(solve, shape)


def bayes_label(x: Column, model: Column) -> Column:
    """The most likely class, the smaller one on ties."""

    def likelihood(c: Column) -> Column:
        cell = F.transform(F.arrays_zip(x.alias("x"), c["mean"].alias("m"), c["variance"].alias("v")),
                           lambda t: F.log(2 * F.lit(np.pi) * t["v"]) + (t["x"] - t["m"]) * (t["x"] - t["m"]) / t["v"])
        return c["prior"] - F.aggregate(cell, F.lit(0.0), lambda a, b: a + b) / 2

    return -F.array_max(F.transform(model, lambda c: F.struct(likelihood(c).alias("s"), (-c["label"]).alias("l"))))["l"]


# ---- trees --------------------------------------------------------------------------------------

def binned(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """`rows` with `bins`: how many of the dataset's quantile cuts lie below each value of x."""
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return rows.withColumn("bins", F.array().cast("array<int>"))
    probs = [i / bins for i in range(1, bins)]
    cuts = rows.groupBy("dataset").agg(F.array(*[F.array_sort(F.array_distinct(F.percentile_approx(F.get("x", F.lit(j)), probs, ACCURACY))) for j in range(width)]).alias("__cuts"))
    joined = null_safe_join(rows, cuts, ["dataset"], "inner")
    place = F.transform(F.arrays_zip(F.col("x").alias("x"), F.col("__cuts").alias("c")), lambda t: F.size(F.filter(t["c"], lambda c: c < t["x"])))
    return joined.withColumn("bins", place).drop("__cuts")


def descend(rows: DataFrame, found: DataFrame, level: int, cv: int) -> DataFrame:
    """`rows` one level deeper in their dataset's trees: `nodes` by fold, 0 below a node that isn't split, and `value` in the tree without the row's own fold.

    `found` has the splits of this level's nodes. They are joined as arrays, so that a row looks its node up by position.
    """
    width = 1 << level
    slot = F.floor(F.col("place") / _NODE).cast("int") * width + F.col("place") % _NODE - width
    entries = found.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct(slot, F.struct("feature", "bin", "value", "left", "right")))).alias("m"))
    names = {"feature": "__feature", "bin": "__bin", "left": "__left", "right": "__right"} | ({} if level else {"value": "__root"})
    slots = F.transform(F.sequence(F.lit(0), F.lit(cv * width - 1)), lambda i: F.try_element_at("m", i))
    tables = entries.select("dataset", slots.alias("slots")).select("dataset", *[F.col(f"slots.{c}").alias(n) for c, n in names.items()])
    met = null_safe_join(rows, tables, ["dataset"], "inner")

    def step(fold: Column | int, inner: bool) -> Column:
        """Below the node of a row in a tree: the node's number (`inner`) or the value there, which stays where nothing is split."""
        node = F.get("nodes", fold if isinstance(fold, Column) else F.lit(fold))
        at = node + (fold - 1) * width
        feature = F.get("__feature", at)
        right = F.get("bins", feature) > F.get("__bin", at)
        if inner:
            return F.when((node > 0) & (feature >= 0), 2 * node + right.cast("int")).otherwise(0)
        stays = F.col("value") if level else F.get("__root", at)
        return F.when((node > 0) & (feature >= 0), F.when(right, F.get("__right", at)).otherwise(F.get("__left", at))).otherwise(stays)

    return met.withColumn("value", step(F.col("fold"), False)).withColumn("nodes", F.array(*[step(F.lit(f), True) for f in range(cv)])).drop(*names.values())


def best_split(sums: np.ndarray, classes: int) -> tuple[int, int, float, float, float]:
    """(feature, bin, value, left, right) of a node from its histograms (feature, bin, class or moment); feature -1: no split.

    Gini impurity for classes, variance for numbers; rows up to and with the bin go left. The first of equally good splits wins.
    """
    def value(v: np.ndarray) -> np.ndarray:
        return v.argmax(axis=-1).astype(float) if classes else v[..., 1] / np.maximum(v[..., 0], 1)

    def impurity(v: np.ndarray) -> np.ndarray:  # times the number of rows
        n = np.maximum(v.sum(axis=-1) if classes else v[..., 0], 1e-300)
        return n - np.square(v).sum(axis=-1) / n if classes else v[..., 2] - np.square(v[..., 1]) / n

    left = sums.cumsum(axis=1)
    total = left[0, -1]
    right = total - left
    rows = (lambda v: v.sum(axis=-1)) if classes else (lambda v: v[..., 0])
    gain = impurity(total) - impurity(left) - impurity(right)
    gain[(rows(left) < 0.5) | (rows(right) < 0.5)] = -1
    small = 1e-9 * max(impurity(total), 1e-9)
    at = int((gain >= gain.max() - small).argmax())  # gains of equal splits may differ in their last digits
    if gain.ravel()[at] <= small:
        return -1, 0, float(value(total)), 0.0, 0.0
    j, b = divmod(at, sums.shape[1])
    return j, b, float(value(total)), float(value(left[j, b])), float(value(right[j, b]))


def grow_trees(rows: DataFrame, cv: int, depth: int = DEPTH, bins: int = BINS) -> DataFrame:
    """`rows` with `value`: what the tree of their dataset without their own fold gives them, NULL where it has no rows.

    The trees of every dataset without each fold in turn grow level by level; rows are stored with the nodes they are in.
    """
    kind = rows.schema["dataset"].dataType.simpleString()
    shape = f"dataset {kind}, place int, feature int, bin int, value double, left double, right double"

    def make(key: tuple, columns: list[np.ndarray]) -> dict:
        fold, label, places, nodes = columns
        places = places.astype(np.int64)
        p, kinds = places.shape[1], key[1] or 3
        size = p * bins * kinds
        cell = (np.arange(p) * bins + places) * kinds
        out = {}
        for f in range(cv):
            inside = (fold != f) & (nodes[:, f] > 0)
            met, which = np.unique(nodes[inside, f], return_inverse=True)
            at = cell[inside] + which[:, None] * size
            if key[1]:
                hist = np.bincount((at + label[inside, None].astype(np.int64)).ravel(), minlength=len(met) * size)
            else:
                y = np.repeat(label[inside], p)
                hist = sum((np.bincount(at.ravel() + k, y**k, len(met) * size) for k in range(3)), np.zeros(len(met) * size))
            for node, own in zip(met, hist.astype(float).reshape(len(met), size)):
                out[(int(f * _NODE + node),)] = own.copy()
        return out

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_split(np.array(v).reshape(-1, bins, c or 3), c) for c, v in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, pa.int32()) for c in columns[:2]), *(pa.array(c, pa.float64()) for c in columns[2:])],
                names=["dataset", "place", "feature", "bin", "value", "left", "right"])

    now = rows.withColumns({"nodes": F.array(*[F.lit(1)] * cv), "value": F.lit(None).cast("double")})
    for level in range(depth):
        hist = merge_sums(task_sums(now, ["dataset", "classes"], ["fold", "label", "bins", "nodes"], make, [T.StructField("place", T.IntegerType())]), ["dataset", "classes", "place"])
        found = cut_lineage(hist.select("dataset", "classes", "place", "sums").mapInArrow(choose, shape))
        now = cut_lineage(descend(now, found, level, cv))
        if not found.where("feature >= 0").limit(1).count():
            break
    return now


# ---- scores -------------------------------------------------------------------------------------

def predicted_scores(rows: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """(dataset, fold, model, score) of prediction columns: support-weighted F1, or minus RMSE."""
    entries = F.array(*[F.struct(F.lit(n).alias("model"), p.alias("prediction")) for n, p in predictions.items()])
    long = rows.select("dataset", "problem", "fold", "label", F.explode(entries).alias("e")).select("dataset", "problem", "fold", "label", "e.*").where("prediction IS NOT NULL")
    by = ["dataset", "fold", "model"]
    f1 = ev.classification_metrics(long.where("problem = 'classification'"), "label", "prediction", by).select(*by, F.col("f1").alias("score"))
    rmse = ev.regression_metrics(long.where("problem = 'regression'"), "label", "prediction", by).select(*by, (-F.col("rmse")).alias("score"))
    return f1.unionByName(rmse)


def grouped_scores(rows: DataFrame, names: Sequence[str] | None = None, cv: int = 3, depth: int = DEPTH, bins: int = BINS) -> DataFrame:
    """(dataset_id, task, model, score, time_s, folds_done) of the rows of `model_rows`, means over folds.

    `time_s` is an estimate from rows, columns and passes, as fits share their passes.
    """
    wanted = set(names or PASSES)
    out: list[DataFrame] = []
    linear = [n for n in GROUPED["regression"] if n in wanted and n in PENALTIES]
    if linear or "naive_bayes" in wanted:
        sums = cut_lineage(fold_sums(rows, cv))
        if linear:
            out.append(linear_scores(sums, linear))
        if "naive_bayes" in wanted:
            met = null_safe_join(rows.where("classes > 0"), bayes_models(sums), ["dataset", "fold"], "inner")
            out.append(predicted_scores(met, {"naive_bayes": bayes_label(F.col("x"), F.col("bayes"))}))
    trees = {"classification": "dt_clf", "regression": "dt_reg"}
    if wanted & set(trees.values()):
        ours = rows.where(F.col("problem").isin([k for k, n in trees.items() if n in wanted]))
        grown = grow_trees(cut_lineage(binned(ours, bins).drop("x")), cv, depth, bins)
        out.append(predicted_scores(grown, {n: F.when(F.col("problem") == k, F.col("value")) for k, n in trees.items() if n in wanted}))
    if not out:
        raise ValueError(f"none of {sorted(wanted)} is fitted from grouped statistics")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    sizes = rows.groupBy("dataset", "problem").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"))
    means = every.groupBy("dataset", "model").agg(F.avg("score").alias("score"), F.count(F.lit(1)).cast("int").alias("folds_done"))
    passes = F.try_element_at(F.create_map(*[F.lit(x) for kv in PASSES.items() for x in kv]), F.col("model"))
    return null_safe_join(means, sizes, ["dataset"], "inner").select(
        F.col("dataset").alias("dataset_id"), F.col("problem").alias("task"), "model", "score",
        (F.col("n") * F.col("p") * passes * SECONDS_PER_VALUE).alias("time_s"), "folds_done")


def queued(ids: Iterator, job, at_once: int = 4) -> int:
    """Run `job(id)` for each of `ids`, `at_once` at a time; ids are taken as room comes free. Gives their number."""
    done, open_ = 0, set()
    with ThreadPoolExecutor(at_once) as pool:
        for value in ids:
            if len(open_) >= at_once:
                ready, open_ = wait(open_, return_when=FIRST_COMPLETED)
                done += sum(1 for f in ready if f.result() is None or True)
            open_.add(pool.submit(job, value))
        return done + sum(1 for f in open_ if f.result() is None or True)


def single_scores(rows: DataFrame, s: Datasets, names: Sequence[str], cv: int = 3, at_once: int = 4) -> DataFrame | None:
    """Scores like `grouped_scores` of models that need a fit for each dataset: a queue of jobs over cleaned rows.

    Ids come from the executors as the queue takes them, and each job writes its scores to the shared folder.
    """
    from .models import AVAILABLE, Task, screen_models

    names = [n for n in names if n not in PASSES]
    if not names:
        return None
    spark = rows.sparkSession
    path = scratch_path(spark, "scores")
    counts = rows.groupBy(s.by).agg(F.count_distinct(s.y).alias("n")).withColumn("problem", problem_type(F.col("n"), MAX_CLASSES))
    text = isinstance(rows.schema[s.y].dataType, T.StringType)

    def job(found) -> None:
        value, problem = found[s.by], found["problem"]
        ours = [n for n in names if n in AVAILABLE[problem]]
        if not ours:
            return
        part = cut_lineage(rows.where(F.col(s.by).eqNullSafe(F.lit(value))))
        if text or problem == "classification":
            part = clean.label_index(part.withColumn(s.y, F.col(s.y).cast("string")), s.y)
        task = Task(s.y, s.key, s.numeric, s.categorical, problem)
        scores, _ = screen_models(part, task, ours, 1.0, cv)
        scores.select(F.lit(value).cast(rows.schema[s.by].dataType).alias("dataset_id"), F.lit(problem).alias("task"), "model", "score", "time_s", F.lit(max(cv, 1)).alias("folds_done")).write.parquet(
            f"{path}/job={spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}")

    stored = cut_lineage(counts)
    schema = f"dataset_id {rows.schema[s.by].dataType.simpleString()}, task string, model string, score double, time_s double, folds_done int"
    spark.createDataFrame([], schema).write.parquet(f"{path}/job=none")
    queued(stored.toLocalIterator(), job, at_once)
    return spark.read.schema(schema).parquet(path).drop("job")


def build_memory(
    df: DataFrame, s: Datasets, names: Sequence[str] | None = None, done: DataFrame | None = None, minimum: int = 50, cv: int = 3,
    store: str | None = None, at_once: int = 4,
) -> DataFrame:
    """One memory record per dataset: fingerprint, the winner by utility, its score, time and problem type.

    Datasets are cleaned, described and fitted together; only models that can't be fitted from grouped statistics go
    through a queue, `at_once` fits at a time. By default all grouped models run. Datasets in `done` (column `s.by`), with
    fewer than `minimum` rows or a NULL id are left out. With `store`, records are appended to that table and the table's
    datasets count as done.
    """
    from . import utility as ut

    spark = df.sparkSession
    ours = df.where(F.col(s.by).isNotNull())
    if store is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            stored = spark.read.parquet(store).select(F.col("dataset_id").alias(s.by))
            done = stored if done is None else done.select(s.by).unionByName(stored)
    if done is not None:
        ours = ours.join(done.select(s.by).distinct(), s.by, "left_anti")
    rows = cut_lineage(cleaned(ours, s, minimum))
    prints = fingerprints(rows, s.features, s.y, [s.by]).withColumnRenamed(s.by, "dataset_id")
    names = list(names or PASSES)
    scores = None
    if any(n in PASSES for n in names):
        scores = grouped_scores(model_rows(rows, s, cv), [n for n in names if n in PASSES], cv)
    more = single_scores(rows, s, names, cv, at_once)
    if more is not None:
        scores = more if scores is None else scores.unionByName(more)
    best = ut.multi_objective(scores.where("NOT isnan(score)")).join(scores.select("dataset_id", "task").distinct(), "dataset_id")
    records = prints.join(best, "dataset_id").select(
        "dataset_id", F.concat(F.lit("openml_"), F.col("dataset_id").cast("string")).alias("key"), "embedding",
        F.array("model").alias("models"), F.col("task").alias("problem_type"), "score", F.col("time_s").alias("elapsed_s"))
    if store is None:
        return records
    records = cut_lineage(records)
    records.write.mode("append").parquet(store)
    return records
