"""Metrics over prediction tables and calibration of confidences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .ordering import null_safe_join, running_sums

MAX_CLASSES = 1000
PROBABILITY_EPS = 1e-15


# ---- classification -----------------------------------------------------------------------------

def confusion_counts(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the label pairs that occur."""
    return df.groupBy(*by, F.col(y).alias("label"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts for all label pairs, also those that never occur."""
    counts = confusion_counts(df, y, pred, by)
    labels = [r[0] for r in counts.select(F.explode(F.array("label", "predicted")).alias("v")).distinct().orderBy("v").limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    wide = counts.groupBy(*by, "label").pivot("predicted", labels).agg(F.sum("n"))
    row = wide.select(*by, "label", F.explode(F.array(*[
        F.struct(F.lit(v).alias("predicted"), F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias("n")) for v in labels
    ])).alias("e")).select(*by, "label", "e.*")
    # Labels that are predicted but never true have no row above.
    missing = counts.groupBy(*by).agg(F.array_except(F.array(*[F.lit(v) for v in labels]), F.collect_set("label")).alias("l"))
    zeros = missing.select(*by, F.explode("l").alias("label")).select(
        *by, "label", F.explode(F.array(*[F.lit(v) for v in labels])).alias("predicted"), F.lit(0).cast("long").alias("n"))
    return row.unionByName(zeros)


def class_report(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    hit = F.when(F.col("label").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("named"), hit.alias("hit")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("named"), zero.alias("hit")),
    )
    per_class = confusion_counts(df, y, pred, by).select(*by, F.explode(sides).alias("e")).groupBy(*by, "e.class").agg(
        *[F.sum(f"e.{c}").alias(c) for c in ("support", "named", "hit")])
    zero_d = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hit", "named"), zero_d)
    recall = F.coalesce(F.try_divide("hit", "support"), zero_d)
    return per_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero_d))


def report_averages(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and the macro and support-weighted averages of a class report."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return report.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )


def classification_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    avg = report_averages(class_report(df, y, pred, by), by)
    return avg.select(*by, "accuracy", F.col("weighted_precision").alias("precision"),
                      F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"))


def roc_auc(df: DataFrame, positive: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half, plus the numbers of positives and negatives.

    Rows are first combined to distinct scores; the running count of positives is taken in score
    ranges, so neither one model nor the whole table has to be sorted in one task.
    """
    by = list(by)
    rows = df.select(*by, score.cast("double").alias("__score"), positive.cast("int").alias("__pos"))
    rows = rows.where(F.col("__score").isNotNull() & F.col("__pos").isNotNull())
    counts = rows.groupBy(*by, "__score").agg(
        F.sum(F.col("__pos").cast("long")).alias("__p"), F.sum((1 - F.col("__pos")).cast("long")).alias("__n"))
    above = running_sums(counts, by, "__score", {"__above": "__p"}, descending=True, inclusive=False, spread=rows)
    p, n = F.col("__p").cast("double"), F.col("__n").cast("double")
    return above.groupBy(*by).agg(
        F.try_divide(F.sum(n * (F.col("__above") + p / 2)), F.sum(p) * F.sum(n)).alias("auc"),
        F.sum("__p").alias("positives"), F.sum("__n").alias("negatives"))


def roc_auc_one_vs_rest(df: DataFrame, y: str, probabilities: str, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted one-vs-rest AUC; `probabilities` is ordered by the class index in y."""
    long = df.select(*by, F.col(y).alias("__y"), F.posexplode(probabilities).alias("class", "__p"))
    per_class = roc_auc(long, F.col("__y") == F.col("class"), F.col("__p"), [*by, "class"])
    return per_class.groupBy(*by).agg(
        F.avg("auc").alias("auc_macro"),
        (F.sum(F.col("auc") * F.col("positives")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("positives")))).alias("auc_weighted"))


def log_loss(df: DataFrame, y: str, probabilities: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean -ln of the clipped and normalised probability of the true class (index in y)."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x.cast("double"))
    p = F.try_divide(F.try_element_at(F.col(probabilities), (F.col(y) + 1).cast("int")), total)
    clipped = clamp(p, PROBABILITY_EPS, 1 - PROBABILITY_EPS)
    return df.groupBy(*by).agg(F.avg(-F.ln(clipped)).alias("log_loss"))


# ---- regression ---------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, MSE and R2 in one pass."""
    both = F.col(y).isNotNull() & F.col(pred).isNotNull()
    t = F.when(both, F.col(y).cast("double"))
    e = t - F.col(pred).cast("double")
    return df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(t).alias("__var")).select(
        *by, F.sqrt("mse").alias("rmse"), "mae", "mse", (1 - F.try_divide("mse", "__var")).alias("r2"))


# ---- calibration --------------------------------------------------------------------------------

def confidence(similarity: Column, consistency: Column, agreement: Column) -> Column:
    return clamp(0.6 * similarity + 0.2 * consistency + 0.2 * agreement, 0.0, 1.0)


def normal_utility(df: DataFrame, col: str, out: str = "norm_utility") -> DataFrame:
    """Utility scaled to [0, 1] over the whole table; 1 when all are equal."""
    bounds = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    scaled = df.withColumn("__b", bounds)
    lo, hi = F.col("__b.lo"), F.col("__b.hi")
    return scaled.withColumn(out, F.when(hi > lo, F.try_divide(F.col(col) - lo, hi - lo)).otherwise(1.0)).drop("__b")


def calibration_bins(df: DataFrame, conf: str, actual: str, bins: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Reliability curve: mean confidence, mean actual and rows per bin [lo, hi), the last bin closed."""
    c = F.col(conf)
    index = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    return df.where(c.between(0.0, 1.0)).groupBy(*by, index.alias("bin")).agg(
        F.avg(c).alias("mean_conf"), F.avg(actual).alias("mean_actual"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(df: DataFrame, conf: str, actual: str, bins: int = 5, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    per_bin = calibration_bins(df, conf, actual, bins, by)
    return _weighted_gap(per_bin, df.groupBy(*by).agg(F.count(F.lit(1)).alias("__t")), by)


def _weighted_gap(per_bin: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    gap = per_bin.groupBy(*by).agg(F.sum(F.abs(F.col("mean_actual") - F.col("mean_conf")) * F.col("n")).alias("__g"))
    joined = null_safe_join(totals, gap, by, "left") if by else totals.withColumn("__g", gap.scalar())
    return joined.select(*by, F.coalesce(F.try_divide("__g", "__t"), F.lit(0.0)).alias("ece"))


def probability_calibration_error(df: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Calibration error of class probabilities: bins (lo, hi], a group's largest label is positive, and a
    probability of 0 falls in no bin but counts in the total."""
    by = list(by)
    if by:
        df = null_safe_join(df, df.groupBy(*by).agg(F.max(y).alias("__top")), by, "left")
    top = F.col("__top") if by else df.agg(F.max(y)).scalar()
    rows = df.withColumn("__hit", (F.col(y) == top).cast("double"))
    index = (F.ceil(F.col(p) * bins) - 1).cast("int")
    per_bin = rows.where((F.col(p) > 0) & (F.col(p) <= 1)).groupBy(*by, index.alias("bin")).agg(
        F.avg(p).alias("mean_conf"), F.avg("__hit").alias("mean_actual"), F.count(F.lit(1)).alias("n"))
    return _weighted_gap(per_bin, df.groupBy(*by).agg(F.count(F.lit(1)).alias("__t")), by)
