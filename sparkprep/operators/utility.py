"""Multi-objective choice over result tables.

A result table has one row per dataset and model, so a dataset holds at most as many rows as the model
catalogue; windows over a dataset are that small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import complexity_of
from ..functions.scalars import clamp

EPS = 1e-9
SPEED_CAP = 0.5
MAX_DROP = 0.05
CATALOGUE_SIZE = 14
# Weights (score, speed, simplicity) per problem type.
WEIGHTS = {"classification": (0.6, 0.3, 0.1), "regression": (0.8, 0.15, 0.05)}
# Weight triples compared in the weight search.
WEIGHT_GRID = {
    "classification": [(1.0, 0.0, 0.0), (0.6, 0.3, 0.1), (0.5, 0.4, 0.1), (0.7, 0.2, 0.1), (0.33, 0.33, 0.33)],
    "regression": [(1.0, 0.0, 0.0), (0.8, 0.15, 0.05), (0.7, 0.2, 0.1), (0.9, 0.05, 0.05), (0.33, 0.33, 0.33)],
}


def default_weights(task: Column) -> tuple[Column, Column, Column]:
    clf, reg = WEIGHTS["classification"], WEIGHTS["regression"]
    return tuple(F.when(task == "classification", c).otherwise(r) for c, r in zip(clf, reg))


def utility(
    results: DataFrame, w1: Column, w2: Column, w3: Column, by: Sequence[str] = ("dataset_id",)
) -> DataFrame:
    """Add `utility` from score, time_s and complexity, each scaled inside the dataset.

    Speed is capped at one half before it is scaled to its largest value, so one very slow model does
    not make all others look equally fast.
    """
    w = Window.partitionBy(*by)

    def scaled(c: str) -> Column:
        x = F.col(c).cast("double")
        return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + EPS)

    made = results
    if "complexity" not in results.columns:
        made = made.withColumn("complexity", complexity_of(F.col("model")))
    made = made.withColumns({
        "__score": scaled("score"), "__speed": F.least(1 - scaled("time_s"), F.lit(SPEED_CAP)), "__simple": 1 - scaled("complexity")})
    top = F.max("__speed").over(w)
    speed = F.when(top > 0, F.col("__speed") / F.when(top > 0, top)).otherwise(F.col("__speed"))
    return made.withColumn("utility", w1 * F.col("__score") + w2 * speed + w3 * F.col("__simple")).drop("__score", "__speed", "__simple")


def eligible(results: DataFrame, by: Sequence[str], max_drop: float = MAX_DROP) -> DataFrame:
    """Models within `max_drop` of the dataset's best score (regression scores are negative); all of
    them when that leaves none."""
    w = Window.partitionBy(*by)
    best = F.max("score").over(w)
    limit = F.when(F.col("task") == "regression", best * (1 + max_drop)).otherwise(best * (1 - max_drop))
    marked = results.withColumn("__ok", F.col("score") >= limit)
    return marked.withColumn("__any", F.bool_or("__ok").over(w)).where(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")


def multi_objective(
    results: DataFrame, weights: tuple[Column, Column, Column] | None = None, by: Sequence[str] = ("dataset_id",)
) -> DataFrame:
    """The eligible model with the largest utility per dataset; ties go to the smaller name."""
    w1, w2, w3 = weights or default_weights(F.col("task"))
    scored = utility(eligible(results, by), w1, w2, w3, by)
    first = F.struct(-F.col("utility"), F.col("model"))
    return scored.groupBy(*by).agg(F.min_by(F.struct("model", "score", "time_s", "utility"), first).alias("w")).select(*by, "w.*")


def weight_search(results: DataFrame, grid=WEIGHT_GRID) -> DataFrame:
    """Winner of every dataset under every weight triple of its problem type."""
    triples = lambda rows: F.array(*[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2"), F.lit(c).alias("w3")) for a, b, c in rows])
    configs = F.when(F.col("task") == "classification", triples(grid["classification"])).otherwise(triples(grid["regression"]))
    every = results.withColumn("__c", F.explode(configs)).select("*", "__c.*").drop("__c")
    return multi_objective(every, (F.col("w1"), F.col("w2"), F.col("w3")), ["dataset_id", "w1", "w2", "w3"])


def trial_utility(score: Column, time_s: Column, complexity: Column, task: Column, w1: Column, w2: Column, w3: Column) -> Column:
    """Utility of one trial on its own: penalties for time above 0-10 s and complexity 1-4."""
    slow = F.least(time_s / 10.0, F.lit(1.0))
    complex_ = (complexity - 1) / 3.0
    factor = 1.0 + w2 * slow + w3 * complex_
    return F.when(task == "classification", w1 * score - w2 * slow - w3 * complex_).otherwise(
        F.when(score < 0, score * factor).otherwise(score / factor))


def network_utility(score: Column, time_s: Column, params: Column, task: Column, w1: float = 0.6, w2: float = 0.3, w3: float = 0.1) -> Column:
    quality = F.when(task == "classification", clamp(score, 0.0, 1.0)).otherwise(1.0 / (1.0 + F.abs(score)))
    return w1 * quality + w2 / (1.0 + time_s) + w3 / (1.0 + params / 10_000.0)


def search_metrics(trained: Column, accuracy: Column, baseline: Column) -> dict[str, Column]:
    """Compression of the catalogue, accuracy against the majority baseline, and their product."""
    compression = F.lit(float(CATALOGUE_SIZE)) / F.greatest(F.lit(1), trained)
    retention = accuracy / F.greatest(F.lit(0.01), baseline)
    return {"compression": compression, "retention": retention, "transfer_utility": compression * retention}


def transfer_metrics(all_models: Column, cold_models: Column, full_score: Column, cold_score: Column) -> dict[str, Column]:
    """The same idea against a full search: models saved, score kept, kept score per model tried."""
    cold, total = F.greatest(cold_models, F.lit(1)), F.greatest(all_models, F.lit(1))
    kept = F.when(full_score == 0, 0.0).otherwise(1.0 - F.try_divide(F.abs(full_score - cold_score), F.abs(full_score)))
    return {"compression": total / cold, "retention": kept, "transfer_utility": kept * (cold / total)}


def gap_and_saved(full_score: Column, cold_score: Column, all_models: Column, selected: Column) -> dict[str, Column]:
    return {"score_gap": full_score - cold_score, "models_saved": all_models - selected}


def best_by_metric(metrics: DataFrame, problem: str = "classification", by: Sequence[str] = ()) -> DataFrame:
    """Model with the largest f1, or the smallest rmse for regression; ties go to the smaller name."""
    order = -F.col("f1") if problem == "classification" else F.col("rmse")
    return metrics.groupBy(*by).agg(F.min_by("model", F.struct(order, F.col("model"))).alias("model"))


def top_models(results: DataFrame, n: int, value: str = "score", ascending: bool = False, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    order = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(*by).orderBy(order, "model")
    return results.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def screen(results: DataFrame, keep: float = 0.70, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Drop models in the worst part of the dataset's score range; keep all when scores are equal."""
    w = Window.partitionBy(*by)
    best, worst = F.max("score").over(w), F.min("score").over(w)
    return results.withColumn("__limit", best - keep * (best - worst)).where(F.col("score") >= F.col("__limit")).drop("__limit")


def fold_means(fold_scores: DataFrame, by: Sequence[str] = ("dataset_id", "model")) -> DataFrame:
    return fold_scores.groupBy(*by).agg(F.avg("score").alias("score"), F.avg("time_s").alias("time_s"))
