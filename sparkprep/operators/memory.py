"""Retrieval decisions over neighbour tables: scoring, thresholds, model picks.

A neighbour table has one row per query and neighbour: query_id, memory_id, rank, similarity and the
columns of the memory record. Groups here are the k neighbours of one query, so windows are small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import vectors as vx
from .ordering import null_safe_join

SIMILARITY_FLOOR = 0.75
WARM_START_DISTANCE = 0.50
SEARCH_SIMILARITY = 0.60
NEUTRAL = 0.5
# Weight triples (similarity, performance, recency) of the sensitivity sweep.
SWEEP = [(1.0, 0.0, 0.0), (0.6, 0.3, 0.1), (0.5, 0.4, 0.1), (0.5, 0.3, 0.2), (0.4, 0.5, 0.1), (0.7, 0.2, 0.1)]

MEMORY_RECORD = (
    "dataset_id string, key string, embedding array<float>, models array<string>, "
    "metadata struct<problem_type: string, score: double, recorded_at: timestamp, elapsed_s: double, "
    "hparams: map<string, map<string, string>>>"
)
MEMORY_ENTRY = (
    "dataset_id string, dataset_embedding array<double>, paradigm string, model_name string, "
    "hyperparameters map<string, string>, architecture_config map<string, string>, "
    "performance struct<accuracy: double, f1: double, auc: double, rmse: double>, "
    "training_time double, task_type string"
)


#: Weights of similarity, performance and recency in the combined score.
COMBINED_WEIGHTS = (0.6, 0.3, 0.1)
DECAY_DAYS = 30.0


def record_key(dataset_id: Column, prefix: str = "openml_") -> Column:
    return F.concat(F.lit(prefix), dataset_id.cast("string"))


# ---- scores -------------------------------------------------------------------------------------

def minmax(col: Column, by: Sequence[str], higher_is_better: bool | Column = True) -> Column:
    """Min-max scaling inside small groups; 1 when all values are equal, NULL stays NULL."""
    if isinstance(higher_is_better, bool):
        v = col if higher_is_better else -col
    else:
        v = F.when(higher_is_better, col).otherwise(-col)
    w = Window.partitionBy(*by)
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(v.isNotNull(), F.when(hi == lo, 1.0).otherwise(F.try_divide(v - lo, hi - lo)))


def minmax_large(
    df: DataFrame, col: str, by: Sequence[str], higher_is_better: bool = True, out: str = "scaled"
) -> DataFrame:
    """The same scaling for groups of any size: bounds are aggregated and joined, no window."""
    v = F.col(col) if higher_is_better else -F.col(col)
    bounds = df.groupBy(*by).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    joined = null_safe_join(df, bounds, list(by), "inner")
    lo, hi = F.col("__lo"), F.col("__hi")
    scaled = F.when(v.isNotNull(), F.when(hi == lo, 1.0).otherwise(F.try_divide(v - lo, hi - lo)))
    return joined.withColumn(out, scaled).drop("__lo", "__hi")


def recency(recorded_at: Column, as_of: Column, decay_days: float = 30.0) -> Column:
    """exp(-age/decay); the future has age 0, a missing time is neutral. Times are compared to the
    given moment, never to the clock."""
    age = (F.unix_micros(as_of) - F.unix_micros(recorded_at)) / 86_400_000_000.0
    return F.when(recorded_at.isNull(), NEUTRAL).otherwise(F.exp(-F.greatest(F.lit(0.0), age) / decay_days))


def scored(
    neighbors: DataFrame, as_of: Column, weights: tuple[float, float, float] = COMBINED_WEIGHTS, decay_days: float = DECAY_DAYS,
    by: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Add s, p, r and combined, their sum under `weights` (which add up to 1), to a neighbour table.

    Needs similarity, score (higher is better, may be NULL) and recorded_at.
    """
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError(f"weights {weights} don't add up to 1")
    return weighted(_parts(neighbors, as_of, decay_days, by), *map(F.lit, weights))


def _parts(neighbors: DataFrame, as_of: Column, decay: float, by: Sequence[str]) -> DataFrame:
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))
    return neighbors.withColumns({
        "s": minmax(sim, by),
        "p": F.coalesce(minmax(F.col("score"), by), F.lit(NEUTRAL)),
        "r": recency(F.col("recorded_at"), as_of, decay),
    })


def weighted(parts: DataFrame, alpha: Column, beta: Column, gamma: Column) -> DataFrame:
    return parts.withColumn("combined", alpha * F.col("s") + beta * F.col("p") + gamma * F.col("r"))


def adaptive_threshold(neighbors: DataFrame, value: str = "similarity", lam: float = 0.5, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """mu, sigma (population) and epsilon = mu - lam*sigma per query."""
    return neighbors.groupBy(*by).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma")).withColumn(
        "epsilon", F.col("mu") - lam * F.col("sigma"))


def top_k_mean(neighbors: DataFrame, k: int = 3, value: str = "similarity") -> DataFrame:
    """Mean of the k largest similarities of each query (k=1 gives the maximum)."""
    best = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, k)
    return neighbors.groupBy("query_id").agg(best.alias("__b")).select(
        "query_id", (F.aggregate("__b", F.lit(0.0), lambda a, x: a + x) / F.size("__b")).alias("top_k_mean"))


def consistency(neighbors: DataFrame, score: str = "score") -> DataFrame:
    """1 / (1 + 10 * variance of the neighbours' scores); neutral below two neighbours."""
    return neighbors.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("__n"), F.var_pop(F.coalesce(score, F.lit(0.0))).alias("__v")
    ).select("query_id", F.when(F.col("__n") > 1, 1.0 / (1.0 + 10.0 * F.col("__v"))).otherwise(NEUTRAL).alias("consistency"))


def deep_share(neighbors: DataFrame, flag: str = "is_dl") -> DataFrame:
    """Share of the neighbours whose winner was a network."""
    return neighbors.groupBy("query_id").agg(
        F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")).alias("memory_score"))


# ---- decisions ----------------------------------------------------------------------------------

def decide(
    queries: DataFrame,
    neighbors: DataFrame,
    as_of: Column,
    weights: tuple[float, float, float] = COMBINED_WEIGHTS,
    decay_days: float = DECAY_DAYS,
    floor: float = SIMILARITY_FLOOR,
    **choice,
) -> DataFrame:
    """One decision row per query: 'memory' or 'cold_start', threshold, winner and chosen models.

    `queries` has query_id and problem_type; queries without neighbours get zeros and the fallback. `choice` may set
    `sensitivity` of the threshold and how many models come `from_memory` and `from_fallback`.
    """
    return _decide(queries, scored(neighbors, as_of, weights, decay_days), floor, (), **choice)


def _decide(
    queries: DataFrame, best: DataFrame, floor: float, extra: Sequence[str], sensitivity: float = 0.5, from_memory: int = 3, from_fallback: int = 5,
) -> DataFrame:
    if min(from_memory, from_fallback) < 1:
        raise ValueError("at least one model is chosen, from memory and as a fallback")
    first = F.struct(-F.col("combined"), F.col("rank"))
    winner = F.struct("memory_id", "similarity", "combined", "p", "r")
    ranked_models = F.sort_array(F.collect_list(F.struct((-F.col("combined")).alias("c"), F.col("rank"), F.col("models")[0].alias("m"))))
    per_query = best.groupBy("query_id", *extra).agg(
        F.avg("combined").alias("mu"), F.stddev_pop("combined").alias("sigma"),
        F.min_by(winner, first).alias("w"), ranked_models.alias("__ranked"),
        F.sort_array(F.collect_list("similarity"), asc=False).alias("similarities"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "memory_id"))), lambda e: e["memory_id"]).alias("neighbor_ids"),
    )
    joined = queries.select("query_id", "problem_type").join(per_query, "query_id", "left")
    epsilon = F.col("mu") - sensitivity * F.col("sigma")
    problem = F.col("problem_type")
    named = F.filter(F.transform("__ranked", lambda e: e["m"]), lambda m: m.isNotNull())
    remembered = F.slice(F.array_distinct(F.transform(named, lambda m: cat.model_for(m, problem))), 1, from_memory)
    memory_list = F.when(F.size(remembered) > 0, remembered).otherwise(cat.fallback_models(problem, from_memory))
    decision = (
        F.when(F.col("w").isNull() | (F.col("w.similarity") < floor), "cold_start")
        .when(F.col("w.combined") >= epsilon, "memory").otherwise("cold_start")
    )
    zero = F.lit(0.0)
    out = joined.withColumn("decision", decision).select(
        "query_id", *extra, "problem_type", "decision",
        F.coalesce(F.round(epsilon, 6), zero).alias("epsilon"),
        F.coalesce(F.round("w.similarity", 6), zero).alias("similarity_score"),
        F.coalesce(F.round("w.combined", 6), zero).alias("combined_score"),
        F.col("w.memory_id").alias("winning_id"),
        F.coalesce(F.round("w.p", 6), zero).alias("winning_perf"),
        F.coalesce(F.round("w.r", 6), zero).alias("winning_recency"),
        F.coalesce(F.round("mu", 6), zero).alias("mu_s"),
        F.coalesce(F.round("sigma", 6), zero).alias("sigma_s"),
        "similarities", "neighbor_ids",
        F.when(F.col("decision") == "memory", memory_list)
        .otherwise(cat.fallback_models(problem, from_fallback)).alias("models_selected"),
    )
    return out.withColumn("num_models_evaluated", F.size("models_selected"))


def weight_sweep(
    queries: DataFrame, neighbors: DataFrame, as_of: Column, triples=SWEEP, decay_days: float = DECAY_DAYS, **choice
) -> DataFrame:
    """The decision under each weight triple. Every neighbour row is repeated per triple in place."""
    configs = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(c).alias("gamma")) for a, b, c in triples])
    parts = _parts(neighbors, as_of, decay_days, ["query_id"])
    every = parts.withColumn("__c", F.explode(configs)).select("*", "__c.*").drop("__c")
    best = weighted(every, F.col("alpha"), F.col("beta"), F.col("gamma"))
    return _decide(queries, best, SIMILARITY_FLOOR, ["alpha", "beta", "gamma"], **choice)


def near_match(distance: Column, limit: float = WARM_START_DISTANCE) -> Column:
    """True when the best squared distance is close enough to start from the neighbour's settings."""
    return F.coalesce(distance <= limit, F.lit(False))


def search_match(sq_distance: Column, limit: float = SEARCH_SIMILARITY) -> Column:
    return F.coalesce(vx.pseudo_similarity(sq_distance) >= limit, F.lit(False))


# ---- models of the neighbours -------------------------------------------------------------------

def vote_ranking(neighbors: DataFrame, top_n: int = 3) -> DataFrame:
    """Models of the nearest records by number of votes, then name."""
    votes = (
        neighbors.where(F.col("rank") <= top_n).select("query_id", F.explode("models").alias("model"))
        .groupBy("query_id", "model").agg(F.count(F.lit(1)).alias("votes"))
    )
    w = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "model")
    return votes.withColumn("position", F.row_number().over(w))


def candidate_pool(neighbors: DataFrame, nearest: int = 3, size: int = 3) -> DataFrame:
    """Distinct models of the nearest records, in order of nearness."""
    lists = F.sort_array(F.collect_list(F.when(F.col("rank") <= nearest, F.struct("rank", "models"))))
    return neighbors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_neighbors"), lists.alias("__l")).select(
        "query_id", "n_neighbors",
        F.slice(F.array_distinct(F.flatten(F.transform("__l", lambda e: F.coalesce(e["models"], cat.strings([]))))), 1, size).alias("pool"))


def similar_datasets(neighbors: DataFrame, n: int = 3) -> DataFrame:
    """The nearest records with distance, first model and its settings."""
    return neighbors.where(F.col("rank") <= n).select(
        "query_id", "rank", "memory_id", "distance",
        F.coalesce(F.col("models")[0], F.lit("Unknown")).alias("best_model"), "hparams")


# ---- mixed memory -------------------------------------------------------------------------------

def entry_performance(task_type: Column, f1: Column, rmse: Column) -> Column:
    """f1 for classification, 1/(1+rmse) for regression, neutral when unknown or 0."""
    raw = F.when(task_type == "classification", f1).otherwise(1.0 / (1.0 + rmse))
    return F.when(F.coalesce(raw, F.lit(0.0)) == 0.0, NEUTRAL).otherwise(raw)


def strategy_key(paradigm: Column, model: Column, architecture: Column) -> Column:
    ordered = F.array_sort(F.map_entries(architecture))
    text = F.array_join(F.transform(ordered, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.concat_ws("-", paradigm, F.when(paradigm == "ML", model).otherwise(F.coalesce(text, F.lit(""))))


def paradigm_selection(
    neighbors: DataFrame, top_n: int = 5, performance_weight: float = 1.0, time_penalty: float = 0.01
) -> DataFrame:
    """The best distinct strategies of each query's neighbours, `position` 1 first.

    score = similarity * weight * performance - penalty * training time.
    """
    perf = entry_performance(F.col("task_type"), F.col("performance.f1"), F.col("performance.rmse"))
    score = F.col("similarity") * performance_weight * perf - F.col("training_time") * time_penalty
    keyed = neighbors.withColumn("strategy_score", score).withColumn(
        "strategy", strategy_key(F.col("paradigm"), F.col("model_name"), F.col("architecture_config")))
    order = [F.col("strategy_score").desc(), F.col("rank")]
    one = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "strategy").orderBy(*order))).where("__n = 1").drop("__n")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= top_n)


def strategy_label(paradigm: Column, model: Column, architecture: Column) -> Column:
    layers = F.coalesce(F.try_element_at(architecture, F.lit("layers")), F.lit("3"))
    return F.when(paradigm == "ML", F.concat(F.lit("ML:"), F.coalesce(model, F.lit("None")))).otherwise(
        F.concat(F.lit("DL:MLP_"), layers, F.lit("L")))


def paradigm_shares(selection: DataFrame) -> DataFrame:
    ml = (F.col("paradigm") == "ML").cast("double")
    return selection.groupBy("query_id").agg(
        F.avg(ml).alias("ml_share"), F.avg(1.0 - ml).alias("dl_share"), F.min_by("paradigm", "position").alias("best_paradigm"))


def unified_decision(queries: DataFrame, neighbors: DataFrame, sensitivity: float = 0.5, top_k: int = 3, models: int = 3) -> DataFrame:
    """Decision over a memory of both classical models and networks, one row per query."""
    limits = adaptive_threshold(neighbors, "similarity", sensitivity).join(
        top_k_mean(neighbors, top_k), "query_id")
    time = neighbors.groupBy("query_id").agg(F.sum("training_time").alias("__time"))
    chosen = paradigm_selection(neighbors, models)
    label = strategy_label(F.col("paradigm"), F.col("model_name"), F.col("architecture_config"))
    ml = (F.col("paradigm") == "ML").cast("double")
    picked = chosen.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", label.alias("l")))), lambda e: e["l"]).alias("__models"),
        F.avg(ml).alias("__ml"), F.min_by("paradigm", "position").alias("__best"), F.avg("performance.f1").alias("__f1"))
    joined = queries.select("query_id").join(limits, "query_id", "left").join(picked, "query_id", "left").join(time, "query_id", "left")
    empty = F.col("mu").isNull()
    memory = ~empty & (F.col("top_k_mean") >= F.col("epsilon"))
    zero = F.lit(0.0)
    cold_ml = F.when(empty, 1.0).otherwise(0.6)
    return joined.select(
        "query_id", F.when(memory, "memory").otherwise("cold_start").alias("decision"),
        F.coalesce(F.round("epsilon", 4), zero).alias("epsilon"),
        F.coalesce(F.round("top_k_mean", 4), zero).alias("similarity_score"),
        F.when(memory, F.col("__models")).when(empty, cat.strings(cat.UNIFIED_EMPTY)).otherwise(cat.strings(cat.UNIFIED_COLD)).alias("selected_models"),
        F.when(memory, F.col("__ml")).otherwise(cold_ml).alias("ml_share"),
        F.when(memory, 1.0 - F.col("__ml")).otherwise(1.0 - cold_ml).alias("dl_share"),
        F.when(memory, F.col("__best")).otherwise("ML").alias("best_model_type"),
        F.when(memory, F.round("__f1", 4)).otherwise(zero).alias("estimated_performance"),
        F.when(memory, F.col("__time")).otherwise(zero).alias("time_saved_s"),
    )


# ---- memory tables ------------------------------------------------------------------------------

def flat_metadata(memory: DataFrame) -> DataFrame:
    return memory.select("dataset_id", "key", "metadata.*")


def memory_stats(memory: DataFrame) -> DataFrame:
    """Entries, distinct datasets and the paradigms present (at most two)."""
    return memory.agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("dataset_id").alias("datasets"),
        F.sort_array(F.collect_set("paradigm")).alias("paradigms"))


def replace_vectors(memory: DataFrame, fresh: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Vectors of listed keys are replaced, all other records stay as they are."""
    new = fresh.select(key, F.col(vec).alias("__new"))
    return memory.join(new, key, "left").withColumn(vec, F.coalesce("__new", vec)).drop("__new").select(*memory.columns)


def fill_settings(memory: DataFrame, found: DataFrame, key: str, col: str = "hparams") -> DataFrame:
    """Settings for records that have none; records with settings are not touched."""
    new = found.select(key, F.col(col).alias("__new"))
    empty = F.col(col).isNull() | (F.size(col) == 0)
    return memory.join(new, key, "left").withColumn(
        col, F.when(empty, F.coalesce("__new", col)).otherwise(F.col(col))).drop("__new").select(*memory.columns)


def run_summary(results: DataFrame) -> DataFrame:
    """Shares of decisions and mean effects of a retrieval run; gaps count only where both scores are positive."""
    both = (F.col("final_score") > 0) & (F.col("full_score") > 0)
    return results.agg(
        F.count(F.lit(1)).alias("processed"),
        (F.avg(F.when(F.col("decision") == "memory", 1.0).otherwise(0.0)) * 100).alias("pct_memory"),
        (F.avg(F.when(F.col("decision") == "memory", 0.0).otherwise(1.0)) * 100).alias("pct_fallback"),
        F.avg("similarity").alias("avg_similarity"), F.avg("models_tried").alias("avg_models"),
        F.avg(F.when(both, F.col("full_score") - F.col("final_score"))).alias("avg_score_gap"),
        F.avg(F.when(both, F.col("models_total") - F.col("models_tried"))).alias("avg_models_saved"),
        F.count_if(both).alias("validated"))


# ---- encoder inference --------------------------------------------------------------------------

def encode(df: DataFrame, vec: str, weights: dict, out: str = "encoded") -> DataFrame:
    """Two-layer encoder with batch normalisation (running statistics), unit-length output.

    `weights` holds numpy arrays w1, b1, mean, var, gamma, beta, w2, b2. They are fixed in size and go
    out as a broadcast variable; rows pass through in Arrow batches.
    """
    shared = df.sparkSession.sparkContext.broadcast({k: np.asarray(v, dtype=np.float64) for k, v in weights.items()})

    @F.pandas_udf("array<float>")
    def forward(col: pd.Series) -> pd.Series:
        w = shared.value
        x = np.stack(col.to_numpy()).astype(np.float64)
        h = x @ w["w1"].T + w["b1"]
        h = (h - w["mean"]) / np.sqrt(w["var"] + 1e-5) * w["gamma"] + w["beta"]
        y = np.maximum(h, 0) @ w["w2"].T + w["b2"]
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(y.astype(np.float32)))

    return df.withColumn(out, F.when(F.col(vec).isNotNull(), forward(F.coalesce(vec, F.array_repeat(F.lit(0.0), shared.value["w1"].shape[1])))))
