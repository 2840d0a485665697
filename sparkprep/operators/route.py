"""Routing rules over tables of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions.scalars import clamp
from .setops import ordered_union

MEMORY_WEIGHT, SUGGESTION_WEIGHT, RULE_WEIGHT = 0.6, 0.2, 0.2


def rule_candidates(problem_type: Column) -> Column:
    """Ordered models suggested by the meta-features of a dataset, at most five.

    Reads n_samples, n_features, num_ratio, cat_ratio, missing_rate, skewness_mean, mean_corr,
    n_classes and is_binary.
    """
    c = F.col
    # Conditions and the models they suggest, in order.
    classification = [
        (c("n_samples") > 5000, ["lgbm_clf", "xgb_clf", "rf"]),
        (c("cat_ratio") > 0.6, ["lgbm_clf", "xgb_clf", "gb"]),
        ((c("n_features") > 100) & (c("num_ratio") > 0.8), ["logistic", "sgd_clf", "svc"]),
        (c("is_binary") & (c("n_features") < 20), ["logistic", "svc", "lgbm_clf"]),
        (F.abs("skewness_mean") > 1.5, ["rf", "et_clf", "lgbm_clf"]),
        (c("mean_corr") > 0.7, ["logistic", "sgd_clf"]),
        (c("missing_rate") > 0.2, ["lgbm_clf", "xgb_clf"]),
        (c("n_samples") < 200, ["naive_bayes", "knn_clf", "dt_clf"]),
        (c("n_classes") > 10, ["lgbm_clf", "rf", "xgb_clf"]),
    ]
    regression = [
        (c("n_samples") > 5000, ["lgbm_reg", "xgb_reg", "rf_reg"]),
        (c("n_features") > 100, ["ridge", "lasso", "elastic"]),
        (F.abs("skewness_mean") > 1.5, ["rf_reg", "et_reg", "lgbm_reg"]),
        ((c("num_ratio") > 0.9) & (c("n_features") < 15), ["knn_reg", "svr", "mlp_reg"]),
        (c("n_samples") < 200, ["ridge", "knn_reg", "svr"]),
        (c("mean_corr") > 0.7, ["ridge", "lasso", "elastic"]),
        (c("missing_rate") > 0.2, ["lgbm_reg", "xgb_reg"]),
    ]

    def fired(rules) -> Column:
        return ordered_union(*[F.when(cond, cat.strings(models)) for cond, models in rules])

    found = F.when(problem_type == "classification", fired(classification)).otherwise(fired(regression))
    default = cat.by_problem(cat.ROUTING_FALLBACK, problem_type)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(default), 1, 5)


def fuse_rankings(
    df: DataFrame,
    key: str,
    memory: str = "memory_models",
    memory_score: str = "memory_score",
    suggested: str = "suggested_models",
    rules: str = "rule_models",
    top: int = 3,
    weights: tuple[float, float, float] = (MEMORY_WEIGHT, SUGGESTION_WEIGHT, RULE_WEIGHT),
) -> DataFrame:
    """(key, position, model, combined): three ordered model lists merged by position scores.

    Lists hold a handful of models, so a key has few rows. Ties go to the smaller name; a key with
    three empty lists gets the default list of its problem_type.
    """
    def signal(name: str, col: str) -> Column:
        listed = F.array_distinct(F.coalesce(F.col(col), cat.strings([])))
        return F.transform(listed, lambda m, i: F.struct(F.lit(name).alias("signal"), m.alias("model"), i.alias("pos")))

    rows = df.select(key, memory_score, F.explode(F.concat(
        signal("memory", memory), signal("suggested", suggested), signal("rules", rules))).alias("e")).select(key, memory_score, "e.*")
    wm, ws, wr = weights
    pos = F.col("pos").cast("double")
    part = (
        F.when(F.col("signal") == "memory", wm * F.col(memory_score) * (1 - pos * 0.1))
        .when(F.col("signal") == "suggested", ws * (1 - pos * 0.2)).otherwise(wr * (1 - pos * 0.2))
    )
    combined = rows.groupBy(key, "model").agg(F.sum(part).alias("combined"))
    w = Window.partitionBy(key).orderBy(F.round("combined", 12).desc(), "model")
    ranked = combined.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
    empty = F.size(F.concat(*[F.coalesce(F.col(c), cat.strings([])) for c in (memory, suggested, rules)])) == 0
    default = df.where(empty).select(key, F.posexplode(cat.by_problem(cat.ROUTING_FALLBACK, F.col("problem_type"))).alias("p", "model"))
    return ranked.select(key, "position", "model", "combined").unionByName(
        default.select(key, (F.col("p") + 1).alias("position"), "model", F.lit(None).cast("double").alias("combined")))


def size_score(rows: Column, cols: Column) -> Column:
    """How much the size of a dataset speaks for a network, in [0, 1]."""
    by_rows = F.when(rows > 100_000, 0.5).when(rows > 50_000, 0.4).when(rows > 10_000, 0.2).otherwise(0.0)
    by_cols = F.when(cols > 100, 0.3).when(cols > 50, 0.1).otherwise(0.0)
    few = F.when(cols < 20, -0.5).otherwise(0.0)
    return clamp(by_rows + by_cols + few, 0.0, 1.0)


def paradigm(suggestion: Column, memory: Column, rules: Column, tau: float = 0.5) -> tuple[Column, Column]:
    """(score, 'AutoDL' or 'AutoML'); a missing suggestion counts 0.2."""
    score = 0.5 * F.coalesce(suggestion, F.lit(0.2)) + 0.2 * F.coalesce(memory, F.lit(0.0)) + 0.3 * rules
    return score, F.when(score > tau, "AutoDL").otherwise("AutoML")


def pool(retrieved: Column, n_neighbors: Column, rules: Column, suggested: Column, problem_type: Column) -> Column:
    """Models to tune: suggestions and the retrieved ones, or the first three rule candidates when
    fewer than three neighbours exist; regression always adds three boosted and forest models."""
    base = F.when(F.coalesce(n_neighbors, F.lit(0)) < 3, F.slice(rules, 1, 3)).otherwise(retrieved)
    extra = F.when(problem_type == "regression", cat.strings(cat.ALWAYS_IN_REGRESSION))
    return ordered_union(suggested, base, extra)


def models_for_size(category: Column, problem_type: Column, rows: Column) -> Column:
    """Models allowed for a dataset size under catalogue names, kernel models only up to 5000 rows."""
    lists = None
    for size in ("small", "medium"):
        col = cat.by_problem(cat.BY_SIZE[size], problem_type)
        lists = F.when(category == size, col) if lists is None else lists.when(category == size, col)
    lists = lists.otherwise(cat.by_problem(cat.BY_SIZE["large"], problem_type))
    named = F.array_distinct(F.transform(lists, lambda m: cat.model_for(m, problem_type)))
    return without_kernels(named, rows)


def without_kernels(models: Column, rows: Column) -> Column:
    return F.when(rows > 5000, F.array_except(models, cat.strings(cat.KERNEL_MODELS))).otherwise(models)


# Vision encoders per domain and architecture (name, vector length).
DOMAIN_MODELS = {
    ("general", "clip"): ("openai/clip-vit-base-patch32", 512),
    ("general", "resnet"): ("resnet50", 2048),
    ("biology", "clip"): ("imageomics/bioclip", 512),
    ("biology", "resnet"): ("microsoft/beit-base-patch16-224-pt22k-ft22k", 768),
    ("remote_sensing", "clip"): ("nvidia/mit-b0", 320),
    ("remote_sensing", "resnet"): ("resnet50", 2048),
    ("documents", "clip"): ("microsoft/trocr-base-printed", 768),
    ("documents", "resnet"): ("resnet50", 2048),
}


def domain_model(domain: Column, architecture: Column) -> tuple[Column, Column]:
    """(model name, vector length); an unknown domain means general, an unknown architecture clip."""
    name = F.lower(F.trim(domain))
    name = F.when(name.isin(sorted({d for d, _ in DOMAIN_MODELS})), name).otherwise("general")
    arch = F.when(architecture.isin(sorted({a for _, a in DOMAIN_MODELS})), architecture).otherwise("clip")
    key = F.concat_ws("/", name, arch)
    names = {"/".join(k): v[0] for k, v in DOMAIN_MODELS.items()}
    sizes = {"/".join(k): v[1] for k, v in DOMAIN_MODELS.items()}
    return F.element_at(cat.constant_map(names), key), F.element_at(cat.constant_map(sizes), key)


def recommendation(accuracy: Column) -> Column:
    """What to do with a model of this hold-out accuracy."""
    return F.when(accuracy > 0.90, "deploy").when(accuracy > 0.75, "collect more data").otherwise("re-evaluate")
