"""Model names and the fixed facts about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model catalogue per problem type.
CLASSIFIERS = [
    "logistic", "sgd_clf", "knn_clf", "naive_bayes", "dt_clf", "svc", "mlp_clf",
    "rf", "et_clf", "ada_clf", "bag_clf", "gb", "lgbm_clf", "xgb_clf",
]
REGRESSORS = [
    "ridge", "lasso", "elastic", "sgd_reg", "knn_reg", "dt_reg", "svr", "mlp_reg",
    "rf_reg", "et_reg", "ada_reg", "bag_reg", "gb_reg", "lgbm_reg", "xgb_reg",
]
# Complexity, 1 = simplest.
COMPLEXITY = {
    "logistic": 1, "ridge": 1, "lasso": 1, "elastic": 1, "naive_bayes": 1, "sgd_clf": 1, "sgd_reg": 1,
    "knn_clf": 2, "knn_reg": 2, "dt_clf": 2, "dt_reg": 2, "svr": 2, "svc": 2,
    "mlp_clf": 3, "mlp_reg": 3, "rf": 3, "rf_reg": 3, "et_clf": 3, "et_reg": 3,
    "ada_clf": 3, "ada_reg": 3, "bag_clf": 3, "bag_reg": 3,
    "gb": 4, "gb_reg": 4, "lgbm_clf": 4, "lgbm_reg": 4, "xgb_clf": 4, "xgb_reg": 4,
}
DEFAULT_COMPLEXITY = 3
# Family of each model.
FAMILY = {
    "rf": "tree_based", "et_clf": "tree_based", "gb": "tree_based", "lgbm_clf": "tree_based",
    "xgb_clf": "tree_based", "rf_reg": "tree_based", "et_reg": "tree_based", "gb_reg": "tree_based",
    "lgbm_reg": "tree_based", "xgb_reg": "tree_based", "ada_clf": "tree_based", "ada_reg": "tree_based",
    "logistic": "linear", "ridge": "linear", "lasso": "linear", "elastic": "linear",
    "sgd_clf": "linear", "sgd_reg": "linear",
    "knn_clf": "distance", "knn_reg": "distance",
    "mlp_clf": "neural_ml", "mlp_reg": "neural_ml",
    "svc": "kernel", "svr": "kernel",
    "bag_clf": "bagging", "bag_reg": "bagging",
}
# Counterpart of a model in the other problem type.
TO_REGRESSION = {
    "logistic": "ridge", "linear": "ridge", "rf": "rf_reg", "gb": "gb_reg",
    "lgbm_clf": "lgbm_reg", "lightgbm": "lgbm_reg", "xgb_clf": "xgb_reg", "xgboost": "xgb_reg",
    "et_clf": "et_reg", "knn_clf": "knn_reg", "svc": "svr", "dt_clf": "dt_reg",
    "mlp_clf": "mlp_reg", "ada_clf": "ada_reg", "bag_clf": "bag_reg",
}
TO_CLASSIFICATION = {
    "ridge": "logistic", "linear": "logistic", "rf_reg": "rf", "gb_reg": "gb",
    "lgbm_reg": "lgbm_clf", "lightgbm": "lgbm_clf", "xgb_reg": "xgb_clf", "xgboost": "xgb_clf",
    "et_reg": "et_clf", "knn_reg": "knn_clf", "svr": "svc", "dt_reg": "dt_clf",
    "mlp_reg": "mlp_clf", "ada_reg": "ada_clf", "bag_reg": "bag_clf",
}
# Ordered fallback lists.
FALLBACK = {
    "classification": ["logistic", "rf", "gb", "lgbm_clf", "xgb_clf"],
    "regression": ["ridge", "rf_reg", "gb_reg", "lgbm_reg", "xgb_reg"],
}
ROUTING_FALLBACK = {
    "classification": ["lgbm_clf", "rf", "logistic"],
    "regression": ["lgbm_reg", "rf_reg", "ridge"],
}
# Answer of the mixed memory when nothing close is known.
UNIFIED_EMPTY = ["logistic", "rf", "simple_mlp", "xgboost", "gb"]
UNIFIED_COLD = ["ML:logistic", "ML:rf", "ML:xgboost", "DL:MLP_2L", "DL:MLP_4L"]
# Models run per dataset size.
BY_SIZE = {
    "small": {"classification": ["logistic", "rf", "gb", "lightgbm", "xgboost"],
              "regression": ["linear", "rf", "gb", "lightgbm", "xgboost"]},
    "medium": {"classification": ["logistic", "rf", "lightgbm", "xgboost"],
               "regression": ["linear", "rf", "lightgbm", "xgboost"]},
    "large": {"classification": ["logistic", "lightgbm", "xgboost"],
              "regression": ["linear", "lightgbm", "xgboost"]},
}
ALWAYS_IN_REGRESSION = ["xgb_reg", "lgbm_reg", "rf_reg"]
KERNEL_MODELS = ["svc", "svr"]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def constant_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def look_up(values: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(values), key), default)


def complexity_of(model: Column) -> Column:
    return look_up(COMPLEXITY, model, F.lit(DEFAULT_COMPLEXITY))


def family_of(model: Column) -> Column:
    return look_up(FAMILY, model, F.lit("unknown"))


def model_for(model: Column, problem_type: Column) -> Column:
    """Counterpart of a model for the problem type; names already fitting are unchanged."""
    return F.when(problem_type == "regression", look_up(TO_REGRESSION, model, model)).otherwise(
        look_up(TO_CLASSIFICATION, model, model))


def by_problem(lists: dict[str, list[str]], problem_type: Column) -> Column:
    return F.when(problem_type == "classification", strings(lists["classification"])).otherwise(
        strings(lists["regression"]))


def fallback_models(problem_type: Column, count: int = 5) -> Column:
    return F.slice(by_problem(FALLBACK, problem_type), 1, count)
