"""Model screening, training, search and explanation with Spark ML.

The driver only loops over models, folds and trials; every fit, prediction and metric is a Spark job.
Labels are 0-based class indexes (see `clean.label_index`) or numbers.
"""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions.catalog import COMPLEXITY, DEFAULT_COMPLEXITY
from ..session import cut_lineage
from . import evaluate as ev
from . import utility as ut
from .features import fit_preprocessor
from .neighbors import knn_join
from .ordering import hash_rank, row_rank
from .split import cap_rows, folds, holdout, sample_share

FEATURES, LABEL, HELD_OUT = "features", "label", "held_out"
KNN = ("knn_clf", "knn_reg")
BOOSTED = ("gb", "gb_reg", "lgbm_clf", "lgbm_reg", "xgb_clf", "xgb_reg")
#: Names that stand for the same Spark estimator with default settings: fitted once, reported under each name.
SAME_FIT = {"sgd_clf": "logistic", "lgbm_clf": "gb", "xgb_clf": "gb", "lgbm_reg": "gb_reg", "xgb_reg": "gb_reg"}


@dataclass(frozen=True)
class Task:
    """What to learn from a table: target, columns, row key and problem type."""

    y: str
    key: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    problem_type: str = "classification"
    scalers: dict | None = None
    encodings: dict | None = None

    @property
    def is_classification(self) -> bool:
        return self.problem_type == "classification"


# ---- M1 catalogue -------------------------------------------------------------------------------

_COMMON = {"featuresCol": FEATURES, "labelCol": LABEL}


class KnnModel:
    """k nearest training rows by the exact join; majority (smallest on ties) or mean of their labels.

    Training rows are stored with dense numbers, so equal rows stay apart. `probability` has the share of each class
    among the neighbours. `save` and `load` keep preprocessing, rows and settings.
    """

    def __init__(self, train: DataFrame, prep: PipelineModel, task: Task, k: int = 5, classes: int = 2) -> None:
        labelled = _vectors(prep.transform(train)).select("__vec", F.col(task.y).cast("double").alias(LABEL), *task.key)
        numbered = hash_rank(cut_lineage(labelled), [], list(task.key), 42, "__tid").select("__tid", "__vec", LABEL)
        self._set(cut_lineage(numbered), prep, task, k, classes)

    def _set(self, rows: DataFrame, prep: PipelineModel, task: Task, k: int, classes: int) -> KnnModel:
        self.train, self.prep, self.task, self.k, self.classes = rows, prep, task, k, classes
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = _vectors(self.prep.transform(df)).withColumn("__qid", F.struct(*self.task.key).cast("string"))
        near = knn_join(rows, self.train, self.k, query_id="__qid", memory_id="__tid", vec="__vec")
        voted = near.join(self.train.select(F.col("__tid").alias("memory_id"), LABEL), "memory_id")
        if self.task.is_classification:
            votes = voted.groupBy("query_id", LABEL).agg(F.count(F.lit(1)).alias("n"))
            share = F.map_from_entries(F.collect_list(F.struct(F.col(LABEL).cast("int"), F.col("n"))))  # at most k labels
            found = votes.groupBy("query_id").agg(
                F.min_by(LABEL, F.struct(-F.col("n"), F.col(LABEL))).alias("prediction"), F.sum("n").alias("__n"), share.alias("__votes"))
            each = F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), lambda c: F.coalesce(F.try_element_at("__votes", c), F.lit(0)) / F.col("__n"))
            found = found.select("query_id", "prediction", array_to_vector(each).alias("probability"))
        else:
            found = voted.groupBy("query_id").agg(F.avg(LABEL).alias("prediction"))
        return rows.join(found.withColumnRenamed("query_id", "__qid"), "__qid").drop("__qid", "__vec")

    def save(self, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        self.train.write.mode("overwrite").parquet(f"{path}/rows")
        facts = json.dumps({**asdict(self.task), "k": self.k, "classes": self.classes})
        self.train.sparkSession.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/knn")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnnModel:
        facts = json.loads(spark.read.text(f"{path}/knn").first()[0])
        k, classes = facts.pop("k"), facts.pop("classes")
        task = Task(**{n: tuple(v) if isinstance(v, list) else v for n, v in facts.items()})
        return cls.__new__(cls)._set(spark.read.parquet(f"{path}/rows"), PipelineModel.load(f"{path}/prep"), task, k, classes)


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("__vec", vector_to_array(FEATURES))


def _boosted(task: Task, classes: int, **params):
    """Boosted trees. Where one model is fitted (not one per class) a row in ten is held out, and trees are added until its loss
    stops falling, `maxIter` at most; one model per class has no hold-out and fewer trees."""
    if task.is_classification and classes > 2:
        return mlc.OneVsRest(classifier=mlc.GBTClassifier(**_COMMON, **{"maxIter": 20, **params}), **_COMMON)
    kind = mlc.GBTClassifier if task.is_classification else mlr.GBTRegressor
    return kind(**_COMMON, validationIndicatorCol=HELD_OUT, **{"maxIter": 100, **params})


# Parameter names of stored settings and what they are called here.
_RENAMED = {
    "n_estimators": "numTrees", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
    "min_samples_split": "minInstancesPerNode", "alpha": "regParam", "C": "regParam",
    "penalty": "elasticNetParam",
}


def spark_params(name: str, params: dict, n_rows: int = 1) -> dict:
    """Stored settings under Spark ML names; settings without a counterpart are left out.

    Stored penalties of classifiers (C) and of ridge (alpha) weigh against a sum of losses; Spark's weigh against
    the mean, so they are divided by the number of rows.
    """
    out = {}
    for key, value in params.items():
        target = _RENAMED.get(key)
        if target is None or value is None:
            continue
        if key == "C":
            value = 1.0 / (float(value) * max(n_rows, 1))
        if key == "alpha" and name == "ridge":
            value = float(value) / max(n_rows, 1)
        if key == "penalty":
            value = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[value]
        if target == "numTrees" and name in BOOSTED:
            target = "maxIter"
        if target == "minInstancesPerNode":
            value = max(1, int(value) // 2)
        if target == "maxDepth":
            value = int(value)
            if value > 30:
                raise ValueError(f"{key} {value} of {name} is deeper than 30, the most that Spark trees have")
        out[target] = value
    return out


def create_model(name: str, task: Task, classes: int = 2, n_features: int = 0, params: dict | None = None):
    """An unfitted estimator for a catalogue name. `params` are Spark ML parameters."""
    p = dict(params or {})
    if name in ("logistic", "sgd_clf"):
        return mlc.LogisticRegression(**_COMMON, **{"maxIter": 100, **p})
    if name == "naive_bayes":
        return mlc.NaiveBayes(**_COMMON, modelType="gaussian")
    if name == "dt_clf":
        return mlc.DecisionTreeClassifier(**_COMMON, **{"seed": 42, **p})
    if name == "rf":
        return mlc.RandomForestClassifier(**_COMMON, **{"numTrees": 100, "seed": 42, **p})
    if name == "bag_clf":
        return mlc.RandomForestClassifier(**_COMMON, **{"numTrees": 20, "featureSubsetStrategy": "all", "seed": 42, **p})
    if name == "svc":
        svm = mlc.LinearSVC(**_COMMON, **p)
        return svm if classes <= 2 else mlc.OneVsRest(classifier=svm, **_COMMON)
    if name == "mlp_clf":
        layers = p.pop("layers", [n_features, 100, classes])
        return mlc.MultilayerPerceptronClassifier(**_COMMON, layers=layers, **{"seed": 42, **p})
    if name in ("ridge", "lasso", "elastic", "sgd_reg"):
        # Ridge's usual penalty of 1 against a sum of losses is next to nothing against their mean.
        penalty = {"ridge": 0.0, "sgd_reg": 1e-4}.get(name, 1.0)
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic": 0.5, "sgd_reg": 0.0}[name]
        return mlr.LinearRegression(**_COMMON, **{"regParam": penalty, "elasticNetParam": mix, **p})
    if name == "dt_reg":
        return mlr.DecisionTreeRegressor(**_COMMON, **{"seed": 42, **p})
    if name == "rf_reg":
        return mlr.RandomForestRegressor(**_COMMON, **{"numTrees": 100, "seed": 42, **p})
    if name == "bag_reg":
        return mlr.RandomForestRegressor(**_COMMON, **{"numTrees": 20, "featureSubsetStrategy": "all", "seed": 42, **p})
    if name in BOOSTED:
        return _boosted(task, classes, **{"seed": 42, **p})
    raise ValueError(f"Unknown or unavailable model name: {name}")


AVAILABLE = {
    "classification": ["logistic", "sgd_clf", "knn_clf", "naive_bayes", "dt_clf", "svc", "mlp_clf", "rf", "bag_clf", "gb", "lgbm_clf", "xgb_clf"],
    "regression": ["ridge", "lasso", "elastic", "sgd_reg", "knn_reg", "dt_reg", "rf_reg", "bag_reg", "gb_reg", "lgbm_reg", "xgb_reg"],
}


def get_models(problem_type: str, names: Sequence[str] | None = None) -> list[str]:
    """Catalogue names to run; an empty choice, an unknown one or 'all' means every model. No size leaves a model out:
    the support vector machine here is linear and scales like the others."""
    known = dict.fromkeys(AVAILABLE[problem_type])
    asked = known if "all" in (names or ["all"]) else {n: None for n in known if n in set(names)}
    return list(asked or known)


# ---- M2 fits and folds --------------------------------------------------------------------------

def n_classes(df: DataFrame, task: Task) -> int:
    if not task.is_classification:
        return 0
    top = df.agg(F.max(task.y)).first()[0]
    return max(2, int(top) + 1)


def _prepare(df: DataFrame, task: Task) -> PipelineModel:
    return fit_preprocessor(df, task.numeric, task.categorical, task.scalers, task.encodings, FEATURES)


def _labelled(df: DataFrame, task: Task) -> DataFrame:
    return df.withColumn(LABEL, F.col(task.y).cast("double"))


def _fit_estimator(ready: DataFrame, task: Task, name: str, classes: int, params: dict | None):
    """Estimator fitted on ready (features, label) rows. `hidden` gives a perceptron's hidden layers."""
    params = dict(params or {})
    size = len(ready.first()[FEATURES]) if name == "mlp_clf" else 0
    if "hidden" in params:
        params["layers"] = [size, *params.pop("hidden"), classes]
    if name in BOOSTED:
        ready = ready.withColumn(HELD_OUT, F.pmod(F.xxhash64(F.col(FEATURES).cast("string"), LABEL), F.lit(10)) == 0)
        if not ready.where(HELD_OUT).limit(1).count():
            ready = ready.withColumn(HELD_OUT, F.lit(True)).unionByName(ready)  # too few rows to hold one out
    return create_model(name, task, classes, size, params).fit(ready)


def fit_model(df: DataFrame, task: Task, name: str, classes: int, params: dict | None = None):
    """Preprocessing and model fitted on the same rows."""
    prep = _prepare(df, task)
    if name in KNN:
        return KnnModel(df, prep, task, int((params or {}).get("k", 5)), classes)
    ready = prep.transform(_labelled(df, task)).select(FEATURES, LABEL)
    return PipelineModel([*prep.stages, _fit_estimator(ready, task, name, classes, params)])


def _score(out: DataFrame, task: Task) -> float:
    """Support-weighted F1, or minus RMSE."""
    if task.is_classification:
        return MulticlassClassificationEvaluator(labelCol=LABEL, metricName="f1").evaluate(out)
    return -RegressionEvaluator(labelCol=LABEL, metricName="rmse").evaluate(out)


def score_model(model, df: DataFrame, task: Task) -> float:
    return _score(model.transform(_labelled(df, task)).select("prediction", LABEL), task)


@dataclass
class FoldScore:
    model: str
    fold: int
    score: float
    time_s: float


def with_folds(df: DataFrame, task: Task, cv: int, seed: int = 42) -> DataFrame:
    """Add `fold`; with cv <= 1 a single 15 % hold-out is fold 0 and the rest has fold -1."""
    y = task.y if task.is_classification else None
    if cv <= 1:
        made = holdout(df, y, list(task.key), 0.15, seed)
        return made.withColumn("fold", F.when(F.col("split") == "test", 0).otherwise(-1)).drop("split")
    return folds(df, y, list(task.key), cv, seed)


@dataclass
class Fold:
    """Training and validation part of one fold: raw rows, and vectors by the fold's own preprocessing."""

    number: int
    prep: PipelineModel
    raw_train: DataFrame
    raw_test: DataFrame
    train: DataFrame
    test: DataFrame


def prepare_folds(df: DataFrame, task: Task, cv: int, seed: int = 42) -> list[Fold]:
    """Fit the preprocessing of every fold once and store the vectors, for all models to share."""
    folded = cut_lineage(with_folds(df, task, cv, seed))
    out = []
    for number in range(max(cv, 1)):
        train, test = folded.where(F.col("fold") != number), folded.where(F.col("fold") == number)
        prep = _prepare(train, task)
        vectors = lambda part: cut_lineage(prep.transform(_labelled(part, task)).select(FEATURES, LABEL))
        out.append(Fold(number, prep, train, test, vectors(train), vectors(test)))
    return out


def cross_validate(
    parts: Sequence[Fold], task: Task, name: str, classes: int, params: dict | None = None, deadline: float | None = None
) -> list[FoldScore]:
    """One fit per fold; stops between fits when the time is up."""
    out = []
    for part in parts:
        if deadline is not None and time.time() > deadline:
            break
        start = time.time()
        if name in KNN:
            model = KnnModel(part.raw_train, part.prep, task, int((params or {}).get("k", 5)), classes)
            spent, score = time.time() - start, score_model(model, part.raw_test, task)
        else:
            model = _fit_estimator(part.train, task, name, classes, params)
            spent, score = time.time() - start, _score(model.transform(part.test), task)
        out.append(FoldScore(name, part.number, score, spent))
    return out


def _table(df: DataFrame, scores: Sequence[FoldScore]) -> DataFrame:
    rows = [(s.model, s.fold, float(s.score), float(s.time_s)) for s in scores]
    return df.sparkSession.createDataFrame(rows, "model string, fold int, score double, time_s double")


# ---- M3, M4 screening and training --------------------------------------------------------------

def screen_models(
    df: DataFrame, task: Task, names: Sequence[str], share: float = 0.3, cv: int = 5, seed: int = 42,
    max_seconds: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(all scores, promising models): cross-validation of each model on a sample, then the screening rule."""
    sample = df if share >= 1.0 else sample_share(df, task.key[0], share, seed=seed)
    classes = n_classes(sample, task)
    parts = prepare_folds(sample, task, cv, seed)
    deadline = None if max_seconds is None else time.time() + max_seconds
    scores = _cross_validate_all(parts, task, names, classes, deadline)
    means = _means(df, scores, cv)
    return means, ut.screen(means, by=[])


def _cross_validate_all(parts: Sequence[Fold], task: Task, names: Sequence[str], classes: int, deadline: float | None) -> list[FoldScore]:
    """`cross_validate` of all names; names of one estimator share its fits and times."""
    done: dict[str, list[FoldScore]] = {}
    for name in names:
        kind = SAME_FIT.get(name, name)
        if kind not in done:
            done[kind] = cross_validate(parts, task, kind, classes, None, deadline)
    return [replace(s, model=n) for n in names for s in done[SAME_FIT.get(n, n)]]


def _means(df: DataFrame, scores: Sequence[FoldScore], cv: int) -> DataFrame:
    """Means over folds, with the number of folds that were finished and whether these are all."""
    table = _table(df, scores)
    counts = table.groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("folds_done"))
    return ut.fold_means(table, ["model"]).join(counts, "model").withColumn("complete", F.col("folds_done") == max(cv, 1))


def full_train(
    df: DataFrame, task: Task, names: Sequence[str], cv: int = 5, seed: int = 42, max_seconds: float | None = None
) -> tuple[dict[str, object], DataFrame]:
    """Cross-validated scores and, per model, a pipeline fitted on all rows."""
    classes = n_classes(df, task)
    parts = prepare_folds(df, task, cv, seed)
    prep = _prepare(df, task)
    ready = cut_lineage(prep.transform(_labelled(df, task)).select(FEATURES, LABEL))
    deadline = None if max_seconds is None else time.time() + max_seconds
    models, scores = {}, []
    for name in names:
        if deadline is not None and time.time() > deadline:
            break
        kind = SAME_FIT.get(name, name)
        twin = next((n for n in models if SAME_FIT.get(n, n) == kind), None)
        if twin is not None:
            scores += [replace(s, model=name) for s in scores if s.model == twin]
            models[name] = models[twin]
            continue
        found = cross_validate(parts, task, name, classes, None, deadline)
        if found:
            scores += found
            models[name] = KnnModel(df, prep, task, classes=classes) if name in KNN else PipelineModel(
                [*prep.stages, _fit_estimator(ready, task, name, classes, None)])
    return models, _means(df, scores, cv)


# ---- M5 evaluation ------------------------------------------------------------------------------

def prediction_table(models: dict[str, object], test: DataFrame, task: Task) -> DataFrame:
    """Predictions of all models in long form: model, key, label, prediction, probability (or NULL)."""
    out: DataFrame | None = None
    for name, model in models.items():
        made = model.transform(_labelled(test, task))
        probs = vector_to_array("probability") if "probability" in made.columns else F.lit(None).cast("array<double>")
        part = made.select(F.lit(name).alias("model"), *task.key, LABEL, "prediction", probs.alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_models(models: dict[str, object], test: DataFrame, task: Task) -> DataFrame:
    """One metrics row per model on hold-out rows."""
    table = prediction_table(models, test, task)
    if not task.is_classification:
        return ev.regression_metrics(table, LABEL, "prediction", ["model"])
    metrics = ev.classification_metrics(table, LABEL, "prediction", ["model"])
    with_p = table.where(F.col("probability").isNotNull())
    if n_classes(test, task) <= 2:
        auc = ev.roc_auc(with_p, F.col(LABEL), F.col("probability")[1], ["model"]).select("model", F.col("auc").alias("roc_auc"))
    else:
        auc = ev.roc_auc_one_vs_rest(with_p, LABEL, "probability", ["model"]).select("model", F.col("auc_weighted").alias("roc_auc"))
    return metrics.join(auc, "model", "left")


# ---- M6-M8 search -------------------------------------------------------------------------------

# Small grids for the best models.
GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1, 10]},
    "rf": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5]},
    "gb": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
}
# Search ranges per model: parameter -> (kind, low, high) or (choice, options).
_FOREST = {"n_estimators": ("int", 50, 300), "max_depth": ("int", 5, 30), "min_samples_split": ("int", 2, 10)}
_XGB = {"n_estimators": ("int", 50, 300), "max_depth": ("int", 3, 10), "learning_rate": ("log", 0.01, 0.3), "subsample": ("float", 0.6, 1.0)}
_LGBM = {"n_estimators": ("int", 50, 300), "max_depth": ("int", 3, 15), "learning_rate": ("log", 0.01, 0.3), "num_leaves": ("int", 20, 100)}
_SGD = {"alpha": ("log", 1e-5, 1e-1), "penalty": ("choice", ["l2", "l1", "elasticnet"])}
SEARCH_SPACE = {
    "xgb_clf": _XGB, "xgb_reg": _XGB, "rf": _FOREST, "rf_reg": _FOREST, "et_clf": _FOREST, "et_reg": _FOREST,
    "lgbm_clf": _LGBM, "lgbm_reg": _LGBM, "logistic": {"C": ("log", 1e-4, 10.0)},
    "ridge": {"alpha": ("log", 1e-4, 10.0)}, "lasso": {"alpha": ("log", 1e-4, 10.0)}, "elastic": {"alpha": ("log", 1e-4, 10.0)},
    "sgd_clf": _SGD, "sgd_reg": _SGD,
}
# Network shapes that may be tried.
LAYER_COUNTS = (1, 2, 3, 4)
LAYER_WIDTHS = (32, 64, 128, 256)


def grid_points(grid: dict, method: str = "randomized", n_iter: int = 20, seed: int = 42) -> list[dict]:
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if method == "grid" or len(points) <= n_iter:
        return points
    return random.Random(seed).sample(points, n_iter)


def tune_top_models(
    df: DataFrame, task: Task, metrics: DataFrame, top_n: int = 2, method: str = "randomized", n_iter: int = 20,
    cv: int = 5, grids: dict | None = None,
) -> tuple[dict[str, object], DataFrame]:
    """Grid or random search on the best models of a metrics table, refitted with the best settings."""
    order = F.col("f1").desc() if task.is_classification else F.col("rmse").asc()
    names = [r["model"] for r in metrics.orderBy(order, "model").limit(top_n).collect()]
    classes = n_classes(df, task)
    parts = prepare_folds(df, task, cv)
    size = df.count()
    tuned, rows = {}, []
    for name in names:
        best: tuple[float, dict] = (-math.inf, {})
        grid = (grids or GRIDS).get(name, {})
        for point in grid_points(grid, method, n_iter) if grid else []:
            found = cross_validate(parts, task, name, classes, spark_params(name, point, size))
            score = sum(s.score for s in found) / len(found)
            best = max(best, (score, point), key=lambda b: b[0])
        rows.append((name, None if best[0] == -math.inf else best[0], {k: str(v) for k, v in best[1].items()}))
        tuned[name] = fit_model(df, task, name, classes, spark_params(name, best[1], size))
    return tuned, df.sparkSession.createDataFrame(rows, "model string, score double, params map<string,string>")


def search_space_table(spark) -> DataFrame:
    rows = []
    for model, space in SEARCH_SPACE.items():
        for param, (kind, *limits) in space.items():
            low, high = (limits[0], limits[1]) if kind != "choice" else (None, None)
            options = [str(v) for v in limits[0]] if kind == "choice" else None
            rows.append((model, param, None if low is None else float(low), None if high is None else float(high), kind == "log", options))
    return spark.createDataFrame(rows, "model string, param string, low double, high double, log boolean, options array<string>")


def warm_start(space: dict, remembered: dict | None) -> dict:
    """Remembered settings that the search space knows and that have a value."""
    return {k: v for k, v in (remembered or {}).items() if k in space and v is not None}


def draw(space: dict, rng: random.Random) -> dict:
    out = {}
    for param, (kind, *limits) in space.items():
        if kind == "int":
            out[param] = rng.randint(*limits)
        elif kind == "float":
            out[param] = rng.uniform(*limits)
        elif kind == "log":
            out[param] = math.exp(rng.uniform(math.log(limits[0]), math.log(limits[1])))
        else:
            out[param] = rng.choice(limits[0])
    return out


@dataclass
class Trial:
    model: str
    number: int
    params: dict
    score: float
    time_s: float
    utility: float
    warm: bool


def _rated(spark, trials: list[Trial], loads: list[int], utility) -> list[Trial]:
    """Trials with the utility that a column function of (score, time, load) gives them."""
    rows = spark.createDataFrame([(i, float(t.score), float(t.time_s), n) for i, (t, n) in enumerate(zip(trials, loads))], "i int, score double, time_s double, load long")
    found = dict(map(tuple, rows.select("i", utility(F.col("score"), F.col("time_s"), F.col("load"))).collect()))
    return [replace(t, utility=found[i]) for i, t in enumerate(trials)]


def search(
    df: DataFrame, task: Task, names: Sequence[str], remembered: dict[str, dict] | None = None, trials: int = 10,
    cv: int = 3, seed: int = 42, spaces: dict | None = None, max_seconds: float | None = None,
) -> tuple[str | None, dict, list[Trial]]:
    """Random search per model; remembered settings of a similar dataset are tried first."""
    classes = n_classes(df, task)
    parts = prepare_folds(df, task, cv, seed)
    size = df.count()
    deadline = None if max_seconds is None else time.time() + max_seconds
    done: list[Trial] = []
    for name in names:
        space = (spaces or SEARCH_SPACE).get(name)
        if not space or name not in AVAILABLE[task.problem_type]:
            continue
        space = {k: v for k, v in space.items() if k in _RENAMED}  # settings that Spark has
        rng = random.Random(f"{name}-{seed}")
        warm = warm_start(space, (remembered or {}).get(name))
        for i in range(trials):
            if deadline is not None and time.time() > deadline:
                break
            drawn = draw(space, rng)
            params = {**drawn, **warm} if warm and i == 0 else drawn
            found = cross_validate(parts, task, name, classes, spark_params(name, params, size), deadline)
            if not found:
                break
            score, spent = (sum(getattr(s, a) for s in found) / len(found) for a in ("score", "time_s"))
            done.append(Trial(name, i, params, score, spent, math.nan, bool(warm) and i == 0))
    if not done:
        return None, {}, []
    w1, w2, w3 = map(F.lit, ut.WEIGHTS[task.problem_type])
    rate = lambda score, spent, load: ut.trial_utility(score, spent, load, F.lit(task.problem_type), w1, w2, w3)
    done = _rated(df.sparkSession, done, [COMPLEXITY.get(t.model, DEFAULT_COMPLEXITY) for t in done], rate)
    best = max(done, key=lambda t: t.utility)
    return best.model, best.params, done


def layer_search(
    df: DataFrame, task: Task, trials: int = 10, seed: int = 42, prior: dict | None = None, max_iter: int = 30
) -> tuple[dict, list[Trial]]:
    """Random search over hidden layers of a perceptron; utility rewards accuracy, speed and few weights.

    `prior` (dl_num_layers, dl_hidden_dim) from a similar dataset is tried first.
    """
    if not task.is_classification:
        raise ValueError("networks are available for classification only")
    parts = cut_lineage(holdout(df, None, list(task.key), 0.2, seed))
    classes = n_classes(parts, task)
    prep = _prepare(parts.where("split = 'train'"), task)
    ready = cut_lineage(prep.transform(_labelled(parts, task)).select(FEATURES, LABEL, "split"))
    train, test = ready.where("split = 'train'"), ready.where("split = 'test'")
    rng = random.Random(seed)
    shapes = [(rng.choice(LAYER_COUNTS), rng.choice(LAYER_WIDTHS)) for _ in range(trials)]
    if prior and prior.get("dl_num_layers") and prior.get("dl_hidden_dim"):
        shapes = [(int(prior["dl_num_layers"]), int(prior["dl_hidden_dim"])), *shapes[:-1]]
    done, sizes = [], []
    for i, (count, width) in enumerate(shapes):
        start = time.time()
        model = _fit_estimator(train, task, "mlp_clf", classes, {"hidden": [width] * count, "maxIter": max_iter})
        spent = time.time() - start
        score = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy").evaluate(model.transform(test))
        sizes.append(len(model.weights))
        params = {"dl_num_layers": count, "dl_hidden_dim": width}
        done.append(Trial("mlp_clf", i, params, score, spent, math.nan, i == 0 and prior is not None))
    rate = lambda score, spent, load: ut.network_utility(score, spent, load, F.lit(task.problem_type), *ut.WEIGHTS[task.problem_type])
    done = _rated(df.sparkSession, done, sizes, rate)
    return max(done, key=lambda t: t.utility).params, done


# ---- M9 persistence -----------------------------------------------------------------------------

def save_model(model: PipelineModel | KnnModel, path: str) -> None:
    model.save(path) if isinstance(model, KnnModel) else model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | KnnModel:
    spark = SparkSession.getActiveSession()
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/knn")
    if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return KnnModel.load(spark, path)
    return PipelineModel.load(path)


# ---- M10-M12 explanation ------------------------------------------------------------------------

def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the vector positions, from the column's metadata."""
    field = PipelineModel(model.stages[:-1]).transform(df.limit(0)).schema[FEATURES]
    attrs = field.metadata["ml_attr"]["attrs"]
    listed = sorted((a["idx"], a.get("name", str(a["idx"]))) for group in attrs.values() for a in group)
    return [n for _, n in listed]


def importances(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """Built-in importances of a tree model, largest first."""
    values = model.stages[-1].featureImportances
    names = feature_names(model, df)
    rows = [(n, float(values[i])) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature").limit(top)


def permutation_importance(
    model, df: DataFrame, task: Task, cols: Sequence[str] | None = None, repeats: int = 5, rows: int | None = None, seed: int = 42
) -> DataFrame:
    """Mean drop of the score when one column is shuffled among the rows.

    All shuffles are built as one table: each row meets, per repeat, the row at its own shuffled
    position, and takes one column at a time from it. One prediction job and one metric job follow.
    """
    cols = list(cols or [*task.numeric, *task.categorical])
    sample = df if rows is None else cap_rows(df, task.key[0], rows, seed)
    base = cut_lineage(sample.select(*task.key, *[F.col(c) for c in cols], F.col(task.y).cast("double").alias(LABEL),
                                     *[c for c in [*task.numeric, *task.categorical] if c not in cols]))
    every = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key_hash = lambda salt: F.xxhash64(*[F.col(k) for k in task.key], F.lit(seed), F.lit(salt), F.col("repeat"))
    place = row_rank(every.withColumn("__h", key_hash("place")), ["repeat"], ["__h", *task.key], "__pos", hashed=True)
    donor = row_rank(every.withColumn("__h", key_hash("donor")), ["repeat"], ["__h", *task.key], "__pos", hashed=True)
    donor = donor.select("repeat", "__pos", F.struct(*cols).alias("__donor"))
    met = place.join(donor, ["repeat", "__pos"]).withColumn("column", F.explode(F.array(*[F.lit(c) for c in cols])))
    shuffled = met.withColumns({c: F.when(F.col("column") == c, F.col(f"__donor.{c}")).otherwise(F.col(c)) for c in cols})
    keep = [*task.key, *task.numeric, *task.categorical, LABEL, "column", "repeat"]
    plain = base.withColumns({"column": F.lit("__none"), "repeat": F.lit(0)}).select(*keep)
    made = model.transform(shuffled.select(*keep).unionByName(plain)).select("column", "repeat", LABEL, "prediction")
    by = ["column", "repeat"]
    if task.is_classification:
        scores = ev.classification_metrics(made, LABEL, "prediction", by).select(*by, F.col("accuracy").alias("s"))
    else:
        scores = ev.regression_metrics(made, LABEL, "prediction", by).select(*by, F.col("r2").alias("s"))
    scores = cut_lineage(scores)
    reference = scores.where("column = '__none'").select("s").scalar()
    return scores.where("column <> '__none'").groupBy("column").agg(
        F.avg(reference - F.col("s")).alias("importance"), F.stddev_pop("s").alias("sd")).orderBy(F.col("importance").desc(), "column")


def linear_attribution(df: DataFrame, coefficients: dict[str, float], top: int = 3) -> DataFrame:
    """Mean |coefficient * (x - mean)| per feature of a linear model, largest first."""
    cols = list(coefficients)
    means = df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
    parts = df.withColumn("__m", means).agg(*[
        F.avg(F.abs(F.lit(float(coefficients[c])) * (F.col(c) - F.col(f"__m.m{i}")))).alias(f"a{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("attribution")) for i, c in enumerate(cols)])
    return parts.select(F.inline(entries)).orderBy(F.col("attribution").desc(), "feature").limit(top)
