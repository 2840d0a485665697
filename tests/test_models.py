"""Model catalogue, folds, search and explanation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import models as m
from sparkprep.operators import route, utility


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400), "c": rng.choice(["x", "y"], 400)})
    pdf["y"] = (pdf.a + 0.1 * rng.normal(size=400) > 0).astype(int)
    pdf["t"] = 3 * pdf.a + 0.1 * rng.normal(size=400)
    return spark.createDataFrame(pdf)


CLF = m.Task("y", ("id",), ("a", "b"), ("c",))
REG = m.Task("t", ("id",), ("a", "b"), ("c",), "regression")


def test_catalogue_rules():
    assert m.get_models("classification") == m.AVAILABLE["classification"]
    assert m.get_models("classification", ["rf", "nope"]) == ["rf"]
    assert m.get_models("regression", ["nope"]) == m.AVAILABLE["regression"]
    with pytest.raises(ValueError):
        m.create_model("et_clf", CLF)


@pytest.mark.parametrize("name", ["logistic", "naive_bayes", "dt_clf", "gb", "svc", "mlp_clf", "bag_clf", "knn_clf"])
def test_classifiers_learn(table, name):
    train, test = table.where("id < 300"), table.where("id >= 300")
    params = {"hidden": [8]} if name == "mlp_clf" else ({"maxIter": 5} if name == "gb" else None)
    assert m.score_model(m.fit_model(train, CLF, name, 2, params), test, CLF) > 0.8


@pytest.mark.parametrize("name", ["ridge", "elastic", "dt_reg", "gb_reg", "knn_reg"])
def test_regressors_learn(table, name):
    train, test = table.where("id < 300"), table.where("id >= 300")
    assert m.score_model(m.fit_model(train, REG, name, 0), test, REG) > -2.0


def test_screen_and_evaluate(table):
    scores, kept = m.screen_models(table, CLF, ["logistic", "naive_bayes", "dt_clf"], 0.5, 2)
    assert scores.count() == 3 and 1 <= kept.count() <= 3
    models, _ = m.full_train(table.where("id < 300"), CLF, ["logistic", "dt_clf"], cv=1)
    rows = {r["model"]: r for r in m.evaluate_models(models, table.where("id >= 300"), CLF).collect()}
    assert set(rows) == {"logistic", "dt_clf"}
    assert all(0.5 < r[c] <= 1 for r in rows.values() for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))


def test_search_starts_with_remembered_settings(table):
    name, params, trials = m.search(table, CLF, ["logistic", "knn_clf"], {"logistic": {"C": 0.37, "x": 1, "penalty": None}}, trials=2, cv=1)
    assert name == "logistic" and trials[0].warm and trials[0].params["C"] == 0.37 and not trials[1].warm
    again = m.draw(m.SEARCH_SPACE["rf"], __import__("random").Random("rf-42"))
    assert again == m.draw(m.SEARCH_SPACE["rf"], __import__("random").Random("rf-42"))


def test_time_budget_stops(table, monkeypatch):
    scores, _ = m.screen_models(table, CLF, ["naive_bayes", "dt_clf"], 1.0, 2, max_seconds=0.0)
    assert scores.count() == 0
    clock = iter(range(0, 10_000, 10))
    monkeypatch.setattr(m.time, "time", lambda: next(clock))
    cut, _ = m.screen_models(table, CLF, ["naive_bayes", "dt_clf"], 1.0, 3, max_seconds=65.0)
    rows = {r["model"]: (r["folds_done"], r["complete"]) for r in cut.collect()}
    assert rows["naive_bayes"] == (2, False)  # the cut is marked


def test_boosters_stop_early_and_equal_estimators_are_fitted_once(table, monkeypatch):
    easy = table.withColumn("t", F.when(F.col("a") > 0, 1.0).otherwise(-1.0))
    assert m.fit_model(easy, REG, "gb_reg", 0).stages[-1].getNumTrees < 30
    fitted = []
    real = m._fit_estimator
    monkeypatch.setattr(m, "_fit_estimator", lambda ready, task, name, *a: fitted.append(name) or real(ready, task, name, *a))
    scores, _ = m.screen_models(table, CLF, ["logistic", "sgd_clf"], 1.0, 1)
    rows = {r["model"]: r["score"] for r in scores.collect()}
    assert fitted == ["logistic"] and rows["logistic"] == rows["sgd_clf"] > 0.8


def test_neighbour_model_keeps_equal_rows_and_gives_probabilities(spark, table, tmp_path):
    rows = [(i, float(i // 10), 0.0, "x", i % 2) for i in range(40)]  # ten equal rows at each point
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y int")
    model = m.fit_model(df, CLF, "knn_clf", 2, {"k": 10})
    out = model.transform(df).collect()
    assert all(list(r["probability"]) == [0.5, 0.5] and r["prediction"] == 0.0 for r in out)
    train, test = table.where("id < 300"), table.where("id >= 300")
    knn = m.fit_model(train, CLF, "knn_clf", 2)
    metrics = m.evaluate_models({"knn_clf": knn}, test, CLF).first()
    assert metrics["roc_auc"] > 0.9
    m.save_model(knn, str(tmp_path / "knn"))
    again = m.load_model(str(tmp_path / "knn"))
    key = lambda x: sorted((r["id"], r["prediction"], tuple(r["probability"])) for r in x.transform(test).collect())
    assert key(knn) == key(again)


def test_layer_search_tries_prior_first(table):
    best, trials = m.layer_search(table, CLF, trials=2, prior={"dl_num_layers": 1, "dl_hidden_dim": 32}, max_iter=3)
    assert trials[0].params == {"dl_num_layers": 1, "dl_hidden_dim": 32} and best in [t.params for t in trials]


def test_importance_and_permutation(table):
    model = m.fit_model(table, CLF, "dt_clf", 2)
    assert m.importances(model, table).first()["feature"] == m.feature_names(model, table)[0]
    rows = m.permutation_importance(model, table, CLF, repeats=2).collect()
    assert rows[0]["column"] == "a" and rows[0]["importance"] > 0.2 and len(rows) == 3


def test_grid_points():
    assert len(m.grid_points(m.GRIDS["rf"], "grid")) == 18 and len(m.grid_points(m.GRIDS["gb"], n_iter=20)) == 20
    assert m.spark_params("logistic", {"C": 0.5}, 1000) == {"regParam": 0.002}
    assert m.spark_params("ridge", {"alpha": 2.0}, 1000) == {"regParam": 0.002} and m.spark_params("lasso", {"alpha": 2.0}, 1000) == {"regParam": 2.0}
    assert m.spark_params("sgd_clf", {"penalty": "l1"}) == {"elasticNetParam": 1.0}
    assert m.spark_params("xgb_clf", {"n_estimators": 50, "max_depth": None}) == {"maxIter": 50}


def test_space_table(spark):
    rows = m.search_space_table(spark).where("model = 'sgd_clf'").orderBy("param").collect()
    assert [(r["param"], r["log"], r["options"]) for r in rows] == [("alpha", True, None), ("penalty", False, ["l2", "l1", "elasticnet"])]


def test_single_candidate_utility(spark):
    df = spark.createDataFrame([("d", "rf", 0.9, 3.0, "classification")], "dataset_id string, model string, score double, time_s double, task string")
    row = utility.multi_objective(df).first()
    assert row["model"] == "rf" and row["utility"] == pytest.approx(0.3 + 0.1)


def test_regression_drop_uses_negative_scores(spark):
    rows = [("d", "ridge", -1.0, 1.0, "regression"), ("d", "rf_reg", -1.04, 0.1, "regression"), ("d", "gb_reg", -2.0, 0.01, "regression")]
    df = spark.createDataFrame(rows, "dataset_id string, model string, score double, time_s double, task string")
    assert sorted(r["model"] for r in utility.eligible(df, ["dataset_id"]).collect()) == ["rf_reg", "ridge"]


def test_routing_ties_and_defaults(spark):
    rows = [("a", ["rf"], 1.0, ["gb"], ["svc"], "classification"), ("b", [], 0.0, [], [], "regression")]
    df = spark.createDataFrame(rows, "id string, memory_models array<string>, memory_score double, suggested_models array<string>, rule_models array<string>, problem_type string")
    got = {}
    for r in route.fuse_rankings(df, "id").orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["model"])
    assert got == {"a": ["rf", "gb", "svc"], "b": ["lgbm_reg", "rf_reg", "ridge"]}
