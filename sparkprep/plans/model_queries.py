"""Queries over Spark ML models. Fits are not expressible in SQL, so most have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators import models as m
from ..session import scratch_path
from .registry import query, table

R = 6
TASK = m.Task(y="label", key=("o_orderkey",), numeric=("o_totalprice", "o_custkey", "o_days"), categorical=("o_orderpriority",))
REG = m.Task(y="o_totalprice", key=("o_orderkey",), numeric=("o_custkey", "o_days"), categorical=("o_orderpriority",), problem_type="regression")


def labelled(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
        F.datediff("o_orderdate", F.lit("1995-01-01")).alias("o_days"))
    return clean.label_index(o, "o_orderstatus", "label")


def halves(spark, d):
    o = labelled(spark, d)
    late = F.col("o_days") >= 1500
    return o.where(~late), o.where(late)


def trial_rows(spark, trials):
    rows = [(t.model, t.number, float(t.score), float(t.utility), t.warm) for t in trials]
    return spark.createDataFrame(rows, "model string, trial int, score double, utility double, warm boolean")


@query("m2_cross_validate")
def _(spark, d):
    scores = m.cross_validate(m.prepare_folds(labelled(spark, d), TASK, 3), TASK, "naive_bayes", 3)
    return spark.createDataFrame([(s.model, s.fold, float(s.score)) for s in scores], "model string, fold int, score double")


@query("m3_screen_models")
def _(spark, d):
    scores, kept = m.screen_models(labelled(spark, d), TASK, ["naive_bayes", "dt_clf", "logistic"], 0.3, 2)
    return scores.join(kept.select("model", F.lit(True).alias("kept")), "model", "left").select("model", "score", "kept")


@query("m4_m5_train_evaluate")
def _(spark, d):
    train, test = halves(spark, d)
    models, _ = m.full_train(train, TASK, ["naive_bayes", "dt_clf"], cv=1)
    return m.evaluate_models(models, test, TASK)


@query("m5_evaluate_regression")
def _(spark, d):
    train, test = halves(spark, d)
    models, _ = m.full_train(train, REG, ["ridge", "dt_reg"], cv=1)
    return m.evaluate_models(models, test, REG)


@query("m1_knn_model", """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS label, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS o_days FROM orders),
  s AS (SELECT avg(o_totalprice) AS pm, stddev_pop(o_totalprice) AS ps, avg(o_custkey) AS cm, stddev_pop(o_custkey) AS cs, avg(o_days) AS dm, stddev_pop(o_days) AS ds FROM o WHERE o_days < 1500),
  z AS (SELECT o_orderkey, label, o_days < 1500 AS train, o_orderpriority AS f, (o_totalprice - pm) / ps AS p, (o_custkey - cm) / cs AS c, (o_days - dm) / ds AS d FROM o, s),
  n AS (SELECT q.o_orderkey, any_value(q.label) AS label, min_by(t.label, (q.p - t.p) * (q.p - t.p) + (q.c - t.c) * (q.c - t.c) + (q.d - t.d) * (q.d - t.d) + CASE WHEN q.f = t.f THEN 0 ELSE 2 END, 5) AS near
    FROM z q JOIN z t ON NOT q.train AND t.train GROUP BY q.o_orderkey),
  v AS (SELECT label, list_transform([0, 1, 2], lambda x: len(list_filter(near, lambda y: y = x))) AS votes FROM n)
SELECT label::DOUBLE AS label, (list_position(votes, list_max(votes)) - 1)::DOUBLE AS prediction, count(*) AS n FROM v GROUP BY ALL""")
def _(spark, d):
    train, test = halves(spark, d)
    model = m.fit_model(train, TASK, "knn_clf", 3)
    return m.prediction_table({"knn_clf": model}, test, TASK).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


NUMERIC = m.Task(y="label", key=("o_orderkey",), numeric=("o_totalprice", "o_custkey", "o_days"))
PRICE = m.Task(y="o_totalprice", key=("o_orderkey",), numeric=("o_custkey", "o_days"), problem_type="regression")
PARTS_SQL = """o AS (SELECT o_orderkey, o_custkey, o_totalprice, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS label, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS o_days FROM orders),
  tr AS (SELECT * FROM o WHERE o_days < 1500), te AS (SELECT * FROM o WHERE o_days >= 1500)"""
_x = ("o_totalprice", "o_custkey", "o_days")
BAYES_SQL = f"""WITH {PARTS_SQL},
  c AS (SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM tr)) AS prior, {', '.join(f'avg({x}) AS m{i}, var_pop({x}) AS v{i}' for i, x in enumerate(_x))} FROM tr GROUP BY label),
  s AS (SELECT o_orderkey, te.label, c.label AS p, prior - ({' + '.join(f'ln(v{i}) + ({x} - m{i}) * ({x} - m{i}) / v{i}' for i, x in enumerate(_x))}) / 2 AS score FROM te, c),
  p AS (SELECT label, p FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, p) = 1),
  u AS (SELECT v, sum(support) AS support, sum(named) AS named, sum(hit) AS hit FROM (SELECT label AS v, 1 AS support, 0 AS named, (label = p)::INT AS hit FROM p UNION ALL SELECT p, 0, 1, 0 FROM p) GROUP BY v)
SELECT 'naive_bayes' AS model, round(sum(hit) / sum(support), 6) AS accuracy, round(sum(support * CASE WHEN named > 0 THEN hit / named ELSE 0 END) / sum(support), 6) AS precision,
  round(sum(support * 2.0::DOUBLE * hit / (support + named)) / sum(support), 6) AS f1 FROM u"""


@query("m4_m5_naive_bayes", BAYES_SQL)
def _(spark, d):
    """Trained on the earlier orders, measured on the later ones; class means and variances in SQL."""
    train, test = halves(spark, d)
    models, _ = m.full_train(train, NUMERIC, ["naive_bayes"], cv=1)
    return m.evaluate_models(models, test, NUMERIC).select("model", *[F.round(c, R).alias(c) for c in ("accuracy", "precision", "f1")])


@query("m4_m5_ridge", f"""WITH {PARTS_SQL},
  t AS (SELECT avg(o_custkey) AS m0, avg(o_days) AS m1, avg(o_totalprice) AS my, var_pop(o_custkey) AS v0, var_pop(o_days) AS v1, covar_pop(o_custkey, o_days) AS c,
    covar_pop(o_custkey, o_totalprice) AS c0, covar_pop(o_days, o_totalprice) AS c1 FROM tr),
  b AS (SELECT *, (v1 * c0 - c * c1) / (v0 * v1 - c * c) AS b0, (v0 * c1 - c * c0) / (v0 * v1 - c * c) AS b1 FROM t),
  e AS (SELECT o_totalprice AS y, o_totalprice - my - b0 * (o_custkey - m0) - b1 * (o_days - m1) AS e FROM te, b)
SELECT 'ridge' AS model, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM e""")
def _(spark, d):
    """Least squares on two columns against Cramer's rule."""
    train, test = halves(spark, d)
    models, _ = m.full_train(train, PRICE, ["ridge"], cv=1)
    return m.evaluate_models(models, test, PRICE).select("model", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", R).alias("r2"))


@query("m6_tune_top_models")
def _(spark, d):
    metrics = spark.createDataFrame([("logistic", 0.5), ("naive_bayes", 0.4), ("dt_clf", 0.1)], "model string, f1 double")
    _, table_ = m.tune_top_models(labelled(spark, d), TASK, metrics, 2, cv=2, grids={"logistic": m.GRIDS["logistic"]})
    return table_


@query("m7_search")
def _(spark, d):
    _, _, trials = m.search(labelled(spark, d), TASK, ["logistic"], {"logistic": {"C": 0.5, "solver": "x"}}, trials=4, cv=2)
    return trial_rows(spark, trials)


@query("m8_layer_search")
def _(spark, d):
    _, trials = m.layer_search(labelled(spark, d), TASK, trials=3, prior={"dl_num_layers": 1, "dl_hidden_dim": 32}, max_iter=10)
    return trial_rows(spark, trials)


@query("m2_early_stopping", "SELECT TRUE AS fewer_trees, TRUE AS all_folds, TRUE AS learned")
def _(spark, d):
    """Boosted trees on all orders, for a target that a few trees learn: they stop far below the 100 allowed."""
    o = labelled(spark, d).withColumn("late", (F.col("o_days") >= 1500).cast("int"))
    task = m.Task(y="late", key=("o_orderkey",), numeric=("o_totalprice", "o_days"))
    scores, _ = m.screen_models(o, task, ["gb", "lgbm_clf"], 1.0, 1)
    trees = m.fit_model(o, task, "gb", 2).stages[-1].getNumTrees
    return scores.agg(F.lit(trees < 60).alias("fewer_trees"), F.bool_and("complete").alias("all_folds"), (F.min("score") > 0.99).alias("learned"))


@query("m9_save_load", """SELECT count(*) AS n, count(*) AS same FROM orders""")
def _(spark, d):
    o = labelled(spark, d)
    model = m.fit_model(o, TASK, "dt_clf", 3)
    path = scratch_path(spark, "model")
    m.save_model(model, path)
    again = m.load_model(path)
    a = model.transform(o).select("o_orderkey", F.col("prediction").alias("a"))
    b = again.transform(o).select("o_orderkey", F.col("prediction").alias("b"))
    return a.join(b, "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("m9_save_load_knn", """SELECT count(*) AS n, count(*) AS same, count(*) AS sound FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' + INTERVAL 1500 DAY""")
def _(spark, d):
    """A stored neighbour model predicts what it did before, with probabilities that add up to one."""
    train, test = halves(spark, d)
    model = m.fit_model(train, TASK, "knn_clf", 3)
    path = scratch_path(spark, "model")
    m.save_model(model, path)
    both = [x.transform(test).select("o_orderkey", F.col("prediction").alias(n), m.vector_to_array("probability").alias(f"p_{n}")) for x, n in ((model, "a"), (m.load_model(path), "b"))]
    total = F.aggregate("p_a", F.lit(0.0), lambda x, y: x + y)
    return both[0].join(both[1], "o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") == F.col("b")) & (F.col("p_a") == F.col("p_b"))).alias("same"),
        F.count_if((F.abs(total - 1) < 1e-9) & (F.array_max("p_a") == F.get("p_a", F.col("a").cast("int")))).alias("sound"))


@query("m10_importance")
def _(spark, d):
    o = labelled(spark, d)
    return m.importances(m.fit_model(o, TASK, "dt_clf", 3), o)


@query("m11_permutation_importance")
def _(spark, d):
    train, test = halves(spark, d)
    return m.permutation_importance(m.fit_model(train, TASK, "dt_clf", 3), test, TASK)


@query("m12_linear_attribution", """WITH s AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, avg(l_extendedprice) AS e FROM lineitem),
  t AS (SELECT 'l_quantity' AS feature, avg(abs(0.5 * (l_quantity - a))) AS v FROM lineitem, s UNION ALL SELECT 'l_discount', avg(abs(-40 * (l_discount - b))) FROM lineitem, s
    UNION ALL SELECT 'l_tax', avg(abs(3 * (l_tax - c))) FROM lineitem, s UNION ALL SELECT 'l_extendedprice', avg(abs(0.001 * (l_extendedprice - e))) FROM lineitem, s)
SELECT feature, round(v, 6) AS attribution FROM t ORDER BY v DESC LIMIT 3""")
def _(spark, d):
    a = m.linear_attribution(table(spark, d, "lineitem"), {"l_quantity": 0.5, "l_discount": -40.0, "l_tax": 3.0, "l_extendedprice": 0.001})
    return a.withColumn("attribution", F.round("attribution", R))
