"""Queries over tables that hold many datasets: models and memory records of all of them at once."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import grouped
from .registry import query, table
from .result_queries import _elig_sql, _util_sql, _w

R = 6
#: Orders of a priority are a dataset: their status is a classification, their price a regression.
STATUS = grouped.Datasets("ds", "o_orderstatus", ("o_orderkey",), ("o_totalprice", "o_custkey", "o_days"))
PRICE = grouped.Datasets("ds", "o_totalprice", ("o_orderkey",), ("o_custkey", "o_days"))


def orders(spark, d, prefix):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.concat(F.lit(prefix), F.substring("o_orderpriority", 1, 1)).alias("ds"),
        F.datediff("o_orderdate", F.lit("1995-01-01")).alias("o_days"))


def _base_sql(prefix, features, y):
    """First rows of equal features, with labels and folds of three."""
    label, by = (f"(dense_rank() OVER (PARTITION BY ds ORDER BY {y}) - 1)::DOUBLE", "ds, label") if y == "o_orderstatus" else (f"{y}::DOUBLE", "ds")
    return f"""a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, '{prefix}' || substr(o_orderpriority, 1, 1) AS ds, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS o_days FROM orders),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ds, {', '.join(features)} ORDER BY o_orderkey) = 1 AND count(*) OVER (PARTITION BY ds) >= 50),
  l AS (SELECT *, {label} AS label FROM b),
  r AS (SELECT ds, label, ((row_number() OVER (PARTITION BY {by} ORDER BY md5(o_orderkey::VARCHAR)) - 1) % 3)::INT AS fold,
    {', '.join(f"({c} - avg({c}) OVER (PARTITION BY ds)) / stddev_pop({c}) OVER (PARTITION BY ds) AS x{i}" for i, c in enumerate(features))} FROM l)"""


def _bayes_sql():
    """Gaussian naive Bayes by class means and variances outside each fold, and weighted F1 inside it."""
    k = len(STATUS.features)
    stats = ", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) AS v{i}" for i in range(k))
    like = " + ".join(f"ln(2 * pi() * (v{i} + eps)) + (x{i} - m{i}) * (x{i} - m{i}) / (v{i} + eps)" for i in range(k))
    return f"""{_base_sql('status-', STATUS.features, 'o_orderstatus')},
  f AS (SELECT unnest(range(3)) AS f),
  t AS (SELECT ds, f, label, count(*) AS n, {stats} FROM r, f WHERE fold <> f GROUP BY ds, f, label),
  e AS (SELECT ds, f, count(*) AS n_all, 1e-9 * greatest({', '.join(f'var_pop(x{i})' for i in range(k))}) AS eps FROM r, f WHERE fold <> f GROUP BY ds, f),
  s AS (SELECT r.ds, e.f, r.label, t.label AS c, row_number() OVER (PARTITION BY r.ds, e.f, k ORDER BY ln(n::DOUBLE / n_all) - ({like}) / 2 DESC, t.label) AS place
    FROM (SELECT *, row_number() OVER () AS k FROM r) r JOIN e ON r.ds = e.ds AND r.fold = e.f JOIN t ON e.ds = t.ds AND e.f = t.f),
  p AS (SELECT ds, f, label, c FROM s WHERE place = 1),
  u AS (SELECT ds, f, v, sum(is_true) AS support, sum(is_named) AS named, sum(hit) AS hit FROM (
    SELECT ds, f, label AS v, 1 AS is_true, 0 AS is_named, (label = c)::INT AS hit FROM p UNION ALL SELECT ds, f, c, 0, 1, 0 FROM p) GROUP BY ds, f, v),
  w AS (SELECT ds, f, sum(support * 2.0::DOUBLE * hit / (support + named)) / sum(support) AS score FROM u GROUP BY ds, f),
  bayes AS (SELECT ds AS dataset_id, 'classification' AS task, 'naive_bayes' AS model, avg(score) AS score, count(*)::INT AS folds_done FROM w GROUP BY ds),
  bayes_times AS (SELECT bayes.*, n * {k} * 1e-8::DOUBLE AS time_s FROM bayes JOIN (SELECT ds, count(*) AS n FROM b GROUP BY ds) ON ds = dataset_id)"""


def _ridge_sql():
    """Ridge regression on two standardised columns by Cramer's rule."""
    return f"""{_base_sql('price-', PRICE.features, 'o_totalprice')},
  f AS (SELECT unnest(range(3)) AS f),
  t AS (SELECT ds, f, count(*)::DOUBLE AS n, avg(x0) AS m0, avg(x1) AS m1, avg(label) AS my, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1,
    corr(x0, x1) AS c, covar_pop(x0, label) / stddev_pop(x0) AS c0, covar_pop(x1, label) / stddev_pop(x1) AS c1 FROM r, f WHERE fold <> f GROUP BY ds, f),
  q AS (SELECT *, unnest([{{'model': 'ridge', 'd': n + 1.0::DOUBLE}}, {{'model': 'sgd_reg', 'd': n + 1e-4::DOUBLE * n}}]) AS w FROM t),
  g AS (SELECT *, n * (w.d * c0 - n * c * c1) / (w.d * w.d - n * c * n * c) AS b0, n * (w.d * c1 - n * c * c0) / (w.d * w.d - n * c * n * c) AS b1 FROM q),
  w AS (SELECT g.ds, f, w.model AS model, -sqrt(avg(pow(label - my - b0 * (x0 - m0) / s0 - b1 * (x1 - m1) / s1, 2))) AS score FROM r JOIN g ON r.ds = g.ds AND fold = f GROUP BY g.ds, f, w.model),
  ridge AS (SELECT ds AS dataset_id, 'regression' AS task, model, avg(score) AS score, count(*)::INT AS folds_done FROM w GROUP BY ds, model),
  ridge_times AS (SELECT ridge.*, n * 2 * 1e-8::DOUBLE AS time_s FROM ridge JOIN (SELECT ds, count(*) AS n FROM b GROUP BY ds) ON ds = dataset_id)"""


SCORE_COLUMNS = f"dataset_id, task, model, round(score, {R}) AS score, round(time_s, 9) AS time_s, folds_done"


@query("m13_grouped_scores", f"""SELECT * FROM (WITH {_bayes_sql()} SELECT {SCORE_COLUMNS} FROM bayes_times)
UNION ALL SELECT * FROM (WITH {_ridge_sql()} SELECT {SCORE_COLUMNS} FROM ridge_times)""")
def _(spark, d):
    status = grouped.grouped_scores(grouped.model_rows(grouped.cleaned(orders(spark, d, "status-"), STATUS), STATUS), ["naive_bayes"])
    price = grouped.grouped_scores(grouped.model_rows(grouped.cleaned(orders(spark, d, "price-"), PRICE), PRICE), ["ridge", "sgd_reg"])
    both = status.unionByName(price)
    return both.withColumns({"score": F.round("score", R), "time_s": F.round("time_s", 9)})


def _print_sql(s):
    """Ten numbers of each dataset from the rows `b`."""
    cols, y, k = s.features, s.y, len(s.features)
    pairs = list(combinations(cols, 2))
    skews = ", ".join(f"skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS g{i}" for i, c in enumerate(cols))
    spreads = ", ".join(f"greatest(-10, least(10, stddev_samp({c}) / (abs(avg({c})) + 1e-8))) AS c{i}" for i, c in enumerate(cols))
    corrs = ", ".join(f"abs(corr({x}, {z})) AS r{i}" for i, (x, z) in enumerate(pairs))
    plus = lambda p, n, f="{}": "(" + " + ".join(f.format(f"{p}{i}") for i in range(n)) + f") / {n}"
    return f"""pm AS (SELECT ds, count(*) AS n, {skews}, {spreads}, {corrs} FROM b GROUP BY ds),
  pk AS (SELECT ds, {y}, count(*) AS n FROM b GROUP BY ds, {y}),
  pp AS (SELECT ds, n / sum(n) OVER (PARTITION BY ds) AS p FROM pk),
  py AS (SELECT ds, count(*) AS classes, -sum(p * ln(p)) AS h FROM pp GROUP BY ds),
  fp AS (SELECT ds, [CAST(v AS FLOAT) FOR v IN [ln(1 + n) / 10, ln(1 + {k}) / 10, ln(1 + n / {k}) / 10, greatest(-1, least(1, {plus('g', k)} / 5)),
    {plus('g', k, '(abs({})>1)::INT')}, {plus('r', len(pairs))}, tanh({plus('c', k)}), ln(1 + classes) / 5, least(1, h / ln(greatest(classes, 2))), 0]] AS e FROM pm JOIN py USING (ds))"""


def _record_sql(scores, times, s):
    return f"""SELECT * FROM (WITH {scores}, res AS (SELECT *, 1 AS complexity FROM {times}), {_elig_sql('res', 'dataset_id')}, {_util_sql('eb', 'dataset_id', _w(0), _w(1), _w(2))},
  best AS (SELECT * FROM ub QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, model) = 1), {_print_sql(s)}
SELECT dataset_id, 'openml_' || dataset_id AS "key", model, task AS problem_type, round(score, {R}) AS score, round(time_s, 9) AS elapsed_s,
  CAST(i - 1 AS INT) AS dim, round(e[i]::DOUBLE, 5) AS value FROM best JOIN fp ON ds = dataset_id, unnest(range(1, 11)) AS t(i))"""


@query("m13_build_memory", f"""{_record_sql(_bayes_sql(), 'bayes_times', STATUS)} UNION ALL {_record_sql(_ridge_sql(), 'ridge_times', PRICE)}""")
def _(spark, d):
    status = grouped.build_memory(orders(spark, d, "status-"), STATUS, ["naive_bayes"])
    price = grouped.build_memory(orders(spark, d, "price-"), PRICE, ["ridge", "sgd_reg"])
    return status.unionByName(price).select(
        "dataset_id", "key", F.col("models")[0].alias("model"), "problem_type", F.round("score", R).alias("score"), F.round("elapsed_s", 9).alias("elapsed_s"),
        F.posexplode("embedding").alias("dim", "v")).select("*", F.round(F.col("v").cast("double"), 5).alias("value")).drop("v")


@query("m13_memory_trees")
def _(spark, d):
    """Trees beside naive Bayes for all datasets of order statuses; a test holds the trees against greedy ones."""
    rows = grouped.model_rows(grouped.cleaned(orders(spark, d, "status-"), STATUS), STATUS)
    return grouped.grouped_scores(rows, ["naive_bayes", "dt_clf"]).withColumn("score", F.round("score", R))
