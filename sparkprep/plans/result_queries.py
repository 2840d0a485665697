"""Queries over prediction tables, result tables and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..operators import evaluate as ev
from ..operators import route
from ..operators import utility as ut
from .registry import query, table

R = 6


def rounded(df, *names, digits=R):
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---- prediction tables --------------------------------------------------------------------------

PRED_SQL = """pred AS (SELECT event_id, event_type AS model, CAST(user_id % 3 AS INT) AS y, CAST(CASE WHEN event_id % 4 = 0 THEN (event_id * 7) % 3 ELSE user_id % 3 END AS INT) AS p,
  CASE WHEN value > 50 THEN 1 ELSE 0 END AS yb, round(((event_id * 37) % 997) / 1994.0::DOUBLE + least(value / 400, 0.5), 3) AS score,
  value AS t, value * 0.9 + ((event_id * 13) % 11) AS th,
  [(event_id % 7 + 1) / ((event_id % 7 + 1) + (event_id % 5 + 1) + (user_id % 4 + 1)), (event_id % 5 + 1) / ((event_id % 7 + 1) + (event_id % 5 + 1) + (user_id % 4 + 1)),
   (user_id % 4 + 1) / ((event_id % 7 + 1) + (event_id % 5 + 1) + (user_id % 4 + 1))] AS probs FROM events)"""


def predictions(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    a, b, c = e % 7 + 1, e % 5 + 1, u % 4 + 1
    return table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("model"), (u % 3).cast("int").alias("y"),
        F.when(e % 4 == 0, (e * 7) % 3).otherwise(u % 3).cast("int").alias("p"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("yb"),
        F.round(((e * 37) % 997) / 1994.0 + F.least(F.col("value") / 400, F.lit(0.5)), 3).alias("score"),
        F.col("value").alias("t"), (F.col("value") * 0.9 + (e * 13) % 11).alias("th"),
        F.array(a / (a + b + c), b / (a + b + c), c / (a + b + c)).alias("probs"))


REPORT_SQL = f"""{PRED_SQL}, c AS (SELECT model, y, p, count(*) AS n FROM pred GROUP BY ALL),
  cls AS (SELECT model, y AS k FROM c UNION SELECT model, p FROM c),
  r AS (SELECT cls.model, k, coalesce(sum(n) FILTER (y = k), 0) AS support, coalesce(sum(n) FILTER (p = k), 0) AS named, coalesce(sum(n) FILTER (y = k AND p = k), 0) AS hit
    FROM cls JOIN c ON cls.model = c.model GROUP BY ALL),
  q AS (SELECT *, CASE WHEN named = 0 THEN 0 ELSE hit / named END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS rc FROM r),
  rep AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM q)"""


@query("e1_classification_metrics", f"""WITH {REPORT_SQL} SELECT model, round(sum(hit) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
  round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM rep GROUP BY model""")
def _(spark, d):
    return rounded(ev.classification_metrics(predictions(spark, d), "y", "p", ["model"]), "accuracy", "precision", "recall", "f1")


AUC_SQL = """s AS (SELECT {by}, {score} AS sc, sum({pos})::DOUBLE AS p, (count(*) - sum({pos}))::DOUBLE AS n FROM {src} GROUP BY {by}, {score}),
  w AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY {by} ORDER BY sc DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s),
  a AS (SELECT {by}, sum(n * (above + p / 2)) / (sum(p) * sum(n)) AS auc, sum(p) AS pos FROM w GROUP BY {by})"""


@query("e2_roc_auc", f"""WITH {PRED_SQL}, {AUC_SQL.format(by='model', score='score', pos='yb', src='pred')} SELECT model, round(auc, 6) AS auc FROM a""")
def _(spark, d):
    return ev.roc_auc(predictions(spark, d), F.col("yb"), F.col("score"), ["model"]).select("model", F.round("auc", R).alias("auc"))


@query("e3_roc_auc_one_vs_rest", f"""WITH {PRED_SQL}, l AS (SELECT model, i - 1 AS k, round(probs[i], 9) AS pr, (y = i - 1)::INT AS hit FROM pred, unnest(range(1, 4)) AS t(i)),
  {AUC_SQL.format(by='model, k', score='pr', pos='hit', src='l')} SELECT model, round(avg(auc), 6) AS auc_macro, round(sum(auc * pos) / sum(pos), 6) AS auc_weighted FROM a GROUP BY model""")
def _(spark, d):
    p = predictions(spark, d).withColumn("probs", F.transform("probs", lambda x: F.round(x, 9)))
    return rounded(ev.roc_auc_one_vs_rest(p, "y", "probs", ["model"]), "auc_macro", "auc_weighted")


@query("e4_regression_metrics", f"""WITH {PRED_SQL} SELECT model, round(sqrt(avg((t - th) ** 2)), 6) AS rmse, round(avg(abs(t - th)), 6) AS mae, round(avg((t - th) ** 2), 6) AS mse,
  round(1 - avg((t - th) ** 2) / var_pop(t), 6) AS r2 FROM pred GROUP BY model""")
def _(spark, d):
    return rounded(ev.regression_metrics(predictions(spark, d), "t", "th", ["model"]), "rmse", "mae", "mse", "r2")


@query("e5_log_loss", f"""WITH {PRED_SQL} SELECT model, round(avg(-ln(greatest(1e-15, least(1 - 1e-15, probs[y + 1])))), 6) AS log_loss FROM pred GROUP BY model""")
def _(spark, d):
    return rounded(ev.log_loss(predictions(spark, d), "y", "probs", ["model"]), "log_loss")


@query("e6_confusion_matrix", f"""WITH {PRED_SQL}, f AS (SELECT model, y, CASE WHEN p = 2 AND y = 0 THEN 3 ELSE p END AS p FROM pred), l AS (SELECT DISTINCT y AS k FROM f UNION SELECT p FROM f), m AS (SELECT DISTINCT model FROM f)
SELECT m.model, a.k AS label, b.k AS predicted, count(f.y) AS n FROM m, l a, l b LEFT JOIN f ON f.model = m.model AND f.y = a.k AND f.p = b.k GROUP BY ALL""")
def _(spark, d):
    p = predictions(spark, d).withColumn("p", F.when((F.col("p") == 2) & (F.col("y") == 0), 3).otherwise(F.col("p")))
    return ev.confusion_matrix(p, "y", "p", ["model"])


@query("e7_class_report", f"""WITH {REPORT_SQL} SELECT model, k AS class, CAST(support AS BIGINT) AS support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM rep""")
def _(spark, d):
    return rounded(ev.class_report(predictions(spark, d), "y", "p", ["model"]).drop("named", "hit"), "precision", "recall", "f1")


@query("e7_report_averages", f"""WITH {REPORT_SQL} SELECT model, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM rep GROUP BY model""")
def _(spark, d):
    a = ev.report_averages(ev.class_report(predictions(spark, d), "y", "p", ["model"]), ["model"])
    return rounded(a.select("model", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "support"), "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


CONF_SQL = """cf AS (SELECT event_id, event_type AS model, round(greatest(0, least(1, 0.6::DOUBLE * ((event_id % 101) / 100.0::DOUBLE) + 0.2::DOUBLE * ((user_id % 11) / 10.0::DOUBLE) + 0.2::DOUBLE * (user_id % 2))), 9) AS conf, value FROM events),
  u AS (SELECT *, (value - (SELECT min(value) FROM cf)) / ((SELECT max(value) FROM cf) - (SELECT min(value) FROM cf)) AS nu FROM cf),
  b AS (SELECT *, CAST(least(floor(conf * 5), 4) AS INT) AS bin FROM u)"""


def confidences(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    conf = ev.confidence((e % 101) / 100.0, (u % 11) / 10.0, (u % 2).cast("double"))
    made = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), conf.alias("conf"), "value")
    return ev.normal_utility(made, "value", "nu")


@query("e10_confidence", f"""WITH {CONF_SQL} SELECT event_id, round(conf::DOUBLE, 6) AS conf, round(nu, 6) AS nu FROM b""")
def _(spark, d):
    return rounded(confidences(spark, d).select("event_id", "conf", "nu"), "conf", "nu")


@query("e8_calibration_bins", f"""WITH {CONF_SQL} SELECT bin, round(avg(conf::DOUBLE), 6) AS mean_conf, round(avg(nu), 6) AS mean_actual, count(*) AS n FROM b GROUP BY bin""")
def _(spark, d):
    c = confidences(spark, d).withColumn("conf", F.round("conf", 9))
    return rounded(ev.calibration_bins(c, "conf", "nu"), "mean_conf", "mean_actual")


@query("e8_calibration_error", f"""WITH {CONF_SQL}, g AS (SELECT model, bin, abs(avg(nu) - avg(conf::DOUBLE)) * count(*) AS g, count(*) AS n FROM b GROUP BY ALL)
SELECT model, round(sum(g) / sum(n), 6) AS ece FROM g GROUP BY model""")
def _(spark, d):
    c = confidences(spark, d).withColumn("conf", F.round("conf", 9))
    return rounded(ev.expected_calibration_error(c, "conf", "nu", by=["model"]), "ece")


@query("e9_probability_calibration", f"""WITH {PRED_SQL}, b AS (SELECT model, CAST(ceil(score * 10) - 1 AS INT) AS bin, score, yb FROM pred WHERE score > 0),
  g AS (SELECT model, bin, abs(avg(yb) - avg(score)) * count(*) AS g FROM b GROUP BY ALL), n AS (SELECT model, count(*) AS n FROM pred GROUP BY model)
SELECT model, round(sum(g) / max(n), 6) AS ece FROM g JOIN n USING (model) GROUP BY model""")
def _(spark, d):
    return rounded(ev.probability_calibration_error(predictions(spark, d), "yb", "score", by=["model"]), "ece")


# ---- result tables ------------------------------------------------------------------------------

NAMES = ["logistic", "knn_clf", "rf", "gb", "svc", "mlp_clf", "dt_clf"]
_N = "[" + ",".join(f"'{n}'" for n in NAMES) + "]"

RES_SQL = f"""res AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS dataset_id, ({_N})[l_linenumber] AS model, CASE WHEN l_suppkey % 10 < 5 THEN 'classification' ELSE 'regression' END AS task,
    CASE WHEN l_suppkey % 10 < 5 THEN round(avg(l_discount), 9) * 10 ELSE -round(avg(l_tax), 9) END AS score, round(avg(l_quantity), 9) AS time_s,
    CAST(1 + l_linenumber % 4 AS INT) AS complexity FROM lineitem GROUP BY l_suppkey % 10, l_linenumber)"""


def results(spark, d):
    ds = F.col("l_suppkey") % 10
    agg = table(spark, d, "lineitem").groupBy(ds.alias("dataset_id"), "l_linenumber").agg(
        F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("q"))
    clf = F.col("dataset_id") < 5
    return agg.select(
        "dataset_id", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("l_linenumber")).alias("model"),
        F.when(clf, "classification").otherwise("regression").alias("task"),
        F.when(clf, F.round("a", 9) * 10).otherwise(-F.round("b", 9)).alias("score"), F.round("q", 9).alias("time_s"),
        (1 + F.col("l_linenumber") % 4).cast("int").alias("complexity"))


def _util_sql(src, keys, w1, w2, w3):
    win = f"OVER (PARTITION BY {keys})"
    return f"""ua AS (SELECT *, (score - min(score) {win}) / (max(score) {win} - min(score) {win} + 1e-9) AS ns,
    least(0.5, 1 - (time_s - min(time_s) {win}) / (max(time_s) {win} - min(time_s) {win} + 1e-9)) AS sp,
    1 - (complexity - min(complexity) {win}) / (max(complexity) {win} - min(complexity) {win} + 1e-9) AS si FROM {src}),
  ub AS (SELECT *, {w1} * ns + {w2} * (CASE WHEN max(sp) {win} > 0 THEN sp / max(sp) {win} ELSE sp END) + {w3} * si AS utility FROM ua)"""


@query("e11_utility", f"""WITH {RES_SQL}, {_util_sql('res', 'dataset_id', '0.6', '0.3', '0.1')} SELECT dataset_id, model, round(utility::DOUBLE, 6) AS utility FROM ub""")
def _(spark, d):
    u = ut.utility(results(spark, d), F.lit(0.6), F.lit(0.3), F.lit(0.1))
    return rounded(u.select("dataset_id", "model", "utility"), "utility")


def _elig_sql(src, keys):
    win = f"OVER (PARTITION BY {keys})"
    return f"""ea AS (SELECT *, score >= CASE WHEN task = 'regression' THEN max(score) {win} * 1.05 ELSE max(score) {win} * 0.95 END AS ok FROM {src}),
  eb AS (SELECT * FROM (SELECT *, bool_or(ok) {win} AS anyok FROM ea) WHERE ok OR NOT anyok)"""


def _w(i):
    return f"(CASE WHEN task = 'classification' THEN {ut.WEIGHTS['classification'][i]} ELSE {ut.WEIGHTS['regression'][i]} END)"


@query("e12_multi_objective", f"""WITH {RES_SQL}, {_elig_sql('res', 'dataset_id')}, {_util_sql('eb', 'dataset_id', _w(0), _w(1), _w(2))}
SELECT dataset_id, model, round(score, 6) AS score, round(utility::DOUBLE, 6) AS utility FROM ub QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, model) = 1""")
def _(spark, d):
    return rounded(ut.multi_objective(results(spark, d)).drop("time_s"), "score", "utility")


def _grid_sql(task):
    return "[" + ",".join(f"[{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE]" for a, b, c in ut.WEIGHT_GRID[task]) + "]"


@query("e15_weight_search", f"""WITH {RES_SQL}, cx AS (SELECT *, unnest(CASE WHEN task = 'classification' THEN {_grid_sql('classification')} ELSE {_grid_sql('regression')} END) AS w FROM res),
  cw AS (SELECT * EXCLUDE (w), w[1] AS w1, w[2] AS w2, w[3] AS w3 FROM cx), {_elig_sql('cw', 'dataset_id, w1, w2, w3')}, {_util_sql('eb', 'dataset_id, w1, w2, w3', 'w1', 'w2', 'w3')}
SELECT dataset_id, w1, w2, w3, model, round(utility, 6) AS utility FROM ub QUALIFY row_number() OVER (PARTITION BY dataset_id, w1, w2, w3 ORDER BY utility DESC, model) = 1""")
def _(spark, d):
    return rounded(ut.weight_search(results(spark, d)).drop("time_s", "score"), "utility")


TRIAL_SQL = "least(l_quantity / 10, 1.0)"


@query("e13_trial_utility", f"""WITH {RES_SQL} SELECT dataset_id, model, round(CASE WHEN task = 'classification' THEN 0.6::DOUBLE * score - 0.3::DOUBLE * least(time_s / 10, 1.0) - 0.1::DOUBLE * (complexity - 1) / 3.0
  WHEN score < 0 THEN score * (1 + 0.3::DOUBLE * least(time_s / 10, 1.0) + 0.1::DOUBLE * (complexity - 1) / 3.0) ELSE score / (1 + 0.3::DOUBLE * least(time_s / 10, 1.0) + 0.1::DOUBLE * (complexity - 1) / 3.0) END, 6) AS utility FROM res""")
def _(spark, d):
    u = ut.trial_utility(F.col("score"), F.col("time_s"), F.col("complexity"), F.col("task"), F.lit(0.6), F.lit(0.3), F.lit(0.1))
    return results(spark, d).select("dataset_id", "model", F.round(u, R).alias("utility"))


@query("e14_network_utility", f"""WITH {RES_SQL} SELECT dataset_id, model, round(0.6::DOUBLE * CASE WHEN task = 'classification' THEN greatest(0, least(1, score)) ELSE 1 / (1 + abs(score)) END
  + 0.3::DOUBLE / (1 + time_s) + 0.1::DOUBLE / (1 + complexity * 5000 / 10000.0), 6) AS utility FROM res""")
def _(spark, d):
    u = ut.network_utility(F.col("score"), F.col("time_s"), F.col("complexity") * 5000, F.col("task"))
    return results(spark, d).select("dataset_id", "model", F.round(u, R).alias("utility"))


@query("e16_e17_search_metrics", f"""WITH {RES_SQL} SELECT dataset_id, model, round(14.0::DOUBLE / greatest(1, complexity), 6) AS compression, round(abs(score) / greatest(0.01, abs(score) * 0.8), 6) AS retention,
  round(14.0::DOUBLE / greatest(1, complexity) * (abs(score) / greatest(0.01, abs(score) * 0.8)), 6) AS transfer_utility, round(14.0::DOUBLE / complexity, 6) AS search_compression,
  round(1 - abs(score - score * 0.9) / abs(score), 6) AS score_kept, round((1 - abs(score - score * 0.9) / abs(score)) * (complexity / 14.0::DOUBLE), 6) AS kept_per_model,
  round(score - score * 0.9, 6) AS score_gap, 14 - complexity AS models_saved FROM res""")
def _(spark, d):
    r, size = results(spark, d), F.abs("score")
    a = ut.search_metrics(F.col("complexity"), size, size * 0.8)
    b = ut.transfer_metrics(F.lit(14.0), F.col("complexity"), F.col("score"), F.col("score") * 0.9)
    g = ut.gap_and_saved(F.col("score"), F.col("score") * 0.9, F.lit(14), F.col("complexity"))
    return r.select(
        "dataset_id", "model", *[F.round(c, R).alias(n) for n, c in a.items()], F.round(b["compression"], R).alias("search_compression"),
        F.round(b["retention"], R).alias("score_kept"), F.round(b["transfer_utility"], R).alias("kept_per_model"),
        F.round(g["score_gap"], R).alias("score_gap"), g["models_saved"].alias("models_saved"))


@query("e18_best_by_metric", f"""WITH {PRED_SQL}, m AS (SELECT model, sqrt(avg((t - th) ** 2)) AS rmse FROM pred GROUP BY model) SELECT model FROM m ORDER BY rmse, model LIMIT 1""")
def _(spark, d):
    return ut.best_by_metric(ev.regression_metrics(predictions(spark, d), "t", "th", ["model"]), "regression")


@query("e19_screen", f"""WITH {RES_SQL}, w AS (SELECT *, max(score) OVER (PARTITION BY dataset_id) AS hi, min(score) OVER (PARTITION BY dataset_id) AS lo FROM res)
SELECT dataset_id, model FROM w WHERE score >= hi - 0.7::DOUBLE * (hi - lo)""")
def _(spark, d):
    return ut.screen(results(spark, d)).select("dataset_id", "model")


@query("e20_fold_means", """SELECT l_suppkey % 10 AS dataset_id, CAST(l_linenumber AS VARCHAR) AS model, round(avg(s), 6) AS score, round(avg(t), 6) AS time_s FROM
  (SELECT l_suppkey, l_linenumber, l_orderkey % 5 AS fold, avg(l_discount) AS s, avg(l_quantity) AS t FROM (SELECT l_suppkey % 10 AS l_suppkey, l_linenumber, l_orderkey, l_discount, l_quantity FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, d):
    folds = table(spark, d, "lineitem").groupBy(
        (F.col("l_suppkey") % 10).alias("dataset_id"), F.col("l_linenumber").cast("string").alias("model"), (F.col("l_orderkey") % 5).alias("fold")
    ).agg(F.avg("l_discount").alias("score"), F.avg("l_quantity").alias("time_s"))
    return rounded(ut.fold_means(folds), "score", "time_s")


@query("t2_arg_best", f"""WITH {RES_SQL} SELECT dataset_id, arg_max(model, score) AS best, arg_min(model, time_s) AS fastest FROM res GROUP BY dataset_id""")
def _(spark, d):
    return results(spark, d).groupBy("dataset_id").agg(
        F.min_by("model", F.struct(-F.col("score"), F.col("model"))).alias("best"), F.min_by("model", F.struct("time_s", "model")).alias("fastest"))


@query("t4_top_models", f"""WITH {RES_SQL} SELECT dataset_id, model, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, model) AS INT) AS position FROM res
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, model) <= 3""")
def _(spark, d):
    return ut.top_models(results(spark, d), 3).select("dataset_id", "model", "position")


# ---- routing ------------------------------------------------------------------------------------

META_SQL = """meta AS (SELECT p_partkey AS did, CAST(p_size * (p_partkey % 40) * 10 AS BIGINT) AS n_samples, CAST(p_partkey % 150 AS BIGINT) AS n_features, (p_partkey % 11) / 10.0::DOUBLE AS cat_ratio,
  1 - (p_partkey % 11) / 10.0::DOUBLE AS num_ratio, (p_partkey % 7) / 20.0::DOUBLE AS missing_rate, (p_partkey % 9) / 2.0::DOUBLE - 2 AS skewness_mean, (p_partkey % 13) / 13.0::DOUBLE AS mean_corr,
  CAST(p_partkey % 15 + 1 AS BIGINT) AS n_classes, p_partkey % 15 + 1 = 2 AS is_binary, CASE WHEN p_partkey % 3 = 0 THEN 'regression' ELSE 'classification' END AS problem_type, p_size, p_brand, p_name FROM part)"""


def meta(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("did"), (F.col("p_size") * (k % 40) * 10).alias("n_samples"), (k % 150).alias("n_features"), ((k % 11) / 10.0).alias("cat_ratio"),
        (1 - (k % 11) / 10.0).alias("num_ratio"), ((k % 7) / 20.0).alias("missing_rate"), ((k % 9) / 2.0 - 2).alias("skewness_mean"),
        ((k % 13) / 13.0).alias("mean_corr"), (k % 15 + 1).alias("n_classes"), (k % 15 + 1 == 2).alias("is_binary"),
        F.when(k % 3 == 0, "regression").otherwise("classification").alias("problem_type"), "p_size", "p_brand", "p_name")


def _sql_list(*models):
    return "[" + ",".join(f"'{m}'" for m in models) + "]"


def _fired(rules):
    return " || ".join(f"(CASE WHEN {cond} THEN {_sql_list(*models)} ELSE [] END)" for cond, models in rules)


RULES_CLF = _fired([
    ("n_samples > 5000", ["lgbm_clf", "xgb_clf", "rf"]), ("cat_ratio > 0.6", ["lgbm_clf", "xgb_clf", "gb"]),
    ("n_features > 100 AND num_ratio > 0.8", ["logistic", "sgd_clf", "svc"]), ("is_binary AND n_features < 20", ["logistic", "svc", "lgbm_clf"]),
    ("abs(skewness_mean) > 1.5", ["rf", "et_clf", "lgbm_clf"]), ("mean_corr > 0.7", ["logistic", "sgd_clf"]), ("missing_rate > 0.2", ["lgbm_clf", "xgb_clf"]),
    ("n_samples < 200", ["naive_bayes", "knn_clf", "dt_clf"]), ("n_classes > 10", ["lgbm_clf", "rf", "xgb_clf"])])
RULES_REG = _fired([
    ("n_samples > 5000", ["lgbm_reg", "xgb_reg", "rf_reg"]), ("n_features > 100", ["ridge", "lasso", "elastic"]),
    ("abs(skewness_mean) > 1.5", ["rf_reg", "et_reg", "lgbm_reg"]), ("num_ratio > 0.9 AND n_features < 15", ["knn_reg", "svr", "mlp_reg"]),
    ("n_samples < 200", ["ridge", "knn_reg", "svr"]), ("mean_corr > 0.7", ["ridge", "lasso", "elastic"]), ("missing_rate > 0.2", ["lgbm_reg", "xgb_reg"])])

RULES_SQL = f"""{META_SQL}, l0 AS (SELECT *, CASE WHEN problem_type = 'classification' THEN {RULES_CLF} ELSE {RULES_REG} END AS l FROM meta),
  l1 AS (SELECT * EXCLUDE (l), CASE WHEN len(l) > 0 THEN l WHEN problem_type = 'classification' THEN ['lgbm_clf', 'rf', 'logistic'] ELSE ['lgbm_reg', 'rf_reg', 'ridge'] END AS l FROM l0),
  l2 AS (SELECT did, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM l1), l3 AS (SELECT did, m, min(i) AS i FROM l2 GROUP BY did, m),
  rules AS (SELECT did, list_slice(list(m ORDER BY i), 1, 5) AS r FROM l3 GROUP BY did)"""


@query("r1_rule_candidates", f"""WITH {RULES_SQL} SELECT did, array_to_string(r, ',') AS models FROM rules""")
def _(spark, d):
    return meta(spark, d).select("did", F.array_join(route.rule_candidates(F.col("problem_type")), ",").alias("models"))


FUSE_SQL = f"""{RULES_SQL}, sig AS (SELECT rules.did, problem_type, CASE WHEN rules.did % 4 = 0 THEN [] ELSE [({_N})[CAST(p_size % 7 AS INT) + 1], ({_N})[CAST((p_size + 3) % 7 AS INT) + 1], ({_N})[CAST((p_size + 5) % 7 AS INT) + 1]] END AS a,
    (rules.did % 101) / 100.0::DOUBLE AS ms, CASE WHEN rules.did % 5 = 0 THEN [] ELSE [({_N})[CAST(rules.did % 7 AS INT) + 1], ({_N})[CAST((rules.did + 2) % 7 AS INT) + 1]] END AS b,
    CASE WHEN rules.did % 20 = 0 THEN [] ELSE r END AS r FROM rules JOIN meta ON rules.did = meta.did),
  sc AS (SELECT did, m, 0.6::DOUBLE * ms * (1 - (i - 1) * 0.1::DOUBLE) AS v FROM (SELECT did, ms, unnest(a) AS m, generate_subscripts(a, 1) AS i FROM sig)
    UNION ALL SELECT did, m, 0.2::DOUBLE * (1 - (i - 1) * 0.2::DOUBLE) FROM (SELECT did, unnest(b) AS m, generate_subscripts(b, 1) AS i FROM sig)
    UNION ALL SELECT did, m, 0.2::DOUBLE * (1 - (i - 1) * 0.2::DOUBLE) FROM (SELECT did, unnest(r) AS m, generate_subscripts(r, 1) AS i FROM sig)),
  su AS (SELECT did, m, round(sum(v), 12) AS v FROM sc GROUP BY did, m),
  fused AS (SELECT did, m, v, CAST(row_number() OVER (PARTITION BY did ORDER BY v DESC, m) AS INT) AS position FROM su)"""


def signals(spark, d):
    m, k, s = meta(spark, d), F.col("did"), F.col("p_size")
    names = F.array(*[F.lit(n) for n in NAMES])
    at = lambda x: F.element_at(names, (x % 7 + 1).cast("int"))
    none = cat.strings([])
    return m.select(
        "did", "problem_type", F.when(k % 4 == 0, none).otherwise(F.array(at(s), at(s + 3), at(s + 5))).alias("memory_models"),
        ((k % 101) / 100.0).alias("memory_score"), F.when(k % 5 == 0, none).otherwise(F.array(at(k), at(k + 2))).alias("suggested_models"),
        F.when(k % 20 == 0, none).otherwise(route.rule_candidates(F.col("problem_type"))).alias("rule_models"))


@query("r2_rank_fusion", f"""WITH {FUSE_SQL} SELECT did, position, m AS model, round(v, 6) AS combined FROM fused WHERE position <= 3
UNION ALL SELECT did, i, (CASE WHEN problem_type = 'classification' THEN ['lgbm_clf', 'rf', 'logistic'] ELSE ['lgbm_reg', 'rf_reg', 'ridge'] END)[i], NULL
  FROM sig, (SELECT CAST(unnest(range(1, 4)) AS INT) AS i) WHERE len(a) + len(b) + len(r) = 0""")
def _(spark, d):
    return rounded(route.fuse_rankings(signals(spark, d), "did"), "combined")


@query("r3_paradigm", f"""WITH {META_SQL}, h AS (SELECT did, CASE WHEN did % 6 = 0 THEN NULL ELSE (did % 10) / 10.0::DOUBLE END AS s, (did % 5) / 4.0::DOUBLE AS mem,
  greatest(0, least(1, CASE WHEN n_samples > 100000 THEN 0.5::DOUBLE WHEN n_samples > 50000 THEN 0.4 WHEN n_samples > 10000 THEN 0.2 ELSE 0.0 END
    + CASE WHEN n_features > 100 THEN 0.3::DOUBLE WHEN n_features > 50 THEN 0.1 ELSE 0.0 END + CASE WHEN n_features < 20 THEN -0.5::DOUBLE ELSE 0.0 END)) AS h FROM meta),
  r AS (SELECT *, 0.5::DOUBLE * coalesce(s, 0.2) + 0.2::DOUBLE * mem + 0.3::DOUBLE * h AS rd FROM h)
SELECT did, round(h, 6) AS size_score, round(rd, 6) AS score, CASE WHEN rd > 0.5 THEN 'AutoDL' ELSE 'AutoML' END AS paradigm FROM r""")
def _(spark, d):
    m, k = meta(spark, d), F.col("did")
    h = route.size_score(F.col("n_samples"), F.col("n_features"))
    score, name = route.paradigm(F.when(k % 6 != 0, (k % 10) / 10.0), (k % 5) / 4.0, h)
    return m.select("did", F.round(h, R).alias("size_score"), F.round(score, R).alias("score"), name.alias("paradigm"))


@query("r4_tuning_pool", f"""WITH {FUSE_SQL}, p AS (SELECT did, b || (CASE WHEN did % 6 < 3 THEN list_slice(r, 1, 3) ELSE a END) || (CASE WHEN problem_type = 'regression' THEN ['xgb_reg', 'lgbm_reg', 'rf_reg'] ELSE [] END) AS l FROM sig),
  u AS (SELECT did, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM p), f AS (SELECT did, m, min(i) AS i FROM u GROUP BY did, m)
SELECT p.did, coalesce(string_agg(m, ',' ORDER BY f.i), '') AS pool FROM p LEFT JOIN f ON p.did = f.did GROUP BY p.did""")
def _(spark, d):
    s = signals(spark, d)
    pool = route.pool(F.col("memory_models"), F.col("did") % 6, F.col("rule_models"), F.col("suggested_models"), F.col("problem_type"))
    return s.select("did", F.array_join(pool, ",").alias("pool"))


@query("r5_models_for_size", f"""WITH {META_SQL}, c AS (SELECT did, problem_type, n_samples * 20 AS n FROM meta),
  l AS (SELECT did, problem_type, CASE WHEN problem_type = 'classification' THEN CASE WHEN n < 50000 THEN ['logistic', 'rf', 'gb', 'lgbm_clf', 'xgb_clf'] WHEN n <= 200000 THEN ['logistic', 'rf', 'lgbm_clf', 'xgb_clf'] ELSE ['logistic', 'lgbm_clf', 'xgb_clf'] END
    ELSE CASE WHEN n < 50000 THEN ['ridge', 'rf_reg', 'gb_reg', 'lgbm_reg', 'xgb_reg'] WHEN n <= 200000 THEN ['ridge', 'rf_reg', 'lgbm_reg', 'xgb_reg'] ELSE ['ridge', 'lgbm_reg', 'xgb_reg'] END END AS l FROM c)
SELECT did, array_to_string(l, ',') AS models FROM l""")
def _(spark, d):
    from ..operators.profile import size_category

    rows = F.col("n_samples") * 20
    return meta(spark, d).select("did", F.array_join(route.models_for_size(size_category(rows), F.col("problem_type"), rows), ",").alias("models"))


@query("r5_without_kernels", f"""WITH {META_SQL}, l AS (SELECT did, n_samples, ({_N})[CAST(did % 7 AS INT) + 1] AS a, ({_N})[CAST((did + 2) % 7 AS INT) + 1] AS b FROM meta),
  u AS (SELECT did, n_samples, unnest([a, b]) AS m FROM l) SELECT did, m AS model FROM u WHERE NOT (n_samples > 5000 AND m IN ('svc', 'svr'))""")
def _(spark, d):
    names = F.array(*[F.lit(n) for n in NAMES])
    at = lambda x: F.element_at(names, (x % 7 + 1).cast("int"))
    m = meta(spark, d).withColumn("l", F.array(at(F.col("did")), at(F.col("did") + 2)))
    return m.select("did", F.explode(route.without_kernels(F.col("l"), F.col("n_samples"))).alias("model"))


DOMAIN_SQL = "CASE doc_id % 6 WHEN 0 THEN ' Biology ' WHEN 1 THEN 'documents' WHEN 2 THEN 'REMOTE_SENSING' WHEN 3 THEN 'general' WHEN 4 THEN source ELSE lang END"


@query("r6_domain_model", f"""WITH t AS (SELECT doc_id, lower(trim({DOMAIN_SQL})) AS dom, CASE WHEN doc_id % 3 = 0 THEN 'resnet' WHEN doc_id % 3 = 1 THEN 'clip' ELSE 'vit' END AS arch FROM documents),
  n AS (SELECT doc_id, CASE WHEN dom IN ('biology', 'documents', 'remote_sensing', 'general') THEN dom ELSE 'general' END || '/' || CASE WHEN arch IN ('clip', 'resnet') THEN arch ELSE 'clip' END AS k FROM t)
SELECT doc_id, CASE k {' '.join(f"WHEN '{a}/{b}' THEN '{v[0]}'" for (a, b), v in route.DOMAIN_MODELS.items())} END AS model, CASE k {' '.join(f"WHEN '{a}/{b}' THEN {v[1]}" for (a, b), v in route.DOMAIN_MODELS.items())} END AS size FROM n""")
def _(spark, d):
    k = F.col("doc_id")
    dom = (F.when(k % 6 == 0, " Biology ").when(k % 6 == 1, "documents").when(k % 6 == 2, "REMOTE_SENSING").when(k % 6 == 3, "general")
           .when(k % 6 == 4, F.col("source")).otherwise(F.col("lang")))
    arch = F.when(k % 3 == 0, "resnet").when(k % 3 == 1, "clip").otherwise("vit")
    name, size = route.domain_model(dom, arch)
    return table(spark, d, "documents").select("doc_id", name.alias("model"), size.alias("size"))


@query("r7_recommendation", """SELECT o_orderkey, CASE WHEN (o_custkey % 101) / 100.0 > 0.90 THEN 'deploy' WHEN (o_custkey % 101) / 100.0 > 0.75 THEN 'collect more data' ELSE 're-evaluate' END AS advice FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", route.recommendation((F.col("o_custkey") % 101) / 100.0).alias("advice"))
