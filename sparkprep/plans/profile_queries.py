"""Queries over profiling, fingerprints and feature engineering."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import neighbors as nb
from ..operators import profile
from ..session import cut_lineage, scratch_path
from ..sources import tables
from .clean_queries import ORDERS_WITH_GAPS, orders_with_gaps
from .registry import query, table

R = 6
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

GAPS_SQL = """li AS (SELECT CAST(l_suppkey % 20 AS BIGINT) AS ds, l_quantity, l_extendedprice,
  CASE WHEN l_partkey % 23 <> 0 THEN l_discount END AS l_discount, CASE WHEN l_orderkey % 19 <> 0 THEN l_tax END AS l_tax,
  l_linestatus, l_returnflag, l_linenumber FROM lineitem)"""


def lines(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("ds"), "l_quantity", "l_extendedprice",
        F.when(F.col("l_partkey") % 23 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 19 != 0, F.col("l_tax")).alias("l_tax"),
        "l_linestatus", "l_returnflag", "l_linenumber")


def rounded(df, *names, digits=R):
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---- aggregates ---------------------------------------------------------------------------------


@query("a1_table_summary", f"""WITH {ORDERS_WITH_GAPS} SELECT count(*) AS rows, 6 AS cols, count(DISTINCT o_orderstatus) AS target_unique,
  'o_orderstatus=' || count_if(o_orderstatus IS NULL) || ';o_totalprice=' || count_if(o_totalprice IS NULL) || ';o_orderpriority=' || count_if(o_orderpriority IS NULL) AS missing,
  'o_orderkey,o_custkey,o_totalprice' AS numeric_cols, 'o_orderstatus,o_orderpriority' AS categorical_cols FROM g""")
def _(spark, d):
    s = profile.table_summary(orders_with_gaps(spark, d), "o_orderstatus")
    item = lambda e: F.concat_ws("=", e["column"], e["missing"].cast("string"))
    return s.select("rows", "cols", "target_unique", F.array_join(F.transform("missing", item), ";").alias("missing"),
                    F.array_join("numeric_cols", ",").alias("numeric_cols"), F.array_join("categorical_cols", ",").alias("categorical_cols"))


@query("p4_column_types", f"""WITH {ORDERS_WITH_GAPS} SELECT * FROM (SELECT 'numeric' AS kind, 'o_orderkey' AS "column", count(o_orderkey) AS present FROM g UNION ALL SELECT 'numeric', 'o_custkey', count(o_custkey) FROM g
  UNION ALL SELECT 'categorical', 'o_orderstatus', count(o_orderstatus) FROM g UNION ALL SELECT 'numeric', 'o_totalprice', count(o_totalprice) FROM g
  UNION ALL SELECT 'datetime', 'o_orderdate', count(o_orderdate) FROM g UNION ALL SELECT 'categorical', 'o_orderpriority', count(o_orderpriority) FROM g)""")
def _(spark, d):
    g = orders_with_gaps(spark, d)
    kind = {c: k for k, cols in profile.column_types(g).items() for c in cols}
    kinds = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    counts = profile.per_column(g, list(kind), {"present": lambda c: F.count(c)})
    return counts.select(F.element_at(kinds, F.col("column")).alias("kind"), "column", "present")


@query("a2_missing_rate", f"""WITH {ORDERS_WITH_GAPS}, n AS (SELECT count(*) * 4 AS cells, CAST(sum((o_orderstatus IS NULL)::INT + (o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT + (o_orderdate IS NULL)::INT) AS BIGINT) AS null_cells FROM g)
SELECT null_cells, cells, round(null_cells / cells, 6) AS missing_rate, round(null_cells / cells * 100, 2) AS missing_pct FROM n""")
def _(spark, d):
    return rounded(profile.missing_rate(orders_with_gaps(spark, d), ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]), "missing_rate")


@query("a2_missing_counts", f"""WITH {GAPS_SQL} SELECT 'l_discount' AS "column", count_if(l_discount IS NULL) AS missing, count(*) AS rows FROM li
  UNION ALL SELECT 'l_tax', count_if(l_tax IS NULL), count(*) FROM li UNION ALL SELECT 'l_quantity', 0, count(*) FROM li""")
def _(spark, d):
    return profile.missing_counts(lines(spark, d), ["l_discount", "l_tax", "l_quantity"]).select("column", "missing", "rows")


@query("a3_class_distribution", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(n / (SELECT sum(n) FROM c), 3) AS share, round((SELECT max(n) / min(n) FROM c), 2) AS imbalance_ratio FROM c""")
def _(spark, d):
    return profile.class_distribution(table(spark, d, "orders"), "o_orderpriority")


@query("a4_majority_baseline", """WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), te AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
  m AS (SELECT o_orderpriority AS c FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT (SELECT c FROM m) AS majority_class, round(avg(CASE WHEN o_orderpriority = (SELECT c FROM m) THEN 1.0 ELSE 0.0 END), 6) AS baseline_accuracy FROM te""")
def _(spark, d):
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")
    return rounded(profile.majority_baseline(o.where(early), o.where(~early), "o_orderpriority"), "baseline_accuracy")


@query("a4_majority_share", """WITH c AS (SELECT o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1)
SELECT (SELECT c FROM c ORDER BY n DESC, c LIMIT 1) AS majority_class, round((SELECT max(n) / sum(n) FROM c), 6) AS majority_share""")
def _(spark, d):
    return rounded(profile.majority(table(spark, d, "orders"), "o_orderstatus"), "majority_share")


@query("a5_unique_ratio", """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS n_unique, round(count(DISTINCT p_brand) / count(*), 6) AS ratio FROM part
  UNION ALL SELECT 'p_name', count(DISTINCT p_name), round(count(DISTINCT p_name) / count(*), 6) FROM part
  UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), round(count(DISTINCT p_retailprice) / count(*), 6) FROM part""")
def _(spark, d):
    return rounded(profile.unique_ratio(table(spark, d, "part"), ["p_brand", "p_name", "p_retailprice"]).select("column", "n_unique", "ratio"), "ratio")


@query("a6_entropy", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT p_brand, n / sum(n) OVER (PARTITION BY p_brand) AS p, count(*) OVER (PARTITION BY p_brand) AS k FROM c)
SELECT p_brand, round(-sum(p * ln(p)), 6) AS entropy, round(least(1, -sum(p * ln(p)) / ln(greatest(max(k), 2))), 6) AS entropy_norm,
  round(-sum(p * ln(p + 1e-10)), 6) AS target_entropy FROM p GROUP BY p_brand""")
def _(spark, d):
    p = table(spark, d, "part")
    out = profile.class_stats(p, "p_type", ["p_brand"]).join(profile.smoothed_entropy(p, "p_type", ["p_brand"]), "p_brand")
    return rounded(out.select("p_brand", "entropy", "entropy_norm", "target_entropy"), "entropy", "entropy_norm", "target_entropy")


def _union(fmt, cols, **kw):
    return " UNION ALL ".join(fmt.format(c=c, **kw) for c in cols)


@query("a7_a8_skewness", f"""WITH {GAPS_SQL}, s AS ({_union("SELECT '{c}' AS col, skewness({c}) AS g, count({c}) AS n FROM li", NUM)})
SELECT col AS "column", round(g * (n - 2) / sqrt(n::DOUBLE * (n - 1)), 6) AS g1, round(g, 6) AS g1_corrected, abs(g * (n - 2) / sqrt(n::DOUBLE * (n - 1))) > 1 AS high FROM s""")
def _(spark, d):
    t = profile.skewness_table(lines(spark, d), NUM)
    return rounded(t.select("column", "g1", "g1_corrected", (F.abs("g1") > 1).alias("high")), "g1", "g1_corrected")


CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM li" for a, b in combinations(NUM, 2))


@query("a9_corr_long", f"""WITH {GAPS_SQL}, c AS ({CORR_SQL}) SELECT col_a, col_b, round(r, 6) AS corr FROM c""")
def _(spark, d):
    return rounded(profile.corr_long(lines(spark, d), NUM), "corr")


@query("a10_mean_abs_corr", f"""WITH {GAPS_SQL}, c AS ({CORR_SQL}) SELECT round(avg(abs(r)), 6) AS mean_abs_corr FROM c""")
def _(spark, d):
    return rounded(profile.mean_abs_corr(lines(spark, d), NUM), "mean_abs_corr")


@query("a11_corr_with", f"""WITH {GAPS_SQL} {_union('SELECT $q{c}$q AS "column", round(abs(corr({c}, l_extendedprice)), 6) AS abs_corr FROM li', ["l_quantity", "l_discount", "l_tax"]).replace("$q", "'")}""")
def _(spark, d):
    return rounded(profile.corr_with(lines(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "abs_corr")


@query("a12_variation", f"""WITH {GAPS_SQL}, c AS ({_union("SELECT greatest(-10, least(10, stddev_samp({c}) / (abs(avg({c})) + 1e-8))) AS cv FROM li", NUM)})
SELECT round(tanh(avg(cv)), 6) AS variation FROM c""")
def _(spark, d):
    return profile.variation(lines(spark, d), NUM).agg(F.round(F.tanh(F.avg("cv")), R).alias("variation"))


QUARTS_SQL = """WITH {gaps}, q AS ({parts}) SELECT col AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM q""".format(
    gaps=GAPS_SQL, parts=_union("SELECT '{c}' AS col, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM li", NUM))


def _bounds(spark, bounds):
    rows = [(c, *b) for c, b in bounds.items()]
    return rounded(spark.createDataFrame(rows, "column string, q1 double, q3 double, lower double, upper double"), "q1", "q3", "lower", "upper")


@query("a13_iqr_bounds", QUARTS_SQL)
def _(spark, d):
    return _bounds(spark, profile.iqr_bounds(lines(spark, d), NUM))


@query("a13_iqr_bounds_narrowing", QUARTS_SQL)
def _(spark, d):
    return _bounds(spark, profile.iqr_bounds(lines(spark, d), NUM, exact_rows=100, bracket_rows=20))


NORMAL_SQL = f"""WITH {GAPS_SQL}, s AS ({_union("SELECT '{c}' AS col, count({c})::DOUBLE AS n, skewness({c}) AS gg, kurtosis_pop({c}) AS k FROM li", NUM)}),
  a AS (SELECT *, gg * (n - 2) / sqrt(n * (n - 1)) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
    (k + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM s),
  c AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w, 6 + (8 / b) * (2 / b + sqrt(1 + 4 / (b * b))) AS aa FROM a),
  e AS (SELECT *, 1 / sqrt(0.5 * ln(w)) * ln(y / sqrt(2 / (w - 1)) + sqrt(y * y / (2 / (w - 1)) + 1)) AS z1, 1 + x * sqrt(2 / (aa - 4)) AS dd FROM c),
  f AS (SELECT *, (1 - 2 / (9 * aa) - sign(dd) * pow((1 - 2 / aa) / abs(dd), 1.0 / 3.0)) / sqrt(2 / (9 * aa)) AS z2 FROM e)
SELECT col AS "column", round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value, CASE WHEN exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 THEN 'standard' ELSE 'robust' END AS scaler FROM f"""


@query("a14_f9_normality", NORMAL_SQL)
def _(spark, d):
    return rounded(profile.normality(lines(spark, d), NUM).select("column", "p_value", "scaler"), "p_value")


@query("a15_histogram", """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events)
SELECT CAST(least(floor((value - lo) / w), 29) AS INT) AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def _(spark, d):
    return profile.histogram(table(spark, d, "events"), "value", 30).select("bin", "n")


@query("a16_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def _(spark, d):
    return profile.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("a16_value_shares", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2""")
def _(spark, d):
    return rounded(profile.value_shares(table(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"]), "share")


#: Extra numeric columns of lineitem, so many that all pairs take more than one pass of aggregates.
WIDE = {f"{c}_{n}": e.format(c=c) for c in NUM for n, e in {
    "id": "{c}", "square": "{c} * {c}", "root": "sqrt({c})", "log": "ln(1 + {c})", "rest": "(l_orderkey % 13) * {c}"}.items()}


@query("a9_a10_corr_wide", f"""WITH li AS (SELECT * REPLACE (CASE WHEN l_partkey % 23 <> 0 THEN l_discount END AS l_discount, CASE WHEN l_orderkey % 19 <> 0 THEN l_tax END AS l_tax) FROM lineitem),
  w AS (SELECT {', '.join(f'{e} AS {n}' for n, e in WIDE.items())} FROM li),
  c AS (SELECT {', '.join(f'corr({a}, {b}) AS r{i}' for i, (a, b) in enumerate(combinations(WIDE, 2)))} FROM w),
  u AS (SELECT unnest([{', '.join(f"{{'a': '{a}', 'b': '{b}', 'r': r{i}}}" for i, (a, b) in enumerate(combinations(WIDE, 2)))}]) AS e FROM c)
SELECT e.a AS col_a, e.b AS col_b, round(e.r, 6) AS corr FROM u""")
def _(spark, d):
    t = table(spark, d, "lineitem").withColumns({
        "l_discount": F.when(F.col("l_partkey") % 23 != 0, F.col("l_discount")), "l_tax": F.when(F.col("l_orderkey") % 19 != 0, F.col("l_tax"))})
    wide = t.select(*[F.expr(e).alias(n) for n, e in WIDE.items()])
    return rounded(profile.corr_long(wide, list(WIDE)), "corr")


FP_FEATURES = [*NUM, "l_linestatus"]
_pairs = list(combinations(NUM, 2))
_cnt = "(" + " + ".join(f"(r{i} IS NOT NULL)::INT" for i in range(len(_pairs))) + ")"


def _fp_sql(by: str) -> str:
    g = f"GROUP BY {by}"
    skews = ", ".join(f"skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS g{i}" for i, c in enumerate(NUM))
    cvs = ", ".join(f"greatest(-10, least(10, stddev_samp({c}) / (abs(avg({c})) + 1e-8))) AS c{i}" for i, c in enumerate(NUM))
    corrs = ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(_pairs))
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in FP_FEATURES)
    plus = lambda p, n, f="{}": " + ".join(f.format(f"{p}{i}") for i in range(n))
    return f"""m AS (SELECT {by}, count(*) AS n, {nulls} AS nulls, {skews}, {cvs}, {corrs} FROM li {g}),
  k AS (SELECT {by}, l_returnflag, count(*) AS n FROM li GROUP BY {by}, l_returnflag),
  p AS (SELECT {by}, n / sum(n) OVER (PARTITION BY {by}) AS p FROM k),
  y AS (SELECT {by}, count(*) AS classes, -sum(p * ln(p)) AS h, max(p) AS maj, -sum(p * ln(p + 1e-10)) AS hs FROM p {g}),
  fp AS (SELECT m.{by}, n, [CAST(v AS FLOAT) FOR v IN [ln(1 + n) / 10, ln(1 + 5) / 10, ln(1 + n / 5) / 10,
    greatest(-1, least(1, ({plus('g', 4)}) / 4 / 5)), ({plus('g', 4, '(abs({})>1)::INT')}) / 4, ({plus('r', 6, 'abs({})')}) / 6,
    tanh(({plus('c', 4)}) / 4), ln(1 + classes) / 5, least(1, h / ln(greatest(classes, 2))), nulls / (n * 5)]] AS e FROM m JOIN y USING ({by}))"""


@query("a17_fingerprint", f"""WITH {GAPS_SQL.replace("AS ds", "AS ds0").replace("SELECT CAST", "SELECT 1 AS one, CAST", 1)}, {_fp_sql('one')}
SELECT CAST(i - 1 AS INT) AS dim, round(e[i]::DOUBLE, 5) AS value FROM fp, unnest(range(1, 11)) AS t(i)""")
def _(spark, d):
    fp = profile.fingerprints(lines(spark, d), FP_FEATURES, "l_returnflag")
    return fp.select(F.posexplode("embedding").alias("dim", "v")).select("dim", F.round(F.col("v").cast("double"), 5).alias("value"))


#: Datasets of different tables and columns: numeric features, other features, target.
MIXED = {
    "orders": (["o_totalprice", "o_custkey"], ["o_orderpriority"], "o_orderstatus"),
    "part": (["p_size", "p_retailprice"], [], "p_brand"),
    "customer": (["c_acctbal"], ["c_name"], "c_mktsegment"),
    "supplier": (["s_acctbal", "s_nationkey", "s_suppkey"], [], None),
}


def _mixed_sql():
    out = []
    for t, (num, other, y) in MIXED.items():
        k, f, pairs = len(num), len(num) + len(other), list(combinations(num, 2))
        plus = lambda items: "(" + " + ".join(items) + f") / {k}"
        skew = lambda c: f"skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1))"
        spread = [f"greatest(-10, least(10, stddev_samp({c}) / (abs(avg({c})) + 1e-8)))" for c in num]
        corr = "(" + " + ".join(f"abs(corr({a}, {b}))" for a, b in pairs) + f") / {len(pairs)}" if pairs else "0"
        classes, h = (f"(SELECT count(DISTINCT {y}) FROM {t})", f"""(SELECT least(1, -sum(p * ln(p)) / ln(greatest(count(*), 2))) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {t} GROUP BY {y}))""") if y else ("0", "0")
        dims = ["ln(1 + count(*)) / 10", f"ln(1 + {f}) / 10", f"ln(1 + count(*) / {f}) / 10", f"greatest(-1, least(1, {plus([skew(c) for c in num])} / 5))",
                plus([f"(abs({skew(c)}) > 1)::INT" for c in num]), corr, f"tanh({plus(spread)})", f"ln(1 + {classes}) / 5", h, "0"]
        kind = f"CASE WHEN {classes} <= 2 THEN 0 ELSE 2 END" if y else "1"
        out.append(f"SELECT '{t}' AS dataset, {kind} AS task_type, count(*) AS n_samples, {f}::BIGINT AS n_features, [{', '.join(f'({d})::FLOAT' for d in dims)}] AS e FROM {t}")
    return f"""WITH fp AS ({' UNION ALL '.join(out)}) SELECT dataset, task_type::INT AS task_type, n_samples, n_features, CAST(i - 1 AS INT) AS dim, round(e[i]::DOUBLE, 5) AS value FROM fp, unnest(range(1, 11)) AS t(i)"""


@query("a18_mixed_schemas", _mixed_sql())
def _(spark, d):
    found = profile.fingerprints_of({t: (table(spark, d, t), [*num, *other], y) for t, (num, other, y) in MIXED.items()})
    return found.select("dataset", F.col("task_type").cast("int").alias("task_type"), "n_samples", "n_features", F.posexplode("embedding").alias("dim", "v")).select(
        "*", F.round(F.col("v").cast("double"), 5).alias("value")).drop("v")


@query("a18_fingerprints", f"""WITH {GAPS_SQL}, {_fp_sql('ds')} SELECT ds, n AS n_samples, CAST(i - 1 AS INT) AS dim, round(e[i]::DOUBLE, 5) AS value FROM fp, unnest(range(1, 11)) AS t(i)""")
def _(spark, d):
    fp = profile.fingerprints(lines(spark, d), FP_FEATURES, "l_returnflag", ["ds"])
    return fp.select("ds", "n_samples", F.posexplode("embedding").alias("dim", "v")).select(
        "ds", "n_samples", "dim", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("a18_nearest_dataset", f"""WITH {GAPS_SQL}, {_fp_sql('ds')}, pr AS (SELECT a.ds AS ds, b.ds AS nearest,
    list_sum(list_transform(range(1, 11), lambda i: (a.e[i]::DOUBLE - b.e[i]::DOUBLE) ** 2)) AS dist FROM fp a JOIN fp b ON a.ds <> b.ds)
SELECT ds, nearest, round(dist, 8) AS distance FROM pr QUALIFY row_number() OVER (PARTITION BY ds ORDER BY dist, nearest) = 1""")
def nearest_dataset(spark, d):
    """Which slice of the data is most like each slice: fingerprints, then an exact nearest-neighbour join."""
    fp = cut_lineage(profile.fingerprints(lines(spark, d), FP_FEATURES, "l_returnflag", ["ds"]))
    near = nb.knn_join(fp, fp, 1, query_id="ds", memory_id="ds", exclude_same=True)
    return near.select(F.col("query_id").alias("ds"), F.col("memory_id").alias("nearest"), F.round("distance", 8).alias("distance"))


@query("a19_meta_features", f"""WITH {GAPS_SQL}, {_fp_sql('ds')}, mm AS (SELECT * FROM m JOIN y USING (ds)),
  gg AS (SELECT ds, ({' + '.join(f'skewness({c})' for c in NUM)}) / 4 AS sk FROM li GROUP BY ds)
SELECT ds, n AS n_samples, CAST(5 AS BIGINT) AS n_features, 0.8::DOUBLE AS num_ratio, 0.2::DOUBLE AS cat_ratio, round(nulls / (n * 5), 6) AS missing_rate, round(sk, 6) AS skewness_mean,
  round((abs(r0) + abs(r1) + abs(r2) + abs(r3) + abs(r4) + abs(r5)) / 6, 6) AS mean_corr, classes AS n_classes, classes = 2 AS is_binary, round(hs, 6) AS target_entropy, round(maj, 6) AS majority_class_ratio
FROM mm JOIN gg USING (ds)""")
def _(spark, d):
    m = profile.meta_features(lines(spark, d), FP_FEATURES, "l_returnflag", ["ds"])
    return rounded(m, "missing_rate", "skewness_mean", "mean_corr", "target_entropy", "majority_class_ratio")


@query("s10_fingerprint_sink", f"""WITH {GAPS_SQL}, {_fp_sql('ds')} SELECT ds, n AS n_samples, 2 AS task_type, round(e[6]::DOUBLE, 5) AS mean_corr FROM fp""")
def _(spark, d):
    fp = profile.fingerprints(lines(spark, d), FP_FEATURES, "l_returnflag", ["ds"])
    path = scratch_path(spark, "fingerprints") + ".json"
    tables.save_fingerprints(fp, path)
    return tables.read_table(spark, path, fp.schema).select("ds", "n_samples", "task_type", F.round(F.col("embedding")[5].cast("double"), 5).alias("mean_corr"))


PLAN_SQL = """WITH s AS (SELECT 'p_brand' AS col, 0 AS pos, count(DISTINCT p_brand) AS u, count(*) AS n FROM part UNION ALL SELECT 'p_type', 1, count(DISTINCT p_type), count(*) FROM part
  UNION ALL SELECT 'p_name', 2, count(DISTINCT p_name), count(*) FROM part UNION ALL SELECT 'p_code', 3, count(DISTINCT p_partkey // 3), count(*) FROM part),
  f AS (SELECT *, u / n AS r, CASE WHEN u / n < 0.05 THEN 'onehot' WHEN u / n <= 0.1 THEN 'frequency' ELSE 'hash' END AS st FROM s),
  w AS (SELECT *, (SELECT coalesce(sum(u), 0) FROM f WHERE st = 'onehot') - coalesce(sum(CASE WHEN st = 'onehot' THEN u END) OVER (ORDER BY st <> 'onehot', u DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain FROM f)
SELECT col AS "column", u AS n_unique, round(r, 6) AS ratio, CASE WHEN st = 'onehot' AND remain > 40 THEN 'frequency' ELSE st END AS strategy FROM w"""


@query("a20_encoding_plan", PLAN_SQL)
def _(spark, d):
    p = table(spark, d, "part").withColumn("p_code", F.floor(F.col("p_partkey") / 3).cast("string"))
    return rounded(profile.encoding_plan(p, ["p_brand", "p_type", "p_name", "p_code"], max_onehot=40, low=0.05), "ratio")


@query("a23_mean_vector", """SELECT label, CAST(i AS BIGINT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY label, i""")
def _(spark, d):
    m = profile.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("mean_vector").alias("p", "x"))
    return m.select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", R).alias("x"))


@query("a24_profile_row", f"""WITH {ORDERS_WITH_GAPS}, c AS (SELECT o_orderstatus AS k, count(*) AS n FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT 'o_custkey,o_totalprice,o_orderpriority' AS sample_columns, (SELECT round(100.0 * (count_if(o_totalprice IS NULL) + count_if(o_orderpriority IS NULL)) / (3 * count(*)), 2) FROM g) AS missing_data_pct,
  3 AS num_features, (SELECT count(*) FROM g) AS num_samples, k AS class, round(n / (SELECT sum(n) FROM c), 3) AS share, round((SELECT max(n) / min(n) FROM c), 2) AS imbalance_ratio FROM c""")
def _(spark, d):
    p = profile.profile_row(orders_with_gaps(spark, d), ["o_custkey", "o_totalprice", "o_orderpriority"], "o_orderstatus")
    return p.select(F.array_join("sample_columns", ",").alias("sample_columns"), "missing_data_pct", "num_features", "num_samples",
                    "imbalance_ratio", F.explode("class_distribution").alias("class", "share"))


@query("a25_class_quartiles", f"""WITH {GAPS_SQL} {_union('SELECT l_returnflag, $q{c}$q AS "column", min({c}) AS "min", round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS "max" FROM li GROUP BY 1', NUM).replace("$q", "'")}""")
def _(spark, d):
    return rounded(profile.class_quartiles(lines(spark, d), NUM, "l_returnflag"), "q1", "median", "q3")


# ---- feature steps ------------------------------------------------------------------------------


@query("f1_text_statistics", """SELECT doc_id, length(text) AS text_length, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS INT) AS text_word_count FROM documents""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", "lang")
    chosen = fe.text_columns(t, ["text", "lang"])
    out = fe.text_statistics(t, chosen)
    return out.select("doc_id", F.col("text_length").cast("long").alias("text_length"), "text_word_count")


@query("f2_datetime_parts", """SELECT event_id, CAST(year(ts) AS INT) AS ts_year, CAST(month(ts) AS INT) AS ts_month, CAST(day(ts) AS INT) AS ts_day, CAST(isodow(ts) - 1 AS INT) AS ts_weekday,
  round(sin(2 * pi() * month(ts) / 12), 6) AS ts_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS ts_month_cos FROM events""")
def _(spark, d):
    return rounded(fe.datetime_parts(table(spark, d, "events").select("event_id", "ts"), ["ts"]), "ts_month_sin", "ts_month_cos")


@query("f3_rare_grouping", """WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_name FROM c WHERE n >= 0.0155 * (SELECT sum(n) FROM c))
SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE '_RARE' END AS p_name FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return fe.group_rare(p, fe.frequent_values(p, ["p_name"], 0.0155))


@query("f4_target_encoding", """WITH t AS (SELECT p_brand AS v, p_partkey % 5 AS f, p_retailprice AS y FROM part), g AS (SELECT avg(y) AS g FROM t),
  pf AS (SELECT v, f, sum(y) AS s, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT *, sum(s) OVER (PARTITION BY v) - s AS os, sum(n) OVER (PARTITION BY v) - n AS o FROM pf),
  e AS (SELECT v, n, (o / (o + 10.0)) * (os / o) + (1 - o / (o + 10.0)) * g AS enc FROM w, g WHERE o > 0),
  m AS (SELECT v, sum(enc * n) / sum(n) AS enc FROM e GROUP BY v)
SELECT p_partkey, round(coalesce(enc, g), 6) AS p_brand FROM part LEFT JOIN m ON p_brand = v, g""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    enc = fe.target_encoding(p, "p_brand", "p_retailprice", F.col("p_partkey") % 5)
    mean = p.agg(F.avg("p_retailprice")).scalar()
    return rounded(fe.apply_encoding(p, "p_brand", enc, mean).select("p_partkey", "p_brand"), "p_brand")


@query("f5_frequency_encoding", """WITH c AS (SELECT user_id, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1)
SELECT event_id, round(share, 6) AS user_id FROM events JOIN c USING (user_id)""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return rounded(fe.apply_encoding(e, "user_id", fe.frequency_encoding(e, "user_id"), F.lit(0.0)), "user_id")


def _yj_sql(x, lam):
    return f"CASE WHEN {x} >= 0 THEN (pow({x} + 1, {lam}) - 1) / {lam} ELSE -(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam} END"


@query("f6_yeo_johnson", f"""SELECT event_id, round({_yj_sql('(value - 50)', 0.3)}, 4) AS value FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(fe.yeo_johnson(F.col("value") - 50, 0.3), 4).alias("value"))


def _yj_fit_sql(columns):
    """The same three grids: log-likelihood of every lambda over all rows."""
    any_lam = "CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-12 THEN ln(1 + x) ELSE (pow(1 + x, lam) - 1) / lam END ELSE CASE WHEN abs(lam - 2) < 1e-12 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END"
    parts = ["v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS col, ({e})::DOUBLE AS x FROM events" for n, e in columns.items()) + "), b0 AS (SELECT DISTINCT col, 1.0::DOUBLE AS best FROM v)"]
    for k, (step, reach) in enumerate(((0.25, 3.0), (0.025, 0.25), (0.0025, 0.025))):
        points = round(reach / step)
        parts.append(f"""g{k} AS (SELECT col, round(best + i * {step}::DOUBLE, 6) AS lam FROM b{k}, range({-points}, {points + 1}) AS t(i)),
  l{k} AS (SELECT col, lam, -count(*) / 2.0::DOUBLE * ln(var_pop({any_lam})) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS score FROM v JOIN g{k} USING (col) GROUP BY col, lam),
  b{k + 1} AS (SELECT col, arg_max(lam, score) AS best FROM l{k} GROUP BY col)""")
    return "WITH " + ", ".join(parts) + """ SELECT col AS "column", best AS lambda FROM b3"""


@query("f6_fit_yeo_johnson", _yj_fit_sql({"value": "value", "centred": "value - 50", "cube": "pow(value, 3) / 1000"}))
def _(spark, d):
    e = table(spark, d, "events").select("value", (F.col("value") - 50).alias("centred"), (F.pow("value", F.lit(3)) / 1000).alias("cube"))
    lam = fe.fit_yeo_johnson(e, ["value", "centred", "cube"])
    return spark.createDataFrame(list(lam.items()), "column string, lambda double")


@query("f7_log_shift", """SELECT event_id, round(ln(1 + (value - 50) + (SELECT greatest(0, -min(value - 50)) FROM events)), 6) AS value FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") - 50).alias("value"))
    shift = fe.fit_log_shift(e, ["value"])["value"]
    return e.select("event_id", F.round(fe.log_shifted(F.col("value"), shift), R).alias("value"))


@query("f8_outlier_cap", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), value)), 6) AS value FROM events, q""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return rounded(fe.cap(e, fe.fit_caps(e, ["value"])), "value")


@query("f10_drop_correlated", """WITH l AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 + l_tax AS q2 FROM lineitem)
SELECT 'net' AS dropped FROM l HAVING abs(corr(l_extendedprice, net)) > 0.95 OR abs(corr(l_quantity, net)) > 0.95
UNION ALL SELECT 'q2' FROM l HAVING abs(corr(l_quantity, q2)) > 0.95 OR abs(corr(l_extendedprice, q2)) > 0.95 OR abs(corr(net, q2)) > 0.95
UNION ALL SELECT 'l_extendedprice' FROM l HAVING abs(corr(l_quantity, l_extendedprice)) > 0.95""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                                            (F.col("l_quantity") * 2 + F.col("l_tax")).alias("q2"))
    gone = fe.correlated_columns(li, li.columns)
    return spark.createDataFrame([(c,) for c in gone], "dropped string")


@query("f11_f12_f13_combinations", """SELECT round(sum(l_quantity * l_discount), 2) AS products, round(sum(l_quantity / (l_discount + 1e-5)), 2) AS ratios, round(sum(l_tax * l_tax), 6) AS squares,
  round(sum(l_tax / (l_quantity + 1e-5)), 6) AS ratios_back FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    x = fe.add_squares(fe.add_ratios(fe.add_products(li, fe.product_pairs(li.columns)), fe.ratio_pairs(li.columns)), li.columns)
    return x.agg(F.round(F.sum("l_quantity__x__l_discount"), 2).alias("products"), F.round(F.sum("l_quantity__div__l_discount"), 2).alias("ratios"),
                 F.round(F.sum("l_tax__squared"), R).alias("squares"), F.round(F.sum("l_tax__div__l_quantity"), R).alias("ratios_back"))


@query("f14_f15_scaling", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, median(o_custkey) AS q2, quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25) AS iqr FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / sd, 6) AS o_totalprice, round((o_custkey - q2) / iqr, 6) AS o_custkey FROM orders, s""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(fe.scale(o, fe.fit_scales(o, {"o_totalprice": "standard", "o_custkey": "robust"})), "o_totalprice", "o_custkey")


@query("f16_one_hot", """SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT AS seg_AUTOMOBILE, (c_mktsegment = 'BUILDING')::INT AS seg_BUILDING, (c_mktsegment = 'HOUSEHOLD')::INT AS seg_HOUSEHOLD,
  (c_mktsegment = 'MACHINERY')::INT AS seg_MACHINERY, (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY'))::INT AS seg_missing FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("seg"))
    return fe.one_hot(c, "seg", fe.categories(c, "seg"))


@query("f17_feature_hashing", """SELECT count(DISTINCT p_brand) AS tokens, count(*) AS rows FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    made = fe.fit_preprocessor(p, [], ["p_brand"], encodings={"p_brand": "hash"}).transform(p)
    return made.groupBy("features").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("rows"))


MI_SQL = " UNION ALL ".join("SELECT '{c}' AS col, l_returnflag AS y, ".format(c=c) + " + ".join(
    f"CASE WHEN {c} > (SELECT quantile_cont({c}, {i / 10}) FROM lineitem) THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS bin FROM lineitem" for c in NUM)


@query("f20_mutual_information", f"""WITH b AS ({MI_SQL}), j AS (SELECT col, bin, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
  p AS (SELECT *, sum(n) OVER (PARTITION BY col) AS t, sum(n) OVER (PARTITION BY col, bin) AS nb, sum(n) OVER (PARTITION BY col, y) AS ny FROM j)
SELECT col AS "column", round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi FROM p GROUP BY col""")
def _(spark, d):
    return rounded(fe.mutual_information(table(spark, d, "lineitem"), NUM, "l_returnflag"), "mi")


@query("f21_feature_level", """WITH t AS (SELECT p_partkey AS did, CASE p_partkey % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'light' WHEN 2 THEN 'medium' WHEN 3 THEN 'full' ELSE 'auto' END AS asked,
  CASE WHEN p_size * 6000 < 50000 THEN 3 WHEN p_size * 6000 <= 200000 THEN 2 ELSE 1 END AS cap, p_size / 50 AS score FROM part)
SELECT did, (['off', 'light', 'medium', 'full'])[1 + CASE WHEN asked = 'auto' THEN CASE WHEN score >= 0.85 THEN greatest(1, cap - 1) ELSE cap END
  ELSE least(cap, CASE asked WHEN 'off' THEN 0 WHEN 'light' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) END] AS level FROM t""")
def _(spark, d):
    k = F.col("p_partkey") % 5
    asked = F.when(k == 0, "off").when(k == 1, "light").when(k == 2, "medium").when(k == 3, "full").otherwise("auto")
    safe = profile.feature_level(profile.size_category(F.col("p_size") * 6000))
    return table(spark, d, "part").select(F.col("p_partkey").alias("did"), fe.capped_level(asked, safe, F.col("p_size") / 50).alias("level"))


@query("f22_pca", """SELECT count(*) AS n, 16 AS size, TRUE AS centred, TRUE AS uncorrelated, TRUE AS falling, TRUE AS within_total FROM embeddings""")
def _(spark, d):
    """What makes components principal: mean zero, no correlation, falling variances whose sum is at most that of the columns."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    made = fe.reduce_vectors(e, "embedding", fe.fit_pca(e, "embedding", 16), 16).select("embedding", F.col("reduced").alias("r"))
    wide = made.select(*[F.col("r")[i].alias(f"r{i}") for i in range(16)], *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    facts = wide.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"r{i}") for i in range(16)]).alias("m"), F.array(*[F.var_pop(f"r{i}") for i in range(16)]).alias("v"),
        F.array(*[F.corr(f"r{i}", f"r{j}") for i, j in combinations(range(16), 2)]).alias("c"), sum((F.var_pop(f"e{i}") for i in range(64)), F.lit(0.0)).alias("t"))
    falls = F.forall(F.sequence(F.lit(1), F.lit(15)), lambda i: F.element_at("v", i) + 1e-12 >= F.element_at("v", i + 1))
    return facts.select(
        "n", F.size("v").alias("size"), F.forall("m", lambda x: F.abs(x) < 1e-6).alias("centred"), F.forall("c", lambda x: F.abs(x) < 1e-6).alias("uncorrelated"),
        falls.alias("falling"), (F.aggregate("v", F.lit(0.0), lambda a, b: a + b) <= F.col("t") + 1e-9).alias("within_total"))


def vx_norm(col):
    from ..functions.vectors import norm

    return norm(F.col(col))


@query("f23_text_vectors")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return fe.text_vectors(t, "text", size=32).select("doc_id", F.size("vector").alias("size"), F.round(vx_norm("vector"), 3).alias("norm"))


@query("f24_pooled_vectors", """SELECT label, CAST(i AS BIGINT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY label, i""")
def _(spark, d):
    m = fe.pooled_vectors(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", F.posexplode("mean_vector").alias("p", "x"))
    return m.select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", R).alias("x"))


@query("f18_dense_bypass", """SELECT vec_id, 64 AS width, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::DOUBLE)), 6) AS checksum FROM embeddings""")
def _(spark, d):
    """Sixty-four numeric columns and no others stay as they are: no fill, no scaling."""
    wide = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    made = fe.fit_preprocessor(wide, [f"e{i}" for i in range(64)], []).transform(wide).select("vec_id", vector_to_array("features").alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return made.select("vec_id", F.size("v").alias("width"), F.round(weighted, R).alias("checksum"))


@query("f19_preprocess", f"""WITH {ORDERS_WITH_GAPS}, f AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM g)) AS price, o_custkey::DOUBLE AS cust,
    coalesce(o_orderstatus, 'missing') AS status FROM g),
  q AS (SELECT quantile_cont(cust, 0.25) AS a, quantile_cont(cust, 0.5) AS b, quantile_cont(cust, 0.75) AS c, avg(price) AS m, stddev_pop(price) AS s FROM f),
  k AS (SELECT list_sort(list(DISTINCT status)) AS levels FROM f),
  v AS (SELECT o_orderkey, list_concat([(price - m) / s, (cust - b) / (c - a)], list_transform(levels, lambda x: (x = status)::INT::DOUBLE)) AS v FROM f, q, k)
SELECT o_orderkey, CAST(i - 1 AS INT) AS pos, round(v[i], 6) AS value FROM v, unnest(range(1, len(v) + 1)) AS t(i)""")
def _(spark, d):
    """Fills, a scaler for each column, and one-hot levels in one vector."""
    g = orders_with_gaps(spark, d)
    model = fe.fit_preprocessor(g, ["o_totalprice", "o_custkey"], ["o_orderstatus"], {"o_totalprice": "standard", "o_custkey": "robust"})
    return model.transform(g).select("o_orderkey", F.posexplode(vector_to_array("features")).alias("pos", "v")).select("o_orderkey", "pos", F.round("v", R).alias("value"))


@query("a20_f19_steps", """WITH t AS (SELECT p_partkey, p_brand, p_size, p_retailprice, count(*) OVER (PARTITION BY p_brand) / count(*) OVER () AS share FROM part)
SELECT p_partkey, round(share, 6) AS p_brand, p_size, CAST(p_size * p_size AS BIGINT) AS squared FROM t""")
def _(spark, d):
    """A plan of chosen steps: a frequency encoding that the encoding plan asked for, and squares."""
    p = table(spark, d, "part").withColumn("flat", F.lit(1))
    steps = [fe.drop_constant(), fe.encode_values({"p_brand": "frequency"}), fe.square(1)]
    made = fe.FeaturePlan.fit(p, ["flat", "p_brand", "p_size"], "p_retailprice", ["p_partkey"], [*steps]).apply(p)
    return made.select("p_partkey", F.round("p_brand", R).alias("p_brand"), "p_size", F.col("p_size__squared").cast("long").alias("squared"))


@query("f_feature_plan")
def _(spark, d):
    """The whole plan: fit on the earlier orders, apply to all of them."""
    o = table(spark, d, "orders").withColumn("o_days", F.datediff("o_orderdate", F.lit("1995-01-01"))).withColumn(
        "late", F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0))
    feats = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_days"]
    train = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"))
    plan = fe.FeaturePlan.fit(train, feats, "late", ["o_orderkey"])
    return plan.apply(o.select("o_orderkey", "late", *feats))
