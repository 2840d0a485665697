"""Queries over sources, cleaning, set operations and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fx
from ..operators import clean, ordering, profile, setops, split
from ..session import scratch_path
from ..sources import files, tables
from .registry import query, table

R = 6

# ---- inputs -------------------------------------------------------------------------------------


def orders_with_gaps(spark, d):
    """orders with some missing prices, priorities and statuses (the tables hold no NULL)."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 17 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_WITH_GAPS = """g AS (SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# ---- sources and sinks --------------------------------------------------------------------------


@query("s1_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    path = scratch_path(spark, "customer") + ".csv"
    tables.write_metrics(c, path)
    return tables.read_table(spark, path, c.schema)


@query("s3_labeled_files", """SELECT 'source=' || source AS label, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
  FROM documents GROUP BY source""")
def _(spark, d):
    path = scratch_path(spark, "labeled")
    table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(path)
    found = files.scan_labeled_files(spark, path, [".txt"])
    return found.groupBy("label").agg(F.sum(F.length(F.decode("content", "UTF-8"))).alias("n_chars"))


EXT_SQL = """CASE doc_id % 7 WHEN 0 THEN '.JPG' WHEN 1 THEN '.wav' WHEN 2 THEN '.mp4' WHEN 3 THEN '.csv'
  ELSE CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.png' WHEN 'fr' THEN '.mp3' ELSE '.parquet' END END"""


def document_paths(spark, d):
    k = F.col("doc_id") % 7
    ext = (
        F.when(k == 0, ".JPG").when(k == 1, ".wav").when(k == 2, ".mp4").when(k == 3, ".csv")
        .when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".png")
        .when(F.col("lang") == "fr", ".mp3").otherwise(".parquet")
    )
    return table(spark, d, "documents").select(
        "source", F.concat_ws("/", F.lit("/data"), "source", F.concat(F.lit("f.v2_"), "doc_id", ext)).alias("path")
    )


@query("s4_modality", f"""WITH e AS (SELECT source, lower({EXT_SQL}) AS ext FROM documents),
  c AS (SELECT source, ext, count(*) AS n FROM e GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, ext) AS rn FROM c)
SELECT source, CASE WHEN ext IN ('.jpg','.jpeg','.png','.bmp','.tiff','.webp') THEN 'vision'
  WHEN ext IN ('.txt','.csv','.json','.md') THEN 'text' WHEN ext IN ('.wav','.mp3','.flac','.ogg') THEN 'audio'
  WHEN ext IN ('.mp4','.avi','.mov','.mkv') THEN 'video' ELSE 'tabular' END AS modality FROM r WHERE rn = 1""")
def _(spark, d):
    return files.detect_modality(document_paths(spark, d), by=["source"])


@query("s4_modality_present", f"""WITH e AS (SELECT source, lower({EXT_SQL}) AS ext FROM documents)
SELECT source, CASE WHEN bool_or(ext IN ('.jpg','.png','.jpeg')) THEN 'vision' WHEN bool_or(ext IN ('.wav','.mp3')) THEN 'audio'
  WHEN bool_or(ext IN ('.txt','.json')) THEN 'text' WHEN bool_or(ext IN ('.mp4','.avi')) THEN 'video' ELSE 'tabular' END AS modality
FROM e GROUP BY source""")
def _(spark, d):
    return files.modality_present(document_paths(spark, d), by=["source"])


@query("s5_text_bodies", """SELECT lang AS label, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
  FROM documents GROUP BY lang""")
def _(spark, d):
    path = scratch_path(spark, "bodies")
    table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    label = F.regexp_extract("path", "lang=([^/]+)", 1).alias("label")
    return files.read_text_bodies(spark, path).groupBy(label).agg(F.sum(F.length("text")).alias("n_chars"))


@query("s7_merge_memory", """SELECT o_custkey AS k, min(o_orderkey) AS first_order FROM orders WHERE o_custkey % 2 = 1 GROUP BY o_custkey
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 2 = 0""")
def _(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("at"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("long").alias("at")).where("k % 2 = 1")
    held = lambda t: t.withColumn("settings", F.create_map(F.lit("order"), F.col("at")))
    merged = setops.merge_new(held(old), held(new), "k", order_by="at")
    return merged.select("k", F.col("settings")["order"].alias("first_order"))


@query("s7_merge_new", """WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT k, 'existing' AS origin FROM e
UNION ALL SELECT c_custkey, 'incoming' FROM customer WHERE c_custkey NOT IN (SELECT k FROM e)""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("incoming").alias("origin"))
    return setops.merge_new(o.withColumn("origin", F.lit("existing")), c.unionByName(c), "k")


@query("s8_metrics_sink", """SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS avg_discount
  FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), R).alias("avg_discount"))
    path = scratch_path(spark, "metrics") + ".csv"
    tables.write_metrics(m, path)
    return tables.read_table(spark, path, m.schema)


@query("s9_append_log", """SELECT event_type, user_id, round(value, 6) AS value, 'first' AS batch FROM events
  UNION ALL SELECT event_type, user_id, round(value * 2, 6), 'second' FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "value")
    path = scratch_path(spark, "log")
    tables.append_log(e.select("event_type", "user_id", F.round("value", R).alias("value"), F.lit("first").alias("batch")), path)
    tables.append_log(e.select("event_type", "user_id", F.round(F.col("value") * 2, R).alias("value"), F.lit("second").alias("batch")), path)
    return spark.read.parquet(path)


@query("s11_remaining", """SELECT DISTINCT o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(spark, d):
    done = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return setops.remaining(table(spark, d, "orders"), done, "o_custkey")


CATALOG = """cat AS (SELECT p_partkey AS did, CAST(p_size * 3000 AS BIGINT) AS n_rows, CAST(p_partkey % 300 AS BIGINT) AS n_features,
  CASE WHEN p_size % 7 <> 0 THEN p_size END AS n_classes, p_brand FROM part)"""


def catalog(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("did"), (F.col("p_size") * 3000).cast("long").alias("n_rows"),
        (F.col("p_partkey") % 300).alias("n_features"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("n_classes"), "p_brand",
    )


@query("s12_select_catalog", f"""WITH {CATALOG} SELECT did, n_rows, n_features, n_classes FROM cat
  WHERE n_rows > 50 AND n_rows < 100000 AND n_features < 200 AND coalesce(n_classes, 0) <= 20 AND p_brand <> 'Brand#1'
  ORDER BY did LIMIT 150""")
def _(spark, d):
    c = catalog(spark, d)
    return setops.select_catalog(c.drop("p_brand"), c.where("p_brand = 'Brand#1'"))


# ---- projections, filters -----------------------------------------------------------------------


@query("p3_sanitize_values", r"""SELECT page_id, regexp_replace(url, '[\[\]{}"'':,<>]', '', 'g') AS url,
  regexp_replace(html, '[\[\]{}"'':,<>]', '', 'g') AS html FROM pages""")
def _(spark, d):
    return clean.sanitize_values(table(spark, d, "pages"), ["url", "html"])


@query("p5_id_columns", """SELECT 'event_id' AS "column", count(DISTINCT event_id) AS n_unique,
  count(DISTINCT event_id) > 0.5 * count(*) AS dropped FROM events
UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(DISTINCT user_id) > 0.5 * count(*) FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    left = clean.drop_id_columns(e, "event_type").columns
    return profile.unique_ratio(e, ["event_id", "user_id"]).select(
        "column", "n_unique", (~F.col("column").isin(left)).alias("dropped"))


@query("p6_constant_columns", """SELECT 'l_quantity' AS "column", round(var_samp(l_quantity), 6) AS variance, var_samp(l_quantity) < 0.000001 AS constant FROM lineitem
UNION ALL SELECT 'l_discount', round(var_samp(l_discount), 6), var_samp(l_discount) < 0.000001 FROM lineitem
UNION ALL SELECT 'flat', round(var_samp(l_tax * 0 + 3), 6), var_samp(l_tax * 0 + 3) < 0.000001 FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("flat", F.col("l_tax") * 0 + 3)
    return clean.variance_table(li, ["l_quantity", "l_discount", "flat"]).select(
        "column", F.round("variance", R).alias("variance"), "constant")


@query("p7_minimum_rows", """SELECT user_id, count(*) AS n FROM events WHERE user_id IN
  (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 50) GROUP BY user_id""")
def _(spark, d):
    return clean.minimum_rows(table(spark, d, "events"), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("p8_preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return clean.preview(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("p9_delete_keys", """SELECT o_orderkey, o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return clean.delete_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("p10_number_or", """SELECT p_partkey, coalesce(TRY_CAST(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_retailprice AS VARCHAR)
  ELSE replace(p_brand, 'Brand#', '') END AS DOUBLE), 0.0) AS value FROM part""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_retailprice").cast("string")).otherwise(
        F.regexp_replace("p_brand", "Brand#", ""))
    return table(spark, d, "part").select("p_partkey", fx.number_or(raw).alias("value"))


@query("p11_downcast", """SELECT 'o_orderkey' AS "column", CASE WHEN max(o_orderkey) < 128 THEN 'tinyint' WHEN max(o_orderkey) < 32768 THEN 'smallint'
  WHEN max(o_orderkey) < 2147483648 THEN 'int' ELSE 'bigint' END AS type, CAST(sum(CAST(o_orderkey AS INT)) AS BIGINT) AS total FROM orders
UNION ALL SELECT 'o_custkey', CASE WHEN max(o_custkey) < 128 THEN 'tinyint' WHEN max(o_custkey) < 32768 THEN 'smallint'
  WHEN max(o_custkey) < 2147483648 THEN 'int' ELSE 'bigint' END, CAST(sum(CAST(o_custkey AS INT)) AS BIGINT) FROM orders
UNION ALL SELECT 'o_totalprice', 'float', CAST(count(o_totalprice) AS BIGINT) FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    plan = clean.downcast_plan(o)
    small = clean.downcast(o, plan)
    total = {"o_orderkey": F.sum("o_orderkey"), "o_custkey": F.sum("o_custkey"), "o_totalprice": F.count("o_totalprice")}
    return small.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), total[c].cast("long").alias("total")) for c, t in plan.items()
    ]).alias("a")).select(F.inline("a"))


@query("p12_audit_equation", """SELECT count(*) AS total, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS mismatches,
  round(100.0 * sum(CASE WHEN bad THEN 1 ELSE 0 END) / count(*), 6) AS mismatch_pct FROM (
  SELECT abs(l_quantity * 1000 - l_extendedprice) > 0.0001 + 0.00001 * abs(l_extendedprice) AS bad FROM lineitem)""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return clean.audit_equation(li, F.col("l_quantity") * 1000, F.col("l_extendedprice")).withColumn(
        "mismatch_pct", F.round("mismatch_pct", R))


@query("p13_size_category", """SELECT did, n_rows, CASE WHEN n_rows < 50000 THEN 'small' WHEN n_rows <= 200000 THEN 'medium' ELSE 'large' END AS category,
  CASE WHEN n_rows < 50000 THEN 'full' WHEN n_rows <= 200000 THEN 'medium' ELSE 'light' END AS fe_level,
  CASE WHEN n_rows < 50000 THEN 5 WHEN n_rows <= 200000 THEN 2 ELSE 0 END AS interactions
  FROM (SELECT p_partkey AS did, CAST(p_size AS BIGINT) * 6000 AS n_rows FROM part)""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("did"), (F.col("p_size").cast("long") * 6000).alias("n_rows"))
    cat = profile.size_category(F.col("n_rows"))
    return rows.select("did", "n_rows", cat.alias("category"), profile.feature_level(cat).alias("fe_level"),
                       profile.interaction_limit(cat).alias("interactions"))


# ---- cleaning -----------------------------------------------------------------------------------


@query("c1_dedupe_first", f"""WITH {ORDERS_WITH_GAPS}, f AS (SELECT o_orderstatus, o_orderpriority, CAST(o_custkey % 50 AS INT) AS grp, o_orderkey, o_totalprice FROM g)
SELECT o_orderstatus, o_orderpriority, grp, o_orderkey, o_totalprice FROM f
QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, grp ORDER BY o_orderkey) = 1""")
def _(spark, d):
    f = orders_with_gaps(spark, d).select(
        "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 50).cast("int").alias("grp"), "o_orderkey", "o_totalprice")
    return clean.dedupe_first(f, ["o_orderstatus", "o_orderpriority", "grp"], "o_orderkey")


MODE_SQL = """(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query("c2_c3_fill", f"""WITH {ORDERS_WITH_GAPS}
SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM g)) AS o_totalprice,
  coalesce(o_orderstatus, {MODE_SQL.format(c='o_orderstatus')}) AS o_orderstatus,
  coalesce(o_orderpriority, {MODE_SQL.format(c='o_orderpriority')}) AS o_orderpriority FROM g""")
def _(spark, d):
    g = orders_with_gaps(spark, d)
    fills = clean.fit_fill(g, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    return clean.fill(g, fills).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("c4_constant_fill", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, coalesce(o_orderstatus, 'missing') AS o_orderstatus,
  coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM g""")
def _(spark, d):
    g = orders_with_gaps(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return clean.constant_fill(g, ["o_orderstatus", "o_orderpriority"])


@query("c5_forward_fill", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey,
  last_value(o_orderstatus IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_orderstatus FROM g""")
def _(spark, d):
    g = orders_with_gaps(spark, d).select("o_orderkey", "o_orderstatus")
    return clean.forward_fill_target(g, "o_orderstatus", "o_orderkey")


@query("c6_label_index", f"""WITH {ORDERS_WITH_GAPS}, u AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS label
  FROM (SELECT DISTINCT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL))
SELECT o_orderkey, g.o_orderpriority, label FROM g LEFT JOIN u USING (o_orderpriority)""")
def _(spark, d):
    g = orders_with_gaps(spark, d).select("o_orderkey", "o_orderpriority")
    return clean.label_index(g, "o_orderpriority", "label")


@query("c6_label_index_wide", """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INT) AS label FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return clean.label_index(c, "c_name", "label").select("c_custkey", "label")


@query("c8_c9_target_kind", """WITH t AS (SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus) AS n, true AS is_text FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), true FROM orders
  UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), false FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), false FROM orders)
SELECT target, n AS n_unique, CASE WHEN n < 10 THEN 'classification' ELSE 'regression' END AS problem_type,
  CASE WHEN n <= 2 THEN 0 WHEN n <= 20 OR is_text THEN 2 ELSE 1 END AS task_type FROM t""")
def _(spark, d):
    o = table(spark, d, "orders")
    text = profile.column_types(o)["categorical"]
    u = profile.unique_ratio(o, ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"])
    return u.select(
        F.col("column").alias("target"), "n_unique", profile.problem_type(F.col("n_unique")).alias("problem_type"),
        profile.task_type(F.col("n_unique"), F.col("column").isin(text)).alias("task_type"))


@query("c10_leaky_columns", """WITH l AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
SELECT 'l_quantity' AS "column", round(abs(corr(l_quantity, l_extendedprice)), 6) AS abs_corr, abs(corr(l_quantity, l_extendedprice)) > 0.95 AS leaky FROM l
UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6), abs(corr(l_tax, l_extendedprice)) > 0.95 FROM l
UNION ALL SELECT 'net', round(abs(corr(net, l_extendedprice)), 6), abs(corr(net, l_extendedprice)) > 0.95 FROM l""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return clean.leaky_columns(li, ["l_quantity", "l_tax", "net"], "l_extendedprice").withColumn("abs_corr", F.round("abs_corr", R))


def _tree_sql(cols, depth=3, grid=1024, share=256):
    """AUC of a greedy Gini tree per column of t (y and the columns), over a grid whose crowded bins are cut once more."""
    parts = []
    for c in cols:
        step = lambda cuts: f"CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter({cuts}, lambda q: q < {c})) END"
        parts.append(f"""end_{c} AS (SELECT list_sort(list_distinct(list_filter([min({c}) FILTER (WHERE y > 0), max({c}) FILTER (WHERE y > 0), min({c}) FILTER (WHERE y <= 0), max({c}) FILTER (WHERE y <= 0)],
    lambda q: q IS NOT NULL)))::DOUBLE[] AS e FROM t),
  cut_{c} AS MATERIALIZED (SELECT list_sort(list_distinct(list_concat(list_transform(range(1, {grid}), lambda i: e[1] + (e[-1] - e[1]) * i / {grid}),
    list_concat(e, list_transform(e, lambda q: nextafter(q, '-inf'::DOUBLE)))))) AS v FROM end_{c}),
  val_{c} AS MATERIALIZED (SELECT {c}, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM t GROUP BY {c}),
  one_{c} AS (SELECT {step('v')} AS bin, sum(pos) AS pos, sum(n) AS n, count(*) AS kinds FROM val_{c}, cut_{c} GROUP BY 1),
  big_{c} AS (SELECT bin FROM one_{c}, cut_{c} WHERE bin > 0 AND bin < len(v) AND kinds > 1
    AND (pos * {share} > (SELECT sum(pos) FROM one_{c}) OR (n - pos) * {share} > (SELECT sum(n) - sum(pos) FROM one_{c}))),
  fine_{c} AS MATERIALIZED (SELECT list_sort(list_distinct(list_concat(v, coalesce((SELECT list(v[bin] + (v[bin + 1] - v[bin]) * m / 64) FROM big_{c}, cut_{c}, range(1, 64) AS k(m)), [])))) AS v FROM cut_{c}),
  bin_{c} AS (SELECT '{c}' AS col, {step('v')} AS bin, pos, n FROM val_{c}, fine_{c})""")
    union = " UNION ALL ".join(f"SELECT * FROM bin_{c}" for c in cols)
    parts.append(f"n0 AS (SELECT col, bin, sum(pos) AS pos, sum(n) AS n, 1 AS node FROM ({union}) GROUP BY col, bin)")
    pure = lambda p, m: f"(({p}) * ({p}) + (({m}) - ({p})) * (({m}) - ({p}))) / ({m})"
    for k in range(depth):
        parts.append(f"""c{k} AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER a AS tp, sum(n) OVER a AS tn FROM n{k}
    WINDOW w AS (PARTITION BY col, node ORDER BY bin), a AS (PARTITION BY col, node)),
  g{k} AS (SELECT col, node, bin, round(({pure('cp', 'cn')} + {pure('tp - cp', 'tn - cn')}) / tn, 12) AS score, round({pure('tp', 'tn')} / tn, 12) AS was FROM c{k} WHERE cn < tn),
  s{k} AS (SELECT * FROM g{k} WHERE score > was + 1e-12 QUALIFY row_number() OVER (PARTITION BY col, node ORDER BY score DESC, bin) = 1),
  n{k + 1} AS (SELECT n.col, n.bin, n.pos, n.n, 2 * n.node + coalesce(n.bin > s.bin, FALSE)::INT AS node FROM n{k} n LEFT JOIN s{k} s ON n.col = s.col AND n.node = s.node)""")
    parts.append(f"""leaf AS (SELECT col, node, sum(pos) AS pos, sum(n) - sum(pos) AS neg FROM n{depth} GROUP BY col, node),
  tied AS (SELECT col, round(pos / (pos + neg), 12) AS share, sum(pos) AS pos, sum(neg) AS neg FROM leaf GROUP BY ALL),
  up AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY col ORDER BY share DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM tied),
  auc AS (SELECT col, sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM up GROUP BY col)
SELECT col AS "column", round(auc, 6) AS auc, auc > 0.98 AS leaky FROM auc""")
    return ",\n  ".join(parts)


@query("c11_rare_positives", f"""WITH t AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN 1.0 ELSE 0.0 END AS y, l_discount, l_discount - 5 * (CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS below,
    CASE WHEN l_orderkey % 97 = 0 THEN 0.55 + l_discount / 1000 ELSE l_discount * 10 END AS inside, CASE WHEN l_orderkey % 97 <> 0 THEN l_tax END AS missing FROM lineitem),
  {_tree_sql(['below', 'inside', 'missing', 'l_discount'])}""")
def _(spark, d):
    """One positive in a hundred: below all others, in a band inside their range, marked by NULL, and not told apart at all."""
    rare = F.col("l_orderkey") % 97 == 0
    t = table(spark, d, "lineitem").select(
        F.when(rare, 1.0).otherwise(0.0).alias("y"), "l_discount", (F.col("l_discount") - 5 * rare.cast("int")).alias("below"),
        F.when(rare, 0.55 + F.col("l_discount") / 1000).otherwise(F.col("l_discount") * 10).alias("inside"), F.when(~rare, F.col("l_tax")).alias("missing"))
    return clean.leaky_by_auc(t, ["below", "inside", "missing", "l_discount"], "y").withColumn("auc", F.round("auc", R))


@query("c11_leaky_by_auc", f"""WITH t AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS y,
    CASE WHEN l_returnflag = 'A' THEN 100.0 ELSE 0.0 END + l_discount AS leak FROM lineitem),
  {_tree_sql(['l_quantity', 'l_extendedprice', 'leak'])}""")
def _(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)
    t = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", flag.alias("y"), (flag * 100 + F.col("l_discount")).alias("leak"))
    return clean.leaky_by_auc(t, ["l_quantity", "l_extendedprice", "leak"], "y").withColumn("auc", F.round("auc", R))


@query("s2_p1_features", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderstatus, 'o_custkey,o_totalprice,o_orderdate,o_orderpriority' AS features, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM g GROUP BY 1""")
def _(spark, d):
    """The target is checked and taken out of the features; a wrong name lists what there is."""
    g = orders_with_gaps(spark, d)
    try:
        clean.require_column(g, "o_status")
        raise AssertionError("a missing target must be refused")
    except ValueError as refused:
        assert "o_orderstatus" in str(refused)
    features = clean.feature_columns(g, "o_orderstatus", ["o_orderkey"])
    return g.groupBy("o_orderstatus").agg(F.lit(",".join(features)).alias("features"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("p2_clean_names", """SELECT 'l_quantity_per_order_' AS "column", 'replace' AS rule, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'price_EUR_', 'replace', round(sum(l_extendedprice), 2) FROM lineitem
  UNION ALL SELECT 'lquantity_per_order', 'delete', round(sum(l_quantity), 2) FROM lineitem UNION ALL SELECT 'price_EUR', 'delete', round(sum(l_extendedprice), 2) FROM lineitem""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    out = None
    for rule, names in (("replace", ("l_quantity per\torder]", "price:EUR}")), ("delete", ("l[quantity:per,order]", "price:EUR>"))):
        named = clean.clean_names(lines.select(F.col("l_quantity").alias(names[0]), F.col("l_extendedprice").alias(names[1])), rule)
        sums = profile.per_column(named, named.columns, {"total": lambda c: F.round(F.sum(c), 2)}).select("column", F.lit(rule).alias("rule"), "total")
        out = sums if out is None else out.unionByName(sums)
    return out


@query("c7_fill_values", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_totalprice, 0) AS o_totalprice, coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM g""")
def _(spark, d):
    """NULLs become the empty text, zero or a tag, by column."""
    g = orders_with_gaps(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return clean.constant_fill(clean.fill(g, {"o_orderstatus": "", "o_totalprice": 0.0}), ["o_orderpriority"], "missing")


@query("c12_to_numeric", f"""WITH {ORDERS_WITH_GAPS}, f AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM g)) AS o_totalprice,
  coalesce(o_orderstatus, {MODE_SQL.format(c='o_orderstatus')}) AS o_orderstatus,
  coalesce(o_orderpriority, {MODE_SQL.format(c='o_orderpriority')}) AS o_orderpriority FROM g)
SELECT f.o_orderkey, f.o_totalprice, CAST(dense_rank() OVER (ORDER BY f.o_orderstatus) - 1 AS INT) AS o_orderstatus,
  CAST(dense_rank() OVER (ORDER BY f.o_orderpriority) - 1 AS INT) AS o_orderpriority, CAST(epoch(o.o_orderdate::TIMESTAMP) AS DOUBLE) AS o_orderdate
FROM f JOIN orders o USING (o_orderkey)""")
def _(spark, d):
    g = orders_with_gaps(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return clean.to_numeric(g, keep=["o_orderkey"])


# ---- splits -------------------------------------------------------------------------------------

# Order key for the checkable splits: a fixed permutation of the keys.
PERM_SQL = "(o_orderkey * 7919) % 1000003"


def permuted_orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", ((F.col("o_orderkey") * 7919) % 1000003).alias("perm"))


@query("x2_stratified_split", f"""WITH r AS (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {PERM_SQL}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    return split.stratified_split(permuted_orders(spark, d), "o_orderpriority", ["o_orderkey"], 0.2, order=["perm"]).select(
        "o_orderkey", "o_orderpriority", "split")


@query("x2_x3_hot_order", """WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber, l_orderkey, l_extendedprice, l_quantity) AS place,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
  p AS (SELECT l_returnflag, l_quantity, CASE WHEN place <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r UNION ALL SELECT l_returnflag, l_quantity, 'fold' || (place - 1) % 5 FROM r)
SELECT l_returnflag, part, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM p GROUP BY ALL""")
def _(spark, d):
    """Split and folds in an order whose seven values hold many rows each."""
    key = ["l_orderkey", "l_extendedprice", "l_quantity"]
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", *key)
    parts = split.stratified_split(t, "l_returnflag", key, 0.2, order=["l_linenumber"]).withColumnRenamed("split", "part")
    folds = split.folds(t, "l_returnflag", key, 5, order=["l_linenumber"]).withColumn("part", F.concat(F.lit("fold"), "fold"))
    both = parts.select("l_returnflag", "part", "l_quantity").unionByName(folds.select("l_returnflag", "part", "l_quantity"))
    return both.groupBy("l_returnflag", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), R).alias("quantity"))


@query("x3_folds", f"""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {PERM_SQL}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders""")
def _(spark, d):
    return split.folds(permuted_orders(spark, d), "o_orderpriority", ["o_orderkey"], 5, order=["perm"]).select("o_orderkey", "fold")


@query("x1_cap_rows", "SELECT least(2000, count(*)) AS n, least(2000, count(*)) AS n_keys FROM orders")
def _(spark, d):
    capped = split.cap_rows(table(spark, d, "orders"), "o_orderkey", 2000)
    return capped.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("x1_sample_share", "SELECT greatest(CAST(floor(count(*) * 0.3) AS BIGINT), 50) AS n, greatest(CAST(floor(count(*) * 0.3) AS BIGINT), 50) AS n_keys FROM orders")
def _(spark, d):
    part = split.sample_share(table(spark, d, "orders"), "o_orderkey", 0.3)
    return part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("x2_hash_split_sizes", """SELECT o_orderpriority, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test,
  CAST(count(*) - round(count(*) * 0.2) AS BIGINT) AS n_train FROM orders GROUP BY o_orderpriority""")
def _(spark, d):
    s = split.stratified_split(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])
    return s.groupBy("o_orderpriority").agg(
        F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("split") == "train").alias("n_train"))


@query("x4_holdout", """SELECT CAST(sum(t) AS BIGINT) AS n_test, CAST(sum(n - t) AS BIGINT) AS n_train FROM
  (SELECT round(count(*) * 0.15) AS t, count(*) AS n FROM orders GROUP BY o_orderstatus)""")
def _(spark, d):
    s = split.holdout(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"])
    return s.agg(F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("split") == "train").alias("n_train"))


@query("x5_cap_per_class", """SELECT o_orderkey, o_orderpriority FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 100""")
def _(spark, d):
    return split.cap_per_class(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("x6_split_ids", """WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)
SELECT 'test' AS part, CAST(round(n * 0.2) AS BIGINT) AS ids FROM n UNION ALL SELECT 'memory', CAST(n - round(n * 0.2) AS BIGINT) FROM n""")
def _(spark, d):
    return split.split_ids(table(spark, d, "orders"), "o_custkey").groupBy("part").agg(F.count(F.lit(1)).alias("ids"))


# ---- set operations, joins on keys --------------------------------------------------------------


@query("u1_union_rows", """SELECT o_orderkey, o_totalprice, 'train' AS split FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
  UNION ALL SELECT o_orderkey, o_totalprice, 'test' FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def _(spark, d):
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")
    cols = ["o_orderkey", "o_totalprice"]
    return o.where(early).select(*cols, F.lit("train").alias("split")).unionByName(
        o.where(~early).select(*cols, F.lit("test").alias("split")))


@query("u2_keep_last", """SELECT c_custkey AS k, CASE WHEN o.n IS NULL THEN 'customer' ELSE 'orders' END AS origin, coalesce(o.n, 0) AS n
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey
UNION ALL SELECT o_custkey, 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""")
def _(spark, d):
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"), F.lit(0).cast("long").alias("n"))
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.lit("orders").alias("origin"), F.count(F.lit(1)).alias("n"))
    return setops.concat_keep_last([first, last], ["k"])


NAMES = ["logistic", "rf", "gb", "lgbm_clf", "xgb_clf", "svc", "knn_clf"]


def _pick(k, *steps):
    """Model names chosen by integer arithmetic on a key."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array(*[F.element_at(names, ((k * s + i) % len(NAMES) + 1).cast("int")) for i, s in enumerate(steps)])


def _pick_sql(k, *steps):
    lit = "[" + ",".join(f"'{n}'" for n in NAMES) + "]"
    return "[" + ",".join(f"({lit})[CAST(({k} * {s} + {i}) % {len(NAMES)} AS INT) + 1]" for i, s in enumerate(steps)) + "]"


LISTS_SQL = f"lists AS (SELECT p_partkey AS id, {_pick_sql('p_partkey', 1, 3, 5)} AS a, {_pick_sql('p_size', 2, 1, 4)} AS b FROM part)"


def model_lists(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), _pick(F.col("p_partkey"), 1, 3, 5).alias("a"), _pick(F.col("p_size"), 2, 1, 4).alias("b"))


@query("u3_ordered_union", f"""WITH {LISTS_SQL}, u AS (SELECT id, unnest(a || b) AS m, generate_subscripts(a || b, 1) AS i FROM lists),
  f AS (SELECT id, m, min(i) AS i FROM u GROUP BY id, m)
SELECT id, string_agg(m, ',' ORDER BY i) AS models FROM f GROUP BY id""")
def _(spark, d):
    return model_lists(spark, d).select("id", F.array_join(setops.ordered_union(F.col("a"), F.col("b")), ",").alias("models"))


@query("u4_difference", f"""WITH {LISTS_SQL}, u AS (SELECT DISTINCT id, unnest(a) AS m, b FROM lists)
SELECT id, m AS model FROM u WHERE NOT list_contains(b, m)""")
def _(spark, d):
    return model_lists(spark, d).select("id", F.explode(F.array_except("a", "b")).alias("model"))


@query("u5_intersect", f"""WITH {LISTS_SQL}, u AS (SELECT DISTINCT id, unnest(a) AS m, b FROM lists)
SELECT id, m AS model FROM u WHERE list_contains(b, m)""")
def _(spark, d):
    return model_lists(spark, d).select("id", F.explode(F.array_intersect("a", "b")).alias("model"))


@query("u6_union_distinct", f"""WITH {LISTS_SQL} SELECT id, unnest(a) AS model FROM lists UNION SELECT id, unnest(b) FROM lists""")
def _(spark, d):
    return model_lists(spark, d).select("id", F.explode(F.array_union("a", "b")).alias("model"))


@query("j1_lookup_default", """WITH m AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, -1) AS n FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def _(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return setops.lookup(table(spark, d, "customer").select("c_custkey"), m, "c_custkey", "n", F.lit(-1).cast("long"), "n")


@query("j2_membership", f"""WITH {ORDERS_WITH_GAPS}, s AS (SELECT DISTINCT o_orderstatus AS v FROM g WHERE o_orderstatus = 'F')
SELECT 'in' AS form, count(*) AS n FROM g WHERE o_orderstatus IN (SELECT v FROM s)
UNION ALL SELECT 'not in', count(*) FROM g WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN (SELECT v FROM s)""")
def _(spark, d):
    g = orders_with_gaps(spark, d)
    s = g.where("o_orderstatus = 'F'").select("o_orderstatus")
    count = F.count(F.lit(1)).alias("n")
    return setops.member_of(g, s, "o_orderstatus").agg(F.lit("in").alias("form"), count).unionByName(
        setops.member_of(g, s, "o_orderstatus", negate=True).agg(F.lit("not in").alias("form"), count))


# ---- scalar functions ---------------------------------------------------------------------------


@query("fn_duration_seconds", """SELECT event_id, CAST((user_id % 90) * CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 1
  WHEN 2 THEN 3600 ELSE 60 END AS DOUBLE) AS seconds FROM events""")
def _(spark, d):
    k = F.col("event_id") % 4
    text = F.concat((F.col("user_id") % 90).cast("string"),
                    F.when(k == 0, "m").when(k == 1, "S ").when(k == 2, "h").otherwise(""))
    return table(spark, d, "events").select("event_id", fx.duration_seconds(text).cast("double").alias("seconds"))


@query("fn_safe_file_name", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[\\/*?:"<>|]', '_', 'g') AS name FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fx.safe_file_name(F.col("url")).alias("name"))


REPLY_SQL = """r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || text || '{x}</think>' || chr(10) || '```json' || chr(10) || '{"approved": true, "risk": ' || turn || '}' || chr(10) || '```'
  WHEN 1 THEN regexp_replace(text, '[{}]', '', 'g') || ' {"approved": false, "risk": ' || turn || '} done'
  WHEN 2 THEN '{"approved": true, "risk": ' || turn || '}' ELSE 'Rejected. ' || regexp_replace(text, '[{}]', '', 'g') END AS reply FROM conversations)"""


@query("g1_json_reply", f"""WITH {REPLY_SQL} SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE turn END AS risk,
  CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS approved FROM r""")
def _(spark, d):
    t = F.col("turn")
    bare = F.regexp_replace("text", "[{}]", "")
    body = lambda v: F.concat(F.lit('{"approved": %s, "risk": ' % v), t.cast("string"), F.lit("}"))
    reply = (
        F.when(t % 4 == 0, F.concat(F.lit("<think>"), "text", F.lit("{x}</think>\n```json\n"), body("true"), F.lit("\n```")))
        .when(t % 4 == 1, F.concat(bare, F.lit(" "), body("false"), F.lit(" done")))
        .when(t % 4 == 2, body("true"))
        .otherwise(F.concat(F.lit("Rejected. "), bare))
    )
    c = table(spark, d, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return c.select(
        "conv_id", "turn", F.get_json_object(fx.json_reply(F.col("reply")), "$.risk").cast("long").alias("risk"),
        fx.approval(F.col("reply")).alias("approved"))


@query("t3_top_columns", """WITH c AS (SELECT 'l_quantity' AS "column", abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem
  UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_linenumber', abs(corr(l_linenumber, l_extendedprice)) FROM lineitem)
SELECT "column", round(r, 6) AS abs_corr FROM c ORDER BY r DESC LIMIT 3""")
def _(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return profile.corr_with(table(spark, d, "lineitem"), cols, "l_extendedprice").limit(3).withColumn("abs_corr", F.round("abs_corr", R))


@query("t7_top_per_group", """SELECT o_custkey, o_orderkey, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
  WHERE rn <= 3""")
def _(spark, d):
    o = table(spark, d, "orders")
    return ordering.top_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("t9_running_total", """SELECT o_orderkey, o_orderstatus, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return ordering.running_sums(o, ["o_orderstatus"], "o_orderkey", {"total": "o_custkey"}).drop("o_custkey")
