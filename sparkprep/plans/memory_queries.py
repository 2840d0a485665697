"""Queries over vector search and retrieval decisions.

Every embedding is a query and every other embedding is memory (leave-one-out), so all of the table
takes part on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import vectors as vx
from ..operators import memory as mem
from ..operators import neighbors as nb
from ..session import cut_lineage, scratch_path
from ..sources import tables
from .registry import query, table

R = 6
K = 10
MODELS = ["rf", "logistic", "gb", "svc", "knn_clf", "lgbm_clf", "mlp_clf", "ridge", "xgb_clf", "bag_clf"]
def as_of():
    return F.lit("2024-04-01 00:00:00").cast("timestamp")
_M = "[" + ",".join(f"'{m}'" for m in MODELS) + "]"

# Attributes of the memory records, derived from the key by integer arithmetic in both engines.
MEM_SQL = f"""mem AS (SELECT vec_id, embedding::DOUBLE[] AS e, label,
  CASE WHEN vec_id % 11 <> 0 THEN ((vec_id * 37) % 101) / 100.0::DOUBLE END AS score,
  CASE WHEN vec_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((vec_id * 13) % 120 AS INT)) END AS recorded_at,
  CAST((vec_id * 7) % 50 + 1 AS DOUBLE) AS training_time,
  CASE WHEN vec_id % 3 = 0 THEN 'DL' ELSE 'ML' END AS paradigm,
  ({_M})[label + 1] AS m1, ({_M})[(label + 3) % 10 + 1] AS m2,
  CAST(vec_id % 4 + 1 AS VARCHAR) AS layers, ((vec_id * 53) % 97) / 100.0::DOUBLE AS f1,
  CASE WHEN vec_id % 5 = 0 THEN 'regression' ELSE 'classification' END AS problem FROM embeddings)"""


def records(spark, d):
    v, names = F.col("vec_id"), F.array(*[F.lit(m) for m in MODELS])
    return table(spark, d, "embeddings").select(
        "vec_id", "embedding", "label",
        F.when(v % 11 != 0, ((v * 37) % 101) / 100.0).alias("score"),
        F.when(v % 17 != 0, F.timestamp_add("DAY", ((v * 13) % 120).cast("int"), F.lit("2024-01-01").cast("timestamp"))).alias("recorded_at"),
        ((v * 7) % 50 + 1).cast("double").alias("training_time"),
        F.when(v % 3 == 0, "DL").otherwise("ML").alias("paradigm"),
        F.array(F.element_at(names, F.col("label") + 1), F.element_at(names, (F.col("label") + 3) % 10 + 1)).alias("models"),
        F.create_map(F.lit("layers"), (v % 4 + 1).cast("string")).alias("architecture_config"),
        F.struct(F.lit(0.0).alias("accuracy"), (((v * 53) % 97) / 100.0).alias("f1"), F.lit(0.0).alias("auc"),
                 F.lit(None).cast("double").alias("rmse")).alias("performance"),
        F.when(v % 5 == 0, "regression").otherwise("classification").alias("problem_type"),
    )


KNN_SQL = f"""{MEM_SQL}, pairs AS (SELECT q.vec_id AS query_id, m.vec_id AS memory_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - m.e[i]) * (q.e[i] - m.e[i]))) AS distance,
    CASE WHEN sqrt(list_inner_product(q.e, q.e)) < 1e-12 OR sqrt(list_inner_product(m.e, m.e)) < 1e-12 THEN 0.0
      ELSE greatest(0.0, least(1.0, list_inner_product(q.e, m.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(m.e, m.e))))) END AS similarity
    FROM mem q JOIN mem m ON q.vec_id <> m.vec_id),
  knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS INT) AS rank FROM pairs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) <= {K}),
  nei AS (SELECT knn.*, mem.* EXCLUDE (vec_id, e) FROM knn JOIN mem ON memory_id = vec_id)"""


def knn(spark, d, k=K, metric="l2"):
    e = table(spark, d, "embeddings")
    return nb.knn_join(e, e, k, query_id="vec_id", memory_id="vec_id", metric=metric, exclude_same=True)


def neighbors(spark, d, k=K):
    rec = records(spark, d)
    return nb.with_records(cut_lineage(knn(spark, d, k)), rec, "vec_id")  # read by several branches of a query


@query("j4_knn_join", f"WITH {KNN_SQL} SELECT query_id, memory_id, round(distance, 6) AS distance, rank FROM knn")
def _(spark, d):
    return knn(spark, d).drop("similarity").withColumn("distance", F.round("distance", R))


@query("j4_knn_join_blocks", f"WITH {KNN_SQL} SELECT query_id, memory_id, round(distance, 6) AS distance, rank FROM knn")
def _(spark, d):
    e = table(spark, d, "embeddings")
    size = e.count() * 64 * 8
    out = nb.knn_join(e, e, K, query_id="vec_id", memory_id="vec_id", exclude_same=True, broadcast_bytes=size // 3)
    return out.drop("similarity").withColumn("distance", F.round("distance", R))


@query("v3_knn_inner_product", f"""WITH {MEM_SQL}, p AS (SELECT q.vec_id AS query_id, m.vec_id AS memory_id, list_inner_product(q.e, m.e) AS ip
    FROM mem q JOIN mem m ON q.vec_id <> m.vec_id)
SELECT query_id, memory_id, round(ip, 6) AS ip, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ip DESC, memory_id) AS INT) AS rank FROM p
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ip DESC, memory_id) <= 5""")
def _(spark, d):
    return knn(spark, d, 5, "ip").select("query_id", "memory_id", F.round("distance", R).alias("ip"), "rank")


@query("j3_v1_neighbor_records", f"""WITH {KNN_SQL} SELECT query_id, memory_id, round(similarity, 6) AS similarity, label, m1 AS model FROM nei""")
def _(spark, d):
    return neighbors(spark, d).select("query_id", "memory_id", F.round("similarity", R).alias("similarity"), "label", F.col("models")[0].alias("model"))


@query("v4_pseudo_similarity", f"""WITH {KNN_SQL} SELECT query_id, memory_id, round(1 / (1 + distance), 6) AS similarity, 1 / (1 + distance) >= 0.6 AS warm FROM knn""")
def _(spark, d):
    return knn(spark, d).select(
        "query_id", "memory_id", F.round(vx.pseudo_similarity(F.col("distance")), R).alias("similarity"),
        mem.search_match(F.col("distance")).alias("warm"))


@query("p14_near_match", f"""WITH {KNN_SQL} SELECT query_id, distance <= 0.5 AS warm_start, 1 / (1 + distance) >= 0.6 AS search_match FROM knn WHERE rank = 1""")
def _(spark, d):
    return knn(spark, d, 1).select(
        "query_id", mem.near_match(F.col("distance")).alias("warm_start"), mem.search_match(F.col("distance")).alias("search_match"))


@query("j4_knn_work", """SELECT count(*) * count(*) AS pairs, TRUE AS fewer FROM embeddings""")
def _(spark, d):
    """Blocks that the exact join leaves out; the rows it finds are those of j4_knn_join_blocks."""
    e = table(spark, d, "embeddings")
    work = nb.knn_work(e, e, K, query_id="vec_id", memory_id="vec_id", exclude_same=True, broadcast_bytes=e.count() * 64 * 8 // 3)
    return work.select("pairs", (F.col("pairs_multiplied") <= F.col("pairs")).alias("fewer"))


@query("j5_knn_cells", """SELECT count(*) AS queries, 5 * count(*) AS neighbours, TRUE AS recall_reached, CAST(0 AS BIGINT) AS wrong_distances FROM embeddings""")
def _(spark, d):
    """Neighbours of the approximate join held against the exact ones: share found, and distances that differ."""
    e = table(spark, d, "embeddings")
    near = nb.knn_join_cells(e, e, 5, query_id="vec_id", memory_id="vec_id")
    truth = nb.knn_join(e, e, 5, query_id="vec_id", memory_id="vec_id").select("query_id", "memory_id", F.col("distance").alias("true_distance"))
    met = near.join(truth, ["query_id", "memory_id"], "left")
    return met.agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
        (F.count("true_distance") >= 0.95 * F.count(F.lit(1))).alias("recall_reached"), F.count_if(F.abs(F.col("distance") - F.col("true_distance")) > 1e-9).alias("wrong_distances"))


@query("j6_pair_spread", """WITH p AS (SELECT a.label, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS d2
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, count(*) AS pairs, round(sum(d2), 6) AS sum_sq_distance FROM p GROUP BY label""")
def _(spark, d):
    return nb.pair_spread(table(spark, d, "embeddings"), "label").withColumn("sum_sq_distance", F.round("sum_sq_distance", R))


@query("j7_negative_pairs", "SELECT greatest(2 * count(*), 100) AS pairs, CAST(0 AS BIGINT) AS same_family, CAST(0 AS BIGINT) AS wrong_family FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings")
    drawn = nb.negative_pairs(e, "vec_id", "label", max(2 * e.count(), 100))
    truth = e.select(F.col("vec_id").alias("a_id"), F.col("label").alias("label"))
    return drawn.join(truth, "a_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a_family") == F.col("b_family")).alias("same_family"),
        F.count_if(F.col("a_family") != F.col("label")).alias("wrong_family"))


@query("j8_mean_cosine", """WITH p AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT vec_id, round(avg(c), 6) AS mean_cosine FROM p GROUP BY vec_id""")
def _(spark, d):
    return nb.mean_cosine_to_others(table(spark, d, "embeddings"), "vec_id").withColumn("mean_cosine", F.round("mean_cosine", R))


@query("v22_contrastive_loss", """WITH p AS (SELECT list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS d2
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
  n AS (SELECT sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS gap FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label <> b.label),
  s AS (SELECT (SELECT count(*) FROM p) AS n_positive, (SELECT count(*) FROM n) AS n_negative, (SELECT sum(d2) FROM p) + (SELECT sum(pow(greatest(0, 1.5 - gap), 2)) FROM n) AS total)
SELECT n_positive, n_negative, round(total / (n_positive + n_negative), 6) AS loss FROM s""")
def _(spark, d):
    """All pairs of a family, and neighbours in the table that are of different families."""
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("label").alias("a_family"), F.col("embedding").alias("a_vec"))
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("label").alias("b_family"), F.col("embedding").alias("b_vec"))
    negatives = a.join(b, "a_id").where("a_family <> b_family")
    return nb.contrastive_loss(nb.pair_spread(e, "label"), negatives, margin=1.5).withColumn("loss", F.round("loss", R))


@query("t5_vote_ranking", f"""WITH {KNN_SQL}, v AS (SELECT query_id, unnest([m1, m2]) AS model FROM nei WHERE rank <= 3),
  c AS (SELECT query_id, model, count(*) AS votes FROM v GROUP BY ALL)
SELECT query_id, model, votes, CAST(row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, model) AS INT) AS position FROM c""")
def _(spark, d):
    return mem.vote_ranking(neighbors(spark, d))


@query("t6_list_position", f"""WITH {KNN_SQL}, v AS (SELECT vec_id, [m1, m2] AS l FROM mem) SELECT vec_id, l[1] AS model, 0 AS position FROM v
  UNION ALL SELECT vec_id, l[2], 1 FROM v""")
def _(spark, d):
    return records(spark, d).select("vec_id", F.posexplode("models").alias("position", "model"))


@query("t8_top_k_mean", f"""WITH {KNN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) AS rs FROM nei)
SELECT query_id, round(avg(similarity) FILTER (rs <= 3), 6) AS top3, round(max(similarity), 6) AS best FROM r GROUP BY query_id""")
def _(spark, d):
    n = neighbors(spark, d)
    return mem.top_k_mean(n, 3).join(mem.top_k_mean(n, 1).withColumnRenamed("top_k_mean", "best"), "query_id").select(
        "query_id", F.round("top_k_mean", R).alias("top3"), F.round("best", R).alias("best"))


@query("v5_adaptive_threshold", f"""WITH {KNN_SQL} SELECT query_id, round(avg(similarity), 6) AS mu, round(stddev_pop(similarity), 6) AS sigma,
  round(avg(similarity) - 0.5 * stddev_pop(similarity), 6) AS epsilon FROM nei GROUP BY query_id""")
def _(spark, d):
    t = mem.adaptive_threshold(neighbors(spark, d))
    return t.select("query_id", *[F.round(c, R).alias(c) for c in ("mu", "sigma", "epsilon")])


SCORED_SQL = f"""{KNN_SQL}, w AS (SELECT *, min(similarity) OVER q AS s0, max(similarity) OVER q AS s1, min(score) OVER q AS p0, max(score) OVER q AS p1
    FROM nei WINDOW q AS (PARTITION BY query_id)),
  parts AS (SELECT *, CASE WHEN s1 = s0 THEN 1.0 ELSE (similarity - s0) / (s1 - s0) END AS s,
    CASE WHEN score IS NULL THEN 0.5 WHEN p1 = p0 THEN 1.0 ELSE (score - p0) / (p1 - p0) END AS p,
    CASE WHEN recorded_at IS NULL THEN 0.5 ELSE exp(-greatest(0.0, date_diff('second', recorded_at, TIMESTAMP '2024-04-01 00:00:00') / 86400.0::DOUBLE) / 30.0::DOUBLE) END AS r FROM w)"""


@query("v6_v8_weighted_score", f"""WITH {SCORED_SQL} SELECT query_id, memory_id, round(s, 6) AS s, round(p, 6) AS p, round(r, 6) AS r,
  round(0.6::DOUBLE * s + 0.3::DOUBLE * p + 0.1::DOUBLE * r, 6) AS combined FROM parts""")
def _(spark, d):
    return mem.scored(neighbors(spark, d), as_of()).select("query_id", "memory_id", *[F.round(c, R).alias(c) for c in ("s", "p", "r", "combined")])


def _case_map(values, col):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {col} END"


MAPPED_SQL = f"CASE WHEN problem = 'regression' THEN {_case_map(cat.TO_REGRESSION, 'm')} ELSE {_case_map(cat.TO_CLASSIFICATION, 'm')} END"


def _list_sql(values):
    return "'" + ",".join(values) + "'"


DECIDE_SQL = f"""{SCORED_SQL}, cfg AS (SELECT unnest({{triples}}) AS c), sc AS (SELECT parts.* EXCLUDE (problem), c[1] AS alpha, c[2] AS beta, c[3] AS gamma,
    c[1] * s + c[2] * p + c[3] * r AS combined FROM parts, cfg),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, alpha, beta, gamma ORDER BY combined DESC, rank) AS rc FROM sc),
  agg AS (SELECT query_id, alpha, beta, gamma, avg(combined) AS mu, stddev_pop(combined) AS sigma, max(similarity) FILTER (rc = 1) AS wsim,
    max(combined) FILTER (rc = 1) AS wcomb, max(memory_id) FILTER (rc = 1) AS winning_id, max(p) FILTER (rc = 1) AS wp, max(r) FILTER (rc = 1) AS wr FROM rk GROUP BY ALL),
  mm AS (SELECT rk.query_id, alpha, beta, gamma, rc, rk.m1 AS m, q.problem FROM rk JOIN mem q ON rk.query_id = q.vec_id),
  mapped AS (SELECT query_id, alpha, beta, gamma, rc, {MAPPED_SQL} AS m FROM mm),
  firsts AS (SELECT query_id, alpha, beta, gamma, m, min(rc) AS rc FROM mapped GROUP BY ALL),
  lists AS (SELECT query_id, alpha, beta, gamma, array_to_string(list_slice(list(m ORDER BY rc), 1, 3), ',') AS ms FROM firsts GROUP BY ALL),
  dec AS (SELECT a.*, q.problem, ms, CASE WHEN wsim < 0.75 THEN 'cold_start' WHEN wcomb >= mu - 0.5 * sigma THEN 'memory' ELSE 'cold_start' END AS decision
    FROM agg a JOIN lists l USING (query_id, alpha, beta, gamma) JOIN mem q ON a.query_id = q.vec_id)
SELECT query_id, {{extra}} decision, round(mu - 0.5 * sigma, 6) AS epsilon, round(wsim, 6) AS similarity_score, round(wcomb, 6) AS combined_score,
  winning_id, round(wp, 6) AS winning_perf, round(wr, 6) AS winning_recency, round(mu, 6) AS mu_s, round(sigma, 6) AS sigma_s,
  CASE WHEN decision = 'memory' THEN ms WHEN problem = 'regression' THEN {_list_sql(cat.FALLBACK['regression'])} ELSE {_list_sql(cat.FALLBACK['classification'])} END AS models FROM dec"""

DECISION_COLS = ["decision", "epsilon", "similarity_score", "combined_score", "winning_id", "winning_perf", "winning_recency", "mu_s", "sigma_s"]


def _decisions(df, *extra):
    return df.select("query_id", *extra, *DECISION_COLS, F.array_join("models_selected", ",").alias("models"))


def query_side(spark, d):
    return records(spark, d).select(F.col("vec_id").alias("query_id"), "problem_type")


def _triples_sql(triples):
    return "[" + ",".join(f"[{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE]" for a, b, c in triples) + "]"


def scored_neighbors(spark, d):
    return neighbors(spark, d).drop("problem_type")


@query("v9_v12_decide", "WITH " + DECIDE_SQL.format(triples=_triples_sql([(0.6, 0.3, 0.1)]), extra=""))
def _(spark, d):
    return _decisions(mem.decide(query_side(spark, d), scored_neighbors(spark, d), as_of()))


@query("v10_weight_sweep", "WITH " + DECIDE_SQL.format(triples=_triples_sql(mem.SWEEP), extra="alpha, beta, gamma,"))
def _(spark, d):
    return _decisions(mem.weight_sweep(query_side(spark, d), scored_neighbors(spark, d), as_of()), "alpha", "beta", "gamma")


@query("v9_decide_empty_memory", f"""WITH {MEM_SQL} SELECT vec_id AS query_id, 'cold_start' AS decision, 0.0::DOUBLE AS epsilon, 0.0::DOUBLE AS similarity_score,
  CASE WHEN problem = 'regression' THEN {_list_sql(cat.FALLBACK['regression'])} ELSE {_list_sql(cat.FALLBACK['classification'])} END AS models FROM mem""")
def _(spark, d):
    none = scored_neighbors(spark, d).where(F.col("distance") < 0)
    out = mem.decide(query_side(spark, d), none, as_of())
    return out.select("query_id", "decision", "epsilon", "similarity_score", F.array_join("models_selected", ",").alias("models"))


@query("v11_model_mapping", f"""WITH {MEM_SQL}, x AS (SELECT vec_id, m1 AS m, problem FROM mem) SELECT vec_id, {MAPPED_SQL} AS model FROM x""")
def _(spark, d):
    return records(spark, d).select("vec_id", cat.model_for(F.col("models")[0], F.col("problem_type")).alias("model"))


@query("v13_fallback_models", f"""WITH {MEM_SQL}, x AS (SELECT vec_id, CASE WHEN problem = 'regression' THEN {_list_sql(cat.FALLBACK['regression'])} ELSE {_list_sql(cat.FALLBACK['classification'])} END AS l FROM mem)
SELECT vec_id, array_to_string(list_slice(string_split(l, ','), 1, 3), ',') AS models FROM x""")
def _(spark, d):
    return records(spark, d).select("vec_id", F.array_join(cat.fallback_models(F.col("problem_type"), 3), ",").alias("models"))


STRATEGY_SQL = f"""{KNN_SQL}, st AS (SELECT *, CASE WHEN problem = 'classification' AND f1 <> 0 THEN f1 ELSE 0.5 END AS perf,
    CASE WHEN paradigm = 'ML' THEN 'ML:' || m1 ELSE 'DL:MLP_' || layers || 'L' END AS strategy FROM nei),
  ss AS (SELECT *, similarity * perf - 0.01::DOUBLE * training_time AS sc FROM st),
  one AS (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY query_id, strategy ORDER BY sc DESC, rank) = 1),
  pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, rank) AS INT) AS position FROM one)"""


def entries(spark, d):
    return neighbors(spark, d).withColumn("model_name", F.col("models")[0]).withColumnRenamed("problem_type", "task_type")


@query("v14_paradigm_selection", f"""WITH {STRATEGY_SQL} SELECT query_id, position, strategy, round(sc, 6) AS strategy_score FROM pos WHERE position <= 5""")
def _(spark, d):
    label = mem.strategy_label(F.col("paradigm"), F.col("model_name"), F.col("architecture_config"))
    return mem.paradigm_selection(entries(spark, d), 5).select(
        "query_id", "position", label.alias("strategy"), F.round("strategy_score", R).alias("strategy_score"))


@query("v14_paradigm_shares", f"""WITH {STRATEGY_SQL} SELECT query_id, round(avg(CASE WHEN paradigm = 'ML' THEN 1.0 ELSE 0.0 END), 6) AS ml_share,
  round(avg(CASE WHEN paradigm = 'ML' THEN 0.0 ELSE 1.0 END), 6) AS dl_share, min(paradigm) FILTER (position = 1) AS best_paradigm FROM pos WHERE position <= 5 GROUP BY query_id""")
def _(spark, d):
    return mem.paradigm_shares(mem.paradigm_selection(entries(spark, d), 5)).select(
        "query_id", F.round("ml_share", R).alias("ml_share"), F.round("dl_share", R).alias("dl_share"), "best_paradigm")


@query("v15_v16_unified_decision", f"""WITH {STRATEGY_SQL}, lim AS (SELECT query_id, avg(similarity) - 0.5 * stddev_pop(similarity) AS eps, sum(training_time) AS tt FROM nei GROUP BY query_id),
  t3 AS (SELECT query_id, avg(similarity) AS s FROM (SELECT * FROM nei QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) <= 3) GROUP BY query_id),
  pk AS (SELECT query_id, string_agg(strategy, ',' ORDER BY position) AS ms, avg(CASE WHEN paradigm = 'ML' THEN 1.0 ELSE 0.0 END) AS ml, avg(f1) AS f1,
    min(paradigm) FILTER (position = 1) AS best FROM pos WHERE position <= 3 GROUP BY query_id)
SELECT query_id, CASE WHEN s >= eps THEN 'memory' ELSE 'cold_start' END AS decision, round(eps, 4) AS epsilon, round(s, 4) AS similarity_score,
  CASE WHEN s >= eps THEN ms ELSE {_list_sql(cat.UNIFIED_COLD)} END AS models, round(CASE WHEN s >= eps THEN ml ELSE 0.6 END, 6) AS ml_share,
  CASE WHEN s >= eps THEN best ELSE 'ML' END AS best_model_type, round(CASE WHEN s >= eps THEN f1 ELSE 0 END, 4) AS estimated_performance,
  CASE WHEN s >= eps THEN tt ELSE 0 END AS time_saved_s FROM lim JOIN t3 USING (query_id) JOIN pk USING (query_id)""")
def _(spark, d):
    out = mem.unified_decision(query_side(spark, d), entries(spark, d))
    return out.select("query_id", "decision", "epsilon", "similarity_score", F.array_join("selected_models", ",").alias("models"),
                      F.round("ml_share", R).alias("ml_share"), "best_model_type", "estimated_performance", "time_saved_s")


@query("v17_deep_share", f"""WITH {KNN_SQL} SELECT query_id, round(avg(CASE WHEN paradigm = 'DL' THEN 1.0 ELSE 0.0 END), 6) AS memory_score FROM nei GROUP BY query_id""")
def _(spark, d):
    n = neighbors(spark, d).withColumn("is_dl", F.col("paradigm") == "DL")
    return mem.deep_share(n).withColumn("memory_score", F.round("memory_score", R))


@query("v18_consistency", f"""WITH {KNN_SQL} SELECT query_id, round(1 / (1 + 10 * var_pop(coalesce(score, 0))), 6) AS consistency FROM nei GROUP BY query_id""")
def _(spark, d):
    return mem.consistency(neighbors(spark, d)).withColumn("consistency", F.round("consistency", R))


@query("v19_family", f"""WITH {MEM_SQL} SELECT vec_id, CASE {' '.join(f"WHEN m1 = '{m}' THEN '{f}'" for m, f in cat.FAMILY.items())} ELSE 'unknown' END AS family FROM mem""")
def _(spark, d):
    return records(spark, d).select("vec_id", cat.family_of(F.col("models")[0]).alias("family"))


def sample_weights(dim_in=64, hidden=64, dim_out=32):
    import numpy as np

    grid = lambda r, c, f: np.array([[math.sin(f * (i * c + j + 1)) for j in range(c)] for i in range(r)]) / math.sqrt(c)
    return {
        "w1": grid(hidden, dim_in, 0.7), "b1": grid(1, hidden, 0.3)[0], "mean": grid(1, hidden, 0.2)[0],
        "var": 1 + np.abs(grid(1, hidden, 0.9)[0]), "gamma": 1 + grid(1, hidden, 0.4)[0], "beta": grid(1, hidden, 0.6)[0],
        "w2": grid(dim_out, hidden, 1.1), "b2": grid(1, dim_out, 0.5)[0],
    }


@query("v20_encode", """WITH n AS (SELECT unnest(range(64)) AS i), o AS (SELECT unnest(range(32)) AS o),
  h AS (SELECT vec_id, i, list_sum(list_transform(range(1, 65), lambda j: embedding[j]::DOUBLE * sin(0.7::DOUBLE * (i * 64 + j)) / 8)) + sin(0.3::DOUBLE * (i + 1)) / 8 AS h FROM embeddings, n),
  r AS (SELECT vec_id, i, greatest(0, (h - sin(0.2::DOUBLE * (i + 1)) / 8) / sqrt(1 + abs(sin(0.9::DOUBLE * (i + 1)) / 8) + 1e-5) * (1 + sin(0.4::DOUBLE * (i + 1)) / 8) + sin(0.6::DOUBLE * (i + 1)) / 8) AS r FROM h),
  l AS (SELECT vec_id, list(r ORDER BY i) AS r FROM r GROUP BY vec_id),
  y AS (SELECT vec_id, o, list_sum(list_transform(range(1, 65), lambda j: r[j] * sin(1.1::DOUBLE * (o * 64 + j)) / 8)) + sin(0.5::DOUBLE * (o + 1)) / sqrt(32) AS y FROM l, o)
SELECT vec_id, CAST(o AS INT) AS pos, round(CAST(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)) AS FLOAT)::DOUBLE, 4) AS value FROM y""")
def _(spark, d):
    out = mem.encode(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", sample_weights())
    return out.select("vec_id", F.posexplode("encoded").alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 4).alias("value"))


@query("v21_replace_vectors", """SELECT vec_id, i AS pos, round(CASE WHEN label = 3 THEN -embedding[i] ELSE embedding[i] END::DOUBLE, 6) AS x
  FROM embeddings, unnest(range(1, 65)) AS t(i)""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    fresh = e.where("label = 3").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    out = mem.replace_vectors(e, fresh, "vec_id")
    return out.select("vec_id", F.posexplode("embedding").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).cast("long").alias("pos"), F.round(F.col("x").cast("double"), R).alias("x"))


@query("v23_minmax_vector", """SELECT vec_id, CAST(i AS BIGINT) AS pos, round((embedding[i]::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE), 6) AS x
  FROM embeddings, unnest(range(1, 65)) AS t(i)""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(vx.minmax_vector(F.col("embedding"))).alias("p", "x"))
    return e.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", R).alias("x"))


@query("v24_similar_datasets", f"""WITH {KNN_SQL} SELECT query_id, rank, memory_id, round(distance, 6) AS distance, m1 AS best_model, layers FROM nei WHERE rank <= 3""")
def _(spark, d):
    n = neighbors(spark, d).withColumn("hparams", F.col("architecture_config"))
    return mem.similar_datasets(n).select("query_id", "rank", "memory_id", F.round("distance", R).alias("distance"), "best_model", F.col("hparams")["layers"].alias("layers"))


@query("r4_candidate_pool", f"""WITH {KNN_SQL}, v AS (SELECT query_id, unnest([m1, m2]) AS m, rank * 2 + generate_subscripts([m1, m2], 1) AS o FROM nei WHERE rank <= 3),
  f AS (SELECT query_id, m, min(o) AS o FROM v GROUP BY ALL)
SELECT query_id, array_to_string(list_slice(list(m ORDER BY o), 1, 3), ',') AS pool FROM f GROUP BY query_id""")
def _(spark, d):
    return mem.candidate_pool(neighbors(spark, d)).select("query_id", F.array_join("pool", ",").alias("pool"))


@query("t1_minmax_group", f"""WITH {MEM_SQL}, w AS (SELECT vec_id, label, score, min(-score) OVER (PARTITION BY label) AS lo, max(-score) OVER (PARTITION BY label) AS hi FROM mem)
SELECT vec_id, round(CASE WHEN score IS NULL THEN NULL WHEN hi = lo THEN 1.0 ELSE (-score - lo) / (hi - lo) END, 6) AS scaled FROM w""")
def _(spark, d):
    return mem.minmax_large(records(spark, d), "score", ["label"], higher_is_better=False, out="scaled").select("vec_id", F.round("scaled", R).alias("scaled"))


@query("a21_memory_stats", f"""WITH {MEM_SQL} SELECT count(*) AS entries, count(DISTINCT label) AS datasets, 'DL,ML' AS paradigms FROM mem""")
def _(spark, d):
    return mem.memory_stats(records(spark, d).withColumn("dataset_id", F.col("label"))).withColumn("paradigms", F.array_join("paradigms", ","))


RESULT_SQL = f"""res AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'cold_start' ELSE 'memory' END AS decision, coalesce(score, 0) AS similarity,
  CAST(vec_id % 5 + 1 AS INT) AS models_tried, coalesce(score, 0) AS final_score, f1 AS full_score, 14 AS models_total FROM mem)"""


@query("a22_run_summary", f"""WITH {MEM_SQL}, {RESULT_SQL}
SELECT count(*) AS processed, round(100 * avg(CASE WHEN decision = 'memory' THEN 1.0 ELSE 0.0 END), 6) AS pct_memory,
  round(100 * avg(CASE WHEN decision = 'memory' THEN 0.0 ELSE 1.0 END), 6) AS pct_fallback, round(avg(similarity), 6) AS avg_similarity, round(avg(models_tried), 6) AS avg_models,
  round(avg(full_score - final_score) FILTER (final_score > 0 AND full_score > 0), 6) AS avg_score_gap,
  round(avg(models_total - models_tried) FILTER (final_score > 0 AND full_score > 0), 6) AS avg_models_saved, count(*) FILTER (final_score > 0 AND full_score > 0) AS validated FROM res""")
def _(spark, d):
    r, v = records(spark, d), F.col("vec_id")
    res = r.select(
        F.when(v % 4 == 0, "cold_start").otherwise("memory").alias("decision"), F.coalesce("score", F.lit(0.0)).alias("similarity"),
        (v % 5 + 1).cast("int").alias("models_tried"), F.coalesce("score", F.lit(0.0)).alias("final_score"),
        F.col("performance.f1").alias("full_score"), F.lit(14).alias("models_total"))
    out = mem.run_summary(res)
    return out.select(*[c if c in ("processed", "validated") else F.round(c, R).alias(c) for c in out.columns])


def memory_table(spark, d):
    """The records in the shape of a stored memory table."""
    r = records(spark, d)
    return r.select(
        F.col("vec_id").cast("string").alias("dataset_id"), mem.record_key(F.col("vec_id")).alias("key"), "embedding", "models",
        F.struct(F.col("problem_type"), F.col("score"), F.col("recorded_at"), F.col("training_time").alias("elapsed_s"),
                 F.create_map(F.col("models")[0], F.col("architecture_config")).alias("hparams")).alias("metadata"))


@query("s6_memory_round_trip", f"""WITH {MEM_SQL} SELECT CAST(vec_id AS VARCHAR) AS dataset_id, 'openml_' || vec_id AS key, m1 || ',' || m2 AS models,
  problem AS problem_type, round(score, 6) AS score, layers FROM mem""")
def _(spark, d):
    path = scratch_path(spark, "memory")
    m = memory_table(spark, d)
    tables.save_memory(m, path, "json")
    back = tables.load_memory(spark, path, mem.MEMORY_RECORD, "json")
    return back.select("dataset_id", "key", F.array_join("models", ",").alias("models"), F.col("metadata.problem_type").alias("problem_type"),
                       F.round("metadata.score", R).alias("score"), F.col("metadata.hparams")[F.col("models")[0]]["layers"].alias("layers"))


@query("p15_flat_metadata", f"""WITH {MEM_SQL} SELECT CAST(vec_id AS VARCHAR) AS dataset_id, 'openml_' || vec_id AS key, problem AS problem_type,
  round(score, 6) AS score, training_time AS elapsed_s FROM mem""")
def _(spark, d):
    return mem.flat_metadata(memory_table(spark, d)).select("dataset_id", "key", "problem_type", F.round("score", R).alias("score"), "elapsed_s")


@query("m14_fill_settings", f"""WITH {MEM_SQL} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN layers WHEN label = 3 THEN NULL ELSE 'new' END AS layers FROM mem""")
def _(spark, d):
    r = records(spark, d)
    have = r.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.col("architecture_config")).alias("hparams"))
    found = r.where("label <> 3").select("vec_id", F.create_map(F.lit("layers"), F.lit("new")).alias("hparams"))
    return mem.fill_settings(have, found, "vec_id").select("vec_id", F.col("hparams")["layers"].alias("layers"))
