"""Nearest-neighbour joins and retrieval against brute force and worked numbers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import vectors as vx
from sparkprep.operators import cells
from sparkprep.operators import memory as mem
from sparkprep.operators import neighbors as nb
from sparkprep.plans.memory_queries import sample_weights


def vec_df(spark, mat, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(mat)), mat)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def brute(q, m, k, metric="l2"):
    out = {}
    for i, a in enumerate(q):
        if metric == "l2":
            s = ((a - m) ** 2).sum(axis=1)
        elif metric == "ip":
            s = -(m @ a)
        else:
            s = -(m @ a) / (np.linalg.norm(m, axis=1) * np.linalg.norm(a))
        out[i] = [j for _, j in sorted((round(v, 12), j) for j, v in enumerate(s))][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["memory_id"])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 6)).astype(np.float32).astype(float)
    m = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    m[100:200] = m[5]  # a third of the memory is one and the same vector
    return q, m


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("limit", [1 << 30, 40 * 6 * 8, 400])
def test_knn_join_every_path(spark, data, metric, limit):
    """Memory broadcast, queries broadcast, and blocks of both give the brute-force answer."""
    q, m = data
    got = nb.knn_join(vec_df(spark, q), vec_df(spark, m), 7, query_id="id", memory_id="id", metric=metric, broadcast_bytes=limit)
    assert found(got) == brute(q, m, 7, metric)


def test_knn_ties_go_to_smaller_id_and_k_is_clamped(spark):
    m = np.ones((5, 3))
    got = nb.knn_join(vec_df(spark, m[:1]), vec_df(spark, m), 9, query_id="id", memory_id="id")
    assert found(got) == {0: [0, 1, 2, 3, 4]}


def test_knn_string_ids_and_empty_memory(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, embedding array<double>")
    got = nb.knn_join(q, q, 1, query_id="name", memory_id="name", exclude_same=True)
    assert found(got) == {"a": ["b"], "b": ["a"]}
    none = nb.knn_join(q, q.where("name = 'z'"), 1, query_id="name", memory_id="name")
    assert none.count() == 0


def test_knn_rejects_mixed_lengths(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0])], "id int, embedding array<double>")
    with pytest.raises(ValueError):
        nb.knn_join(q, q, 1, query_id="id", memory_id="id")


def test_cells_recall_and_distances(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 10
    m = np.concatenate([c + rng.normal(size=(60, 8)) for c in centers])
    q = centers + rng.normal(size=(6, 8))
    got = found(nb.knn_join_cells(vec_df(spark, q), vec_df(spark, m), 5, query_id="id", memory_id="id", n_cells=6, probes=2, block_bytes=2000))
    truth = brute(q.astype(np.float32).astype(float), m.astype(np.float32).astype(float), 5)
    hits = sum(len(set(got[i]) & set(truth[i])) for i in truth)
    assert hits >= 0.9 * 5 * len(truth)
    all_cells = found(nb.knn_join_cells(vec_df(spark, q), vec_df(spark, m), 5, query_id="id", memory_id="id", n_cells=6, probes=6))
    assert all_cells == truth


def test_cells_prune_on_clustered_rows(spark):
    """The exact join of two large sides multiplies less than half of the pairs of clustered rows, a third of them in one cluster."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16)) * 8
    at = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 12, 900))
    m = (centers[at] + rng.normal(size=(900, 16))).astype(np.float32).astype(float)
    df = vec_df(spark, m)
    how = dict(query_id="id", memory_id="id", exclude_same=True, broadcast_bytes=60 * 16 * 8)
    got = found(nb.knn_join(df, df, 5, **how))
    want = brute(m, m, 6)
    assert got == {i: [j for j in near if j != i][:5] for i, near in want.items()}
    work = nb.knn_work(df, df, 5, **how).first()
    assert work["pairs"] == 900 * 900 and work["pairs_multiplied"] < 0.5 * work["pairs"]


def test_cells_are_exact_far_from_the_origin(spark):
    """Bounds hold although distances to centres lose digits there."""
    rng = np.random.default_rng(9)
    m = 1e4 + rng.integers(0, 9, size=(400, 4)).astype(float)
    got = found(nb.knn_join(vec_df(spark, m[:90]), vec_df(spark, m), 4, query_id="id", memory_id="id", broadcast_bytes=40 * 32))
    assert got == brute(m[:90], m, 4)


def test_probes_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1500, 8)).astype(np.float32).astype(float)
    q = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    got = found(nb.knn_join_cells(vec_df(spark, q), vec_df(spark, m), 5, query_id="id", memory_id="id"))
    truth = brute(q, m, 5)
    assert sum(len(set(got[i]) & set(truth[i])) for i in truth) >= 0.95 * 5 * len(truth)
    assert nb.knn_join_cells(vec_df(spark, q), vec_df(spark, m).limit(0), 5, query_id="id", memory_id="id").count() == 0


def test_cosine_worked_numbers(spark):
    rows = [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 1.0), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.0),
            ([1.0, 0.0, 0.0], [0.0, 0.0, 0.0], 0.0), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", vx.cosine(F.col("a"), F.col("b"))).collect())
    last = df.where(F.col("b")[0] == -1).select(vx.cosine(F.col("a"), F.col("b"), clip=False)).first()[0]
    assert last == -1.0


def sims(spark, values):
    return spark.createDataFrame([("q", float(v)) for v in values], "query_id string, similarity double")


def test_threshold_and_top_mean(spark):
    v = [0.9, 0.85, 0.8, 0.7, 0.6]
    row = mem.adaptive_threshold(sims(spark, v)).first()
    assert row["epsilon"] == pytest.approx(np.mean(v) - 0.5 * np.std(v))
    assert mem.adaptive_threshold(sims(spark, v), lam=0.0).first()["epsilon"] == pytest.approx(0.77)
    w = sims(spark, [0.6, 0.9, 0.8, 0.85, 0.7])
    assert mem.top_k_mean(w).first()[1] == pytest.approx(0.85)
    assert mem.top_k_mean(w, 1).first()[1] == pytest.approx(0.9)


def test_minmax_all_equal_is_one(spark):
    df = spark.createDataFrame([("q", 3.0), ("q", 3.0), ("q", None)], "query_id string, x double")
    assert sorted(r[0] or -1 for r in df.select(mem.minmax(F.col("x"), ["query_id"])).collect()) == [-1, 1.0, 1.0]


def test_recency(spark):
    now = dt.datetime(2024, 5, 1)
    rows = [(None,), (now,), (now - dt.timedelta(days=30),), (now + dt.timedelta(days=3),)]
    df = spark.createDataFrame(rows, "t timestamp")
    got = [r[0] for r in df.select(mem.recency(F.col("t"), F.lit(now))).collect()]
    assert got == pytest.approx([0.5, 1.0, math.exp(-1), 1.0])


def test_settings_are_checked(spark):
    near = spark.createDataFrame([(1, 1, 0.5, 0.5, None)], "query_id long, rank int, similarity double, score double, recorded_at timestamp")
    with pytest.raises(ValueError):
        mem.scored(near, F.current_timestamp(), weights=(0.9, 0.3, 0.1))
    with pytest.raises(ValueError):
        mem.decide(near, near, F.current_timestamp(), from_memory=0)


ENTRY_SCHEMA = (
    "query_id string, memory_id int, rank int, similarity double, paradigm string, model_name string, "
    "architecture_config map<string,string>, performance struct<accuracy:double,f1:double,auc:double,rmse:double>, training_time double, task_type string"
)


def entries(spark):
    return spark.createDataFrame([
        ("q", 1, 1, 1.0, "ML", "rf", None, (0.0, 0.85, 0.0, None), 10.0, "classification"),
        ("q", 2, 2, 1.0, "DL", None, {"layers": "4", "units": "128"}, (0.0, 0.9, 0.0, None), 120.0, "classification"),
    ], ENTRY_SCHEMA)


def test_paradigm_selection_worked_numbers(spark):
    got = {r["paradigm"]: (r["position"], r["strategy_score"]) for r in mem.paradigm_selection(entries(spark)).collect()}
    assert got["ML"] == (1, pytest.approx(0.75)) and got["DL"] == (2, pytest.approx(-0.30))
    free = {r["paradigm"]: r["position"] for r in mem.paradigm_selection(entries(spark), time_penalty=0.0).collect()}
    assert free == {"DL": 1, "ML": 2}


def test_unified_decision(spark):
    queries = spark.createDataFrame([("q",), ("new",)], "query_id string")
    got = {r["query_id"]: r for r in mem.unified_decision(queries, entries(spark)).collect()}
    assert got["q"]["decision"] == "memory" and got["q"]["selected_models"] == ["ML:rf", "DL:MLP_4L"]
    assert (got["q"]["ml_share"], got["q"]["dl_share"], got["q"]["time_saved_s"]) == (0.5, 0.5, 130.0)
    assert got["new"]["decision"] == "cold_start" and got["new"]["ml_share"] == 1.0
    assert got["new"]["selected_models"] == ["logistic", "rf", "simple_mlp", "xgboost", "gb"]


def test_encoder_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 10)).astype(np.float32)
    w = sample_weights(10, 64, 32)
    got = np.array([r[0] for r in mem.encode(vec_df(spark, x), "embedding", w).orderBy("id").select("encoded").collect()])
    h = (x.astype(float) @ w["w1"].T + w["b1"] - w["mean"]) / np.sqrt(w["var"] + 1e-5) * w["gamma"] + w["beta"]
    y = np.maximum(h, 0) @ w["w2"].T + w["b2"]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose(got, y, atol=1e-5)


def test_contrastive_loss_matches_all_pairs(spark):
    rng = np.random.default_rng(6)
    mat, fam = rng.normal(size=(24, 4)).astype(np.float32).astype(float) * 0.3, [i % 3 for i in range(24)]
    df = spark.createDataFrame([(i, fam[i], [float(v) for v in mat[i]]) for i in range(24)], "id int, family int, embedding array<double>")
    neg = nb.negative_pairs(df, "id", "family", 100)
    drawn = neg.collect()
    assert len(drawn) == 100 and all(r["a_family"] != r["b_family"] for r in drawn)
    assert [(r["pair"], r["a_id"], r["b_id"]) for r in sorted(drawn)] == [(r["pair"], r["a_id"], r["b_id"]) for r in sorted(nb.negative_pairs(df, "id", "family", 100).collect())]
    pos = [((mat[i] - mat[j]) ** 2).sum() for i in range(24) for j in range(i) if fam[i] == fam[j]]
    negs = [max(1 - np.linalg.norm(mat[r["a_id"]] - mat[r["b_id"]]), 0) ** 2 for r in drawn]
    row = nb.contrastive_loss(nb.pair_spread(df, "family"), neg).first()
    assert row["n_positive"] == len(pos)
    assert row["loss"] == pytest.approx((sum(pos) + sum(negs)) / (len(pos) + 100))


def test_pad_and_minmax_vector(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0],)], "v array<double>")
    assert df.select(vx.pad_to(F.col("v"), 5)).first()[0][3:] == [0.0, 0.0]
    assert df.select(vx.minmax_vector(F.col("v"))).first()[0] == pytest.approx([1 / 3, 0.0, 1.0])


def test_kernels_run_without_the_package(tmp_path):
    """Executors have no copy of the library: the pickled kernel must load and run on its own."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "kernel.pkl").write_bytes(cloudpickle.dumps(nb._block_top_k))
    code = (
        "import sys, pickle, numpy as np\n"
        "f = pickle.load(open('kernel.pkl', 'rb'))\n"
        "x = np.eye(3)\n"
        "print(f(np.arange(3), x, np.arange(3), x, 1, 'cosine', False)[1].tolist(), 'sparkprep' in sys.modules)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[0, 1, 2] False", out.stderr


@pytest.mark.parametrize("dim", [3, 32])
def test_kernel_with_leaves_is_exact(monkeypatch, dim):
    rng = np.random.default_rng(dim)
    monkeypatch.setattr(nb, "LEAF", 16)
    monkeypatch.setattr(nb, "GROUP", 8)
    m = np.round(rng.normal(size=(900, dim)), 1)
    m[::9] = m[0]
    m[5] = np.nan
    ids = rng.permutation(900)
    for metric in nb.METRICS:
        pos, found, score, _ = nb._block_top_k(ids[:90], m[:90], ids, m, 7, metric, True)
        for i in range(90):
            s = nb._score(np.repeat(m[i:i + 1], 900, axis=0), m, metric)
            want = sorted((float(v), int(j)) for v, j in zip(s, ids) if np.isfinite(v) and j != ids[i])[:7]
            assert sorted(zip(score[pos == i].tolist(), found[pos == i].tolist())) == want


def test_low_dimensions_meet_few_rows(monkeypatch):
    """Rows of the memory are left out by leaf: of 40,000 x 40,000 pairs in the plane less than a tenth are multiplied."""
    x, ids = np.random.default_rng(0).random((40_000, 2)), np.arange(40_000)
    memory = nb.Memory(ids, x, "l2", False)
    met = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            met.append(len(at))
            return np.asarray(self)[at]

    memory.right = memory.right.view(Counted)
    nb._block_top_k(ids, x, ids, x, 5, "l2", False, memory)
    assert 0 < sum(met) * nb.GROUP < 0.1 * 40_000 * 40_000


def test_queries_of_one_file_are_searched_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(nb, "TASK_PAIRS", 40_000)
    df = vec_df(spark, np.random.default_rng(2).normal(size=(1000, 3))).coalesce(1)
    q, m, n, _, _ = nb._sides(df, df, "id", "id", "embedding")
    best = nb._against_memory(q, m, n, 3, "l2", True, nb._found_schema(q, m))
    assert best.select(F.spark_partition_id()).distinct().count() > 4


def test_a_vector_is_sent_once_to_the_cells_of_a_block(spark):
    df = vec_df(spark, np.random.default_rng(5).normal(size=(300, 4))).select("id", F.col("embedding").cast("array<double>").alias("vec"))
    index = cells.build(df, 12, 300, 4, 1000)
    sent = cells.calls(df, index, 3, None, 0, 8)
    assert sent.count() == 300 and {r[0] for r in sent.select(F.size("cells")).distinct().collect()} == {8}
    index.per_block = 10
    first, pieces = cells.blocks(index)
    assert all(-(-n // p) <= 10 for n, p in zip(index.counts, pieces)) and first[0] == 0
    assert sorted(np.concatenate([np.arange(f, f + p) for f, p in zip(first, pieces) if p > 1])) == sorted({b for f, p in zip(first, pieces) if p > 1 for b in range(f, f + p)})
