"""Cleaning, profiling, splitting and feature steps: properties, edge cases, hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import scalars as fx
from sparkprep.operators import clean, evaluate, features, ordering, profile, quantiles, setops, split
from sparkprep.sources import files, tables


@pytest.fixture(scope="module")
def mixed(spark):
    """200 rows: six numeric columns with gaps, one categorical, a binary target."""
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(200, 6)), columns=[f"num_{i}" for i in range(6)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.05)
    pdf["cat_a"] = rng.choice(["a", "b", "c"], 200)
    pdf["target"] = rng.integers(0, 2, 200)
    pdf.insert(0, "row_id", range(200))
    return clean.nan_to_null(spark.createDataFrame(pdf)), pdf


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; one class and one value hold more than a third of them."""
    rows = [(i, "hot" if i % 5 < 2 else f"k{i % 7}", float(7 if i % 3 == 0 else (i * 37) % 1000), i % 4 == 0) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, cls string, x double, flag boolean")


# ---- fingerprints -------------------------------------------------------------------------------

def expected_fingerprint(pdf, feats, y):
    num = pdf[feats].select_dtypes("number")
    g = [((c.dropna() - c.mean()) ** 3).mean() / c.std(ddof=0) ** 3 for _, c in num.items()]
    corr = num.corr().abs().values[np.triu_indices(num.shape[1], 1)]
    cv = (num.std() / (num.mean().abs() + 1e-8)).clip(-10, 10)
    n, f = len(pdf), len(feats)
    out = [np.log1p(n) / 10, np.log1p(f) / 10, np.log1p(n / f) / 10, np.clip(np.mean(g) / 5, -1, 1), np.mean(np.abs(g) > 1),
           corr.mean(), np.tanh(cv.mean())]
    if y:
        p = pdf[y].value_counts(normalize=True)
        out += [np.log1p(len(p)) / 5, -(p * np.log(p)).sum() / np.log(max(len(p), 2))]
    else:
        out += [0, 0]
    return out + [pdf[feats].isnull().mean().mean()]


@pytest.mark.parametrize("y", ["target", None])
def test_fingerprint_matches_pandas(mixed, y):
    df, pdf = mixed
    feats = [*[f"num_{i}" for i in range(6)], "cat_a"]
    row = profile.fingerprints(df, feats, y).first()
    assert len(row["embedding"]) == profile.FINGERPRINT_SIZE
    assert row["embedding"] == pytest.approx(expected_fingerprint(pdf, feats, y), abs=1e-5)
    assert (row["n_samples"], row["n_features"], row["task_type"]) == (200, 7, 0 if y else 1)


def test_fingerprint_without_numeric_and_constant_column(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0)], "c string, flat double, y double")
    assert profile.fingerprints(df, ["c"], None).first()["embedding"][3:7] == [0.0] * 4
    e = profile.fingerprints(df, ["flat", "y"], None).first()["embedding"]
    assert all(np.isfinite(e)) and e[5] == 0.0


def test_batch_equals_single(mixed):
    df, _ = mixed
    feats = [f"num_{i}" for i in range(6)]
    tagged = df.withColumn("ds", F.col("row_id") % 2)
    batch = {r["ds"]: r["embedding"] for r in profile.fingerprints(tagged, feats, "target", ["ds"]).collect()}
    for ds in (0, 1):
        assert batch[ds] == pytest.approx(profile.fingerprints(tagged.where(F.col("ds") == ds), feats, "target").first()["embedding"], abs=1e-6)


def test_wide_tables_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(profile, "PAIRS_PER_PASS", 4)
    monkeypatch.setattr(profile, "COLUMNS_PER_PASS", 2)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(50, 5)), columns=list("abcde"))
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.corr_long(df, list("abcde")).collect()}
    assert len(got) == 10 and got[("a", "e")] == pytest.approx(pdf.corr().loc["a", "e"])
    assert profile.fingerprints(df, list("abcde"), None).first()["embedding"] == pytest.approx(expected_fingerprint(pdf, list("abcde"), None), abs=1e-5)


# ---- ordering on hot groups ---------------------------------------------------------------------

def test_row_rank_and_running_sums(skewed):
    pdf = skewed.toPandas().sort_values("id")
    got = ordering.row_rank(skewed, ["cls"], ["id"], "r").toPandas().sort_values("id")
    assert (got["r"].values == pdf.groupby("cls").cumcount().values + 1).all()
    sums = ordering.running_sums(skewed.withColumn("one", F.lit(1)), ["cls"], "id", {"s": "x", "n": "one"}, inclusive=False).toPandas().sort_values("id")
    want = pdf.groupby("cls")["x"].cumsum().values - pdf["x"].values
    assert np.allclose(sums["s"].values, want)
    down = ordering.running_sums(skewed, [], "id", {"s": "x"}, descending=True).toPandas().sort_values("id")
    assert np.allclose(down["s"].values, pdf["x"].values[::-1].cumsum()[::-1])


def test_hash_rank_is_a_permutation_per_group(skewed):
    got = ordering.hash_rank(skewed, ["cls"], ["id"], 7).toPandas()
    for _, part in got.groupby("cls"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_forward_fill_across_ranges(spark):
    rows = [(i, "a" if i == 0 else ("b" if i == 700 else None)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v string")
    got = ordering.forward_fill(df, "v", "id").toPandas().sort_values("id")["v"].tolist()
    assert got == ["a"] * 700 + ["b"] * 300


def test_top_per_group_large_k(spark, skewed):
    got = ordering.top_per_group(skewed, ["cls"], [F.col("id")], 1100).groupBy("cls").count().collect()
    assert {r[0]: r[1] for r in got}["hot"] == 1100


@pytest.mark.parametrize("limit", [(10, 3), (10, 10**6), (10**6, 10)])
def test_exact_quantiles_both_ways(skewed, limit):
    pdf = skewed.toPandas()
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = quantiles.exact_quantiles(skewed, ["x"], probs, *limit)["x"]
    assert got == pytest.approx([pdf["x"].quantile(p) for p in probs])


def test_grouped_quantiles(skewed):
    pdf = skewed.toPandas()
    got = quantiles.grouped_quantiles(skewed, ["cls"], ["x", "id"], [0.5], ["m"]).collect()
    for r in got:
        assert r["m"] == pytest.approx(pdf.loc[pdf.cls == r["cls"], r["column"]].median())


# ---- cleaning -----------------------------------------------------------------------------------

def test_dedupe_treats_null_as_equal(spark):
    df = spark.createDataFrame([(3, None, "x", 1), (1, None, "x", 2), (2, 5.0, "x", 3)], "id int, a double, b string, y int")
    assert sorted(r["id"] for r in clean.dedupe_first(df, ["a", "b"], "id").collect()) == [1, 2]


def test_fill_median_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([(1, 1.0, "b", None), (2, None, "a", None), (None, 4.0, None, None)], "i int, x double, c string, e string")
    fills = clean.fit_fill(df, ["i", "x"], ["c", "e"])
    assert fills == {"i": 1.5, "x": 2.5, "c": "a"}
    row = clean.fill(df, fills).collect()[2]
    assert (row["i"], row["c"], row["e"]) == (1.5, "a", None)
    assert clean.fit_fill(df, [], ["e"], all_null="missing") == {"e": "missing"}


def test_names():
    assert clean.clean_name('a[b]: "c"') == "a_b____c_"
    assert clean.clean_name("a[b]:{c},'d'", "delete") == "ab_c_d"


def test_names_collide(spark):
    with pytest.raises(ValueError):
        clean.clean_names(spark.createDataFrame([(1, 2)], "`a b` int, `a:b` int"))


def test_require_column_lists_names(spark):
    with pytest.raises(ValueError, match="Available columns"):
        clean.feature_columns(spark.range(1), "y")


def test_id_columns_need_many_values(spark):
    df = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "ID int, group_id int, y int")
    assert clean.id_columns(df, "y") == ["ID"]


def test_to_numeric_has_no_nulls(mixed):
    df, _ = mixed
    made = clean.to_numeric(df, keep=["row_id"])
    assert made.where(" OR ".join(f"{c} IS NULL" for c in made.columns)).count() == 0
    assert not profile.column_types(made)["categorical"]


def test_label_index_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i % 90}" if i % 10 else None) for i in range(500)], "id int, c string")
    wide = {r["id"]: r["n"] for r in clean.label_index(df, "c", "n").collect()}
    names = sorted({r["c"] for r in df.collect() if r["c"]})
    assert all(wide[r["id"]] == (names.index(r["c"]) if r["c"] else None) for r in df.collect())


def test_leak_by_auc(spark):
    rows = [(float(i % 2), float(i % 2) * 10 + (i % 5), float(i % 7)) for i in range(800)]
    got = {r["column"]: r for r in clean.leaky_by_auc(spark.createDataFrame(rows, "y double, a double, b double"), ["a", "b"], "y").collect()}
    assert got["a"]["leaky"] and not got["b"]["leaky"] and got["a"]["auc"] == pytest.approx(1.0)


def test_rare_class_inside_the_range(spark):
    """One percent of positives in the middle of the others, which no threshold alone finds; NULLs and one-class targets."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(4000):
        y = float(i % 100 == 7)
        inside = 0.5 + rng.random() / 1000 if y else rng.random() * 0.499 + (0.501 if rng.random() < 0.5 else 0)
        rows.append((y, float(inside), float(rng.random()), None if y else 1.0, 1.0))
    rows += [(None, 0.5, 0.5, 0.5, 1.0)] * 50
    df = spark.createDataFrame(rows, "y double, inside double, noise double, gap double, same double")
    got = {r["column"]: (r["auc"], r["leaky"]) for r in clean.leaky_by_auc(df, ["inside", "noise", "gap", "same"], "y").collect()}
    assert got["inside"] == (1.0, True) and got["gap"] == (1.0, True) and got["same"] == (0.5, False)
    assert not got["noise"][1] and 0.5 <= got["noise"][0] < 0.9
    one = clean.leaky_by_auc(df.where("y = 0"), ["inside"], "y").first()
    assert one["auc"] is None and not one["leaky"]


@pytest.mark.parametrize("kind", ["double", "string"])
def test_ranks_with_hot_order_values(spark, kind):
    """Half of the rows tie in the first order column: ranks stay right and no range holds many more rows than the mean."""
    rng = np.random.default_rng(4)
    rows = []
    for i in rng.permutation(6000).tolist():
        v = 5.0 if i % 2 else (None if i % 20 == 0 else float(rng.integers(0, 1000)) / 100)
        rows.append((i % 3, None if v is None else v if kind == "double" else f"{v:08.3f}", i))
    df = spark.createDataFrame(rows, f"g int, v {kind}, k long").repartition(4)
    want = {}
    for g in range(3):
        ours = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2]))
        want.update({r[2]: n for n, r in enumerate(ours, 1)})
    assert {r["k"]: r["r"] for r in ordering.row_rank(df, ["g"], ["v", "k"], "r").collect()} == want
    sizes = [r["count"] for r in ordering.with_tie_ranges(df, ["v", "k"]).groupBy("__range", "__within").count().collect()]
    assert max(sizes) <= 2 * 6000 / ordering.RANGES


def test_column_order_of_merge(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, setops.merge_new(old, new, "k").collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, setops.concat_keep_last([old, new.where("k = 1")], ["k"]).collect())) == [(1, "z")]


# ---- splits -------------------------------------------------------------------------------------

def test_split_keeps_shares_rows_and_seed(skewed):
    a = split.stratified_split(skewed, "cls", ["id"], 0.2, seed=1)
    assert a.count() == 3000
    for r in a.groupBy("cls").agg(F.avg((F.col("split") == "test").cast("double")).alias("s"), F.count("*").alias("n")).collect():
        assert abs(r["s"] - 0.2) <= 1 / r["n"]
    again = split.stratified_split(skewed.repartition(13), "cls", ["id"], 0.2, seed=1)
    assert a.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    other = split.stratified_split(skewed, "cls", ["id"], 0.2, seed=2)
    assert a.select("id", "split").exceptAll(other.select("id", "split")).count() > 0


def test_folds_are_balanced_and_fall_back(spark, skewed):
    n = [r["count"] for r in split.folds(skewed, "cls", ["id"], 5).where("cls = 'hot'").groupBy("fold").count().collect()]
    assert len(n) == 5 and max(n) - min(n) <= 1
    rare = skewed.withColumn("cls", F.when(F.col("id") == 0, "lonely").otherwise(F.col("cls")))
    assert split.folds(rare, "cls", ["id"], 5).select("fold").distinct().count() == 5
    assert split.holdout(rare, "cls", ["id"]).where("split = 'test'").count() == 450


def test_cap_rows(skewed):
    assert split.cap_rows(skewed, "id", 100).count() == 100
    assert split.cap_rows(skewed, "id", 10**6).count() == 3000
    assert split.cap_per_class(skewed, "cls", "id", 3).groupBy("cls").count().where("count <> 3").count() == 0


# ---- metrics ------------------------------------------------------------------------------------

def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3)], "m string, y int, s double")
    got = {r["m"]: r["auc"] for r in evaluate.roc_auc(df, F.col("y"), F.col("s"), ["m"]).collect()}
    assert got == {"a": pytest.approx(0.875), "b": None}


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.2, 0.0), (1.0, 1.0)], "c double, a double")
    assert {r["bin"]: r["n"] for r in evaluate.calibration_bins(df, "c", "a").collect()} == {0: 1, 1: 1, 4: 1}
    p = spark.createDataFrame([(0, 0.0), (1, 1.0), (0, 0.1)], "y int, p double")
    assert evaluate.probability_calibration_error(p, "y", "p").first()[0] == pytest.approx(0.1 / 3)


# ---- features -----------------------------------------------------------------------------------

def test_yeo_johnson_fit_is_the_maximum(spark):
    rng = np.random.default_rng(9)
    x = rng.lognormal(size=4000)
    lam = features.fit_yeo_johnson(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"])["x"]

    def loglik(v):
        t = ((x + 1) ** v - 1) / v
        return -len(x) / 2 * np.log(t.var()) + (v - 1) * np.log1p(x).sum()

    assert loglik(lam) >= max(loglik(lam + 0.01), loglik(lam - 0.01))


def test_target_encoding_matches_loop(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(300), "c": rng.choice(list("abcdefgh"), 300), "y": rng.normal(size=300)})
    pdf.loc[299, "c"] = "once"
    df = spark.createDataFrame(pdf)
    got = {r["value"]: r["encoding"] for r in features.target_encoding(df, "c", "y", F.col("id") % 5).collect()}
    enc = pd.Series(np.nan, index=pdf.index)
    for f in range(5):
        tr, va = pdf[pdf.id % 5 != f], pdf[pdf.id % 5 == f]
        n, m = tr.groupby("c").y.count(), tr.groupby("c").y.mean()
        w = n / (n + 10)
        enc[va.index] = va.c.map(w * m + (1 - w) * pdf.y.mean())
    want = enc.groupby(pdf.c).mean().dropna().to_dict()
    assert got == pytest.approx(want) and "once" not in got


def test_rare_and_unseen_values(spark):
    train = spark.createDataFrame([("a",)] * 150 + [("b",)] + [(None,)], "c string")
    kept = features.frequent_values(train, ["c"])
    assert kept == {"c": ["a"]}
    new = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,)], "c string")
    assert [r[0] for r in features.group_rare(new, kept).collect()] == ["a", "_RARE", "_RARE", None]


def test_plan_learns_from_train_only_and_applies_anywhere(spark, mixed):
    df, _ = mixed
    feats = [*[f"num_{i}" for i in range(6)], "cat_a"]
    x = df.withColumn("copy", F.col("num_0") * 2).withColumn("flat", F.lit(1.0)).withColumn("day", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,row_id)"))
    x = x.withColumn("note", F.concat(F.lit("a long text value with more than thirty characters "), F.col("row_id")))
    x = x.withColumn("code", F.concat(F.lit("c"), F.col("row_id") % 40))
    feats += ["copy", "flat", "day", "note", "code"]
    plan = features.FeaturePlan.fit(x.where("row_id < 150"), feats, "target", ["row_id"])
    out = plan.apply(x)
    assert out.count() == 200
    assert plan["constant"] == ["flat"] and plan["texts"] == ["note"] and plan["dates"] == ["day"] and "copy" in plan["correlated"]
    assert "code" in plan["encodings"] and len(plan["products"]) == 10 and len(plan["ratios"]) == 6 and len(plan["squares"]) == 5
    assert {"note_length", "note_word_count", "day_weekday", "num_0__squared"} <= set(out.columns)
    changed = x.withColumn("num_1", F.when(F.col("row_id") >= 150, 1e6).otherwise(F.col("num_1")))
    again = features.FeaturePlan.fit(changed.where("row_id < 150"), feats, "target", ["row_id"])
    assert again["caps"] == plan["caps"] and again["powers"] == plan["powers"]


def test_encoding_plan_goes_on_to_the_preprocessor(spark):
    """One-hot and hashed columns reach the preprocessor, frequency and target columns arrive there as numbers."""
    rows = [(i, float(i % 7), f"a{i % 3}", f"b{i % 40}", f"c{i}", f"d{i % 50}", float(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, a string, b string, c string, d string, y double")
    ways = {r["column"]: r["strategy"] for r in profile.encoding_plan(df, ["a", "b", "c"]).collect()} | {"d": "target"}
    assert ways == {"a": "onehot", "b": "frequency", "c": "hash", "d": "target"}
    plan = features.FeaturePlan.fit(df, ["x", "a", "b", "c", "d"], "y", ["id"], features.steps_for("light", ways))
    made = plan.apply(df)
    kinds = profile.column_types(made, exclude=["id", "y"])
    assert set(kinds["numeric"]) == {"x", "b", "d"} and set(kinds["categorical"]) == {"a", "c"}
    prep = features.fit_preprocessor(made, kinds["numeric"], kinds["categorical"], encodings=ways)
    assert prep.transform(made).first()["features"].size == 3 + 3 + 2048
    assert {r["b"] for r in made.select(F.round(F.col("b").cast("double"), 6).alias("b")).collect()} == {0.025}
    names = lambda level: [s.name for s in features.steps_for(level)]
    assert names("off") == [] and set(names("light")) < set(names("medium")) < set(names("full"))
    with pytest.raises(ValueError):
        features.steps_for("much")


def test_preprocessor_scales_encodes_and_survives_unseen(spark):
    train = spark.createDataFrame([(1.0, "a", "p"), (3.0, "b", "q"), (None, None, "r")], "x double, c string, h string")
    prep = features.fit_preprocessor(train, ["x"], ["c", "h"], encodings={"h": "hash"})
    test = spark.createDataFrame([(2.0, "zzz", "p"), (1.0, "a", "p")], "x double, c string, h string")
    got = [r["features"] for r in prep.transform(test).collect()]
    assert got[0].size == 1 + 3 + 2048
    assert list(got[0].toArray()[1:4]) == [0, 0, 0] and list(got[1].toArray()[1:4]) == [1, 0, 0]
    assert got[0].toArray()[4:].argmax() == got[1].toArray()[4:].argmax()
    assert got[0][0] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        features.fit_preprocessor(train, ["x"], ["c"], encodings={"c": "frequency"})


def test_dense_embedding_is_left_alone(spark):
    cols = [f"p{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(float(i) for i in range(60))], cols)
    assert list(features.fit_preprocessor(df, cols, []).transform(df).first()["features"].toArray()) == [float(i) for i in range(60)]


def test_pca_shapes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=12)]) for i in range(40)], "id int, v array<double>")
    out = features.reduce_vectors(df, "v", features.fit_pca(df, "v", 5), 5).select("reduced").collect()
    mat = np.array([r[0] for r in out])
    assert mat.shape == (40, 5) and np.allclose(mat.mean(axis=0), 0, atol=1e-8)
    short = features.reduce_vectors(df, "v", features.fit_pca(df, "v", 100), 100).first()["reduced"]
    assert len(short) == 100 and short[12:] == [0.0] * 88


# ---- sources and text ---------------------------------------------------------------------------

def test_labeled_files_prefer_train(spark, tmp_path):
    for p in ("train/cat/a.txt", "train/dog/b.md", "train/c.txt", "test/cat/d.txt", "train/dog/e.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * 6000)
    got = files.scan_labeled_files(spark, str(tmp_path), [".txt", ".md"]).select("label").collect()
    assert sorted(r[0] for r in got) == ["cat", "dog", "unknown"]
    body = files.read_text_bodies(spark, str(tmp_path / "train" / "cat"), cap=files.BODY_CAP).first()["text"]
    assert len(body) == 5000


def test_read_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    tables.write_metrics(df, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t.csv")).collect()), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_search_results_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"dataset": "d", "best_params": {"dl_num_layers": 2, "dl_lr": 0.01}, "accuracy": 0.9}]')
    row = tables.read_search_results(spark, str(tmp_path / "m.json")).first()
    assert (row["dataset"], row["best_params"]["dl_num_layers"], row["accuracy"]) == ("d", 2, 0.9)


def test_replies(spark):
    rows = [("<think>{}</think>```json\n{\"approved\": true}\n```", True), ('ok {"approved": false} end', False), ("Rejected", False), ("it is approved", True), ("hm", None)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", fx.approval(F.col("t"))).collect())


def test_durations(spark):
    df = spark.createDataFrame([("10m", 600.0), (" 30S", 30.0), ("2h", 7200.0), ("5", 300.0), ("x", None)], "t string, want double")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", fx.duration_seconds(F.col("t"))).collect())


def test_ranges_follow_the_shuffle_width(spark, skewed):
    """More shuffle partitions cut a group into more ranges, with the same result."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        ranged = ordering.with_range(skewed, "id")
        assert ranged.where("cls = 'hot'").select("__range").distinct().count() > 500
        lo_hi = ranged.groupBy("__range").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("__range").collect()
        assert all(x["b"] < y["a"] for x, y in zip(lo_hi, lo_hi[1:]))
        pdf = skewed.toPandas().sort_values("id")
        got = ordering.row_rank(skewed, ["cls"], ["id"], "r").toPandas().sort_values("id")
        assert (got["r"].values == pdf.groupby("cls").cumcount().values + 1).all()
        seeded = ordering.hash_rank(skewed, ["cls"], ["id"], 7).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    narrow = ordering.hash_rank(skewed, ["cls"], ["id"], 7).toPandas()
    assert seeded.sort_values("id")["rank"].tolist() == narrow.sort_values("id")["rank"].tolist()


def test_narrow_types_hold_larger_values_of_other_rows(spark):
    train = spark.createDataFrame([(1, 5, 0), (2, 90, 1), (3, 7, 1)], "id long, x long, y long")
    plan = features.FeaturePlan.fit(train, ["x"], "y", ["id"], [features.narrow_types()])
    assert plan["types"] == {"x": "tinyint"}
    out = plan.apply(spark.createDataFrame([(4, 3_000_000_000, 0), (5, None, 1)], "id long, x long, y long"))
    assert dict(out.dtypes)["x"] == "bigint" and [r["x"] for r in out.orderBy("id").collect()] == [3_000_000_000, None]
    assert dict(plan.apply(train).dtypes)["x"] == "tinyint"
    small = clean.downcast(spark.createDataFrame([(300,)], "x long"), {"x": "tinyint"})
    assert small.dtypes == [("x", "smallint")] and small.first()["x"] == 300
