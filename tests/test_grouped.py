"""Models of many datasets at once against fits of each dataset alone."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import grouped as g
from sparkprep.operators import profile, sums

S = g.Datasets("ds", "y", ("id",), ("a", "b"), ("c",))


def fixture_rows():
    rng = np.random.default_rng(4)
    out = []
    for ds, n, kind in (("big", 900, "class"), ("num", 400, "value"), ("two", 120, "class"), ("tiny", 20, "class"), ("flat", 60, "value")):
        for i in range(n):
            a, b, c = rng.integers(0, 8) / 2, rng.normal(), rng.choice(["p", "q", "r{"], p=[0.5, 0.3, 0.2])
            if kind == "class":
                y = float(int(a > 2) + int(b > 0.5)) if ds == "big" else float(a + rng.normal() > 2)
            else:
                y = 3 * a - b + 0.1 * rng.normal() if ds == "num" else rng.normal()
            out.append((ds, len(out), float(a) if ds != "flat" else 1.0, float(b), str(c), float(y)))
    out += [("big", len(out) + k, *out[k][2:]) for k in range(50)]  # copies
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(fixture_rows(), "ds string, id long, a double, b double, c string, y double")


@pytest.fixture(scope="module")
def rows(raw):
    return g.model_rows(g.cleaned(raw, S), S, 3)


def folds_by_hand(data):
    """{dataset: [(fold, label, x)]} of the fixture, by the rules in plain Python."""
    out = {}
    for ds in ("big", "num", "two", "flat"):
        seen, ours = set(), []
        for r in data:
            row = (r[0], r[1], r[2], r[3], r[4].replace("{", ""), r[5])
            if r[0] == ds and row[2:5] not in seen:
                seen.add(row[2:5])
                ours.append(row)
        ys = sorted({r[5] for r in ours}, key=str)
        classes = ys if len(ys) < 10 else None
        shares = {v: sum(r[4] == v for r in ours) / len(ours) for v in "pqr"}
        x = np.array([[r[2], r[3], shares[r[4]]] for r in ours])
        spread = x.std(axis=0)
        x = np.where(spread > 1e-12, (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), 0)
        label = np.array([classes.index(r[5]) if classes else r[5] for r in ours], float)
        strat = classes and min(np.unique(label, return_counts=True)[1]) >= 3
        order = sorted(range(len(ours)), key=lambda i: (label[i] if strat else 0, hashlib.md5(str(ours[i][1]).encode()).hexdigest()))
        fold, count = np.zeros(len(ours), int), {}
        for i in order:
            k = label[i] if strat else 0
            fold[i] = count.get(k, 0) % 3
            count[k] = count.get(k, 0) + 1
        out[ds] = (fold, label, x, len(classes) if classes else 0)
    return out


def test_rows_of_all_datasets(raw, rows):
    want = folds_by_hand(raw.collect())
    got = {}
    for r in rows.collect():
        got.setdefault(r["dataset"], []).append((r["fold"], r["label"], *r["x"], r["classes"]))
    assert set(got) == set(want)
    for ds, (fold, label, x, classes) in want.items():
        ours = np.array(sorted(got[ds]))
        theirs = np.array(sorted((f, y, *v, classes) for f, y, v in zip(fold, label, x.tolist())))
        assert np.allclose(ours, theirs, atol=1e-9), ds


def weighted_f1(y, p):
    total = 0.0
    for c in np.unique(y):
        tp, named, n = ((p == c) & (y == c)).sum(), (p == c).sum(), (y == c).sum()
        total += n * (2 * tp / (named + n) if tp else 0.0)
    return total / len(y)


def bayes_by_hand(x, y, test):
    classes, floor = np.unique(y), 1e-9 * x.var(axis=0).max()
    s = []
    for c in classes:
        m, v = x[y == c].mean(axis=0), x[y == c].var(axis=0) + floor
        s.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (test - m) ** 2 / v).sum(axis=1))
    return classes[np.argmax(s, axis=0)]


def tree_by_hand(x, y, test, classes, cuts, depth):
    """Predictions of a greedy tree with the given thresholds."""
    if classes:
        impurity = lambda v: len(v) - sum((v == c).sum() ** 2 for c in range(classes)) / max(len(v), 1)
        value = lambda v: float(np.argmax([(v == c).sum() for c in range(classes)]))
    else:
        impurity = lambda v: np.square(v).sum() - v.sum() ** 2 / max(len(v), 1)
        value = lambda v: v.mean()
    best = (1e-9 * max(impurity(y), 1e-9), None)
    for j in range(x.shape[1]) if depth else ():
        for t in cuts[j]:
            left = x[:, j] <= t + 1e-9
            if left.any() and not left.all():
                gain = impurity(y) - impurity(y[left]) - impurity(y[~left])
                if gain > best[0] + 1e-9:
                    best = (gain, (j, t))
    if best[1] is None:
        return np.full(len(test), value(y))
    j, t = best[1]
    left, out = x[:, j] <= t + 1e-9, np.zeros(len(test))
    side = test[:, j] <= t + 1e-9
    out[side] = tree_by_hand(x[left], y[left], test[side], classes, cuts, depth - 1)
    out[~side] = tree_by_hand(x[~left], y[~left], test[~side], classes, cuts, depth - 1)
    return out


def test_closed_form_scores_against_numpy(raw, rows):
    got = {(r["dataset_id"], r["model"]): (r["score"], r["folds_done"]) for r in g.grouped_scores(rows, ["naive_bayes", "ridge", "sgd_reg", "lasso", "elastic"]).collect()}
    want = folds_by_hand(raw.collect())
    seen = 0
    for ds, (fold, y, x, classes) in want.items():
        parts = [(x[fold != f], y[fold != f], x[fold == f], y[fold == f]) for f in range(3)]
        if classes:
            score = np.mean([weighted_f1(vy, bayes_by_hand(tx, ty, vx)) for tx, ty, vx, vy in parts])
            assert got[ds, "naive_bayes"] == (pytest.approx(score, abs=1e-9), 3)
            seen += 1
            continue
        for name, (kind, weight, share) in g.PENALTIES.items():
            errors = []
            for tx, ty, vx, vy in parts:
                m, s = tx.mean(axis=0), tx.std(axis=0)
                s[s < 1e-9] = 1
                z, n = (tx - m) / s, len(ty)
                if share == 0:
                    b = np.linalg.solve(z.T @ z + (weight if kind == "sum" else weight * n) * np.eye(3), z.T @ (ty - ty.mean()))
                else:  # proximal gradient
                    b, step = np.zeros(3), n / np.linalg.eigvalsh(z.T @ z).max()
                    for _ in range(5000):
                        v = b - step * ((z.T @ (z @ b - ty + ty.mean())) / n + weight * (1 - share) * b)
                        b = np.sign(v) * np.maximum(np.abs(v) - step * weight * share, 0)
                errors.append(np.sqrt(np.mean((vy - ty.mean() - (vx - m) / s @ b) ** 2)))
            assert got[ds, name][0] == pytest.approx(-np.mean(errors), abs=1e-6), (ds, name)
            seen += 1
    assert seen == len(got) == 10


def test_trees_of_all_datasets_against_greedy_trees(raw, rows):
    got = {r["dataset_id"]: r["score"] for r in g.grouped_scores(rows, ["dt_clf", "dt_reg"], depth=3, bins=8).collect()}
    cuts = {r["dataset"]: r["c"] for r in rows.groupBy("dataset").agg(F.array(*[
        F.percentile_approx(F.get("x", F.lit(j)), [i / 8 for i in range(1, 8)], 10_000) for j in range(3)]).alias("c")).collect()}
    want = folds_by_hand(raw.collect())
    for ds, (fold, y, x, classes) in want.items():
        scores = []
        for f in range(3):
            p = tree_by_hand(x[fold != f], y[fold != f], x[fold == f], classes, [sorted(set(c)) for c in cuts[ds]], 3)
            scores.append(weighted_f1(y[fold == f], p) if classes else -np.sqrt(np.mean((p - y[fold == f]) ** 2)))
        assert got[ds] == pytest.approx(np.mean(scores), abs=1e-6), ds
    assert got["big"] > 0.9


def test_memory_of_all_datasets(spark, raw, tmp_path):
    store = str(tmp_path / "memory")
    first = {r["dataset_id"]: r for r in g.build_memory(raw.where("ds != 'two'"), S, store=store).collect()}
    assert set(first) == {"big", "num", "flat"}  # tiny has too few rows
    assert first["big"]["problem_type"] == "classification" and first["big"]["models"][0] in g.GROUPED["classification"]
    assert first["num"]["problem_type"] == "regression" and first["num"]["key"] == "openml_num" and len(first["num"]["embedding"]) == 10
    second = g.build_memory(raw, S, ["naive_bayes", "ridge"], store=store).collect()
    assert [r["dataset_id"] for r in second] == ["two"]
    assert spark.read.parquet(store).count() == 4
    assert g.build_memory(raw, S, store=store).count() == 0


def test_queue_of_single_fits(raw):
    ours = raw.where("ds in ('two', 'num')")
    got = {r["dataset_id"]: r for r in g.build_memory(ours, S, ["logistic", "elastic"], cv=2, at_once=2).collect()}
    assert got["two"]["models"] == ["logistic"] and got["two"]["score"] > 0.6 and got["num"]["models"] == ["elastic"]
    running, most = [], []

    def job(k):
        running.append(k)
        most.append(len(running))
        running.remove(k)

    assert g.queued(iter(range(20)), job, 3) == 20 and max(most) <= 3
    with pytest.raises(ZeroDivisionError):
        g.queued(iter([0]), lambda k: 1 / k)


def test_missing_values_and_text_targets(spark):
    rows = [("t", k, None if k % 7 == 0 else float(k % 5), 1.0, None if k % 11 == 0 else "u", f"name{k % 30:02d}") for k in range(90)]
    rows += [("n", k, float(k % 5), None, "u", None if k % 10 == 3 else str(k % 2)) for k in range(100, 170)]
    df = spark.createDataFrame(rows, "ds string, id long, a double, b double, c string, y string")
    made = g.model_rows(g.cleaned(df, S), S, 3)
    kinds = {r["dataset"]: (r["problem"], r["n"], r["l"]) for r in made.groupBy("dataset", "problem").agg(F.count("*").alias("n"), F.max("label").alias("l")).collect()}
    assert kinds["t"][0] == "regression" and kinds["n"][0] == "classification" and kinds["n"][2] == 1.0
    assert made.where(F.exists("x", lambda v: v.isNull())).count() == 0


def test_vector_sums(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, None]), ("a", [3.0]), (None, [5.0, 6.0]), ("a", None), ("e", [])], "k string, v array<double>").repartition(3)
    got = {r["k"]: (r["counts"], r["sums"], r["squares"]) for r in sums.vector_sums(df, ["k"], "v").collect()}
    assert got == {"a": ([2.0, 1.0, 0.0], [4.0, 2.0, 0.0], [10.0, 4.0, 0.0]), None: ([1.0, 1.0], [5.0, 6.0], [25.0, 36.0]), "e": ([], [], [])}
    whole = sums.vector_sums(df.where("k = 'a'"), [], "v").first()
    assert whole["sums"] == [4.0, 2.0, 0.0]
    plan = profile.mean_vector(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


def test_correlations_of_wide_tables(spark):
    """All pairs in two passes, over the rows where both columns are present, like numpy pair by pair."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 40)) * 10.0 ** rng.integers(-3, 6, 40) + 1e5
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=60)
    x[:, 7], x[rng.random(x.shape) < 0.1] = 3.7, np.nan
    group = np.arange(60) % 2
    names = [f"c{j}" for j in range(40)]
    rows = [(int(g_), *[None if np.isnan(v) else float(v) for v in r]) for g_, r in zip(group, x)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    for by in ([], ["g"]):
        got = {tuple(r[:-1]): r["corr"] for r in profile.corr_long(df, names, by).collect()}
        assert len(got) == 780 * (2 if by else 1)
        for key, corr in got.items():
            a, b = (names.index(c) for c in key[-2:])
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b]) & ((group == key[0]) if by else True)
            if 7 in (a, b):
                assert corr is None
            else:
                assert corr == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-7)
    few = {tuple(r[:2]): r["corr"] for r in profile.corr_pairs(df, [("c0", "c1"), ("c3", "c7")]).collect()}
    assert few["c0", "c1"] == pytest.approx({tuple(r[:2]): r["corr"] for r in profile.corr_products(df, names).collect()}["c0", "c1"], abs=1e-9) and few["c3", "c7"] is None


def test_grown_trees_carry_their_rows_along(rows, monkeypatch):
    """Every level reads the nodes that the level before stored, and joins that level's splits only; `value` is what a plain descent gives."""
    levels = []
    down = g.descend

    def seen(now, found, level, cv):
        levels.append((level, found.collect(), now.columns))
        return down(now, found, level, cv)

    monkeypatch.setattr(g, "descend", seen)
    got = g.grow_trees(g.binned(rows, 8), 3, 3, 8).collect()
    assert [x[0] for x in levels] == [0, 1, 2] and all("nodes" in x[2] for x in levels)
    assert all(1 << k <= r["place"] % g._NODE < 2 << k for k, found, _ in levels for r in found)
    splits = {(r["dataset"], *divmod(r["place"], g._NODE)): r for _, found, _ in levels for r in found}
    assert len(got) == rows.count()
    for r in got:
        node, value = 1, None
        while (s := splits.get((r["dataset"], r["fold"], node))) is not None:
            value = s["value"] if node == 1 else value
            if s["feature"] < 0:
                break
            right = r["bins"][s["feature"]] > s["bin"]
            node, value = 2 * node + right, s["right" if right else "left"]
        assert r["value"] == value
