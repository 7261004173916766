"""Learners and models against brute force and held-out accuracy."""

import itertools
import math

import numpy as np
import pytest

from tidemark.operators import learners as le
from tidemark.operators import models as ml

NAMES = ["crash_z", "avol", "vix"]


def data(n=600, k=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    return x, (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.4 * rng.normal(size=n) > 0).astype(float)


def auc(y, p):
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])


@pytest.fixture(scope="module")
def table(spark):
    x, y = data()
    rows = [(i, *map(float, x[i]), float(y[i]), "train" if i < 300 else "val" if i < 450 else "test") for i in range(len(y))]
    rows[5] = (5, None, float("nan"), *rows[5][3:])
    return spark.createDataFrame(rows, "id int, crash_z double, avol double, vix double, y double, split string").cache()


def test_logistic_minimises_the_penalised_loss():
    x, y = data()
    m = le.fit_logistic(x, y, 0.1)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    loss = lambda b: np.log1p(np.exp(-(2 * y - 1) * (z @ b))).sum() + 10 * (b[1:] ** 2).sum() / 2
    assert all(loss(m["beta"]) < loss(m["beta"] + d) for d in 1e-3 * np.vstack([np.eye(4), -np.eye(4)]))


def test_first_boosted_split_is_the_best_of_all():
    x, y = data(300)
    m = le.fit_boosting(x, y, 1, 0.1, 2, 0, leaf=20, rows=1.0, columns=1.0)
    p = y.mean()
    worth = lambda g, n: g**2 / (n * p * (1 - p) + 1)
    best = max(((worth((p - y[at]).sum(), at.sum()) + worth((p - y[~at]).sum(), (~at).sum()), f) for f in (0, 1, 2) for v in np.unique(le.quantile_codes(x)[1][f]) for at in [x[:, f] <= v] if 20 <= at.sum() <= 280), key=lambda t: t[0])
    assert m["feature"][0] == best[1] and len(m["value"]) == 3
    at = x[:, best[1]] <= m["threshold"][0]
    assert worth((p - y[at]).sum(), at.sum()) + worth((p - y[~at]).sum(), (~at).sum()) == pytest.approx(best[0])
    assert m["value"][1] == pytest.approx(-0.1 * (p - y[at]).sum() / (at.sum() * p * (1 - p) + 1))


@pytest.mark.parametrize(("kind", "params"), [("random_forest", {"leaf": 10}), ("boosting", {"rounds": 60, "rate": 0.1, "leaves": 8, "leaf": 10})])
def test_trees_rank_unseen_rows(kind, params):
    x, y = data(900)
    m = le.fit_model(kind, params, x[:600], y[:600], 3, 60)
    p = le.probability(m, x[600:])
    assert auc(y[600:], p) > 0.93 and (p >= 0).all() and (p <= 1).all()
    assert np.array_equal(p, le.probability(le.fit_model(kind, params, x[:600], y[:600], 3, 60), x[600:]))
    if kind == "random_forest":
        assert m["cover"][m["feature"] < 0].min() >= 10


def test_degenerate_tables():
    x, y = np.zeros((5, 2)), np.array([0.0, 1, 0, 1, 1])
    for kind, params in (("logistic", {"c": 1.0}), ("random_forest", {"leaf": 1}), ("boosting", {"rounds": 3, "rate": 0.1, "leaves": 4})):
        assert le.probability(le.fit_model(kind, params, x, y, 0, 20), x) == pytest.approx(np.full(5, 0.6), abs=0.2)
    assert np.isfinite(le.probability(le.fit_model("boosting", {"rounds": 3, "rate": 0.1, "leaves": 4}, x, np.ones(5), 0, 1), x)).all()


def test_shapley_values_are_those_of_the_definition():
    x, y = data(400)
    m = le.fit_boosting(x, y, 4, 0.3, 6, 0, leaf=10)
    rows = x[:3]

    def expectation(v, on, at):
        f = m["feature"][at]
        if f < 0:
            return m["value"][at]
        left, right = m["left"][at], m["right"][at]
        if f in on:
            return expectation(v, on, left if v[f] <= m["threshold"][at] else right)
        return (m["cover"][left] * expectation(v, on, left) + m["cover"][right] * expectation(v, on, right)) / m["cover"][at]

    got = le.tree_shap(m, rows)
    for r, v in enumerate(rows):
        for i in range(3):
            rest, want = [j for j in range(3) if j != i], 0.0
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    w = math.factorial(k) * math.factorial(2 - k) / 6
                    want += w * sum(expectation(v, {*s, i}, t) - expectation(v, set(s), t) for t in m["roots"])
            assert got[r, i] == pytest.approx(want, abs=1e-9)


def test_search_refits_the_best_and_scores_once(table, monkeypatch):
    monkeypatch.setitem(ml.PARAMS, "boosting", [{"rounds": 5, "rate": 0.1, "leaves": 4}, {"rounds": 40, "rate": 0.1, "leaves": 4}])
    t, fitted = ml.search(table, "y", NAMES, seed=2, trees=60)
    assert t["model"].tolist() == ["logistic", "random_forest", "boosting", "base_rate"] and (t["roc_auc"][:3] > 0.85).all() and (t["n"] == 150).all()
    assert fitted["boosting"].params in ml.PARAMS["boosting"] and len(fitted["random_forest"].model["roots"]) == 60
    assert ml.logistic_ranking(fitted["logistic"])["feature"][0] == "crash_z"
    best = ml.choose(table, "y", NAMES, ("logistic",), seed=2)["logistic"]
    assert best[1] == fitted["logistic"].params and best[0] == pytest.approx(t["val_roc_auc"][0])
    c = ml.calibration(fitted, table.where("split = 'test'"), "y", 5).toPandas()
    assert c.groupby("model")["n"].sum().tolist() == [150] * 3 and c.groupby("model")["ece"].nunique().tolist() == [1] * 3
    for name, auc_ in zip(t["model"][:3], t["roc_auc"][:3], strict=True):
        assert c[c.model == name]["roc_auc"].iloc[0] == pytest.approx(auc_)


def test_folds_have_every_kind(spark, table, monkeypatch):
    import datetime as dt

    monkeypatch.setitem(ml.PARAMS, "boosting", [{"rounds": 5, "rate": 0.1, "leaves": 4}])
    dated = table.selectExpr("*", "date_add(DATE '2010-01-01', id) AS d")
    folds = [{"fold": k, "train_end": dt.date(2010, 1, 1) + dt.timedelta(days=a), "test_start": dt.date(2010, 1, 1) + dt.timedelta(days=a + 30), "test_end": dt.date(2010, 1, 1) + dt.timedelta(days=a + 129)} for k, a in enumerate((200, 400))]
    t = ml.expanding_comparison(dated, "y", NAMES, "d", folds, trees=40)
    assert t[["fold", "model"]].values.tolist() == [[k, m] for k in (0, 1) for m in ml.PARAMS] and (t["n"] == 100).all() and (t["roc_auc"] > 0.8).all()


def test_learning_rows_are_bounded(table):
    few = ml.labelled(table, "y", NAMES, "split", max_rows=100)
    assert 60 < len(few["y"]) < 140 and few["x"].shape[1] == 3
    assert len(ml.labelled(table, "y", NAMES, "split")["y"]) == 600
    with pytest.raises(ValueError):
        ml.fit(table, "y", ["y"], "logistic", {"c": 1.0})
    with pytest.raises(Exception, match="no rows"):
        ml.fit(table.limit(0), "y", NAMES, "logistic", {"c": 1.0})


def test_importances(table):
    m = ml.fit(table.where("split <> 'test'"), "y", NAMES, "boosting", {"rounds": 40, "rate": 0.1, "leaves": 6, "leaf": 20})
    test = table.where("split = 'test'")
    imp = {r.feature: r for r in ml.permutation_importance(m, test, "y", repeats=3).collect()}
    assert max(imp, key=lambda f: imp[f].importance_mean) == "crash_z" and all(r.importance_std >= 0 for r in imp.values()) and len(imp) == 3
    shap = ml.shap_values(m, test, "id").cache()
    assert shap.count() == 150
    rank = {r.feature: r.mean_abs_shap for r in ml.shap_importance(shap, NAMES).collect()}
    assert max(rank, key=rank.get) == "crash_z"
    scaled = ml.shap_scaled(shap, NAMES, "id").toPandas()
    assert len(scaled) == 450 and scaled["scaled"].min() == 0 and scaled["scaled"].max() == 1
    bins = ml.shap_dependence(shap, NAMES, top=2).toPandas()
    assert set(bins.feature) == set(sorted(rank, key=rank.get)[-2:]) and bins.groupby("feature")["n"].sum().tolist() == [150, 150] and bins["bin"].max() == 11
