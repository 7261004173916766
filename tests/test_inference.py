"""Inference, splits, scores, models and the grid against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest

from tidemark.config import Config
from tidemark.functions import special as sf
from tidemark.operators import evaluation as va
from tidemark.operators import inference as inf
from tidemark.operators import splits as sp


def test_tails_match_known_values():
    assert sf.Z975 == pytest.approx(1.959963985, abs=1e-8)
    assert sf.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert sf.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert sf.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
    assert sf.f_sf(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-5)
    assert sf.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and sf.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 2000
    g = rng.integers(0, 50, n)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    e = rng.normal(size=n) * (1 + np.abs(x1)) + rng.normal(size=50)[g]
    y = 0.5 + 2 * x1 - x2 + e
    lab = (rng.random(n) < 1 / (1 + np.exp(-0.8 * x1))).astype(float)
    return g, x1, x2, y, lab


@pytest.fixture(scope="module")
def table(spark, sample):
    g, x1, x2, y, lab = sample
    rows = [(int(a), float(b), float(c), float(d), float(e), float(2 * b - c)) for a, b, c, d, e in zip(g, x1, x2, y, lab, strict=True)]
    rows += [(1, None, 1.0, 1.0, 1.0, 0.0), (1, float("inf"), 1.0, 1.0, 1.0, 0.0), (1, float("nan"), 1.0, 1.0, 1.0, 0.0)]
    return spark.createDataFrame(rows, "g int, x1 double, x2 double, y double, lab double, alias double").cache()


def test_least_squares_and_its_errors(table, sample):
    g, x1, x2, y, _ = sample
    t, info = inf.ols_hc3(table, "y", ["x1", "x2"], "g")
    X = np.column_stack([np.ones(len(y)), x1, x2])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    inv = np.linalg.inv(X.T @ X)
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv
    s = np.array([(X[g == k] * e[g == k, None]).sum(axis=0) for k in np.unique(g)])
    cl = inv @ s.T @ s @ inv * (50 / 49) * ((len(y) - 1) / (len(y) - 3))
    assert t["coef"].to_numpy() == pytest.approx(b) and t["se_hc3"].to_numpy() == pytest.approx(np.sqrt(np.diag(hc3)))
    assert t["se_cluster_date"].to_numpy() == pytest.approx(np.sqrt(np.diag(cl)))
    assert info["n"] == 2000 and info["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()) and info["f_pvalue"] < 1e-6
    assert t["std_coef"][1] == pytest.approx(b[1] * x1.std() / y.std())


def test_logit(table, sample):
    _, x1, _, _, lab = sample
    t, info = inf.logit_odds(table, "lab", ["x1"])
    z = (x1 - x1.mean()) / x1.std()
    X, b = np.column_stack([np.ones(len(z)), z]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        H = (X.T * (p * (1 - p))) @ X
        b = b + np.linalg.solve(H, X.T @ (lab - p))
    assert t["coef_per_sd"].to_numpy() == pytest.approx(b) and t["se"].to_numpy() == pytest.approx(np.sqrt(np.diag(np.linalg.inv(H))))
    assert t["odds_ratio_per_sd"][1] > 1.5 and 0 < info["pseudo_r2"] < 1


def test_aliased_columns(table):
    assert inf.drop_aliased(table, ["x1", "x2", "alias"]) == (["x1", "x2"], ["alias"])
    assert inf.drop_aliased(table, ["alias", "x1", "x2"]) == (["alias", "x1"], ["x2"])


def test_false_discovery(spark):
    p = [0.001, 0.008, 0.02, 0.04, 0.3, 0.9, 0.02]
    got = {(r.i): r for r in inf.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)) + [(99, None)], "i int, p_value double")).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(max=1)
    for k, i in enumerate(order):
        assert got[int(i)].q_value == pytest.approx(q[k])
    assert 99 not in got and got[0].reject_fdr and not got[5].reject_fdr


def test_clustered_mean(table, sample):
    g, _, _, y, _ = sample
    r = inf.with_t_interval(inf.clustered_sums(table.where("x1 < 1e300 AND x1 IS NOT NULL AND NOT isnan(x1)"), "y", "g")).first()
    dev = y - y.mean()
    se = math.sqrt(sum(dev[g == k].sum() ** 2 for k in np.unique(g))) / len(y) * math.sqrt(50 / 49)
    assert r.se == pytest.approx(se) and r.n == 2000 and r.ci_hi - r["mean"] == pytest.approx(sf.t_quantile(0.975, 49) * se)
    one = inf.with_t_interval(inf.clustered_sums(table.limit(1), "y", "g")).first()
    assert one.n == 1 and one.n_clusters == 0 and one["mean"] is None and one.ci_lo is None and one.p_value is None
    assert inf.clustered_sums(table.selectExpr("g", "CAST(NULL AS DOUBLE) y"), "y", "g").first().n == 0


def test_weights_are_poisson():
    rng = np.random.default_rng(0)
    w = inf.bootstrap_weights(rng.integers(0, inf.PRIME, 3000), rng.integers(1, inf.PRIME, 3000), 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert abs(w.mean(axis=0).var() * 3000 - 1) < 0.25  # replicates vary as means of independent weights do
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.1 and np.abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.25


def test_false_discovery_of_many_tests_with_ties(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(3000) ** 3, np.zeros(5), np.ones(7), np.full(20, 1e-40), np.round(rng.random(500), 2)])
    got = inf.benjamini_hochberg(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p_value double")).toPandas().sort_values("i")
    order = np.argsort(p, kind="stable")
    q = np.empty(len(p))
    q[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(max=1)
    for v in np.unique(p):
        q[p == v] = q[p == v].min()
    assert got["q_value"].to_numpy() == pytest.approx(q) and len(got) == len(p)


def test_bootstrap_covers_and_repeats(spark, table):
    rows = table.withColumnRenamed("g", "id").selectExpr("'all' AS k", "id", "x2", "y", "x1")
    a = inf.bootstrap_mean(rows, "k", ["id", "x2", "y"], "x2", replicates=400).first()
    b = inf.bootstrap_mean(rows.repartition(7), "k", ["id", "x2", "y"], "x2", replicates=400).first()
    assert a.lo < a["mean"] < a.hi and a.hi - a.lo == pytest.approx(2 * 1.96 / math.sqrt(2000), rel=0.2)
    assert (a.lo, a.hi, a.p_value) == pytest.approx((b.lo, b.hi, b.p_value))
    none = inf.bootstrap_mean(rows.selectExpr("CASE WHEN id < 2 THEN 'none' ELSE 'some' END AS k", "id", "IF(id < 2, NULL, x2) AS x2", "y"), "k", ["id", "y"], "x2", replicates=50).where("k = 'none'").first()
    assert none.n == 0 and none["mean"] is None and none.lo is None and none.p_value is None
    two = rows.selectExpr("CASE WHEN id < 25 THEN 'a' ELSE 'b' END AS k", "id", "x2", "y", "CASE WHEN id < 25 THEN x2 + 1 ELSE x2 END AS v")
    d = inf.bootstrap_diff(two, "k", ["id", "x2", "y"], "v", [("H", "a", "b")], replicates=400).first()
    assert d.lo < 1 < d.hi and d.p_value == 0
    path = inf.bootstrap_path(rows, "k", ["id", "x2", "y"], ["x2", "y"], replicates=200).orderBy("tau").collect()
    assert [r.tau for r in path] == [0, 1] and all(r.lo < r.hi for r in path)


def test_split_and_folds(spark):
    days = [dt.date(2007, 1, 1) + dt.timedelta(days=i) for i in range(2000)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d date, i int")
    got = {r.i: r.split for r in sp.chronological_split(df, "d").collect()}
    block = lambda s: [i for i, v in got.items() if v == s]
    assert sp.embargo_days(20) == 29
    assert max(block("train")) == 1400 - 30 and min(block("val")) == 1400 and max(block("val")) == 1700 - 30 and min(block("test")) == 1700
    folds = sp.expanding_folds(df, "d")
    assert len(folds) == 5 and all((f["test_start"] - f["train_end"]).days == 29 for f in folds)
    assert [f["n_train"] for f in folds] == sorted(f["n_train"] for f in folds)
    assert sp.expanding_folds(df.limit(0), "d") == []
    with pytest.raises(ValueError):
        sp.chronological_split(df.limit(0), "d")


def test_scores(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    p = np.round(np.clip(0.4 * y + 0.6 * rng.random(500), 0, 1), 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)] + [(None, 0.5), (1.0, None)], "y double, p double")
    m = va.classification_metrics(df, "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = prev = 0.0
    for t in sorted(set(p), reverse=True):
        tp = (pos >= t).sum()
        ap += (tp - prev) / len(pos) * tp / (p >= t).sum()
        prev = tp
    assert m.roc_auc == pytest.approx(auc) and m.pr_auc == pytest.approx(ap) and m.n == 500
    assert m.brier == pytest.approx(((p - y) ** 2).mean()) and m.accuracy == pytest.approx(((p >= 0.5) == y).mean())
    bins = va.calibration_bins(df, "y", "p").collect()
    assert sum(b.n for b in bins) == 500 and bins[0].ece == pytest.approx(sum(b.n * abs(b.mean_pred - b.observed_freq) for b in bins) / 500)
    one = va.classification_metrics(df.where("y = 1"), "y", "p").first()
    assert one.roc_auc is None


def test_config(tmp_path):
    c = Config()
    d = c.override(**{"events.cooldown": 5})
    assert c.get("events.cooldown") == 20 and d.get("events.cooldown") == 5 and c.fingerprint != d.fingerprint and c.fingerprint == Config().fingerprint
    with pytest.raises(KeyError):
        c.override(**{"events.nothing": 1})
    (tmp_path / "c.yaml").write_text("events:\n  cooldown: 7\n")
    assert Config.from_yaml(str(tmp_path / "c.yaml")).get("events.cooldown") == 7


def test_sources(spark, tmp_path):
    from tidemark import sources

    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    sources.write_table(df, str(tmp_path), "t")
    assert sources.read_table(spark, str(tmp_path), "t").count() == 2
    sources.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in sources.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == [(1, "a"), (2, None)]
    assert "generated_utc" in sources.write_manifest(str(tmp_path / "m.json"), {"n": 2})
