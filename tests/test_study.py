"""Panel, universe, events, features on small hand-made series."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators import panel as pn
from tidemark.operators import universe as un

D0 = dt.date(2010, 1, 4)
DAYS = [d for d in (D0 + dt.timedelta(days=i) for i in range(600)) if d.weekday() < 5][:400]
PRICES = "ticker string, date date, pos int, open double, high double, low double, close double, volume double"


def level(n, seed, sd, start):
    rng, p, out = random.Random(seed), start, []
    for _ in range(n):
        p *= 1 + rng.gauss(0, sd)
        out.append(p)
    return out


def path_a():
    x = level(400, 1, 0.01, 100.0)
    rets = [None] + [b / a - 1 for a, b in zip(x, x[1:], strict=False)]
    rets[200] = -0.20
    for i in range(201, 221):
        rets[i] = 0.005
    out = [x[0]]
    for r in rets[1:]:
        out.append(out[-1] * (1 + r))
    return out


@pytest.fixture(scope="module")
def closes():
    return {"AAA": path_a(), "BBB": level(400, 2, 0.01, 50.0)}


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(d, i) for i, d in enumerate(DAYS)], "date date, pos int")


def frame(spark, closes, skip=()):
    return spark.createDataFrame([(t, DAYS[i], i, c, c * 1.01, c * 0.99, c, 1000.0 + i) for t, cs in closes.items() for i, c in enumerate(cs) if (t, i) not in skip], PRICES)


@pytest.fixture(scope="module")
def panel(spark, closes):
    return pn.with_returns(frame(spark, closes)).cache()


@pytest.fixture(scope="module")
def market(spark, calendar):
    m = level(400, 3, 0.004, 200.0)
    return pn.market_series(spark.createDataFrame([(i, c) for i, c in enumerate(m)], "pos int, close double"), calendar).cache()


@pytest.fixture(scope="module")
def windows(spark):
    return spark.createDataFrame([("AAA", DAYS[0], None), ("BBB", DAYS[0], DAYS[100])], "ticker string, start date, end date")


def values(df, *names):
    return {(r.ticker, r.pos): tuple(r[n] for n in names) for r in df.select("ticker", "pos", *names).collect()}


def test_moments_use_prior_days_only(spark, closes, panel):
    z = pn.with_zscore(panel, 60, 60)
    got = values(z, "ret", "mu", "sigma", "z")
    first = min(p for (t, p), v in got.items() if t == "AAA" and v[3] is not None)
    assert first == 61
    rets = [b / a - 1 for a, b in zip(closes["AAA"], closes["AAA"][1:], strict=False)]
    prior = rets[139:199]
    assert got[("AAA", 200)][1] == pytest.approx(sum(prior) / 60)
    assert got[("AAA", 200)][3] < -10
    changed = {t: [c * 100 + 7 if i >= 200 and t == "AAA" else c for i, c in enumerate(cs)] for t, cs in closes.items()}
    other = values(pn.with_zscore(pn.with_returns(frame(spark, changed)), 60, 60), "mu", "sigma")
    for p in range(0, 201):
        assert other[("AAA", p)] == pytest.approx(got[("AAA", p)][1:3], nan_ok=True) or other[("AAA", p)] == got[("AAA", p)][1:3]


def test_a_missing_day_breaks_returns_and_counts(spark, closes):
    got = values(pn.with_moments(pn.with_returns(frame(spark, closes, {("AAA", 100)})), 60, 60), "ret", "mu")
    assert ("AAA", 100) not in got and got[("AAA", 101)][0] is None
    assert got[("AAA", 130)][1] is None and got[("AAA", 162)][1] is not None
    assert got[("BBB", 101)][0] is not None


def test_expanding_percentile_is_strictly_prior(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])], "k string, pos int, x double")
    got = [r.cut for r in pn.expanding_percentile(df, "k", "x", 0.5, 2).orderBy("pos").collect()]
    assert got == [None, None, 3.0, 4.0, 3.0]


def test_fill_forward_stops_at_the_limit(spark):
    cal = spark.createDataFrame([(i,) for i in range(8)], "pos int")
    got = [r.close for r in pn.fill_forward(spark.createDataFrame([(0, 1.0), (6, 2.0)], "pos int, close double"), cal, 3).orderBy("pos").collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, None, None, 2.0, 2.0]


def test_calendar_and_unpivot(spark):
    df = spark.createDataFrame([(D0, 1.0, None), (D0, 2.0, 3.0), (None, 1.0, 1.0), (D0 + dt.timedelta(days=1), None, None)], "date date, a double, b double")
    assert [tuple(r) for r in pn.calendar_pos(df).orderBy("pos").collect()] == [(D0, 0), (D0 + dt.timedelta(days=1), 1)]
    assert pn.unpivot_fields(df, ["date"], ["a", "b"]).count() == 5


def test_cooldown_golden_and_greedy(spark):
    rows = [("A", p, -3.0) for p in (100, 105, 110, 130, 131, 200)] + [("B", 101, -4.0)]
    df = spark.createDataFrame(rows, "ticker string, pos int, z double")
    got = sorted((r.ticker, r.pos, r.episode_length) for r in ep.cooldown(df, 20).collect())
    assert got == [("A", 100, 3), ("A", 130, 2), ("A", 200, 1), ("B", 101, 1)]
    assert ep.cooldown(df.limit(0), 20).count() == 0
    edge = ep.cooldown(spark.createDataFrame([("A", 0), ("A", 20), ("A", 39), ("A", 40)], "ticker string, pos int"), 20)
    assert sorted(r.pos for r in edge.collect()) == [0, 20, 40]


def test_outcomes_follow_the_event(spark, closes, calendar, panel, market, windows):
    cands = ep.candidates(pn.with_zscore(panel, 60, 60), windows, -3.0, DAYS[0], DAYS[-1])
    kept = ep.cooldown(cands, 20)
    around = ep.surroundings(kept, panel, [1, 5, 20], 20, 20, [60]).withColumnRenamed("prior_volumes_60", "prior_volumes")
    assert around.count() == kept.count() and ep.surroundings(kept.limit(0), panel, [1], 20, 20, [60]).count() == 0
    ev = kept.join(around, ["ticker", "pos"]).withColumnRenamed("z", "crash_z").withColumn("raw_return", F.col("ret")).withColumnRenamed("date", "event_date")
    out = {(r.ticker, r.pos): r for r in ep.with_outcomes(ev, market, calendar, [1, 5, 20], 20).collect()}
    assert ("AAA", 200) in out and not [k for k in out if k[0] == "BBB" and k[1] >= 100]
    e, c = out[("AAA", 200)], closes["AAA"]
    m = {r.pos: r.market for r in market.collect()}
    for h in (1, 5, 20):
        assert e[f"fwd_ret_{h}"] == pytest.approx(c[200 + h] / c[200] - 1)
        assert e[f"car_{h}"] == pytest.approx(c[200 + h] / c[200] - m[200 + h] / m[200])
    assert e.mfe_20 == pytest.approx(max(c[201:221]) / c[200] - 1) and e.mae_20 == pytest.approx(min(c[201:221]) / c[200] - 1)
    assert e.regained_precrash_20 == float(max(c[201:221]) >= c[199]) and e.days_to_recovery is None
    assert e.recovered_20d == float(e.car_20 > 0) and e.complete_20
    late = [r for (t, p), r in out.items() if p > 379]
    assert all(r.car_20 is None and r.recovered_20d is None and r.regained_precrash_20 is None for r in late)
    path = {r.tau: r.car for r in ep.car_path(ev.withColumn("event_id", F.concat("ticker", "pos")).where("pos = 200 AND ticker = 'AAA'"), panel, market, calendar, 30).collect()}
    assert path[0] == 0.0 and path[20] == pytest.approx(e.car_20) and len(path) == 31
    sectors = spark.createDataFrame([("AAA", "ENERGY")], "ticker string, sector string")
    rets = pn.sector_series(panel, sectors, market)
    f = ep.with_features(ep.with_outcomes(ev, market, calendar, [1, 5, 20], 20), market, calendar, sectors, rets, *ep.percentile_cuts(market, rets, 5.0, 100), 60)
    r = {(x.ticker, x.pos): x for x in f.collect()}[("AAA", 200)]
    assert r.mom_5 == pytest.approx(c[199] / c[194] - 1) and r.abs_decline == pytest.approx(0.2)
    assert r.med_volume_60 == pytest.approx(1000 + 169.5) and r.avol == pytest.approx(math.log(1200 / 1169.5))
    assert r.hl_range == pytest.approx(c[200] * 0.02 / c[199]) and r.crash_type in ("sector", "broad_market")


def test_feature_list_refuses_outcomes():
    ep.check_features(ep.FEATURES)
    for bad in ("car_20", "recovered_20d", "episode_length", "close"):
        with pytest.raises(ValueError):
            ep.check_features(["crash_z", bad])


def test_quantile_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)] + [(None,)], "v double")
    got = {r.v: r.q for r in ep.quantile_bins(df, {"q": ("v", ["Q1", "Q2", "Q3", "Q4"])}).collect()}
    assert got == {None: None, 1.0: "Q1", 2.0: "Q1", 3.0: "Q2", 4.0: "Q2", 5.0: "Q3", 6.0: "Q3", 7.0: "Q4", 8.0: "Q4"}


# --- universe -------------------------------------------------------------------

def test_windows_rolled_back(spark):
    d = dt.date
    current = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    log = spark.createDataFrame([(d(2012, 1, 10), "CCC", None), (d(2018, 6, 1), "AAA", "CCC"), (d(2020, 3, 2), "nan", "DDD"), (None, "X", "Y"), (d(2019, 1, 1), "EEE", " ")], "date date, added string, removed string")
    got = sorted((r.ticker, r.start, r.end) for r in un.membership_windows(current, log, d(2005, 6, 1), d(2026, 1, 1)).collect())
    assert got == [("AAA", d(2018, 6, 1), d(2026, 1, 1)), ("BBB", d(2005, 6, 1), d(2026, 1, 1)), ("CCC", d(2012, 1, 10), d(2018, 6, 1)), ("DDD", d(2005, 6, 1), d(2020, 3, 2))]


def test_eligibility_is_half_open(spark):
    w = spark.createDataFrame([("A", DAYS[1], DAYS[4])], "ticker string, start date, end date")
    rows = spark.createDataFrame([("A", d) for d in DAYS[:6]] + [("B", DAYS[2])], "ticker string, date date")
    assert sorted(r.date for r in un.eligible(rows, w).collect()) == DAYS[1:4]


def test_reuse_guard(spark):
    w = spark.createDataFrame([("OLD", dt.date(2010, 1, 1), dt.date(2010, 2, 1)), ("OK", dt.date(2010, 1, 1), dt.date(2020, 1, 1))], "ticker string, start date, end date")
    p = spark.createDataFrame([("OLD", d) for d in DAYS[100:160]] + [("OK", d) for d in DAYS[:60]] + [("NONE", DAYS[0])], "ticker string, date date")
    got = {r.ticker: (r.kept, r.overlap_obs) for r in un.reuse_guard(p, w).collect()}
    assert got == {"OLD": (False, 0), "OK": (True, 60)}


def test_integrity_rules(spark):
    series = {"SWING": [100.0, 5.0] * 100, "FEW": [float(1 + i % 5) * 0.1 + 10 for i in range(300)], "SQUEEZE": [10.0 + 0.01 * i for i in range(50)] + [40.0] + [10.5 + 0.01 * i for i in range(50)], "SHORT": [1.0, 9.0] * 4}
    df = spark.createDataFrame([(t, DAYS[i % 400] if i < 400 else None, c) for t, cs in series.items() for i, c in enumerate(cs)], "ticker string, date date, close double")
    got = {r.ticker: r.reason for r in un.integrity_report(df).collect()}
    assert got["SQUEEZE"] is None and "SHORT" not in got and got["FEW"] == "low_value_diversity"
    assert got["SWING"] == "round_trip_oscillation+extreme_move_frequency+low_value_diversity"
    assert {r.ticker for r in un.integrity_screen(df).select("ticker").distinct().collect()} == {"SQUEEZE", "SHORT"}


def test_coverage_and_sectors(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "ticker string")
    r = un.coverage_report(t("A", "B", "C", "C"), t("A", "B", "Z"), t("A", "D")).first()
    assert (r.eligible_tickers, r.current_members, r.historical_only, r.historical_with_prices, r.historical_missing, r.historical_coverage_pct, r.current_coverage_pct) == (3, 2, 2, 1, 1, 50.0, 50.0)
    s = lambda rows: spark.createDataFrame(rows, "ticker string, sector string")
    got = {r.ticker: r.sector for r in un.resolve_sectors(s([("a.b", None), ("C", " ")]), s([("A-B", "tech "), ("C", "Oil"), (None, "X")]), relabel={"OIL": "ENERGY"}).collect()}
    assert got == {"A-B": "TECH", "C": "ENERGY"}


def test_lenient_dates_and_clean_log(spark):
    raw = spark.createDataFrame([("2012-01-10", " ccc ", None), ("June 1, 2018", "aaa", "CCC"), ("Mar 2, 2020", "nan", "ddd.b"), ("03/02/2020", "", "x"), ("2 March 2020", "y", " "), ("2015-05-05 10:11:12", "z", None), ("soon", "a", "b"), (None, "a", "b"), ("13/45/2020", "a", "b")], "date string, added string, removed string")
    got = [(str(r.date), r.added, r.removed) for r in un.clean_changes(raw).collect()]
    key = lambda t: tuple("" if v is None else v for v in t)
    assert sorted(got, key=key) == sorted([("2012-01-10", "CCC", None), ("2015-05-05", "Z", None), ("2018-06-01", "AAA", "CCC"), ("2020-03-02", None, "DDD-B"), ("2020-03-02", None, "X"), ("2020-03-02", "Y", None)], key=key)
    assert un.clean_changes(raw.limit(0)).count() == 0


def test_first_row_of_a_symbol(spark):
    rows = spark.createDataFrame([("a.b", 2, "later"), (" A-B", 1, "first"), ("A.B", None, "never"), (None, 0, "none"), ("nan", 0, "none"), ("c", None, "only")], "ticker string, n int, _order string")
    assert sorted((r.ticker, r.n, r._order) for r in un.first_by_symbol(rows, "n").collect()) == [("A-B", 1, "first"), ("C", None, "only")]


def test_folders_are_made_once(spark, tmp_path):
    from tidemark.sources import ensure_folders

    for _ in range(2):
        assert len(ensure_folders(spark, f"file://{tmp_path}", "results/tables", "results/metrics")) == 2
    assert (tmp_path / "results" / "tables").is_dir()


def test_regression_cells_without_a_solution_have_nulls(spark):
    from tidemark.operators import grid as gr

    rng = np.random.default_rng(0)
    rows = [(-3.0, 60, c, 20, float(rng.normal()), float(rng.normal()) if c != 10 else 1.0, float(rng.normal()) if c != 20 or i < 2 else None) for c, n in ((5, 40), (10, 40), (20, 40), (40, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "z_threshold double, vol_window int, cooldown int, horizon int, car double, x1 double, x2 double")
    got = {r.cooldown: r for r in gr.grid_regressions(df, ("x1", "x2"), ("x1",), 20).collect()}
    assert set(got) == {5, 10, 20}  # the gate counts outcomes, not complete rows
    assert got[5].beta_x1 is not None and 0 <= got[5].p_x1 <= 1
    assert got[10].beta_x1 is None and got[10].ols_adj_r2 is None and got[20].p_x1 is None
