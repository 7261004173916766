"""Tables that need only means of the grid's cells ask for outcomes only."""

import datetime
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import panel as pn
from tidemark.plans import inference_queries as q

WINDOWS, THRESHOLDS, COOLDOWNS, HORIZONS, LEAST = (4, 6), (-1.0, -1.5), (3, 6), (2, 5), 5


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(5)
    first = datetime.date(2020, 1, 1)
    level = {p: 100 * (1 + 0.001 * p) + rng.random() for p in range(90)}
    made = [(t, first + datetime.timedelta(p), p, rng.uniform(50, 150)) for t in ("A", "B", "C", "OUT") for p in range(90) if t != "B" or p % 17]
    panel = pn.with_returns(spark.createDataFrame(made, "ticker string, date date, pos int, close double").withColumn("volume", F.lit(1000.0))).cache()
    # A's last days, and all of OUT's, lie in no window.
    windows = spark.createDataFrame([("A", first, first + datetime.timedelta(70)), ("B", first, None), ("C", first, None)], "ticker string, start date, end date")
    market = spark.createDataFrame([(p, v if p % 29 else None) for p, v in level.items()], "pos int, market double").coalesce(1).cache()
    config = Config().override(**{"robustness.vol_windows": list(WINDOWS), "robustness.z_thresholds": list(THRESHOLDS), "robustness.cooldowns": list(COOLDOWNS), "robustness.horizons": list(HORIZONS), "robustness.min_events": LEAST})
    return SimpleNamespace(config=config, panel=panel, windows=windows, market=market, calendar=market.select("pos"))


def test_means_are_those_of_events_found_one_by_one(study, monkeypatch):
    monkeypatch.setattr(q, "written", lambda *_: pytest.fail("a table was written"))
    means = q._means(study)
    got = {(r.z_threshold, r.vol_window, r.cooldown, r.horizon): (r.mean_car, r.recovery_rate) for r in means.collect()}
    close = {(r.ticker, r.pos): r.close for r in study.panel.collect()}
    level = {r.pos: r.market for r in study.market.collect()}
    cars = defaultdict(list)
    for w in WINDOWS:
        rows = sorted((r.ticker, r.pos, r.z) for r in pn.with_zscore(study.panel, w, w).where("z IS NOT NULL").collect() if r.ticker in "BC" or r.ticker == "A" and r.pos < 70)
        for t in THRESHOLDS:
            for k in COOLDOWNS:
                last = {}
                for ticker, pos, z in rows:
                    if z > t or pos - last.get(ticker, -99) < k:
                        continue
                    last[ticker] = pos
                    for h in HORIZONS:
                        if (ticker, pos + h) in close and level.get(pos) and level.get(pos + h):
                            cars[t, w, k, h].append(close[ticker, pos + h] / close[ticker, pos] - level[pos + h] / level[pos])
    want = {c: (sum(x) / len(x), sum(v > 0 for v in x) / len(x)) for c, x in cars.items() if len(x) >= LEAST}
    assert len(cars) == 16 and set(got) == set(want) and 8 < len(want)
    for c, (mean, recovery) in want.items():
        assert got[c] == (pytest.approx(mean, abs=1e-12), pytest.approx(recovery, abs=1e-12))


@pytest.fixture
def cells(spark, monkeypatch):
    """The grid's means by specification and horizon, with no whole grid to be had."""
    made = [(t, w, k, h, round(t * w / 100 + k / 10 + h, 6), 0.25 + k / 100) for t in (-2.5, -3.0) for w in (60, 120) for k in q._CDS for h in q._HZS if (t, k) != (-3.0, 40)]
    means = spark.createDataFrame(made, "z_threshold double, vol_window int, cooldown int, horizon int, mean_car double, recovery_rate double").coalesce(1)
    monkeypatch.setattr(q, "_means", lambda s: means)
    monkeypatch.setattr(q, "grid_events", lambda s: pytest.fail("the whole grid was made"))


def test_grid_pivot(cells):
    got = {r.z_threshold: tuple(r)[1:] for r in q.grid_pivot(None).collect()}
    want = {t: tuple(None if (t, k) == (-3.0, 40) else pytest.approx(t * 60 / 100 + k / 10 + q.H, abs=1e-6) for k in q._CDS) for t in (-2.5, -3.0)}
    assert got == want


def test_grid_summary(cells):
    r, = q.grid_summary(None).collect()
    means = sorted(t * w / 100 + k / 10 + q.H for t in (-2.5, -3.0) for w in (60, 120) for k in q._CDS if (t, k) != (-3.0, 40))
    assert (r.n, r.share_negative, r.min_recovery, r.max_recovery, r.share_below_half) == (14, 0.0, 0.3, 0.65, round(12 / 14, 6))
    assert (r.min_mean, r.max_mean, r.median_mean) == pytest.approx((means[0], means[-1], (means[6] + means[7]) / 2), abs=1e-6)


def test_severity_gradient(cells):
    got = {r.z_threshold: r.median_mean_car for r in q.severity_gradient(None).collect()}
    for t in (-2.5, -3.0):
        means = sorted(t * w / 100 + k / 10 + q.H for w in (60, 120) for k in q._CDS if (t, k) != (-3.0, 40))
        n = len(means)
        assert got[t] == pytest.approx((means[(n - 1) // 2] + means[n // 2]) / 2, abs=1e-6)
    assert len(got) == 2


def test_grid_horizon_pivot(cells):
    got = {r.z_threshold: tuple(r)[1:] for r in q.grid_horizon_pivot(None).collect()}
    assert got == {t: tuple(pytest.approx(t * 60 / 100 + 0.5 + h, abs=1e-6) for h in q._HZS) for t in (-2.5, -3.0)}
