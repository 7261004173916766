"""Queries of the event study whose rows no SQL gives, on a small made-up event table."""

import random
from types import SimpleNamespace

import pytest

from tidemark.operators import inference as inf
from tidemark.plans import inference_queries as q


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(2)
    kinds, quartiles, regimes = ("broad_market", "sector", "idiosyncratic"), ("Q1", "Q2", "Q4"), ("high_vix", "low_vix")
    cars = [f"car_{h}" for h in q.HORIZONS]
    events = [(str(i), kinds[i % 3], quartiles[i // 3 % 3], regimes[i % 2], *[None if i == 0 and h == 60 else rng.gauss(h / 10, 1) for h in q.HORIZONS]) for i in range(18)]
    ev = spark.createDataFrame(events, "event_id string, crash_type string, avol_quartile string, vix_regime string, " + ", ".join(f"{c} double" for c in cars)).coalesce(1).cache()
    top = q.CONFIG.get("outcomes.max_tau")
    paths = spark.createDataFrame([(str(i), t, None if i == 0 and t == top else i % 3 + rng.gauss(0, 0.01)) for i in range(18) for t in range(top + 1)], "event_id string, tau int, car double").coalesce(1).cache()
    return SimpleNamespace(spark=spark, events=lambda: ev, outcomes=lambda: ev, paths=lambda: paths)


def test_paths_have_intervals_in_every_group(study):
    got = {(r.group, r.tau): r for r in q.bootstrap_path(study).collect()}
    means = {(r.group, r.tau): r.mean_car for r in q.path_means(study).collect()}
    assert {g for g, _ in got} == set(inf.GROUPS) and set(got) == set(means)
    assert all(got[k].lo < means[k] < got[k].hi for k in means)


def test_every_horizon_has_an_interval(study):
    got = {r.horizon: r for r in q.horizon_intervals(study).collect()}
    assert set(got) == set(q.HORIZONS) and "horizon_intervals" in q.QUERIES
    assert all(r.lo < r["mean"] < r.hi and 0 <= r.p_value <= 1 for r in got.values()) and (got[60].n, got[20].n) == (17, 18)
