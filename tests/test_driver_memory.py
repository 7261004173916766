"""What is gathered for many events is shuffled; only tables of the grid's size are broadcast."""

import datetime
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import episodes as ep
from tidemark.operators import grid as gr
from tidemark.operators import panel as pn
from tidemark.plans import inference_queries as q


@pytest.fixture(scope="module")
def panel(spark):
    days = [(f"T{i}", p, 100.0 + (i * 31 + p * 17) % 23, 0.01 * ((i + p) % 7 - 3), 1000.0 + p) for i in range(3) for p in range(400)]
    return spark.createDataFrame(days, "ticker string, pos int, close double, ret double, volume double").withColumn("prev_close", F.col("close") * 0.99)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    """Without what the order of summing changes."""
    return sorted(map(str, df.withColumns({"prior_volumes_60": F.array_sort("prior_volumes_60"), "rv_20": F.round("rv_20", 9), "rv_60": F.round("rv_60", 9)}).collect()))


def test_days_of_many_events_are_shuffled_whatever_the_planner_guesses(spark, panel, monkeypatch):
    events = panel.where("pos % 50 = 10").select("ticker", "pos", "close", "prev_close")
    around = lambda: ep.surroundings(events, panel, [1, 5], 20, 20, [60])
    few = around()
    assert "BroadcastHashJoin" in plan(few)
    want = rows(few)
    monkeypatch.setattr(ep, "FEW", events.count() - 1)
    # The tables are far below the session's limit of 10 MB for a broadcast.
    many = around()
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert rows(many) == want


def test_a_grid_broadcasts_cells_and_never_events(spark):
    made = [(-3.0, 60, c, "broad_market" if i % 2 else "sector", float(i), float(i % 9), 0.01 * (i % 5 - 2), f"2020-01-{1 + i % 28:02d}") for c in (5, 10) for i in range(60)]
    events = spark.createDataFrame(made, "z_threshold double, vol_window int, cooldown int, crash_type string, avol double, vix double, car_5 double, event_date string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        grid = gr.robustness_grid(events, [5], [0.5, 0.75], 20)
        joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin) \[([^\]]*)\]", plan(grid))
        # Quartiles and cuts to events; the joins by merge are of one row a cell.
        assert sum(j == "BroadcastHashJoin" for j, _ in joins) >= 2 and sum(j == "SortMergeJoin" for j, _ in joins) == 2
        assert {(r.cooldown, r.vix_high_quantile, r.n_events) for r in grid.collect()} == {(c, q, 60) for c in (5, 10) for q in (0.5, 0.75)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


WINDOWS = (4, 6, 12)


def series(spark):
    """Returns of odd series: holes, a leap at the start, exact and nearly exact growth, a price that stands still; each falls at last."""
    closes = {"HOLES": [100 + (p * 17) % 23 for p in range(60)], "LEAP": [1.0, *[100 + (p * 31) % 11 for p in range(59)]], "DOUBLES": [2.0**p for p in range(60)],
              "GROWS": [1.01**p for p in range(60)], "STANDS": [*[100 + (p * 17) % 23 for p in range(30)], *[5.0] * 30]}
    made = [(t, datetime.date(2020, 1, 1) + datetime.timedelta(p), p, float(c) * (0.2 if p > 55 else 1)) for t, cs in closes.items() for p, c in enumerate(cs) if t != "HOLES" or p % 13]
    rows = spark.createDataFrame(made, "ticker string, date date, pos int, close double")
    return pn.with_returns(rows.withColumn("volume", F.lit(1000.0)).withColumn("high", F.col("close")).withColumn("low", F.col("close")))


def test_scores_of_all_windows_in_one_pass_are_those_of_each(spark):
    panel = series(spark)
    got = {(r.ticker, r.pos): r for r in pn.with_zscores(panel, WINDOWS).collect()}
    known = set()
    for w in WINDOWS:
        for r in pn.with_zscore(panel, w, w).collect():
            z = got[r.ticker, r.pos][f"z_{w}"]
            # In nearly exact growth the deviation is rounding; only whether there is a score, and on which side, counts.
            assert (z is None) == (r.z is None), (r, z)
            assert r.ticker != "GROWS" or r.pos != 56 or z is None or z < -1000 and r.z < -1000
            if z is not None and r.ticker in ("HOLES", "LEAP"):
                assert z == pytest.approx(r.z, rel=1e-7, abs=1e-9)
                known.add((r.ticker, w))
            if r.ticker in ("DOUBLES", "STANDS") and r.pos == 56:
                assert z is None
    assert known == {("LEAP", w) for w in WINDOWS} | {("HOLES", 4), ("HOLES", 6)}  # there is a hole every 13 days


def test_the_grid_reads_the_panel_once_and_never_broadcasts_membership(spark, monkeypatch):
    panel = series(spark)
    days = panel.select("ticker").distinct()
    windows = days.select("ticker", F.lit("2020-01-01").cast("date").alias("start"), F.lit("9999-12-31").cast("date").alias("end")).distinct()
    kept = []
    monkeypatch.setattr(q, "written", lambda df, name: kept.append(df) or (_ for _ in ()).throw(StopIteration))
    config = Config().override(**{"robustness.vol_windows": list(WINDOWS), "robustness.z_thresholds": [-1.0, -1.5], "robustness.cooldowns": [3, 5]})
    study = SimpleNamespace(config=config, panel=panel, windows=windows, stored=False)
    study.candidates = lambda z, w: ep.candidates(pn.with_zscore(panel, w, w), windows, z, config.get("study.start"), config.get("study.end"))
    with pytest.raises(StopIteration):
        q.grid_events(study)
    text = plan(kept[0])
    # Of tables that are far below the limit for a broadcast.
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 1
    assert text.count("Window [") == 3 and "Union" not in text
    by = {w: study.candidates(-1.0, w).select("ticker", "pos", "z").collect() for w in WINDOWS}
    want = {(t, w, k) for w, rows in by.items() for r in rows for t in (-1.0, -1.5) for k in (3, 5) if r.z <= t}
    assert {(r.z_threshold, r.vol_window, r.cooldown) for r in kept[0].collect()} == want
