"""Queries of the general problems over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.symbols import symbol
from tidemark.operators.deliveries import last_prices
from tidemark.operators.intervals import periods_and_gaps
from tidemark.operators.membership_history import status_history
from tidemark.operators.quality_profile import ValueCountStore, damaged_columns, profile
from tidemark.operators.regular_grid import regular_grid, session_readings
from tidemark.operators.spikes import implausible_readings
from tidemark.plans.profile_sql import damaged
from tidemark.sources import read_table


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    windows = read_table(spark, d, "membership").select(symbol("ticker").alias("ticker"), "start", "end")
    return periods_and_gaps(windows, "ticker", "start", "end").select("ticker", "kind", _day("from_date"), _day("to_date"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return status_history(read_table(spark, d, "index_changes")).select("ticker", "status", _day("valid_from"), _day("valid_to"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    calendar = read_table(spark, d, "trading_days")
    return regular_grid(session_readings(last_prices(read_table(spark, d, "prices"), "close"), calendar, "close"), calendar)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("status <> 'observed'").select("ticker", _day("session"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("ticker", _day("session"), F.round("y", 4).alias("close"), "status")


LOAD, ARRIVAL = "load_id", "loaded_at"


def _store(spark: SparkSession, d: str) -> ValueCountStore:
    """The value counts of all loads, each applied as its own delta."""
    events = read_table(spark, d, "crash_events")
    store = ValueCountStore(spark, LOAD)
    store.apply(events, [c for c in events.columns if c not in (LOAD, ARRIVAL)])
    return store


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return damaged_columns(_store(spark, d).deltas(), LOAD).select(LOAD, "column_name")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile(_store(spark, d).deltas(), [LOAD])
    return p.select(LOAD, "column_name", "n_rows", "n_missing", "n_distinct", F.round("entropy", 6).alias("entropy"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    flags = implausible_readings(last_prices(read_table(spark, d, "prices"), "close", "volume"))
    return flags.select("ticker", _day("date"), "field")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_grid, p4_found, p4_profile, p5_found)
}

_TICKER = "upper(replace(trim({0}),'.','-'))"

_NUMBERS = (
    "pos", "crash_z", "raw_return", "abs_decline", "hl_range", "volume", "log_volume", "med_volume_60", "avol", "mom_5", "mom_20", "mom_60", "mom_252", "rv_20", "rv_60", "rv_ratio",
    "spy_ret_event", "spy_mom_20", "vix", "vix_chg", "sector_ret_event", "excess_vs_sector", "fwd_ret_20", "bench_ret_20", "car_20",
)

SQL: dict[str, str] = {
    "p1_found": f"""
WITH w AS (SELECT {_TICKER.format('ticker')} ticker, "start" s, coalesce("end", DATE '9999-12-31') e FROM membership),
v AS (SELECT DISTINCT * FROM w WHERE s < e),
m AS (SELECT *, max(e) OVER (PARTITION BY ticker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM v),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM m),
p AS (SELECT ticker, n, min(s) f, max(e) t FROM g GROUP BY 1, 2),
a AS (SELECT ticker, 'period' kind, f, t FROM p
      UNION ALL SELECT ticker, 'gap', t, nxt FROM (SELECT *, lead(f) OVER (PARTITION BY ticker ORDER BY n) nxt FROM p) WHERE nxt IS NOT NULL)
SELECT ticker, kind, strftime(f, '%Y-%m-%d') from_date, strftime(t, '%Y-%m-%d') to_date FROM a""",
    "p2_found": f"""
WITH l AS (SELECT * FROM index_changes QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY loaded_at DESC, "date" DESC NULLS LAST, added DESC NULLS LAST, removed DESC NULLS LAST) = 1),
e AS (SELECT {_TICKER.format('added')} ticker, "date" d, loaded_at o, 1 r, 'member' status FROM l WHERE "date" IS NOT NULL AND trim(added) <> '' AND lower(trim(added)) <> 'nan'
      UNION ALL SELECT {_TICKER.format('removed')}, "date", loaded_at, 0, 'out' FROM l WHERE "date" IS NOT NULL AND trim(removed) <> '' AND lower(trim(removed)) <> 'nan'),
u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ticker, d ORDER BY o DESC, r DESC) = 1),
f AS (SELECT ticker, d, status FROM u
      UNION ALL SELECT ticker, DATE '2005-06-01', 'member' FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d) = 1) WHERE status = 'out' AND d > DATE '2005-06-01'),
c AS (SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY ticker ORDER BY d) before FROM f) WHERE before IS DISTINCT FROM status)
SELECT ticker, status, strftime(d, '%Y-%m-%d') valid_from, strftime(coalesce(lead(d) OVER (PARTITION BY ticker ORDER BY d), DATE '9999-12-31'), '%Y-%m-%d') valid_to FROM c""",
    "p3_found": f"""
WITH d AS (SELECT {_TICKER.format('ticker')} ticker, "date" d, arg_max(CASE WHEN close IS NULL OR isnan(close) THEN 0 ELSE 1 END, loaded_at) has FROM prices GROUP BY 1, 2),
s AS (SELECT "date" d, pos, coalesce(lead("date") OVER (ORDER BY "date"), "date" + 11) nxt FROM trading_days),
r AS (SELECT ticker, s.pos, max(has) has FROM d JOIN s ON d.d >= s.d AND d.d < s.nxt GROUP BY 1, 2),
b AS (SELECT ticker, min(pos) lo, max(pos) hi FROM r GROUP BY 1)
SELECT b.ticker, strftime(s.d, '%Y-%m-%d') session FROM b JOIN s ON s.pos BETWEEN b.lo AND b.hi
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.ticker = b.ticker AND r.pos = s.pos AND r.has = 1)""",
    "p3_grid": f"""
WITH d AS (SELECT {_TICKER.format('ticker')} ticker, "date" d, arg_max(CASE WHEN isnan(close) THEN NULL ELSE close END, loaded_at) y0, arg_max(CASE WHEN close IS NULL OR isnan(close) THEN 0 ELSE 1 END, loaded_at) has FROM prices GROUP BY 1, 2),
s AS (SELECT "date" d, pos, coalesce(lead("date") OVER (ORDER BY "date"), "date" + 11) nxt FROM trading_days),
j AS (SELECT d.ticker, s.pos, CASE WHEN has = 1 THEN y0 END y, d.d = s.d own, d.d FROM d JOIN s ON d.d >= s.d AND d.d < s.nxt),
r AS (SELECT ticker, pos, y FROM j QUALIFY row_number() OVER (PARTITION BY ticker, pos ORDER BY y IS NOT NULL DESC, own DESC, d DESC) = 1),
b AS (SELECT ticker, min(pos) lo, max(pos) hi FROM r GROUP BY 1),
o AS (SELECT ticker, pos x, y, lag(pos) OVER w xa, lag(y) OVER w ya, lead(pos) OVER w xc, lead(y) OVER w yc, lead(pos, 2) OVER w xd, lead(y, 2) OVER w yd FROM r WHERE y IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
h AS (SELECT *, (xc - x)::DOUBLE h, (yc - y) / (xc - x) s, CASE WHEN x - xa <= 11 THEN (x - xa)::DOUBLE END hl, CASE WHEN x - xa <= 11 THEN (y - ya) / (x - xa) END sl, CASE WHEN xd - xc <= 11 THEN (xd - xc)::DOUBLE END hr, CASE WHEN xd - xc <= 11 THEN (yd - yc) / (xd - xc) END sr FROM o WHERE xc - x > 1),
e AS (SELECT *, ((2 * h + hr) * s - h * sr) / (h + hr) eb, ((2 * h + hl) * s - h * sl) / (h + hl) ec FROM h),
m AS (SELECT *, CASE WHEN hl IS NOT NULL THEN CASE WHEN sl * s <= 0 THEN 0 ELSE (3 * h + 3 * hl) / ((2 * h + hl) / sl + (h + 2 * hl) / s) END
    WHEN hr IS NOT NULL THEN CASE WHEN sign(eb) <> sign(s) THEN 0 WHEN sign(s) <> sign(sr) AND abs(eb) > 3 * abs(s) THEN 3 * s ELSE eb END ELSE s END mb,
  CASE WHEN hr IS NOT NULL THEN CASE WHEN s * sr <= 0 THEN 0 ELSE (3 * h + 3 * hr) / ((2 * hr + h) / s + (hr + 2 * h) / sr) END
    WHEN hl IS NOT NULL THEN CASE WHEN sign(ec) <> sign(s) THEN 0 WHEN sign(s) <> sign(sl) AND abs(ec) > 3 * abs(s) THEN 3 * s ELSE ec END ELSE s END mc FROM e),
f AS (SELECT m.*, s.pos p, (s.pos - x) / h t FROM m JOIN s ON s.pos > x AND s.pos < xc),
g AS (SELECT ticker, p pos, CASE WHEN h <= 11 THEN y * (1 + 2 * t) * (1 - t) * (1 - t) + h * mb * t * (1 - t) * (1 - t) + yc * t * t * (3 - 2 * t) + h * mc * t * t * (t - 1) END y, CASE WHEN h <= 11 THEN 'filled' ELSE 'marked' END status FROM f),
a AS (SELECT ticker, pos, y, 'observed' status FROM r WHERE y IS NOT NULL UNION ALL SELECT * FROM g)
SELECT b.ticker, strftime(s.d, '%Y-%m-%d') session, round(a.y, 4) "close", coalesce(a.status, 'marked') status FROM b JOIN s ON s.pos BETWEEN lo AND hi LEFT JOIN a ON a.ticker = b.ticker AND a.pos = s.pos""",
    "p4_found": damaged(_NUMBERS, ("event_date",), ("event_id", "ticker", "sector", "crash_type", "complete_20")),
    "p4_profile": """
WITH u AS (UNPIVOT (SELECT load_id, COLUMNS(lambda c: c NOT IN ('load_id', 'loaded_at'))::VARCHAR FROM crash_events) ON COLUMNS(* EXCLUDE (load_id)) INTO NAME column_name VALUE v0),
k AS (SELECT load_id, count(*) n FROM crash_events GROUP BY 1),
v AS (SELECT load_id, column_name, v0 v, count(*) n FROM u WHERE trim(v0) <> '' AND v0 <> 'nan' GROUP BY ALL),
p AS (SELECT load_id, column_name, sum(n) np, count(*) nd, log2(sum(n)) - sum(n * log2(n)) / sum(n) h FROM v GROUP BY ALL),
c AS (SELECT k.load_id, n, column_name FROM k CROSS JOIN (SELECT column_name FROM (DESCRIBE crash_events) WHERE column_name NOT IN ('load_id', 'loaded_at')))
SELECT load_id, column_name, c.n n_rows, (c.n - coalesce(np, 0))::BIGINT n_missing, coalesce(nd, 0) n_distinct, round(h, 6) entropy FROM c LEFT JOIN p USING (load_id, column_name)""",
}
