"""One query per operator of the event study, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import episodes as ep
from tidemark.operators import panel as pn
from tidemark.operators import universe as un
from tidemark.plans.study import Study
from tidemark.plans.study_sql import T, chain

#: The tables' prices have holes, so fewer prior returns are asked for than the window is long.
CONFIG = Config().override(**{"events.min_prior_obs": 40, "robustness.min_events": 20})
H = CONFIG.get("outcomes.primary")
HORIZONS = CONFIG.get("outcomes.horizons")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: Callable[[Config], str] = chain):
    """Registers a function of a Study as the query of its name, with the SQL that selects the same from the chain."""

    def register(f: Callable[[Study], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(Study(spark, d, CONFIG))
        if sql is not None:
            SQL[f.__name__] = tables(CONFIG) + sql
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) {n}" for n in names)


def day(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


def sday(c: str, name: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') {name}"


KEY = "ticker, pos"


# --- sources and panel ---------------------------------------------------------

@query(f"SELECT ticker, pos, {sday('d', 'date')}, open, high, low, close, volume FROM px WHERE ticker <> 'MKTX'")
def panel_build(s: Study) -> DataFrame:
    return s.prices.select("ticker", "pos", day("date"), *pn.FIELDS)


@query("SELECT ticker, pos, unnest(['open','high','low','close','volume']) field, unnest([open, high, low, close, volume]) \"value\" FROM px WHERE ticker <> 'MKTX'"
       .replace("SELECT ticker", "SELECT * FROM (SELECT ticker") + ") WHERE \"value\" IS NOT NULL")
def panel_unpivot(s: Study) -> DataFrame:
    return pn.unpivot_fields(s.prices, ["ticker", "pos"], list(pn.FIELDS))


@query("SELECT strftime(d, '%Y-%m-%d') \"date\", (row_number() OVER (ORDER BY d) - 1)::INT pos FROM (SELECT DISTINCT \"date\" d FROM prices WHERE \"date\" IS NOT NULL)")
def calendar_pos(s: Study) -> DataFrame:
    return pn.calendar_pos(s.table("prices")).select(day("date"), "pos")


@query(f"SELECT {KEY}, {s6('ret')} FROM pn")
def daily_returns(s: Study) -> DataFrame:
    return s.panel.select("ticker", "pos", *r6("ret"))


@query(f"SELECT {KEY}, {s6('mu', 'sigma')} FROM mo")
def rolling_moments(s: Study) -> DataFrame:
    return pn.with_moments(s.panel, 60, 40).select("ticker", "pos", *r6("mu", "sigma"))


@query(f"SELECT {KEY}, {s6('z')} FROM zs WHERE z IS NOT NULL")
def crash_zscore(s: Study) -> DataFrame:
    return pn.with_zscore(s.panel, 60, 40).where("z IS NOT NULL").select("ticker", "pos", *r6("z"))


@query(f"SELECT {KEY}, round(CASE WHEN nv >= 20 THEN mv END, 6) med_volume FROM wide")
def rolling_median_volume(s: Study) -> DataFrame:
    return pn.with_median_volume(s.panel, 60).select("ticker", "pos", *r6("med_volume"))


@query(f"SELECT {KEY}, {s6('rv_20', 'rv_60')} FROM wide")
def rolling_realised_vol(s: Study) -> DataFrame:
    return pn.with_realised_vol(pn.with_realised_vol(s.panel, 20, "rv_20"), 60, "rv_60").select("ticker", "pos", *r6("rv_20", "rv_60"))


@query(f"SELECT {KEY}, round(CASE WHEN count(ret) OVER x >= 252 THEN quantile_cont(ret, 0.05) OVER x END, 6) cut FROM pn WINDOW x AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding_percentile(s: Study) -> DataFrame:
    return pn.expanding_percentile(s.panel, "ticker", "ret", 0.05, 252).select("ticker", "pos", *r6("cut"))


@query("SELECT pos, round(market, 6) close FROM mk")
def benchmark_ffill3(s: Study) -> DataFrame:
    return s.market.select("pos", F.round("market", 6).alias("close"))


@query(f"SELECT pos, {s6('market', 'market_ret', 'market_mom_20', 'vix', 'vix_chg')} FROM mk")
def market_panel(s: Study) -> DataFrame:
    return s.market.select("pos", *r6("market", "market_ret", "market_mom_20", "vix", "vix_chg"))


@query("SELECT sector, pos, round(level, 2) level, round(sector_ret + 1e-11, 9) sector_ret FROM sr")
def sector_coalesce(s: Study) -> DataFrame:
    # Ratios of binary fractions would fall on ties of rounding; the addend moves them off.
    return s.sector_rets.select("sector", "pos", F.round("level", 2).alias("level"), F.round(F.col("sector_ret") + 1e-11, 9).alias("sector_ret"))


@query("SELECT sector, pos, round(sector_cut, 6) sector_cut FROM sc")
def sector_cuts(s: Study) -> DataFrame:
    return s.cuts[1].select("sector", "pos", *r6("sector_cut"))


# --- universe ------------------------------------------------------------------

_LOG = f"""lg AS (SELECT DISTINCT ticker, d, a FROM (SELECT {T.format('added')} ticker, "date" d, 1 a FROM index_changes UNION ALL SELECT {T.format('removed')}, "date", 0 FROM index_changes)
  WHERE ticker IS NOT NULL AND ticker <> '' AND ticker <> 'NAN' AND d IS NOT NULL),
cur AS (SELECT DISTINCT ticker FROM mw WHERE e = DATE '9999-12-31'),
li AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC, a DESC) i FROM lg),
st AS (SELECT t.ticker, 0::BIGINT i, cur.ticker IS NOT NULL live, CASE WHEN cur.ticker IS NOT NULL THEN DATE '2025-01-01' END r, NULL::DATE ws, NULL::DATE we, 0 odd
    FROM (SELECT ticker FROM lg UNION SELECT ticker FROM cur) t LEFT JOIN cur USING (ticker)
  UNION ALL SELECT st.ticker, li.i, a = 0, CASE WHEN a = 1 THEN NULL WHEN live THEN r ELSE li.d END, CASE WHEN a = 1 AND live THEN li.d END, CASE WHEN a = 1 AND live THEN r END, odd + CASE WHEN (a = 1) <> live THEN 1 ELSE 0 END
    FROM st JOIN li ON li.ticker = st.ticker AND li.i = st.i + 1),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY i DESC) = 1),
al AS (SELECT ticker, ws, we FROM st WHERE ws IS NOT NULL UNION ALL SELECT ticker, DATE '2005-06-01', r FROM fin WHERE live)
SELECT ticker, strftime(greatest(ws, DATE '2005-06-01'), '%Y-%m-%d') "start", strftime(least(we, DATE '2025-01-01'), '%Y-%m-%d') "end", odd anomalies
FROM al JOIN (SELECT ticker, odd FROM fin) USING (ticker) WHERE we > DATE '2005-06-01' AND ws < DATE '2025-01-01'"""


@query("," + _LOG)
def membership_windows(s: Study) -> DataFrame:
    import datetime

    w = un.membership_windows(s.current, s.table("index_changes"), s.config.get("study.floor"), datetime.date(2025, 1, 1))
    return w.select("ticker", day("start"), day("end"), "anomalies")


@query(f"SELECT ticker, pos FROM px WHERE ticker <> 'MKTX' AND EXISTS (SELECT 1 FROM mw WHERE mw.ticker = px.ticker AND px.d >= mw.s AND px.d < mw.e)")
def membership_semi_join(s: Study) -> DataFrame:
    return un.eligible(s.prices, s.windows).select("ticker", "pos")


_GUARD = """, sp AS (SELECT ticker, min(d) lo, max(d) hi FROM px WHERE ticker <> 'MKTX' GROUP BY ticker),
ins AS (SELECT mw.ticker, count(*) n FROM mw JOIN px ON px.ticker = mw.ticker AND px.d >= mw.s AND px.d < mw.e GROUP BY mw.ticker),
gd AS (SELECT mw.ticker, any_value(lo) lo, any_value(hi) hi, bool_or(least(hi, e) > greatest(lo, s)) o, min(s) ms, max(e) me, coalesce(any_value(n), 0) n FROM mw JOIN sp USING (ticker) LEFT JOIN ins USING (ticker) GROUP BY mw.ticker)
"""


@query(_GUARD + "SELECT ticker, n overlap_obs FROM gd WHERE o AND n >= 20")
def reuse_guard_kept(s: Study) -> DataFrame:
    return un.reuse_guard(s.prices, s.windows).where("kept").select("ticker", "overlap_obs")


@query(_GUARD + f"SELECT ticker, {sday('lo', 'price_start')}, {sday('hi', 'price_end')}, {sday('ms', 'membership_start')}, {sday('me', 'membership_end')}, n overlap_obs, 'no_membership_overlap' reason FROM gd WHERE NOT (o AND n >= 20)")
def reuse_guard_rejects(s: Study) -> DataFrame:
    r = un.reuse_guard(s.prices, s.windows).where("NOT kept")
    return r.select("ticker", *[day(c) for c in ("price_start", "price_end", "membership_start", "membership_end")], "overlap_obs", F.lit("no_membership_overlap").alias("reason"))


_SCREEN = """, st AS (SELECT ticker, d, close, lag(close) OVER v pre, """ + ", ".join(f"lead(close, {k}) OVER v a{k}" for k in range(1, 6)) + """ FROM px WHERE ticker <> 'MKTX' WINDOW v AS (PARTITION BY ticker ORDER BY d)),
fl AS (SELECT *, (close / pre >= 2.0 OR close / pre <= 0.5) AND (""" + " OR ".join(f"coalesce(a{k} / pre > 0.67 AND a{k} / pre < 1.5, FALSE)" for k in range(1, 6)) + """) rt FROM st),
sm AS (SELECT ticker, count(CASE WHEN rt THEN 1 END) n_round_trips, count(CASE WHEN abs(close / pre - 1) > 0.5 THEN 1 END) n_extreme_moves, count(DISTINCT close) / count(close) r, count(close) obs, min(close) min_close, max(close) max_close
  FROM fl GROUP BY ticker HAVING count(close) >= 10),
sq AS (SELECT ticker, n_round_trips, n_extreme_moves, round(r, 4) distinct_ratio, obs, min_close, max_close,
  nullif(concat_ws('+', CASE WHEN n_round_trips >= 3 THEN 'round_trip_oscillation' END, CASE WHEN n_extreme_moves > 12 THEN 'extreme_move_frequency' END, CASE WHEN r < 0.25 THEN 'low_value_diversity' END), '') reason FROM sm)
"""


@query(_SCREEN + "SELECT * FROM sq")
def integrity_screen(s: Study) -> DataFrame:
    return un.integrity_report(s.prices)


@query(_SCREEN + "SELECT ticker, count(*) n FROM px WHERE ticker <> 'MKTX' AND ticker NOT IN (SELECT ticker FROM sq WHERE reason IS NOT NULL) GROUP BY ticker")
def integrity_kept(s: Study) -> DataFrame:
    return un.integrity_screen(s.prices).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(""", fx AS (SELECT t.ticker, coalesce(e, 0) e, coalesce(p, 0) p, coalesce(c, 0) c FROM (SELECT ticker FROM mw UNION SELECT ticker FROM pn) t
  LEFT JOIN (SELECT DISTINCT ticker, 1 e FROM mw) USING (ticker) LEFT JOIN (SELECT DISTINCT ticker, 1 p FROM pn) USING (ticker) LEFT JOIN (SELECT DISTINCT ticker, 1 c FROM mw WHERE e = DATE '9999-12-31') USING (ticker)),
k AS (SELECT count(CASE WHEN e = 1 THEN 1 END) eligible_tickers, count(CASE WHEN c = 1 THEN 1 END) current_members, count(CASE WHEN e = 1 AND c = 0 THEN 1 END) historical_only, count(CASE WHEN e = 1 AND p = 1 THEN 1 END) eligible_with_prices,
  count(CASE WHEN e = 1 AND c = 0 AND p = 1 THEN 1 END) historical_with_prices, count(CASE WHEN e = 1 AND c = 0 AND p = 0 THEN 1 END) historical_missing, count(CASE WHEN c = 1 AND p = 1 THEN 1 END) cp FROM fx)
SELECT * EXCLUDE (cp), round(100.0 * historical_with_prices / greatest(historical_only, 1), 1) historical_coverage_pct, round(100.0 * cp / greatest(current_members, 1), 1) current_coverage_pct FROM k""")
def coverage_report(s: Study) -> DataFrame:
    return un.coverage_report(s.windows, s.prices, s.current)


@query(f"SELECT DISTINCT ticker raw, nullif(nullif({T.format('ticker')}, ''), 'NAN') ticker FROM prices".replace("SELECT DISTINCT ticker raw", "SELECT DISTINCT prices.ticker raw").replace("') ticker FROM", "') symbol FROM"))
def symbol_normalise(s: Study) -> DataFrame:
    from tidemark.functions.symbols import symbol

    return s.table("prices").select(F.col("ticker").alias("raw"), symbol("ticker").alias("symbol")).distinct()


@query("SELECT ticker, sector FROM sec")
def sector_resolve(s: Study) -> DataFrame:
    return s.sectors


_SIDE = "nullif(nullif(" + T.format("{0}") + ", ''), 'NAN')"


@query(f"SELECT change_id, strftime(\"date\", '%Y-%m-%d') AS \"date\", {_SIDE.format('added')} added, {_SIDE.format('removed')} removed FROM index_changes WHERE \"date\" IS NOT NULL")
def changes_clean(s: Study) -> DataFrame:
    """The log as if its dates had been delivered as text, in two forms."""
    d = F.col("date").cast("date")
    text = F.when(F.pmod("change_id", F.lit(2)) == 0, F.date_format(d, "MMMM d, yyyy")).otherwise(F.coalesce(d.cast("string"), F.lit("unknown")))
    raw = s.table("index_changes").withColumn("date", text)
    clean = raw.select("change_id", un.lenient_date("date").alias("d"), un.symbol("added").alias("added"), un.symbol("removed").alias("removed")).where("d IS NOT NULL")
    return clean.select("change_id", day("d", "date"), "added", "removed")


@query(f"SELECT ticker, window_id, strftime(\"start\", '%Y-%m-%d') AS \"start\" FROM (SELECT {T.format('ticker')} ticker, window_id, \"start\" FROM membership) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_id) = 1")
def first_windows(s: Study) -> DataFrame:
    return un.first_by_symbol(s.table("membership").select("ticker", "window_id", "start"), "window_id").select("ticker", "window_id", day("start"))


@query(f"""SELECT ticker, CASE s WHEN 'ENERGY' THEN 'OIL AND GAS' ELSE s END sector FROM (SELECT ticker, coalesce(a.s, b.s) s FROM (SELECT {T.format('ticker')} ticker, min(nullif(upper(trim(sector)), '')) s FROM sector_map GROUP BY 1) a
FULL JOIN (SELECT {T.format('ticker')} ticker, min(nullif(upper(trim(sector)), '')) s FROM crash_events GROUP BY 1) b USING (ticker)) WHERE ticker IS NOT NULL""")
def sector_precedence(s: Study) -> DataFrame:
    """The sector map first, then what the events say, one label renamed."""
    return un.resolve_sectors(s.table("sector_map"), s.table("crash_events"), relabel={"ENERGY": "OIL AND GAS"})


@query("SELECT count(*) n_rows, count(DISTINCT ticker) n_tickers, strftime(min(d), '%Y-%m-%d') first_date, strftime(max(d), '%Y-%m-%d') last_date, count(DISTINCT d) n_dates FROM px")
def manifest_statistics(s: Study) -> DataFrame:
    p = pn.observed(s.table("prices"), s.calendar)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
                 F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"), F.count_distinct("date").alias("n_dates"))


# --- events --------------------------------------------------------------------

@query(f"SELECT {KEY}, {sday('d', 'event_date')}, round(z, 6) crash_z FROM cand")
def candidates(s: Study) -> DataFrame:
    return s.candidates().select("ticker", "pos", day("date", "event_date"), F.round("z", 6).alias("crash_z"))


@query(f"SELECT {KEY}, episode_length, round(crash_z, 6) crash_z FROM e0")
def cooldown_events(s: Study) -> DataFrame:
    return s.episodes(wide=False).select("ticker", "pos", F.col("episode_length").cast("long").alias("episode_length"), *r6("crash_z"))


@query(f"SELECT event_id, {s6('episode_min_return')}, {sday('episode_end_date', 'episode_end_date')}, episode_length FROM e0")
def episode_stats(s: Study) -> DataFrame:
    return s.episodes().select("event_id", *r6("episode_min_return"), day("episode_end_date"), F.col("episode_length").cast("long").alias("episode_length"))


@query(f"SELECT event_id, round(raw_return, 6) raw_return FROM e0")
def event_ids(s: Study) -> DataFrame:
    return s.episodes(wide=False).select("event_id", *r6("raw_return"))


_FWD = [f"fwd_ret_{h}" for h in HORIZONS]
_CAR = [f"{a}_{h}" for h in HORIZONS for a in ("bench_ret", "car")]


@query(f"SELECT event_id, {s6(*_FWD)} FROM e2")
def forward_returns(s: Study) -> DataFrame:
    return s.outcomes().select("event_id", *r6(*_FWD))


@query(f"SELECT event_id, {s6(*_CAR)} FROM e2")
def car_horizons(s: Study) -> DataFrame:
    return s.outcomes().select("event_id", *r6(*_CAR))


@query(f"SELECT event_id, {s6(f'mfe_{H}', f'mae_{H}')} FROM e2")
def mfe_mae(s: Study) -> DataFrame:
    return s.outcomes().select("event_id", *r6(f"mfe_{H}", f"mae_{H}"))


@query(f"SELECT event_id, {s6('precrash_close', f'regained_precrash_{H}')} FROM e3")
def regained_precrash(s: Study) -> DataFrame:
    return s.outcomes().select("event_id", *r6("precrash_close", f"regained_precrash_{H}"))


@query("SELECT event_id, days_to_recovery FROM e2")
def days_to_recovery(s: Study) -> DataFrame:
    return s.outcomes().select("event_id", "days_to_recovery")


@query(f"SELECT event_id, recovered_{H}d, complete_{H} FROM e3")
def recovered_label(s: Study) -> DataFrame:
    return s.outcomes().select("event_id", f"recovered_{H}d", f"complete_{H}")


@query(f"SELECT event_id, tau, {s6('car')} FROM path")
def car_path(s: Study) -> DataFrame:
    return s.paths().select("event_id", "tau", *r6("car"))


def _features(name: str, columns: list[str], extra: str = "") -> None:
    def f(s: Study) -> DataFrame:
        return s.features().select("event_id", *([extra] if extra else []), *r6(*columns))

    f.__name__ = name
    query(f"SELECT event_id, {extra + ', ' if extra else ''}{s6(*columns)} FROM e3")(f)


_features("features_crash", ["crash_z", "raw_return", "abs_decline", "hl_range"])
_features("features_volume", ["volume", "log_volume", "med_volume_60", "avol"])
_features("features_momentum", ["mom_5", "mom_20", "mom_60", "mom_252"])
_features("features_volatility", ["rv_20", "rv_60", "rv_ratio"])
_features("features_market", ["spy_ret_event", "spy_mom_20", "vix", "vix_chg"])
_features("features_sector", ["sector_ret_event", "excess_vs_sector"], "sector")
_features("crash_type", ["market_cut", "sector_cut"], "crash_type")


@query("SELECT event_id, vix_regime, round(vix_high_cut, 6) vix_high_cut FROM ev")
def vix_regime(s: Study) -> DataFrame:
    return s.events().select("event_id", "vix_regime", *r6("vix_high_cut"))


@query("SELECT event_id, avol_quartile FROM ev")
def avol_quartile(s: Study) -> DataFrame:
    return s.events().select("event_id", "avol_quartile")


@query("SELECT event_id, severity_quartile FROM ev")
def severity_quartile(s: Study) -> DataFrame:
    return s.events().select("event_id", "severity_quartile")


@query(f"SELECT event_id, {s6(*ep.FEATURES)} FROM e3")
def feature_matrix(s: Study) -> DataFrame:
    return ep.feature_matrix(s.features()).select("event_id", *r6(*ep.FEATURES))


@query(f"SELECT {KEY}, p.close close_back_5, n.close close_ahead_5 FROM pn JOIN (SELECT ticker, pos FROM pn) k USING (ticker, pos) LEFT JOIN (SELECT ticker, pos + 5 pos, close FROM pn) p USING (ticker, pos) LEFT JOIN (SELECT ticker, pos - 5 pos, close FROM pn) n USING (ticker, pos)")
def positional_gather(s: Study) -> DataFrame:
    return s.prices.select("ticker", "pos", pn.at_offset("close", -5).alias("close_back_5"), pn.at_offset("close", 5).alias("close_ahead_5"))
