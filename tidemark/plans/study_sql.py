"""The event study as SQL: a chain of common table expressions, for comparison."""

from __future__ import annotations

from tidemark.config import Config

MOMENTA = (5, 20, 60, 252)
T = "upper(replace(trim({0}),'.','-'))"
W = "PARTITION BY ticker ORDER BY pos"


def _nn(c: str) -> str:
    return f'CASE WHEN isnan("{c}") THEN NULL ELSE "{c}" END'


def _at(value: str, offset: int) -> str:
    side = f"{abs(offset)} {'PRECEDING' if offset < 0 else 'FOLLOWING'}"
    return f"first_value({value}) OVER ({W} RANGE BETWEEN {side} AND {side})"


def _prior(agg: str, n: int) -> str:
    return f"{agg} OVER ({W} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def chain(c: Config) -> str:
    """All tables of the study, from prices to events, as a WITH clause."""
    g = c.get
    hs, H, k, w, mo = g("outcomes.horizons"), g("outcomes.primary"), g("events.cooldown"), g("events.vol_window"), g("events.min_prior_obs")
    fields = ", ".join(f"{_nn(f)} {f}" for f in ("open", "high", "low", "close", "volume"))
    fwd = ", ".join(f"{_at('close', h)} close_p{h}" for h in hs)
    back = ", ".join(f"{_at('close', -1 - m)} close_m{m}" for m in MOMENTA)
    rv = ", ".join(f"CASE WHEN {_prior('count(ret)', n)} >= {max(10, n // 2)} THEN {_prior('stddev_samp(ret)', n)} * sqrt(252.0) END rv_{n}" for n in (20, 60))
    lead_b = ", ".join(f"lead(market, {h}) OVER (ORDER BY pos) b{h}" for h in hs)
    legs = ", ".join(f"close_p{h} / close - 1 fwd_ret_{h}, b{h} / market - 1 bench_ret_{h}, (close_p{h} / close - 1) - (b{h} / market - 1) car_{h}" for h in hs)
    moms = ", ".join(f"prev_close / close_m{m} - 1 mom_{m}" for m in MOMENTA)
    q = g("crash_type.benchmark_pctile") / 100
    return f"""WITH RECURSIVE
px0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, d ORDER BY loaded_at DESC, batch_id DESC, close DESC NULLS LAST, volume DESC NULLS LAST) rn
  FROM (SELECT {T.format('ticker')} ticker, "date" d, loaded_at, batch_id, {fields} FROM prices)) WHERE rn = 1),
px AS (SELECT p.ticker, p.d, t.pos, p.open, p.high, p.low, p.close, p.volume FROM px0 p JOIN trading_days t ON t."date" = p.d WHERE p.close > 0),
pn AS (SELECT *, close / {_at('close', -1)} - 1 ret FROM px WHERE ticker <> '{g("benchmarks.market")}'),
mo AS (SELECT *, CASE WHEN {_prior('count(ret)', w)} >= {mo} THEN {_prior('avg(ret)', w)} END mu,
  CASE WHEN {_prior('count(ret)', w)} >= {mo} THEN {_prior('stddev_samp(ret)', w)} END sigma FROM pn),
zs AS (SELECT *, CASE WHEN sigma > 0 THEN (ret - mu) / sigma END z FROM mo),
mk0 AS (SELECT t.pos, last_value(p.close IGNORE NULLS) OVER (ORDER BY t.pos ROWS BETWEEN {g("benchmarks.fill_limit")} PRECEDING AND CURRENT ROW) market
  FROM trading_days t LEFT JOIN px p ON p.ticker = '{g("benchmarks.market")}' AND p.pos = t.pos),
mk1 AS (SELECT *, market / lag(market) OVER (ORDER BY pos) - 1 market_ret FROM mk0),
mk2 AS (SELECT *, CASE WHEN count(market_ret) OVER v >= {g("benchmarks.vol_days") // 2} THEN stddev_samp(market_ret) OVER v * sqrt(252.0) * 100 END vix
  FROM mk1 WINDOW v AS (ORDER BY pos ROWS BETWEEN {g("benchmarks.vol_days") - 1} PRECEDING AND CURRENT ROW)),
mk AS (SELECT *, lag(market, 1) OVER (ORDER BY pos) / lag(market, 21) OVER (ORDER BY pos) - 1 market_mom_20, vix - lag(vix) OVER (ORDER BY pos) vix_chg,
  CASE WHEN count(market_ret) OVER x >= {g("crash_type.min_periods")} THEN quantile_cont(market_ret, {q}) OVER x END market_cut, {lead_b}
  FROM mk2 WINDOW x AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sec AS (SELECT ticker, min(s) sector FROM (SELECT {T.format('ticker')} ticker, nullif(upper(trim(sector)), '') s FROM sector_map) WHERE s IS NOT NULL GROUP BY ticker),
sd AS (SELECT sector, pos, quantile_cont(ret, 0.5) r FROM pn JOIN sec USING (ticker) WHERE ret IS NOT NULL GROUP BY sector, pos),
sl AS (SELECT sector, pos, 100 * exp(sum(ln(greatest(1 + r, 1e-6))) OVER (PARTITION BY sector ORDER BY pos ROWS UNBOUNDED PRECEDING)) own FROM sd),
ss AS (SELECT s.sector, mk.pos, coalesce(sl.own, mk.market) level FROM (SELECT DISTINCT sector FROM sd) s CROSS JOIN mk LEFT JOIN sl ON sl.sector = s.sector AND sl.pos = mk.pos),
sr AS (SELECT *, level / lag(level) OVER (PARTITION BY sector ORDER BY pos) - 1 sector_ret FROM ss),
sc AS (SELECT *, CASE WHEN count(sector_ret) OVER x >= {g("crash_type.min_periods")} THEN quantile_cont(sector_ret, {q}) OVER x END sector_cut
  FROM sr WINDOW x AS (PARTITION BY sector ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mw AS (SELECT DISTINCT {T.format('ticker')} ticker, "start" s, coalesce("end", DATE '9999-12-31') e FROM membership WHERE "start" < coalesce("end", DATE '9999-12-31')),
wide AS (SELECT *, {_at('close', -1)} prev_close, {fwd}, {back}, {rv},
  max(close) OVER ({W} RANGE BETWEEN 1 FOLLOWING AND {H} FOLLOWING) hi_ahead, min(close) OVER ({W} RANGE BETWEEN 1 FOLLOWING AND {H} FOLLOWING) lo_ahead,
  min(ret) OVER ({W} RANGE BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) episode_min_return,
  count(CASE WHEN volume > 0 THEN 1 END) OVER ({W} RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) nv,
  quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.5) OVER ({W} RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) mv FROM zs),
cand AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) i FROM wide WHERE z <= {g("events.z_threshold")}
  AND d BETWEEN DATE '{g("study.start")}' AND DATE '{g("study.end")}' AND EXISTS (SELECT 1 FROM mw WHERE mw.ticker = wide.ticker AND d >= mw.s AND d < mw.e)),
cd AS (SELECT ticker, i, pos, pos anchor FROM cand WHERE i = 1
  UNION ALL SELECT c.ticker, c.i, c.pos, CASE WHEN c.pos - cd.anchor >= {k} THEN c.pos ELSE cd.anchor END FROM cd JOIN cand c ON c.ticker = cd.ticker AND c.i = cd.i + 1),
ep AS (SELECT ticker, anchor pos, count(*) episode_length FROM cd GROUP BY ticker, anchor),
e0 AS (SELECT cand.ticker || '_' || strftime(cand.d, '%Y-%m-%d') event_id, cand.* EXCLUDE (z, i), cand.z crash_z, cand.ret raw_return, ep.episode_length, ed."date" episode_end_date
  FROM ep JOIN cand USING (ticker, pos) JOIN trading_days ed ON ed.pos = least(cand.pos + {k - 1}, (SELECT max(pos) FROM trading_days))),
e1 AS (SELECT e0.*, mk.market, mk.market_ret spy_ret_event, mk.market_mom_20 spy_mom_20, mk.vix, mk.vix_chg, mk.market_cut, {', '.join(f'mk.b{h}' for h in hs)},
  CASE WHEN e0.pos > 0 THEN prev_close ELSE close END precrash_close, sec.sector FROM e0 JOIN mk ON mk.pos = e0.pos LEFT JOIN sec ON sec.ticker = e0.ticker),
e2 AS (SELECT e1.* EXCLUDE (volume), {legs}, hi_ahead / close - 1 mfe_{H}, lo_ahead / close - 1 mae_{H}, sc.sector_ret sector_ret_event, sc.sector_cut, raw_return - sc.sector_ret excess_vs_sector,
  (SELECT min(p.pos) FROM px p WHERE p.ticker = e1.ticker AND p.pos BETWEEN e1.pos + 1 AND e1.pos + {H} AND p.close >= e1.precrash_close) - e1.pos days_to_recovery,
  abs(raw_return) abs_decline, (high - low) / prev_close hl_range, CASE WHEN volume > 0 THEN volume END volume, CASE WHEN nv >= {max(20, w // 3)} THEN mv END med_volume_60, {moms}
  FROM e1 LEFT JOIN sc ON sc.sector = e1.sector AND sc.pos = e1.pos),
e3 AS (SELECT *, CASE WHEN car_{H} IS NOT NULL THEN CASE WHEN coalesce(hi_ahead >= precrash_close, FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END regained_precrash_{H},
  CASE WHEN car_{H} IS NOT NULL THEN CASE WHEN car_{H} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END recovered_{H}d, car_{H} IS NOT NULL complete_{H}, ln(volume) log_volume, ln(volume) - ln(med_volume_60) avol, rv_20 / nullif(rv_60, 0) rv_ratio,
  CASE WHEN coalesce(spy_ret_event <= market_cut, FALSE) THEN 'broad_market' WHEN coalesce(sector_ret_event <= sector_cut, FALSE) THEN 'sector'
    WHEN market_cut IS NULL OR sector_cut IS NULL OR sector_ret_event IS NULL THEN 'unclassified' ELSE 'idiosyncratic' END crash_type FROM e2),
qs AS (SELECT quantile_cont(vix, {g("regimes.vix_high_quantile")}) vix_high_cut, quantile_cont(avol, [0.25, 0.5, 0.75]) qa, quantile_cont(crash_z, [0.25, 0.5, 0.75]) qz FROM e3),
ev AS (SELECT e3.*, vix_high_cut, CASE WHEN vix >= vix_high_cut THEN 'high_vix' WHEN vix < vix_high_cut THEN 'low_vix' END vix_regime,
  CASE WHEN avol <= qa[1] THEN 'Q1' WHEN avol <= qa[2] THEN 'Q2' WHEN avol <= qa[3] THEN 'Q3' WHEN avol IS NOT NULL THEN 'Q4' END avol_quartile,
  CASE WHEN crash_z <= qz[1] THEN 'S1' WHEN crash_z <= qz[2] THEN 'S2' WHEN crash_z <= qz[3] THEN 'S3' WHEN crash_z IS NOT NULL THEN 'S4' END severity_quartile FROM e3 CROSS JOIN qs),
path AS (SELECT e0.event_id, tau, (p.close / e0.close - 1) - (mt.market / m0.market - 1) car FROM e0 CROSS JOIN (SELECT unnest(range(0, {g("outcomes.max_tau") + 1}))::INT tau)
  LEFT JOIN px p ON p.ticker = e0.ticker AND p.pos = e0.pos + tau LEFT JOIN mk m0 ON m0.pos = e0.pos LEFT JOIN mk mt ON mt.pos = e0.pos + tau),
grp AS (SELECT ev.*, unnest(list_filter([ 'all_events', CASE WHEN crash_type IN ('broad_market', 'sector', 'idiosyncratic') THEN crash_type END,
  CASE avol_quartile WHEN 'Q4' THEN 'avol_q4_highest' WHEN 'Q1' THEN 'avol_q1_lowest' END, vix_regime], lambda x: x IS NOT NULL)) grp FROM ev),
sp0 AS (SELECT *, row_number() OVER (ORDER BY event_date, event_id) - 1 r, count(*) OVER () n FROM (SELECT *, d event_date FROM ev WHERE complete_{H}))
"""


def grid_chain(c: Config) -> str:
    """The chain, and every specification's cells: `cl` with one row per specification, horizon and volatility quantile."""
    g = c.get
    ths, ws, cds, hs, vqs = (g(f"robustness.{n}") for n in ("z_thresholds", "vol_windows", "cooldowns", "horizons", "vix_high_quantiles"))
    parts, picks = [], []
    for w in ws:
        enough = f"{_prior('count(ret)', w)} >= {w}"
        parts.append(f"""g{w} AS (SELECT *, CASE WHEN {enough} THEN {_prior('avg(ret)', w)} END mu, CASE WHEN {enough} THEN {_prior('stddev_samp(ret)', w)} END sigma, {', '.join(f"{_at('close', h)} close_p{h}" for h in hs)}, {_at('close', -1)} / {_at('close', -21)} - 1 mom_20,
  CASE WHEN {_prior('count(ret)', 20)} >= 10 THEN {_prior('stddev_samp(ret)', 20)} * sqrt(252.0) END rv_20,
  count(CASE WHEN volume > 0 THEN 1 END) OVER ({W} RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) nv, quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.5) OVER ({W} RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) mv FROM pn)""")
        picks.append(f"SELECT {w} vol_window, ticker, d, pos, close, ret, (ret - mu) / sigma z, CASE WHEN volume > 0 AND nv >= {max(20, w // 3)} THEN ln(volume) - ln(mv) END avol, mom_20, rv_20, {', '.join(f'close_p{h}' for h in hs)} FROM g{w} WHERE sigma > 0")
    spec = "z_threshold, vol_window, cooldown"
    legs = ", ".join(f"(close_p{h} / close - 1) - (b{h} / market - 1)" for h in hs)
    mean = lambda cond: f"avg(CASE WHEN {cond} THEN car END)"
    return chain(c).rstrip() + ",\n" + ",\n".join(parts) + f""",
gc AS (SELECT * FROM ({' UNION ALL '.join(picks)}) x WHERE z <= {max(ths)} AND d BETWEEN DATE '{g("study.start")}' AND DATE '{g("study.end")}'
  AND EXISTS (SELECT 1 FROM mw WHERE mw.ticker = x.ticker AND x.d >= mw.s AND x.d < mw.e)),
gx AS (SELECT *, row_number() OVER (PARTITION BY {spec}, ticker ORDER BY pos) i FROM gc JOIN (SELECT unnest({ths})::DOUBLE z_threshold) ON z <= z_threshold CROSS JOIN (SELECT unnest({cds}) cooldown)),
gd AS (SELECT {spec}, ticker, i, pos, pos anchor FROM gx WHERE i = 1
  UNION ALL SELECT x.z_threshold, x.vol_window, x.cooldown, x.ticker, x.i, x.pos, CASE WHEN x.pos - gd.anchor >= x.cooldown THEN x.pos ELSE gd.anchor END
  FROM gd JOIN gx x ON x.z_threshold = gd.z_threshold AND x.vol_window = gd.vol_window AND x.cooldown = gd.cooldown AND x.ticker = gd.ticker AND x.i = gd.i + 1),
ge AS (SELECT gx.*, mk.vix, mk.market_ret spy_ret_event, CASE WHEN coalesce(mk.market_ret <= mk.market_cut, FALSE) THEN 'broad_market' WHEN coalesce(sc.sector_ret <= sc.sector_cut, FALSE) THEN 'sector'
    WHEN mk.market_cut IS NULL OR sc.sector_cut IS NULL OR sc.sector_ret IS NULL THEN 'unclassified' ELSE 'idiosyncratic' END crash_type, unnest({hs}) horizon, unnest([{legs}]) car
  FROM gx JOIN gd ON gd.z_threshold = gx.z_threshold AND gd.vol_window = gx.vol_window AND gd.cooldown = gx.cooldown AND gd.ticker = gx.ticker AND gd.pos = gx.pos AND gd.anchor = gd.pos
  JOIN mk ON mk.pos = gx.pos LEFT JOIN sec ON sec.ticker = gx.ticker LEFT JOIN sc ON sc.sector = sec.sector AND sc.pos = gx.pos),
gq AS (SELECT {spec}, quantile_cont(avol, [0.25, 0.75]) q FROM ge WHERE horizon = {hs[0]} GROUP BY ALL),
gl AS (SELECT ge.*, avol <= q[1] q1, avol > q[2] q4 FROM ge JOIN gq USING ({spec}) WHERE car IS NOT NULL),
gs AS (SELECT {spec}, horizon, d, sum(car) s, count(*) n FROM gl GROUP BY ALL),
gt AS (SELECT {spec}, horizon, sum(n)::BIGINT n_events, count(*) n_dates, sum(s) / sum(n) mean_car, sqrt(sum(s * s) - 2 * sum(s) / sum(n) * sum(s * n) + power(sum(s) / sum(n), 2) * sum(n * n)) / sum(n) * sqrt(count(*) / greatest(count(*) - 1, 1)) se_clustered
  FROM gs GROUP BY ALL HAVING sum(n) >= {g("robustness.min_events")}),
gm AS (SELECT {spec}, horizon, avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) recovery_rate, median(car) median_car, {mean("crash_type = 'broad_market'")} mean_car_broad, {mean("crash_type = 'sector'")} mean_car_sector, {mean("crash_type = 'idiosyncratic'")} mean_car_idio,
  {mean("q4")} mean_car_avol_q4, {mean("q1")} mean_car_avol_q1, unnest({vqs})::DOUBLE vix_high_quantile, unnest(quantile_cont(vix, {vqs})) cut FROM gl GROUP BY {spec}, horizon),
gv AS (SELECT gl.z_threshold, gl.vol_window, gl.cooldown, gl.horizon, vix_high_quantile, {mean("vix >= cut")} mean_car_high_vix, {mean("vix < cut")} mean_car_low_vix FROM gl JOIN gm USING ({spec}, horizon) GROUP BY ALL),
cl AS (SELECT *, mean_car_broad - mean_car_idio diff_broad_minus_idio, mean_car_avol_q4 - mean_car_avol_q1 diff_avol_q4_minus_q1, mean_car_high_vix - mean_car_low_vix diff_high_minus_low_vix
  FROM gt JOIN gm USING ({spec}, horizon) JOIN gv USING ({spec}, horizon, vix_high_quantile)),
c1 AS (SELECT DISTINCT z_threshold, vol_window, cooldown, horizon, mean_car, recovery_rate FROM cl)
"""
