"""Event detection, episodes, forward outcomes, features: the event table.

Only the score is a window over the whole panel. Candidates are a filter, the
cooldown a fold over a ticker's few candidates, and what an event needs from
the days around it is gathered for events alone, by a join on (ticker, pos).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import MAX_DAYS, expanding_percentile
from tidemark.operators.universe import eligible
from tidemark.session import broadcast_within

MOMENTA = (5, 20, 60, 252)
#: Names of the predictors an event may be described by; nothing measured after it.
FEATURES = (
    "crash_z", "raw_return", "abs_decline", "hl_range", "volume", "log_volume", "med_volume_60", "avol", "mom_5", "mom_20", "mom_60", "mom_252",
    "rv_20", "rv_60", "rv_ratio", "spy_ret_event", "spy_mom_20", "vix", "vix_chg", "sector_ret_event", "excess_vs_sector",
)
OUTCOMES = ("fwd_", "car_", "mfe_", "mae_", "recovered_", "regained_", "days_to_", "episode_")


def check_features(names: Sequence[str]) -> None:
    """Refuses outcomes, and columns not on the list, as predictors."""
    bad = [n for n in names if n not in FEATURES or n.startswith(OUTCOMES)]
    if bad:
        raise ValueError(f"not event-time features: {bad}")


def feature_matrix(events: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """The predictors of each event, and its id; refuses anything measured later."""
    check_features(columns)
    return events.select("event_id", *columns)


def candidates(panel: DataFrame, windows: DataFrame, threshold: float, start, end, z: str = "z") -> DataFrame:
    """Rows of the panel at or below the threshold, in a membership window and the study's days (both ends in)."""
    hit = panel.where((F.col(z) <= threshold) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return eligible(hit, windows)


def cooldown(cands: DataFrame, k: int | str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Greedy: a candidate starts an event if it lies `k` or more positions after
    the event before; others are absorbed. Adds `episode_length` (1 + absorbed).
    A fold over each key's candidates in order of pos; at most one a day. `k`
    may name one of the keys."""
    k = F.col(k) if isinstance(k, str) else F.lit(k)
    cols = [c for c in cands.columns if c not in keys]
    row = F.struct(F.col("pos").alias("_p"), *cols)
    kept = f"array<struct<x:{cands.select(row.alias('r')).schema['r'].dataType.simpleString()},n:int>>"

    def step(acc: Column, r: Column) -> Column:
        tail = F.element_at(acc, -1)
        fresh = F.concat(acc, F.array(F.struct(r.alias("x"), F.lit(1).alias("n"))))
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(tail["x"].alias("x"), (tail["n"] + 1).alias("n"))))
        return F.when(F.size(acc) == 0, F.array(F.struct(r.alias("x"), F.lit(1).alias("n")))).when(r["_p"] - tail["x"]["_p"] >= k, fresh).otherwise(more).cast(kept)

    folded = cands.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows")).select(*keys, F.explode(F.aggregate("rows", F.array().cast(kept), step)).alias("e"))
    return folded.select(*keys, *[F.col(f"e.x.{c}").alias(c) for c in cols], F.col("e.n").alias("episode_length"))


#: Events whose surroundings may be broadcast: some 150 narrow rows each.
FEW = 5_000


def surroundings(events: DataFrame, panel: DataFrame, horizons: Sequence[int], primary: int, cooldown_days: int, vol_windows: Sequence[int]) -> DataFrame:
    """`ticker, pos` of `events` (also `close, prev_close`; one row each) and all
    they take from their own series: forward closes, extremes, the first day the
    close is back, pre-event closes, volatility, prior volumes per window. Only
    the days asked for are looked up; a day without a row gives nulls. Days of
    more than `FEW` events are shuffled: the planner guesses them by the events'
    compressed size, as if nothing were exploded, and the driver would hold them all."""
    lags = [-1 - w for w in MOMENTA]
    longest = max(60, *vol_windows)
    days = sorted({*range(-longest, cooldown_days), *range(1, primary + 1), *horizons, *lags})
    pre = F.when(F.col("pos") > 0, F.col("prev_close")).otherwise(F.col("close"))
    asked = events.select("ticker", "pos", pre.alias("_pre"), F.explode(F.array(*map(F.lit, days))).alias("_off")).withColumn("_at", F.col("pos") + F.col("_off"))
    there = panel.select("ticker", F.col("pos").alias("_at"), F.col("close").alias("_close"), F.col("ret").alias("_ret"), F.col("volume").alias("_volume"))
    few = events.limit(FEW + 1).count() <= FEW
    x = there.join(F.broadcast(asked) if few else asked.hint("merge"), ["ticker", "_at"])
    off = F.col("_off")
    at = lambda k: F.max(F.when(off == k, F.col("_close")))
    ahead, after = off.between(1, primary), off.between(0, cooldown_days - 1)
    aggs = [at(h).alias(f"close_p{h}") for h in horizons] + [at(k).alias(f"close_m{w}") for w, k in zip(MOMENTA, lags, strict=True)]
    aggs += [
        F.max(F.when(ahead, F.col("_close"))).alias("hi_ahead"), F.min(F.when(ahead, F.col("_close"))).alias("lo_ahead"),
        F.min(F.when(ahead & (F.col("_close") >= F.col("_pre")), F.col("_at"))).alias("regained_pos"), F.min(F.when(after, F.col("_ret"))).alias("episode_min_return"),
    ]
    for w in (20, 60):
        own = F.when(off.between(-w, -1), F.col("_ret"))
        aggs.append(F.when(F.count(own) >= max(10, w // 2), F.stddev_samp(own) * F.sqrt(F.lit(252.0))).alias(f"rv_{w}"))
    aggs += [F.collect_list(F.when(off.between(-w, -1) & (F.col("_volume") > 0), F.col("_volume"))).alias(f"prior_volumes_{w}") for w in vol_windows]
    return x.groupBy("ticker", "pos").agg(*aggs)


def with_cars(ev: DataFrame, market: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Forward returns, those of the market, their difference, from `close` and `close_p<h>`."""
    m = market.select(F.col("pos"), F.col("market").alias("b0"), *[F.lead("market", h).over(Window.orderBy("pos")).alias(f"b{h}") for h in horizons])
    x = ev.join(broadcast_within(m, MAX_DAYS, calendar), "pos", "left")
    for h in horizons:
        x = x.withColumn(f"fwd_ret_{h}", F.col(f"close_p{h}") / F.col("close") - 1).withColumn(f"bench_ret_{h}", F.col(f"b{h}") / F.col("b0") - 1)
        x = x.withColumn(f"car_{h}", F.col(f"fwd_ret_{h}") - F.col(f"bench_ret_{h}"))
    return x.drop("b0", *[f"b{h}" for h in horizons])


def with_outcomes(ev: DataFrame, market: DataFrame, calendar: DataFrame, horizons: Sequence[int], primary: int) -> DataFrame:
    """Adds those of `with_cars`, and the path statistics of the primary horizon."""
    x = with_cars(ev, market, calendar, horizons)
    known = F.col(f"car_{primary}").isNotNull()
    pre = F.when(F.col("pos") > 0, F.col("prev_close")).otherwise(F.col("close"))
    return (
        x.withColumn(f"mfe_{primary}", F.col("hi_ahead") / F.col("close") - 1).withColumn(f"mae_{primary}", F.col("lo_ahead") / F.col("close") - 1)
        .withColumn("precrash_close", pre)
        .withColumn(f"regained_precrash_{primary}", F.when(known, F.coalesce(F.col("hi_ahead") >= F.col("precrash_close"), F.lit(False)).cast("double")))
        .withColumn("days_to_recovery", (F.col("regained_pos") - F.col("pos")).cast("int"))
        .withColumn(f"recovered_{primary}d", F.when(known, (F.col(f"car_{primary}") > 0).cast("double")))
        .withColumn(f"complete_{primary}", known)
    )


def with_features(ev: DataFrame, market: DataFrame, calendar: DataFrame, sectors: DataFrame, sector_rets: DataFrame, market_cut: DataFrame, sector_cut: DataFrame, vol_window: int | str) -> DataFrame:
    """Event-time features and the crash type. `sectors`: ticker, sector;
    `sector_rets`: sector, pos, sector_ret; the cuts are expanding percentiles.
    `vol_window` may name a column."""
    window = F.col(vol_window) if isinstance(vol_window, str) else F.lit(vol_window)
    n, v = F.size("prior_volumes"), F.array_sort("prior_volumes")
    mid = (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor(n / 2).cast("int") + 1)) / 2
    vol = F.when(F.col("volume") > 0, F.col("volume"))
    x = (
        ev.withColumn("abs_decline", F.abs("raw_return")).withColumn("hl_range", (F.col("high") - F.col("low")) / F.col("prev_close"))
        .withColumn("volume", vol).withColumn("log_volume", F.log("volume"))
        .withColumn("med_volume_60", F.when(n >= F.greatest(F.lit(20), F.floor(window / 3)), mid)).withColumn("avol", F.log("volume") - F.log("med_volume_60"))
    )
    for w in MOMENTA:
        x = x.withColumn(f"mom_{w}", F.col("prev_close") / F.col(f"close_m{w}") - 1)
    x = x.withColumn("rv_ratio", F.try_divide("rv_20", "rv_60"))
    m = market.select("pos", F.col("market_ret").alias("spy_ret_event"), F.col("market_mom_20").alias("spy_mom_20"), "vix", "vix_chg").join(market_cut, "pos", "left")
    x = x.join(broadcast_within(m, MAX_DAYS, calendar), "pos", "left").join(sectors, "ticker", "left")
    x = x.join(sector_rets.select("sector", "pos", F.col("sector_ret").alias("sector_ret_event")), ["sector", "pos"], "left").join(sector_cut, ["sector", "pos"], "left")
    x = x.withColumn("excess_vs_sector", F.col("raw_return") - F.col("sector_ret_event"))
    # A comparison with an unknown is no shock.
    broad = F.coalesce(F.col("spy_ret_event") <= F.col("market_cut"), F.lit(False))
    shock = F.coalesce(F.col("sector_ret_event") <= F.col("sector_cut"), F.lit(False))
    unknown = F.col("market_cut").isNull() | F.col("sector_cut").isNull() | F.col("sector_ret_event").isNull()
    kind = F.when(broad, "broad_market").when(shock, "sector").when(unknown, "unclassified").otherwise("idiosyncratic")
    return x.withColumn("crash_type", kind)


def _below(value: str):
    return lambda edge: edge < F.col(value)


def quantile_bins(rows: DataFrame, bins: dict[str, tuple[str, Sequence[str]]], extra: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Adds, for `{name: (value, labels)}`, the bin of each value among
    equal-probability bins: exact interpolated quantiles as edges, each bin
    closed on the right; for `extra` `{name: (value, q)}` the quantile itself.
    All quantiles are one aggregated row, joined back."""
    aggs = [F.percentile(v, F.array(*[F.lit(i / len(labels)) for i in range(1, len(labels))])).alias(f"_{n}") for n, (v, labels) in bins.items()]
    aggs += [F.percentile(v, F.lit(q)).alias(n) for n, (v, q) in (extra or {}).items()]
    x = rows.crossJoin(F.broadcast(rows.agg(*aggs)))  # one row
    for n, (v, labels) in bins.items():
        over = F.size(F.filter(F.col(f"_{n}"), _below(v)))
        x = x.withColumn(n, F.when(F.col(v).isNotNull(), F.element_at(F.array(*map(F.lit, labels)), over + 1)))
    return x.drop(*[f"_{n}" for n in bins])


def with_regimes(ev: DataFrame, q: float) -> DataFrame:
    """Volatility regime against the quantile of all events, quartiles of abnormal volume and severity."""
    x = quantile_bins(
        ev, {"avol_quartile": ("avol", ["Q1", "Q2", "Q3", "Q4"]), "severity_quartile": ("crash_z", ["S1", "S2", "S3", "S4"])}, {"vix_high_cut": ("vix", q)}
    )
    return x.withColumn("vix_regime", F.when(F.col("vix") >= F.col("vix_high_cut"), "high_vix").when(F.col("vix") < F.col("vix_high_cut"), "low_vix"))


def car_path(ev: DataFrame, panel: DataFrame, market: DataFrame, calendar: DataFrame, max_tau: int) -> DataFrame:
    """`event_id, tau, car`: return over the market's from the event's close on, tau 0..max_tau, null where unknown."""
    m = market.select("pos", "market")
    x = ev.select("event_id", "ticker", "pos", F.col("close").alias("p0"), F.explode(F.sequence(F.lit(0), F.lit(max_tau))).alias("tau")).withColumn("at", F.col("pos") + F.col("tau"))
    there = panel.select("ticker", F.col("pos").alias("at"), F.col("close").alias("pt"))
    b0 = broadcast_within(m.select("pos", F.col("market").alias("b0")), MAX_DAYS, calendar)
    bt = broadcast_within(m.select(F.col("pos").alias("at"), F.col("market").alias("bt")), MAX_DAYS, calendar)
    x = x.join(there, ["ticker", "at"], "left").join(b0, "pos", "left").join(bt, "at", "left")
    return x.select("event_id", "tau", ((F.col("pt") / F.col("p0") - 1) - (F.col("bt") / F.col("b0") - 1)).alias("car"))


def percentile_cuts(market: DataFrame, sector_rets: DataFrame, pctile: float, min_periods: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(`pos, market_cut`, `sector, pos, sector_cut`): expanding low percentiles of
    strictly prior returns. `keep` may store the table both are read from."""
    one = market.select(F.lit("market").alias("k"), "pos", "market_ret")
    both = one.unionByName(sector_rets.select(F.concat(F.lit("s:"), "sector").alias("k"), "pos", F.col("sector_ret").alias("market_ret")))
    cuts = keep(expanding_percentile(both, "k", "market_ret", pctile / 100, min_periods))
    return cuts.where("k = 'market'").select("pos", F.col("cut").alias("market_cut")), cuts.where("k <> 'market'").select(F.expr("substring(k, 3)").alias("sector"), "pos", F.col("cut").alias("sector_cut"))
