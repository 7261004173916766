"""Panel of daily series: one row per observed (ticker, pos), never pivoted.

`pos` is the position of a day in the calendar. Windows run over RANGE frames
of `pos`, so a missing day counts as a missing day without being stored. All of
them share one partitioning by ticker and one order by pos: one exchange, one sort.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.deliveries import last_prices
from tidemark.session import broadcast_within

FIELDS = ("open", "high", "low", "close", "volume")
MAX_DAYS = 200_000


def series():
    """The window all panel quantities share."""
    return Window.partitionBy("ticker").orderBy("pos")


def unpivot_fields(wide: DataFrame, keys: list[str], fields: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Wide to long; rows without a value are left out."""
    return wide.unpivot(keys, fields, name, value).where(F.col(value).isNotNull())


def calendar_pos(days: DataFrame) -> DataFrame:
    """`date, pos`: 0-based position among the distinct dates. One task, for at most as many rows as there are days."""
    return days.select(F.col("date").cast("date").alias("date")).where("date IS NOT NULL").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def observed(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """`ticker, date, pos, open..volume`: last deliveries on calendar days with a close above zero."""
    days = broadcast_within(calendar.select(F.col("date").cast("date").alias("date"), "pos"), MAX_DAYS)
    return last_prices(prices, *FIELDS).where("close > 0").join(days, "date").select("ticker", "date", "pos", *FIELDS)


def split_market(rows: DataFrame, market: str) -> tuple[DataFrame, DataFrame]:
    """(panel without the market's symbol, `pos, close` of the market)."""
    return rows.where(F.col("ticker") != market), rows.where(F.col("ticker") == market).select("pos", "close")


def at_offset(value: str, offset: int) -> Column:
    """The value exactly `offset` calendar rows away, null if there is none."""
    return F.first(value).over(series().rangeBetween(offset, offset))


def with_returns(panel: DataFrame) -> DataFrame:
    """Adds `prev_close`, the close one calendar row before, and `ret`, the close over it less one; null across a hole."""
    return panel.withColumn("prev_close", at_offset("close", -1)).withColumn("ret", F.col("close") / F.col("prev_close") - 1)


def prior(window: int):
    """The `window` calendar rows strictly before the current one."""
    return series().rangeBetween(-window, -1)


def with_moments(panel: DataFrame, window: int, min_obs: int, mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    """Mean and sample deviation of the prior returns; null with fewer than `min_obs` of them."""
    enough = F.count("ret").over(prior(window)) >= min_obs
    return panel.withColumn(mu, F.when(enough, F.avg("ret").over(prior(window)))).withColumn(sigma, F.when(enough, F.stddev_samp("ret").over(prior(window))))


def with_zscore(panel: DataFrame, window: int, min_obs: int, z: str = "z") -> DataFrame:
    """Adds the return's distance to the prior mean in prior deviations; null where the deviation isn't above zero."""
    return with_moments(panel, window, min_obs).withColumn(z, F.when(F.col("sigma") > 0, (F.col("ret") - F.col("mu")) / F.col("sigma")))


def with_zscores(panel: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Adds `z_<w>` for every window, as `with_zscore` does with `w` returns asked
    for. Such windows have no holes, so their sums are those of blocks that end
    some blocks before, of the length that divides all windows: a return is summed
    once a block, not once per window and moment. A window has no deviation if the
    return hasn't changed in it; of sums that need not come out as zero."""
    step = math.gcd(*windows)
    block, past = series().rangeBetween(-step, -1), series().rowsBetween(Window.unboundedPreceding, -1)
    x = panel.withColumns({"_n": F.count("ret").over(block), "_s": F.sum("ret").over(block), "_q": F.sum(F.col("ret") * F.col("ret")).over(block), "_p": F.lag("ret").over(series())})
    back = range(0, max(windows), step)
    lags = {f"_{k}{b}": F.lag(f"_{k}", b).over(series()) if b else F.col(f"_{k}") for b in back for k in "nsq"} | {f"_at{w}": F.lag("pos", w).over(series()) for w in windows}
    x = x.withColumns(lags | {"_changed": F.max(F.when(~F.col("ret").eqNullSafe(F.col("_p")), F.col("pos"))).over(past)})
    out = {}
    for w in windows:
        n, s, q = (reduce(Column.__add__, [F.col(f"_{k}{b}") for b in back if b < w]) for k in "nsq")
        whole = (F.col(f"_at{w}") == F.col("pos") - w) & (n == w) & (F.col("_changed") > F.col("pos") - w)
        out[f"z_{w}"] = F.when(whole, (F.col("ret") - s / w) / F.sqrt(F.greatest(q - s * s / w, F.lit(1e-300)) / max(w - 1, 1)))
    return x.withColumns(out).drop("_n", "_s", "_q", "_p", "_changed", *lags)


def with_median_volume(panel: DataFrame, window: int, name: str = "med_volume") -> DataFrame:
    """Median of the prior volumes above zero, with at least max(20, window // 3) of them."""
    traded = F.when(F.col("volume") > 0, F.col("volume"))
    enough = F.count(traded).over(prior(window)) >= max(20, window // 3)
    return panel.withColumn(name, F.when(enough, F.percentile(traded, F.lit(0.5)).over(prior(window))))


def with_realised_vol(panel: DataFrame, window: int, name: str) -> DataFrame:
    """Annualised deviation of the prior returns, with at least max(10, window // 2) of them."""
    enough = F.count("ret").over(prior(window)) >= max(10, window // 2)
    return panel.withColumn(name, F.when(enough, F.stddev_samp("ret").over(prior(window)) * F.sqrt(F.lit(252.0))))


def _linear(ordered: list[float], q: float) -> float:
    at = q * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def expanding_percentile(rows: DataFrame, key: str, value: str, q: float, min_obs: int, name: str = "cut") -> DataFrame:
    """`key, pos, name`: exact percentile of all values before each row, null with
    fewer than `min_obs`. An expanding percentile frame costs the square of a
    series' length; here each value is inserted into a sorted list once. A
    series has at most one row per calendar day."""

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        ordered: list[float] = []
        cuts = []
        for x in part["v"]:
            cuts.append(_linear(ordered, q) if len(ordered) >= min_obs else None)
            if x == x:
                bisect.insort(ordered, x)
        return pd.DataFrame({"k": part["k"], "pos": part["pos"], "cut": pd.Series(cuts, index=part.index, dtype=float)})

    out = rows.select(F.col(key).alias("k"), "pos", F.col(value).cast("double").alias("v")).groupBy("k").applyInPandas(grow, "k string, pos int, cut double")
    return out.select(F.col("k").alias(key), "pos", F.nanvl("cut", F.lit(None).cast("double")).alias(name))


def fill_forward(series: DataFrame, calendar: DataFrame, limit: int) -> DataFrame:
    """`pos, close`: one series on every calendar row, holes of up to `limit` rows filled with the value before."""
    dense = broadcast_within(calendar.select("pos"), MAX_DAYS).join(series.select("pos", "close"), "pos", "left")
    back = Window.orderBy("pos").rowsBetween(-limit, 0)
    return dense.select("pos", F.last("close", ignorenulls=True).over(back).alias("close"))


def market_series(series: DataFrame, calendar: DataFrame, limit: int = 3, vol_days: int = 20) -> DataFrame:
    """`pos, market, market_ret, market_mom_20, vix, vix_chg` per calendar row.
    The volatility level is the annualised deviation, in percent, of the last
    `vol_days` market returns including the day's, with at least half of them."""
    by = Window.orderBy("pos")
    x = fill_forward(series, calendar, limit).withColumn("market_ret", F.col("close") / F.lag("close").over(by) - 1)
    last = by.rowsBetween(1 - vol_days, 0)
    x = x.withColumn("vix", F.when(F.count("market_ret").over(last) >= vol_days // 2, F.stddev_samp("market_ret").over(last) * F.sqrt(F.lit(252.0)) * 100))
    return x.select(
        "pos", F.col("close").alias("market"), "market_ret", (F.lag("close", 1).over(by) / F.lag("close", 21).over(by) - 1).alias("market_mom_20"),
        "vix", (F.col("vix") - F.lag("vix").over(by)).alias("vix_chg"),
    )


def sector_series(panel: DataFrame, sectors: DataFrame, market: DataFrame) -> DataFrame:
    """`sector, pos, level, sector_ret`. A sector's level compounds the median
    return of its tickers; before its first return the market's level stands in
    for it (levels are spliced, so the day of the switch has an artificial return)."""
    daily = panel.join(sectors, "ticker").where("sector IS NOT NULL AND ret IS NOT NULL").groupBy("sector", "pos").agg(F.percentile("ret", F.lit(0.5)).alias("r"))
    by = Window.partitionBy("sector").orderBy("pos")
    level = daily.withColumn("own", 100 * F.exp(F.sum(F.log(F.greatest(1 + F.col("r"), F.lit(1e-6)))).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    dense = broadcast_within(daily.select("sector").distinct(), 10_000).crossJoin(market.select("pos", "market"))  # sectors x calendar days
    spliced = dense.join(level.select("sector", "pos", "own"), ["sector", "pos"], "left").withColumn("level", F.coalesce("own", "market"))
    return spliced.select("sector", "pos", "level", (F.col("level") / F.lag("level").over(by) - 1).alias("sector_ret"))
