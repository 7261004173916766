"""The event study over the project's tables: one plan per stage, built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.symbols import symbol
from tidemark.operators import episodes as ep
from tidemark.operators import panel as pn
from tidemark.operators.universe import resolve_sectors
from tidemark.session import written
from tidemark.sources import read_table


class Study:
    """Builds the panel once; events for any overridden specification.

    With `stored` (set by the first call for events and what surrounds them) the
    prices as last delivered with their returns, the market and the sector series are written to the
    shared folder and read from there: the event table needs them several times over.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.folder, self.config = spark, folder, config or Config()
        self.stored = False

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if self.stored else df

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def calendar(self) -> DataFrame:
        return self.table("trading_days").select(F.col("date").cast("date").alias("date"), F.col("pos").cast("int").alias("pos"))

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        # One table of all symbols with their returns; who needs only prices has the windows pruned.
        rows = pn.with_returns(pn.observed(self.table("prices"), self.calendar))
        return pn.split_market(self._kept(rows, "panel"), self.config.get("benchmarks.market"))

    @cached_property
    def prices(self) -> DataFrame:
        return self._split[0].drop("prev_close", "ret")

    @cached_property
    def panel(self) -> DataFrame:
        return self._split[0]

    @cached_property
    def market(self) -> DataFrame:
        return self._kept(pn.market_series(self._split[1], self.calendar, self.config.get("benchmarks.fill_limit"), self.config.get("benchmarks.vol_days")), "market")

    @cached_property
    def windows(self) -> DataFrame:
        open_ = F.lit("9999-12-31").cast("date")
        return (
            self.table("membership").select(symbol("ticker").alias("ticker"), F.col("start").cast("date").alias("start"), F.coalesce(F.col("end").cast("date"), open_).alias("end"))
            .where("ticker IS NOT NULL AND start < end").distinct()
        )

    @cached_property
    def current(self) -> DataFrame:
        return self.windows.where("end = DATE '9999-12-31'").select("ticker").distinct()

    @cached_property
    def sectors(self) -> DataFrame:
        return resolve_sectors(self.table("sector_map")).where("sector IS NOT NULL")

    @cached_property
    def sector_rets(self) -> DataFrame:
        return self._kept(pn.sector_series(self.panel, self.sectors, self.market), "sectors")

    @cached_property
    def cuts(self) -> tuple[DataFrame, DataFrame]:
        c = self.config
        return ep.percentile_cuts(self.market, self.sector_rets, c.get("crash_type.benchmark_pctile"), c.get("crash_type.min_periods"), lambda df: self._kept(df, "cuts"))

    def candidates(self, z: float | None = None, window: int | None = None, panel: DataFrame | None = None) -> DataFrame:
        c = self.config
        w = window or c.get("events.vol_window")
        # An overridden window is also the number of observations asked for.
        scored = pn.with_zscore(panel or self.panel, w, window or c.get("events.min_prior_obs"))
        return ep.candidates(scored, self.windows, c.get("events.z_threshold") if z is None else z, c.get("study.start"), c.get("study.end"))

    def episodes(self, z: float | None = None, window: int | None = None, cooldown: int | None = None, wide: bool = True) -> DataFrame:
        """Events with all they take from their own series, before joins."""
        c = self.config
        k = cooldown or c.get("events.cooldown")
        w = window or c.get("events.vol_window")
        if wide:
            self.stored = True
        kept = ep.cooldown(self.candidates(z, window), k)
        if wide:
            kept = written(kept, "episodes")  # few rows beside the panel, asked for twice
            around = ep.surroundings(kept, self.panel, c.get("outcomes.horizons"), c.get("outcomes.primary"), k, [w])
            kept = kept.join(around.withColumnRenamed(f"prior_volumes_{w}", "prior_volumes"), ["ticker", "pos"])
        kept = kept.withColumnRenamed("z", "crash_z").withColumn("event_id", F.concat_ws("_", "ticker", F.date_format("date", "yyyy-MM-dd"))).withColumnRenamed("date", "event_date").withColumn("raw_return", F.col("ret"))
        last = self.calendar.agg(F.max("pos").alias("top"))
        ends = self.calendar.select(F.col("pos").alias("end_pos"), F.col("date").alias("episode_end_date"))
        kept = kept.crossJoin(F.broadcast(last)).withColumn("end_pos", F.least(F.col("pos") + (k - 1), F.col("top"))).drop("top")  # one row
        return kept.join(ends, "end_pos", "left").drop("end_pos")

    def outcomes(self, **spec) -> DataFrame:
        return ep.with_outcomes(self.episodes(**spec), self.market, self.calendar, self.config.get("outcomes.horizons"), self.config.get("outcomes.primary"))

    def features(self, **spec) -> DataFrame:
        self.stored = True
        return ep.with_features(self.outcomes(**spec), self.market, self.calendar, self.sectors, self.sector_rets, *self.cuts, spec.get("window") or self.config.get("events.vol_window"))

    def events(self, **spec) -> DataFrame:
        # Events are few beside the panel; written once, so quantiles of all events don't derive them anew.
        return ep.with_regimes(written(self.features(**spec), "events"), self.config.get("regimes.vix_high_quantile"))

    def paths(self, **spec) -> DataFrame:
        return ep.car_path(self.episodes(wide=False, **spec), self.panel, self.market, self.calendar, self.config.get("outcomes.max_tau"))
