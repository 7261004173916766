"""Membership, screening of corrupt series, coverage, sectors."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import symbol

_STATE = "struct<live:boolean,right:date,w:array<struct<start:date,end:date>>,odd:int>"


#: Written forms of dates besides ISO's.
DATE_FORMS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")


def lenient_date(c: Column | str) -> Column:
    """The date a text stands for, in any of the known forms; null if in none."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(c.try_cast("date"), *[F.try_to_date(c, form) for form in DATE_FORMS])


def clean_changes(raw: DataFrame, date: str = "date", added: str = "added", removed: str = "removed") -> DataFrame:
    """`date, added, removed` of a change log as text: dates read leniently, rows
    without one left out, symbols in their normal form, null where a side names no one."""
    return raw.select(lenient_date(date).alias("date"), symbol(added).alias("added"), symbol(removed).alias("removed")).where("date IS NOT NULL")


def first_by_symbol(rows: DataFrame, order: str, ticker: str = "ticker") -> DataFrame:
    """One row per symbol, the first by `order` (nulls last; of equals the least
    row), its symbol in normal form. Rows that name no symbol are left out."""
    others = [c for c in rows.columns if c != ticker]
    row = F.struct(F.struct(F.col(order).isNull(), F.col(order)).alias("first"), F.struct(*others).alias("row"))
    x = rows.select(symbol(ticker).alias("k"), row.alias("x")).where("k IS NOT NULL").groupBy("k").agg(F.min("x").alias("x"))
    return x.select(F.col("k").alias(ticker), *[F.col("x.row")[c].alias(c) for c in others])


def membership_windows(current: DataFrame, changes: DataFrame, floor: datetime.date, ceiling: datetime.date) -> DataFrame:
    """`ticker, start, end, anomalies`: windows from the current list and the log.

    Each symbol is a fold of its own over its entries, latest first, whose state
    is "member or not, and until when". An entry that fits the state turns it and,
    if it is an addition, closes a window; one that doesn't fit only counts in
    `anomalies`. On one day an addition is folded after a removal. The window
    still open when the entries are used up begins at `floor`; windows are cut to
    [`floor`, `ceiling`). Null symbols and dates are left out, repeated entries count once.
    """
    side = lambda c, add: changes.select(symbol(c).alias("ticker"), F.col("date").cast("date").alias("d"), F.lit(add).alias("add"))
    log = side("added", True).unionByName(side("removed", False)).where("ticker IS NOT NULL AND d IS NOT NULL").distinct()
    entries = log.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("d", "add"))).alias("log"))
    now = current.select(symbol("ticker").alias("ticker")).where("ticker IS NOT NULL").distinct().withColumn("live", F.lit(True))
    floor_, ceiling_ = F.lit(floor).cast("date"), F.lit(ceiling).cast("date")

    def step(s, x):
        add, live = x["add"], s["live"]
        emits = add & live
        return F.struct(
            F.when(add, F.lit(False)).otherwise(F.lit(True)).alias("live"),
            F.when(add, F.lit(None).cast("date")).when(live, s["right"]).otherwise(x["d"]).alias("right"),
            F.when(emits, F.concat(s["w"], F.array(F.struct(x["d"].alias("start"), s["right"].alias("end"))))).otherwise(s["w"]).alias("w"),
            (s["odd"] + (add != live).cast("int")).alias("odd"),
        ).cast(_STATE)

    start = F.struct(
        F.coalesce("live", F.lit(False)).alias("live"), F.when(F.col("live"), ceiling_).alias("right"),
        F.array().cast("array<struct<start:date,end:date>>").alias("w"), F.lit(0).alias("odd"),
    ).cast(_STATE)
    none = F.array().cast("array<struct<d:date,add:boolean>>")
    folded = entries.join(now, "ticker", "full").select("ticker", F.aggregate(F.reverse(F.coalesce("log", none)), start, step).alias("s"))
    last = F.array(F.struct(floor_.alias("start"), F.col("s.right").alias("end")))
    return (
        folded.select("ticker", F.col("s.odd").alias("anomalies"), F.explode(F.when(F.col("s.live"), F.concat("s.w", last)).otherwise(F.col("s.w"))).alias("x"))
        .where((F.col("x.end") > floor_) & (F.col("x.start") < ceiling_))
        .select("ticker", F.greatest("x.start", floor_).alias("start"), F.least("x.end", ceiling_).alias("end"), "anomalies")
    )


def eligible(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows whose date lies in a window [start, end) of their ticker; a null end is open."""
    w = windows.select(F.col("ticker").alias("wt"), F.col("start").alias("ws"), F.coalesce("end", F.lit("9999-12-31").cast("date")).alias("we"))
    return rows.join(w, (F.col("ticker") == F.col("wt")) & (F.col("date") >= F.col("ws")) & (F.col("date") < F.col("we")), "left_semi")


def reuse_guard(prices: DataFrame, windows: DataFrame, min_overlap: int = 20) -> DataFrame:
    """`ticker, price_start, price_end, membership_start, membership_end,
    overlap_obs, kept` of tickers with both prices and windows. Kept are those
    whose price span overlaps a window by more than a day's edge and that have
    `min_overlap` observations inside windows, counted window by window."""
    spans = prices.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = (
        windows.join(prices.select("ticker", "date"), "ticker").where("date >= start AND date < end").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    )
    over = windows.join(spans, "ticker").groupBy("ticker", "lo", "hi").agg(
        F.bool_or(F.datediff(F.least("hi", "end"), F.greatest("lo", "start")) > 0).alias("overlap"),
        F.min("start").alias("membership_start"), F.max("end").alias("membership_end"),
    )
    n = F.coalesce("n", F.lit(0))
    return over.join(inside, "ticker", "left").select(
        "ticker", F.col("lo").alias("price_start"), F.col("hi").alias("price_end"), "membership_start", "membership_end",
        n.alias("overlap_obs"), (F.col("overlap") & (n >= min_overlap)).alias("kept"),
    )


def integrity_report(
    prices: DataFrame, jump: float = 2.0, days: int = 5, band: tuple[float, float] = (0.67, 1.5),
    min_round_trips: int = 3, max_extreme: int = 12, extreme: float = 0.5, min_distinct: float = 0.25, min_obs: int = 10,
) -> DataFrame:
    """One row per ticker with at least `min_obs` closes: round trips, extreme
    moves, share of distinct closes, and `reason` (null: credible). Steps are
    between consecutive observed closes, whatever days lie between."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = [F.lead("close", k).over(w) for k in range(1, days + 1)]
    x = prices.select("ticker", "date", "close", F.lag("close").over(w).alias("pre"), F.array(*ahead).alias("ahead"))
    rel = F.col("close") / F.col("pre")
    back = F.exists("ahead", lambda c: F.coalesce((c / F.col("pre") > band[0]) & (c / F.col("pre") < band[1]), F.lit(False)))
    per = x.groupBy("ticker").agg(
        F.count_if(((rel >= jump) | (rel <= 1 / jump)) & back).alias("n_round_trips"), F.count_if(F.abs(rel - 1) > extreme).alias("n_extreme_moves"),
        (F.count_distinct("close") / F.count("close")).alias("r"), F.count("close").alias("obs"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
    ).where(F.col("obs") >= min_obs)
    why = F.concat_ws(
        "+", F.when(F.col("n_round_trips") >= min_round_trips, "round_trip_oscillation"),
        F.when(F.col("n_extreme_moves") > max_extreme, "extreme_move_frequency"), F.when(F.col("r") < min_distinct, "low_value_diversity"),
    )
    return per.select("ticker", "n_round_trips", "n_extreme_moves", F.round("r", 4).alias("distinct_ratio"), "obs", "min_close", "max_close", F.nullif(why, F.lit("")).alias("reason"))


def integrity_screen(prices: DataFrame, **limits) -> DataFrame:
    """The prices without tickers that fail a rule."""
    return prices.join(integrity_report(prices, **limits).where("reason IS NOT NULL"), "ticker", "left_anti")


def coverage_report(windows: DataFrame, prices: DataFrame, current: DataFrame) -> DataFrame:
    """One row: sizes of the point-in-time universe, its parts with prices, coverage in percent."""
    flag = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(1))
    x = flag(windows, "e").join(flag(prices, "p"), "ticker", "full").join(flag(current, "c"), "ticker", "full").fillna(0, ["e", "p", "c"])
    n = lambda cond: F.count_if(F.expr(cond))
    pct = lambda a, b: F.round(100 * a / F.greatest(b, F.lit(1)), 1)
    return x.agg(
        n("e = 1").alias("eligible_tickers"), n("c = 1").alias("current_members"), n("e = 1 AND c = 0").alias("historical_only"),
        n("e = 1 AND p = 1").alias("eligible_with_prices"), n("e = 1 AND c = 0 AND p = 1").alias("historical_with_prices"), n("e = 1 AND c = 0 AND p = 0").alias("historical_missing"),
        pct(n("e = 1 AND c = 0 AND p = 1"), n("e = 1 AND c = 0")).alias("historical_coverage_pct"), pct(n("c = 1 AND p = 1"), n("c = 1")).alias("current_coverage_pct"),
    )


def resolve_sectors(*sources: DataFrame, relabel: dict[str, str] | None = None) -> DataFrame:
    """`ticker, sector`: of the first source that knows one, relabelled. Labels
    are trimmed and upper case; where one source has several, the least counts."""
    out = None
    for i, s in enumerate(sources):
        label = F.upper(F.trim("sector"))
        for old, new in (relabel or {}).items():
            label = F.when(label == old, new).otherwise(label)
        part = s.select(symbol("ticker").alias("ticker"), F.nullif(label, F.lit("")).alias("s")).where("ticker IS NOT NULL").groupBy("ticker").agg(F.min("s").alias(f"s{i}"))
        out = part if out is None else out.join(part, "ticker", "full")
    return out.select("ticker", F.coalesce(*[f"s{i}" for i in range(len(sources))]).alias("sector"))
