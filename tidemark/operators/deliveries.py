"""Price rows as they were last delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbols import real, symbol


def last_prices(prices: DataFrame, *fields: str) -> DataFrame:
    """`ticker, date` and `fields`: of each ticker and date the delivery loaded
    last (no load time: first of all; equal times: the larger batch, then the
    greater values). NaN comes out as null. Rows without ticker or date are left
    out. Resends are combined before the shuffle, so no ticker keeps more than
    one row a day."""
    x = prices.select(
        symbol("ticker").alias("ticker"), F.col("date").cast("date").alias("date"),
        F.struct(F.col("loaded_at"), F.col("batch_id"), *[real(f).alias(f) for f in fields]).alias("x"),
    ).where("ticker IS NOT NULL AND date IS NOT NULL")
    return x.groupBy("ticker", "date").agg(F.max("x").alias("x")).select("ticker", "date", *[F.col(f"x.{f}").alias(f) for f in fields])
