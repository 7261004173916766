"""Membership status of symbols from a log of additions and removals."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbols import symbol
from tidemark.operators.history import version_history

EPOCH = datetime.date(1970, 1, 1)
FLOOR = datetime.date(2005, 6, 1)
OPEN = datetime.date(9999, 12, 31)
#: Log entries that one task merges, if shuffles have tasks enough.
ROWS_A_TASK = 10_000


def last_deliveries(log: DataFrame) -> DataFrame:
    """Of each `change_id` the delivery loaded last (no load time: first of all;
    equal load times: the greatest row). Rows without `change_id` can't be
    matched with others and each stand for themselves."""
    body = F.struct(F.col("loaded_at"), F.col("date"), F.col("added"), F.col("removed"))
    kept = log.where("change_id IS NOT NULL").groupBy("change_id").agg(F.max(body).alias("x")).select("x.*")
    return kept.unionByName(log.where("change_id IS NULL").select("loaded_at", "date", "added", "removed"))


def status_history(log: DataFrame, floor: datetime.date = FLOOR) -> DataFrame:
    """`ticker, status, valid_from, valid_to` (dates), half-open, last version open.

    Entries without date count for nothing; an empty side (null, blank, nan)
    names no one. A ticker whose first entry is a removal was a member from
    `floor`. Where entries for one ticker and date disagree, the one loaded last
    counts, then the addition. Two streams, additions and removals, are merged;
    each is first reduced to one row per ticker and date, so a ticker that
    holds a third of the log has at most one row a day in each.
    """
    last = last_deliveries(log).where("date IS NOT NULL")

    def stream(side: str, status: str) -> DataFrame:
        return (
            last.select(symbol(side).alias("k"), F.unix_date(F.col("date").cast("date")).cast("long").alias("t"),
                        F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("o"))
            .where("k IS NOT NULL").groupBy("k", "t").agg(F.max("o").alias("o")).withColumn("v", F.lit(status))
        )

    since = (floor - EPOCH).days
    # Few rows need few tasks: every entry has at most two sides.
    most = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(most, -(-log.count() // ROWS_A_TASK)))
    found = version_history(
        [stream("removed", "out"), stream("added", "member")], (OPEN - EPOCH).days,
        lambda status: (since, "member") if status == "out" else None, buckets,
    )
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int")).alias(c)
    return found.select(F.col("k").alias("ticker"), F.col("v").alias("status"), day("valid_from"), day("valid_to"))
