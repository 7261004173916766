"""Problem 3: irregular readings onto the grid of a calendar.

The calendar is cut into time shards. Each (source, shard) holds its readings
as one array, at most one per session, so no task depends on how many rows a
source has. Shards exchange halos: the last reading before and the first two
after each shard, wherever those lie. With them every hole between two
readings is filled inside one row by a shape-preserving cubic (Fritsch-Carlson
slopes: zero at turning points, else the weighted harmonic mean of the secants
on both sides), which stays within its two end readings. Holes longer than
`max_gap` end a segment: they are marked, and slopes don't reach across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_within

MAX_SESSIONS = 200_000


def session_days(calendar: DataFrame) -> DataFrame:
    """`date, pos, own`: each day with the session in whose period it lies, from
    a session's date up to the next one's. The last session has its own day and
    the ten after it. Null and repeated calendar rows count for nothing."""
    days = calendar.select(F.col("date").cast("date").alias("s"), "pos").where("s IS NOT NULL AND pos IS NOT NULL").groupBy("s").agg(F.min("pos").alias("pos"))
    nxt = F.coalesce(F.lead("s").over(Window.orderBy("s")), F.date_add("s", 11))
    return (
        days.withColumn("n", F.date_sub(nxt, 1))
        .select("pos", "s", F.explode(F.sequence("s", "n")).alias("date"))
        .select("date", "pos", (F.col("date") == F.col("s")).alias("own"))
    )


def session_readings(rows: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """`ticker, pos, y` from `ticker, date, value` rows, one per ticker and
    session with any row: the session day's own value, else that of the latest
    day in its period that has one, else null. Days before the calendar fall out."""
    days = broadcast_within(session_days(calendar), MAX_SESSIONS * 8)
    best = F.max(F.struct(F.col(value).isNotNull().alias("has"), "own", "date", F.col(value).alias("y"))).alias("b")
    return rows.join(days, "date").groupBy("ticker", "pos").agg(best).select("ticker", "pos", F.col("b.y").alias("y"))


def _edge(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(m) != F.signum(d0), F.lit(0.0)).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def _inner(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def regular_grid(readings: DataFrame, calendar: DataFrame, max_gap: int = 10, shard: int = 256) -> DataFrame:
    """`ticker, pos, session, y, status` for each session from a ticker's first
    to its last row in `readings` (`ticker, pos, y`; null y: a row without value).

    Status: `observed`; `filled` in a hole of at most `max_gap` sessions between
    two readings; `marked` (y null) in longer holes and before the first or
    after the last reading. A ticker without any reading has only marked
    sessions. Extreme and equal readings are readings. Empty input, no rows.
    """
    p = F.when(F.col("y").isNotNull(), F.col("pos"))
    sharded = readings.groupBy("ticker", F.floor(F.col("pos") / shard).cast("int").alias("shard")).agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min(p).alias("p0"), F.max(p).alias("p1"),
        F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("y"))))).alias("own"),
    ).withColumn("some", F.size("own") > 0)
    whole = Window.partitionBy("ticker")
    chain = Window.partitionBy("ticker", "some").orderBy("shard")
    none = F.array().cast("array<struct<p:int,y:double>>")
    tail, head = F.slice("own", -1, 1), F.slice("own", 1, 2)
    halo = (
        sharded.withColumn("first", F.min("lo").over(whole)).withColumn("last", F.max("hi").over(whole)).withColumn("r0", F.min("p0").over(whole)).withColumn("r1", F.max("p1").over(whole))
        .withColumn("before", F.coalesce(F.lag(tail, 1).over(chain), none))
        .withColumn("after", F.concat(F.coalesce(F.lead(head, 1).over(chain), none), F.coalesce(F.lead(head, 2).over(chain), none)))
        .where(F.col("some") | (F.col("r0").isNull() & (F.col("lo") == F.col("first"))))
    )
    # Index i of `ext` runs over the shard's own readings b. Each reading answers for the sessions up to the next one, c;
    # the ticker's first one also for those before it. A ticker without readings has one row without b.
    ext = halo.withColumn("nb", F.when(F.col("some"), F.size("before")).otherwise(0)).withColumn("ext", F.concat("before", "own", F.slice("after", 1, 2)))
    each = ext.select("ticker", "first", "last", "r0", "r1", F.explode(F.expr(
        "transform(sequence(nb, nb + greatest(size(own), 1) - 1), i -> struct(get(ext, i - 1) AS a, get(ext, i) AS b, get(ext, i + 1) AS c, get(ext, i + 2) AS d))"
    )).alias("x")).select("ticker", "first", "last", "r0", "r1", "x.*")
    reach = max_gap + 1
    h = (F.col("c.p") - F.col("b.p")).cast("double")
    s = (F.col("c.y") - F.col("b.y")) / h
    hl, hr = (F.col("b.p") - F.col("a.p")).cast("double"), (F.col("d.p") - F.col("c.p")).cast("double")
    sl, sr = (F.col("b.y") - F.col("a.y")) / hl, (F.col("d.y") - F.col("c.y")) / hr
    left, right = F.coalesce(hl <= reach, F.lit(False)), F.coalesce(hr <= reach, F.lit(False))
    fill = F.coalesce((h > 1) & (h <= reach), F.lit(False))
    mb = F.when(fill, F.when(left, _inner(hl, h, sl, s)).when(right, _edge(h, hr, s, sr)).otherwise(s))
    mc = F.when(fill, F.when(right, _inner(h, hr, s, sr)).when(left, _edge(h, hl, s, sl)).otherwise(s))
    begin = F.when(F.col("b.p").isNull() | (F.col("b.p") == F.col("r0")), F.col("first")).otherwise(F.col("b.p"))
    end = F.when(F.col("b.p").isNull() | (F.col("b.p") == F.col("r1")), F.col("last")).otherwise(F.col("c.p") - 1)
    sessions = each.select("ticker", F.col("b.p").alias("x0"), F.col("b.y").alias("y0"), F.col("c.y").alias("y1"), F.when(fill, h).alias("h"), mb.alias("mb"), mc.alias("mc"), F.explode(F.sequence(begin, end)).alias("pos"))
    t = (F.col("pos") - F.col("x0")) / F.col("h")
    cubic = (
        F.col("y0") * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("h") * F.col("mb") * t * (1 - t) * (1 - t)
        + F.col("y1") * t * t * (3 - 2 * t) + F.col("h") * F.col("mc") * t * t * (t - 1)
    )
    here, filled = F.coalesce(F.col("pos") == F.col("x0"), F.lit(False)), F.col("h").isNotNull() & (F.col("pos") > F.col("x0"))
    valued = sessions.select("ticker", "pos", F.when(here, F.col("y0")).when(filled, cubic).alias("y"), F.when(here, "observed").when(filled, "filled").otherwise("marked").alias("status"))
    days = broadcast_within(calendar.select(F.col("pos"), F.col("date").cast("date").alias("session")).where("pos IS NOT NULL AND session IS NOT NULL").dropDuplicates(["pos"]), MAX_SESSIONS)
    return valued.join(days, "pos").select("ticker", "pos", "session", "y", "status")
