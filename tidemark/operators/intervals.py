"""Problem 1: overlapping and gapped intervals per entity.

Starts and ends are ranked independently of each other. The interval of rank
i+1 by start opens a new period exactly where its start exceeds the i-th
smallest end; that end closes the period before. Neither pairing of windows nor
a running maximum over whole windows is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def periods_and_gaps(windows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """`key, kind, from_date, to_date` of the merged periods and the gaps between.

    Windows are half-open; touching ones belong together. A null end is open
    (9999-12-31). Windows without key or start, or whose end isn't after their
    start, cover nothing and are left out; repeated windows change nothing;
    other columns are ignored; an empty table gives no rows.

    Starts and ends are first counted per key and date, with map-side
    combination, so what is ranked per key has at most one row for each
    calendar day, however many windows one key has.
    """
    known = windows.select(
        F.col(key).alias("k"),
        F.col(start).cast("date").alias("s"),
        F.coalesce(F.col(end).cast("date"), F.lit(OPEN_END).cast("date")).alias("e"),
    ).where("k IS NOT NULL AND s < e")
    edges = (
        known.select("k", F.explode(F.array(
            F.struct(F.col("s").alias("d"), F.lit(1).alias("ns"), F.lit(0).alias("ne")),
            F.struct(F.col("e").alias("d"), F.lit(0).alias("ns"), F.lit(1).alias("ne")),
        )).alias("x"))
        .groupBy("k", F.col("x.d").alias("d"))
        .agg(F.sum("x.ns").alias("ns"), F.sum("x.ne").alias("ne"))
    )
    by_day = Window.partitionBy("k").orderBy("d")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = edges.withColumn("rs", F.sum("ns").over(upto)).withColumn("re", F.sum("ne").over(upto))
    # Start ranks at d are rs-ns+1..rs. The end ranked rs-ns lies before d iff re-ne == rs-ns.
    opens = (F.col("ns") > 0) & (F.col("re") - F.col("ne") == F.col("rs") - F.col("ns"))
    # The start ranked re+1 lies after d iff no more than re starts are at or before d.
    closes = (F.col("ne") > 0) & (F.col("rs") == F.col("re"))
    bounds = ranked.where(opens | closes).withColumn("kind", F.when(opens, "period").otherwise("gap"))
    return (
        bounds.withColumn("to_date", F.lead("d").over(by_day))
        .where("to_date IS NOT NULL")
        .select(F.col("k").alias(key), "kind", F.col("d").alias("from_date"), "to_date")
    )
