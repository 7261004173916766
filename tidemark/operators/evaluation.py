"""Scores of probability forecasts: discrimination, calibration, sharpness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are cut into so many ranges, so cumulated counts need no global sort.
RANGES = 4096


def _ranked(rows: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives at it, and the numbers below it."""
    per = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos")).withColumn("cell", F.floor(F.col("p") * RANGES))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = per.groupBy(*by, "cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    offset = cells.select(*by, "cell", F.coalesce(F.sum("cp").over(before), F.lit(0.0)).alias("op"), F.coalesce(F.sum("cn").over(before), F.lit(0.0)).alias("on"))
    inside = Window.partitionBy(*by, "cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    x = per.join(offset, [*by, "cell"])
    return x.select(*by, "p", "pos", "neg", (F.col("op") + F.coalesce(F.sum("pos").over(inside), F.lit(0.0))).alias("pos_below"), (F.col("on") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0))).alias("neg_below"))


def ranking_metrics(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """`by, roc_auc, pr_auc`: ties count half; precision is averaged in steps, not
    by trapezoids. Null where only one class occurs."""
    r = _ranked(rows, y, p, by)
    totals = r.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    x = r.join(totals, list(by)) if by else r.crossJoin(F.broadcast(totals))  # one row
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")  # at or above the score
    both = (F.first("all_pos") > 0) & (F.first("all_neg") > 0)
    auc = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.first("all_pos") * F.first("all_neg"), F.lit(0.0))
    ap = F.sum(F.col("pos") * tp / (tp + fp)) / F.nullif(F.first("all_pos"), F.lit(0.0))
    return x.groupBy(*by).agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("pr_auc"))


def point_metrics(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """`by, n, base_rate, brier, log_loss, accuracy, brier_skill_vs_base_rate`; the skill is against the evaluated sample's rate."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    t = F.col(y).cast("double")
    x = rows.where(F.col(p).isNotNull() & t.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("base_rate"), F.avg(F.pow(q - t, 2)).alias("brier"),
        F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg(((q >= threshold).cast("double") == t).cast("double")).alias("accuracy"))
    base = F.col("base_rate") * (1 - F.col("base_rate"))
    return x.withColumn("brier_skill_vs_base_rate", 1 - F.col("brier") / F.nullif(base, F.lit(0.0)))


def classification_metrics(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    a, b = point_metrics(rows, y, p, by), ranking_metrics(rows, y, p, by)
    return a.join(b, list(by)) if by else a.crossJoin(b)  # one row each


def calibration_bins(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """`bin, n, mean_pred, observed_freq, lo_edge, hi_edge, ece`: bins between the
    distinct interpolated quantiles, closed on the right."""
    known = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    edges = known.agg(F.array_sort(F.array_distinct(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(bins + 1)])))).alias("e"))
    x = known.crossJoin(F.broadcast(edges))  # one row
    top = F.size("e") - 2
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    at = F.least(F.size(F.filter(inner, lambda v: v < F.col(p))), F.greatest(top, F.lit(0)))
    t = x.withColumn("bin", at).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed_freq"),
        F.first(F.get("e", F.col("bin"))).alias("lo_edge"), F.first(F.get("e", F.col("bin") + 1)).alias("hi_edge"))
    whole = t.agg(F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("observed_freq"))).alias("a"), F.sum("n").alias("b")).select((F.col("a") / F.col("b")).alias("ece"))
    return t.crossJoin(F.broadcast(whole))  # one row
