"""Chronological splits with an embargo.

Cuts are order statistics of the dates. They are read off the counts per date,
so no row is sorted; counts per date are at most one row per calendar day.
"""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _date_counts(rows: DataFrame, date: str) -> tuple[list[datetime.date], np.ndarray]:
    got = rows.where(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    return [r.d for r in got], np.cumsum([r.n for r in got]) if got else np.zeros(0, int)


def embargo_days(trading_days: int) -> int:
    """Calendar days that cover so many trading days, and one more."""
    return int(trading_days * 7 / 5) + 1


def split_cuts(rows: DataFrame, date: str, train: float, val: float) -> tuple[datetime.date, datetime.date]:
    """First dates of validation and test: the order statistics at the floors of the cumulated fractions."""
    days, upto = _date_counts(rows, date)
    if not days:
        raise ValueError("no dated rows to split")
    n = int(upto[-1])
    at = lambda i: days[int(np.searchsorted(upto, min(i, n - 1), side="right"))]
    return at(int(np.floor(n * train))), at(int(np.floor(n * (train + val))))


def chronological_split(rows: DataFrame, date: str, train: float = 0.70, val: float = 0.15, embargo: int = 20) -> DataFrame:
    """Adds `split`: train, val, test, or embargo for rows whose outcome reaches into the next block."""
    cut_val, cut_test = split_cuts(rows, date, train, val)
    gap = datetime.timedelta(days=embargo_days(embargo))
    d = F.col(date).cast("date")
    day = lambda x: F.lit(x).cast("date")
    return rows.withColumn("split", F.when(d < day(cut_val - gap), "train").when((d >= day(cut_val)) & (d < day(cut_test - gap)), "val").when(d >= day(cut_test), "test").otherwise("embargo"))


def expanding_folds(rows: DataFrame, date: str, n_folds: int = 5, min_train: float = 0.4, embargo: int = 20, min_block: int = 50, min_train_rows: int = 200, min_test_rows: int = 50) -> list[dict]:
    """Folds that train on all history before an embargo and test on the next block, both its end dates in."""
    days, upto = _date_counts(rows, date)
    if not days:
        return []
    n = int(upto[-1])
    edges = np.linspace(int(n * min_train), n, n_folds + 1).astype(int)
    at = lambda i: days[int(np.searchsorted(upto, i, side="right"))]
    below = lambda d: int(upto[i - 1]) if (i := int(np.searchsorted(np.array(days), d))) else 0
    folds = []
    for k in range(n_folds):
        lo, hi = int(edges[k]), int(edges[k + 1])
        if hi - lo < min_block:
            continue
        first, last = at(lo), at(hi - 1)
        end = first - datetime.timedelta(days=embargo_days(embargo))
        n_train, n_test = below(end), below(last + datetime.timedelta(days=1)) - below(first)
        if n_train > min_train_rows and n_test > min_test_rows:
            folds.append({"fold": k, "train_end": end, "test_start": first, "test_end": last, "n_train": n_train, "n_test": n_test})
    return folds
