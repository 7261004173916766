"""Problem 5: implausible readings per source.

Seasonal residuals of each source are its log readings less the source's own
weekday level. A reading's departure is the smaller of its distances to the
medians of the five readings before and after it, if both have the same sign:
large only where the level is left and found again. A generalised Pareto tail
is fitted by L-moments to a source's own departures beyond a high threshold; its
shape is free, but drawn towards a common one where excesses are few. The tail
gives the cutoff that a reading exceeds with a fixed small risk. Runs found are
taken out and the tail is fitted anew until the set is stable, so that a source's
own spikes don't lift its cutoff. Runs of a few readings are held against the
same cutoff as one. Further rules: impossible values, stuck runs; high volume
around a move of the price is trade, and so is a move that begins with a surge of volume.
All limits but the risk are in robust deviations of the source's own changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "ticker string, date date, field string, rule string, value double, departure double, cutoff double"
AROUND = 5
#: Sessions that a departure lasts at most: a price that stays away longer has moved.
LONGEST = {"close": 5, "volume": 12}
#: At most so many fits of the tail; each takes out what the one before found.
FITS = 10
#: Share of the departures beyond the threshold of the tail, the least number of
#: departures for a fit, and the tail's shape where a source has few: as if so many excesses more had it.
TAIL, LEAST = 0.10, 30
SHAPE, SHAPE_WEIGHT = 0.1, 150
WIDE = (-0.5, 0.5)
#: In robust deviations of a source's own changes: what never departs from its level,
#: what is a move of the price, and what is a surge of volume.
QUIET, MOVED, SURGE = 3.0, 4.0, 3.5
#: Readings explained by trade are cases all the same if they go so many times beyond the cutoff.
BEYOND = 5.0


def fit_tail(excesses: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto tail by L-moments. The shape is free
    in WIDE and drawn towards SHAPE by the weight of SHAPE_WEIGHT excesses."""
    x = np.sort(excesses)
    n = len(x)
    l1 = x.mean()
    l2 = 2 * (np.arange(n) * x).sum() / (n * max(n - 1, 1)) - l1
    own = 2 - l1 / l2 if l2 > 0 else SHAPE
    xi = float(np.clip((n * own + SHAPE_WEIGHT * SHAPE) / (n + SHAPE_WEIGHT), *WIDE))
    return xi, float(l1 * (1 - xi))


def tail_level(xi: float, scale: float, ratio: float) -> float:
    """Excess that is exceeded once in `ratio` excesses."""
    return scale * np.log(ratio) if abs(xi) < 1e-6 else scale / xi * (ratio**xi - 1)


def tail_cutoff(departures: np.ndarray, risk: float, robust: bool = False) -> float:
    """Peaks over threshold: the level exceeded with probability `risk`. `robust`
    takes the scale from the median excess and the shape as SHAPE, for departures
    that still hold errors. Infinite with fewer than LEAST departures."""
    x = departures[np.isfinite(departures)]
    if len(x) < LEAST:
        return np.inf
    u = np.quantile(x, 1 - TAIL)
    over = x[x > u] - u
    if len(over) < 3 or over.max() <= 0:
        return np.inf
    xi, scale = (SHAPE, float(np.median(over)) * SHAPE / (2**SHAPE - 1)) if robust else fit_tail(over)
    return float(u + tail_level(xi, scale, len(over) / (risk * len(x)))) if scale > 0 else np.inf


def _scale(x: np.ndarray) -> float:
    """Robust deviation of a series' changes."""
    return float(1.4826 * np.median(np.abs(np.diff(x)))) if len(x) > 1 else np.inf


def _medians(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the AROUND values before and after each, at the ends of those there are."""
    pad = np.full(AROUND, np.nan)
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), AROUND)
    with np.errstate(all="ignore"):
        return _nanmedian(w[: len(x)]), _nanmedian(w[AROUND + 1 : AROUND + 1 + len(x)])


def _nanmedian(w: np.ndarray) -> np.ndarray:
    s = np.sort(w, axis=1)  # NaN last
    n = (~np.isnan(s)).sum(axis=1)
    i = np.arange(len(s))
    lo, hi = s[i, np.maximum((n - 1) // 2, 0)], s[i, np.maximum(n // 2, 0).clip(max=s.shape[1] - 1)]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def _departures(x: np.ndarray, length: int, medians: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Signed, for each start of a run of `length` readings: the least distance
    of any of them to the levels before and after the run, 0 where these
    disagree in sign. At either end of a series the one level there is counts."""
    n = len(x) - length + 1
    if n <= 0:
        return np.zeros(0)
    before, after = _medians(x) if medians is None else medians
    b, a = before[:n], after[length - 1 :]
    b, a = np.where(np.isnan(b), a, b), np.where(np.isnan(a), b, a)
    low = high = x[:n]
    for k in range(1, length):
        low, high = np.minimum(low, x[k : n + k]), np.maximum(high, x[k : n + k])
    up, down = low - np.maximum(a, b), np.minimum(a, b) - high
    return np.nan_to_num(np.where(up > 0, up, np.where(down > 0, -down, 0.0)))


def _returns(x: np.ndarray, longest: int) -> np.ndarray:
    """Rows (length, first, departure, limit) of all runs of at most
    `longest` readings that leave the level and return at once: the jumps in and
    out are opposite in sign and cancel to within half the smaller one. The limit is the cutoff up to
    which the run counts. Where a series begins or ends in the run, its one jump must be three times as large."""
    medians, out = _medians(x), []
    for length in range(1, longest + 1):
        dep = _departures(x, length, medians)
        i = np.flatnonzero(dep)
        j = i + length - 1
        sign, first, last = np.sign(dep[i]), i == 0, j == len(x) - 1
        before, after = x[np.maximum(i - 1, 0)], x[np.minimum(j + 1, len(x) - 1)]
        enter = np.where(first, np.inf, sign * (x[i] - before))
        leave = np.where(last, np.inf, sign * (x[j] - after))
        jump = np.minimum(enter, leave)
        ok = (jump > 0) & (first | last | (np.abs(after - before) <= 0.5 * jump))
        limit = np.minimum(np.abs(dep[i]) / 0.6, np.where(first | last, jump / 3, jump))
        out.append(np.column_stack([np.full(ok.sum(), length), i[ok], dep[i[ok]], limit[ok]]))
    return np.concatenate(out)


def _spikes(x: np.ndarray, risk: float, longest: int) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Which readings lie in returning runs beyond the cutoff (see `_returns`), their
    departures, the cutoff, and whether the tail gave it (else QUIET did). The
    tail is fitted to the departures of the readings outside the runs found so
    far, until no more are found; the first fit is a robust one. The cutoff only falls, so what was found stays found."""
    hit, size, cut = np.zeros(len(x), bool), np.zeros(len(x)), np.inf
    fitted, runs = True, _returns(x, longest)
    for k in range(FITS):
        clean = x[~hit]
        tail, floor = tail_cutoff(np.abs(_departures(clean, 1)), risk, robust=k == 0), QUIET * _scale(clean)
        if max(tail, floor) < cut:
            cut, fitted = max(tail, floor), tail >= floor
        if not np.isfinite(cut):
            return hit, size, cut, fitted
        known = hit.copy()
        for length, i, dep, _ in runs[runs[:, 3] > cut].tolist():
            own = slice(int(i), int(i + length))
            hit[own] = True
            size[own] = np.where(np.abs(size[own]) > abs(dep), size[own], dep)
        if k and (hit == known).all():
            break
    return hit, size, cut, fitted


def _surges(x: np.ndarray) -> np.ndarray:
    """Readings far above the levels before and after them."""
    return _departures(x, 1) > SURGE * _scale(x)


def _unexplained(hit: np.ndarray, size: np.ndarray, cut: float, why: np.ndarray) -> np.ndarray:
    """The hits less the runs that hold one of the readings `why`, unless they go BEYOND."""
    run = np.cumsum(hit & ~np.r_[False, hit[:-1]])
    n = int(run.max(initial=0)) + 1
    explained = np.bincount(run, hit & why, n) > 0
    most = np.zeros(n)
    np.maximum.at(most, run[hit], np.abs(size[hit]))
    return hit & ~(explained & (most < BEYOND * cut))[run]


def _weekday_free(x: np.ndarray, weekday: np.ndarray) -> np.ndarray:
    """Less the median deviation of each weekday from the local level."""
    b, a = _medians(x)
    dev = x - (b + a) / 2
    out = x.copy()
    for d in range(7):
        at = weekday == d
        if (ok := at & np.isfinite(dev)).sum() >= 20:
            out[at] -= np.median(dev[ok])
    return out


def _stuck(x: np.ndarray, traded: np.ndarray, length: int) -> np.ndarray:
    """All but the first of each run of at least `length` equal readings, each with trade."""
    if not len(x):
        return np.zeros(0, bool)
    new = np.r_[True, (x[1:] != x[:-1]) | ~traded[1:] | ~traded[:-1]]
    run = np.cumsum(new) - 1
    long = np.bincount(run)[run] >= length
    return long & ~new


def flag_source(rows: pd.DataFrame, risk: float, stuck: int, max_volume: float) -> pd.DataFrame:
    """Flags of one source; `rows`: ticker, date, close, volume, one row a date."""
    rows = rows.sort_values("date")
    weekday = pd.to_datetime(rows.date).dt.weekday.to_numpy()
    close, volume, date = rows.close.to_numpy(float), rows.volume.to_numpy(float), rows.date.to_numpy()
    out: list[pd.DataFrame] = []

    def found(at: np.ndarray, field: str, rule: str, values: np.ndarray, departure=None, cutoff=np.nan) -> None:
        if len(at):
            out.append(pd.DataFrame({"ticker": rows.ticker.iloc[0], "date": date[at], "field": field, "rule": rule, "value": values[at],
                                     "departure": np.nan if departure is None else departure, "cutoff": cutoff}))

    with np.errstate(all="ignore"):
        bad = np.isinf(close) | (close <= 0)
        found(np.flatnonzero(bad), "close", "impossible", close)
        at = np.flatnonzero(~bad & ~np.isnan(close))
        hit, dep, cut, fitted = _spikes(_weekday_free(np.log(close[at]), weekday[at]), risk, LONGEST["close"])
        surge, sold = np.zeros(len(close), bool), np.flatnonzero((volume > 0) & (volume <= max_volume))
        surge[sold] = _surges(_weekday_free(np.log(volume[sold]), weekday[sold]))
        hit = _unexplained(hit, dep, cut, surge[at] & np.r_[True, ~hit[:-1]][: len(hit)])
        found(at[hit], "close", "spike" if fitted else "spike of a quiet source", close, dep[hit], cut)
        moved = np.zeros(len(close), bool)
        clean = at[~hit]
        moved[clean[1:]] = np.abs(np.diff(np.log(close[clean]))) > MOVED * _scale(np.log(close[clean]))
        found(at[_stuck(close[at], volume[at] > 0, stuck)], "close", "stuck", close)

        bad = (volume < 0) | (volume > max_volume)
        found(np.flatnonzero(bad), "volume", "impossible", volume)
        at = np.flatnonzero(~bad & (volume > 0))
        hit, dep, cut, fitted = _spikes(_weekday_free(np.log(volume[at]), weekday[at]), risk, LONGEST["volume"])
        hit = _unexplained(hit, dep, cut, moved[at] & (dep > 0))
        found(at[hit], "volume", "spike" if fitted else "spike of a quiet source", volume, dep[hit], cut)
        # Readings without volume between equal ones break a run.
        found(np.flatnonzero(_stuck(np.nan_to_num(volume, nan=-1.0), volume > 0, stuck)), "volume", "stuck", volume)
    return pd.concat(out).drop_duplicates(["date", "field"]) if out else pd.DataFrame(columns=["ticker", "date", "field", "rule", "value", "departure", "cutoff"])


def implausible_readings(rows: DataFrame, risk: float = 1e-4, stuck: int = 6, max_volume: float = 1e12) -> DataFrame:
    """`ticker, date, field, rule, value, departure, cutoff` of implausible readings.

    `rule` is impossible, spike, spike of a quiet source (the cutoff is QUIET, not the tail's) or stuck.
    `rows`: `ticker, date, close, volume`, at most one row per ticker and date
    (see `last_prices`), so that one task's source has no more rows than the
    calendar has days. Missing values are no readings; rows without date or
    ticker must be left out before; a source of fewer than 30 readings gets no
    spikes, only the other rules; empty input gives no rows.
    """

    def flag(part: pd.DataFrame) -> pd.DataFrame:
        return flag_source(part, risk, stuck, max_volume)

    # The cost is Python time per reading, so tasks aren't merged by their few bytes.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("ticker", "date", "close", "volume").repartition(n, "ticker").groupBy("ticker").applyInPandas(flag, SCHEMA)
