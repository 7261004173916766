import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators.deliveries import last_prices
from tidemark.operators.regular_grid import regular_grid, session_readings

D0 = dt.date(2024, 1, 1)  # a Monday


def calendar(spark, n):
    days = [D0 + dt.timedelta(days=i) for i in range(n * 2) if (D0 + dt.timedelta(days=i)).weekday() < 5][:n]
    return spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, pos int"), days


def slopes(x, y):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    if n == 2:
        return np.array([d[0], d[0]])
    m = np.zeros(n)
    for k in range(1, n - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])

    def edge(h0, h1, d0, d1):
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(v) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v

    m[0], m[-1] = edge(h[0], h[1], d[0], d[1]), edge(h[-1], h[-2], d[-1], d[-2])
    return m


def brute(rows, max_gap):
    """rows: {pos: y or None} -> {pos: (y, status)}."""
    have = sorted(p for p, y in rows.items() if y is not None)
    out = {p: (None, "marked") for p in range(min(rows), max(rows) + 1)}
    segments, seg = [], []
    for p in have:
        if seg and p - seg[-1] > max_gap + 1:
            segments.append(seg)
            seg = []
        seg.append(p)
    segments += [seg] if seg else []
    for seg in segments:
        x, y = np.array(seg, float), np.array([rows[p] for p in seg])
        m = slopes(x, y) if len(seg) > 1 else None
        for i, p in enumerate(seg):
            out[p] = (rows[p], "observed")
            if i + 1 < len(seg):
                h = x[i + 1] - x[i]
                for q in range(p + 1, seg[i + 1]):
                    t = (q - p) / h
                    v = y[i] * (1 + 2 * t) * (1 - t) ** 2 + h * m[i] * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + h * m[i + 1] * t * t * (t - 1)
                    out[q] = (v, "filled")
    return out


@pytest.mark.parametrize("shard", [4, 64])
def test_against_brute_force(spark, shard):
    cal, _ = calendar(spark, 200)
    rng = random.Random(1)
    data = {}
    for t, keep in (("HOT", 0.8), ("A", 0.5), ("B", 0.1), ("C", 0.02)):
        data[t] = {p: (None if rng.random() < 0.1 else round(rng.uniform(1, 9), 3)) for p in range(200) if rng.random() < keep} or {5: 1.0}
    readings = spark.createDataFrame([(t, p, y) for t, d in data.items() for p, y in d.items()], "ticker string, pos int, y double")
    got = {(r.ticker, r.pos): (r.y, r.status) for r in regular_grid(readings, cal, max_gap=6, shard=shard).collect()}
    want = {(t, p): v for t, d in data.items() for p, v in brute(d, 6).items()}
    assert got.keys() == want.keys()
    for k, (y, status) in want.items():
        assert got[k][1] == status
        assert (got[k][0] is None) == (y is None) and (y is None or got[k][0] == pytest.approx(y, abs=1e-9))


def test_fill_stays_between_its_readings(spark):
    cal, _ = calendar(spark, 30)
    readings = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 1.1), ("A", 5, 9.0), ("A", 6, 9.0)], "ticker string, pos int, y double")
    filled = [r.y for r in regular_grid(readings, cal).where("status = 'filled'").orderBy("pos").collect()]
    assert filled == sorted(filled) and 1.1 <= filled[0] and filled[-1] <= 9.0


def test_sessions_resends_and_missing(spark):
    cal, days = calendar(spark, 10)
    at = lambda h: dt.datetime(2024, 2, 1) + dt.timedelta(hours=h)
    sat = days[4] + dt.timedelta(days=1)
    rows = [
        (days[0], " ab.c", 1.0, 1, at(0)), (days[0], "AB-C", 2.0, 2, at(5)), (days[0], "AB-C", 2.0, 2, at(5)), (days[1], "AB-C", float("nan"), 1, at(0)),
        (sat, "AB-C", 7.0, 1, at(0)), (days[6], "AB-C", 0.0, 1, at(0)), (days[7], "AB-C", None, 1, at(0)),
        (None, "AB-C", 1.0, 1, at(0)), (days[0], None, 1.0, 1, at(0)), (days[9], "nan", 1.0, 1, at(0)), (days[2], "EMPTY", None, 1, None),
        (D0 - dt.timedelta(days=9), "EARLY", 1.0, 1, at(0)),
    ]
    prices = spark.createDataFrame([(*r, 1, "z") for r in rows], "date date, ticker string, close double, batch_id bigint, loaded_at timestamp, pos int, y string")
    readings = session_readings(last_prices(prices, "close"), cal, "close")
    got = {(r.ticker, r.pos): (r.status, r.y) for r in regular_grid(readings, cal).collect()}
    assert {p: s for (t, p), (s, _) in got.items() if t == "AB-C"} == {0: "observed", 1: "filled", 2: "filled", 3: "filled", 4: "observed", 5: "filled", 6: "observed", 7: "marked"}
    assert got[("AB-C", 0)][1] == 2.0 and got[("AB-C", 4)][1] == 7.0 and got[("AB-C", 6)][1] == 0.0
    assert {p: s for (t, p), (s, _) in got.items() if t == "EMPTY"} == {2: "marked"}
    assert not [k for k in got if k[0] not in ("AB-C", "EMPTY")]


def test_empty(spark):
    cal, _ = calendar(spark, 5)
    assert regular_grid(spark.createDataFrame([], "ticker string, pos int, y double"), cal).count() == 0
