import datetime as dt
import random

from tidemark.operators.intervals import periods_and_gaps

D0 = dt.date(2020, 1, 1)
OPEN = dt.date(9999, 12, 31)
SCHEMA = "ticker string, start date, end date, k int, d string, kind string"


def day(n):
    return D0 + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(t, s, e, 1, "x", "y") for t, s, e in rows], SCHEMA)


def run(spark, rows):
    return sorted(tuple(r) for r in periods_and_gaps(frame(spark, rows), "ticker", "start", "end").collect())


def brute(rows):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        ws = sorted((s, e or OPEN) for t, s, e in rows if t == key and s is not None and s < (e or OPEN))
        merged = []
        for s, e in ws:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)]
    return sorted(out)


def test_touching_nested_gap_open(spark):
    rows = [("A", day(0), day(5)), ("A", day(5), day(7)), ("A", day(1), day(2)), ("A", day(9), None), ("A", day(20), OPEN)]
    assert run(spark, rows) == sorted([("A", "period", day(0), day(7)), ("A", "gap", day(7), day(9)), ("A", "period", day(9), OPEN)])


def test_defined_cases(spark):
    assert run(spark, []) == []
    rows = [(None, day(0), day(1)), ("A", None, day(4)), ("A", day(3), day(3)), ("A", day(4), day(2)), ("B", day(0), day(1)), ("B", day(0), day(1))]
    assert run(spark, rows) == [("B", "period", day(0), day(1))]


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        t = "HOT" if rng.random() < 0.4 else f"T{rng.randrange(60)}"
        s = rng.randrange(2000)
        rows.append((t, day(s), None if rng.random() < 0.02 else day(s + rng.randrange(-2, 30))))
    assert run(spark, rows) == brute(rows)
