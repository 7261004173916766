import datetime as dt
import random

from tidemark.operators import history
from tidemark.operators.membership_history import status_history

SCHEMA = "change_id bigint, date date, added string, removed string, loaded_at timestamp, k string, t int, v string"
D0 = dt.date(2010, 1, 1)
OPEN, FLOOR = dt.date(9999, 12, 31), dt.date(2005, 6, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def at(n):
    return dt.datetime(2011, 1, 1) + dt.timedelta(hours=n)


def run(spark, rows):
    log = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in status_history(log).collect())


def test_versions_resends_and_first_removal(spark):
    rows = [
        (1, day(0), "aa.b ", None, at(1)), (1, day(3), "AA-B", "nan", at(2)),  # corrected
        (2, day(9), " ", "AA-B", at(3)), (2, day(9), " ", "AA-B", at(3)),
        (3, day(12), None, "aa-b", at(4)),  # states what holds
        (4, day(5), None, "CC", at(1)), (5, None, "DD", None, at(1)), (6, day(1), "NaN", "", at(1)),
    ]
    assert run(spark, rows) == sorted([
        ("AA-B", "member", day(3), day(9)), ("AA-B", "out", day(9), OPEN), ("CC", "member", FLOOR, day(5)), ("CC", "out", day(5), OPEN),
    ])


def test_same_day_and_missing_parts(spark):
    assert run(spark, []) == []
    # Later load wins a day, then the addition; a row without id stands for itself; no load time counts as oldest.
    rows = [(1, day(1), "A", None, at(1)), (2, day(1), None, "A", at(2)), (3, day(1), "B", "B", at(1)), (None, day(2), "C", None, None), (None, day(4), None, "C", None),
            (9, day(1), "E", None, None), (9, day(2), "E", None, at(0))]
    assert run(spark, rows) == sorted([
        ("A", "member", FLOOR, day(1)), ("A", "out", day(1), OPEN), ("B", "member", day(1), OPEN), ("C", "member", day(2), day(4)), ("C", "out", day(4), OPEN), ("E", "member", day(2), OPEN),
    ])


def test_entry_before_the_floor_day(spark):
    assert run(spark, [(1, FLOOR, None, "A", at(1))]) == [("A", "out", FLOOR, OPEN)]


def test_block_merge_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK_ROWS", 3)  # many blocks a stream
    rng = random.Random(5)
    streams, everything = [], []
    for s in range(3):
        rows = {("HOT" if rng.random() < 0.4 else f"T{rng.randrange(30)}", rng.randrange(300)): (rng.randrange(5), rng.choice(["a", "b", "c", None])) for _ in range(400)}
        rows = [(k, t, o, v) for (k, t), (o, v) in rows.items()]
        everything += [(k, t, o, s, v) for k, t, o, v in rows]
        streams.append(spark.createDataFrame(rows, "k string, t long, o long, v string"))
    got = sorted(((r.k, r.valid_from, r.valid_to, r.v) for r in history.version_history(streams, 1000, partitions=3).collect()))
    want = []
    for key in {r[0] for r in everything}:
        last = {}
        for _, t, o, s, v in sorted(x for x in everything if x[0] == key for x in [(x[0], x[1], x[2], x[3], x[4] or "")]):
            last[t] = v or None
        held = since = None
        for t in sorted(last):
            if last[t] != held:
                if held is not None:
                    want.append((key, since, t, held))
                held, since = last[t], t
        if held is not None:
            want.append((key, since, 1000, held))
    assert got == sorted(want)
