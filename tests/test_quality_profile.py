import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality_profile import ValueCountStore, damaged_columns, decimals, profile, value_counts

COLS = ["a", "b", "s", "n", "value"]
SCHEMA = "load_id bigint, a double, b double, s string, n int, value string, column_name string"


def rows(load, n, seed, damage=None):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        r = [rng.gauss(0, 1), None if rng.random() < 0.2 else round(rng.uniform(1, 9), 4), rng.choice(["Energy", "Real Estate", "Materials"]), rng.randrange(10**6), f"V{rng.randrange(400)}"]
        if damage:
            damage(r, rng)
        out.append((load, *r, "x"))
    return out


def test_counts_deltas_and_profile(spark):
    df = spark.createDataFrame([(1, 1.0, None, " ", 3, "q", "x"), (1, float("nan"), 2.0, "A", None, "q", "x"), (1, 1.0, 2.0, "B", 4, "q", "x")], SCHEMA)
    counts = value_counts(df, COLS, "load_id")
    p = {r.column_name: r for r in profile(counts, ["load_id"]).collect()}
    assert (p["a"].n_missing, p["a"].n_distinct, p["a"].min_number, p["a"].top_count) == (1, 1, 1.0, 2)
    assert (p["s"].n_missing, p["s"].n_distinct) == (1, 2) and math.isclose(p["s"].entropy, 1.0)
    assert p["n"].max_number == 4.0 and p["value"].entropy == 0.0
    assert p["b"].n_missing == 1


def key(df):
    return sorted((r.column_name, r.x if r.x is not None else math.inf, r.value or "", r.n) for r in df.select("column_name", "x", "value", "n").collect())


def test_store_is_reopened_and_applies_a_load_once(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    loads = {k: spark.createDataFrame(rows(k, 40 + k, k), SCHEMA) for k in (1, 2, 3)}
    store = ValueCountStore(spark, "load_id", folder)
    assert store.version == 0 and store.apply(loads[1], COLS) == ["1"] and store.apply(loads[1], COLS) == []
    again = ValueCountStore(spark, "load_id", folder)
    assert again.version == 1 and again.loads == ["1"]
    assert again.apply(loads[1].unionByName(loads[2]), COLS) == ["2"]
    assert key(again.counts()) == key(value_counts(loads[1].unionByName(loads[2]), COLS, "load_id").groupBy("column_name", "x", "value").agg(F.sum("n").alias("n")))
    with pytest.raises(Exception, match="(?i)exist"):
        store.apply(loads[3], COLS)  # it still stands at version 1, which another writer has gone beyond
    assert ValueCountStore(spark, "load_id", folder).loads == ["1", "2"]


def test_store_takes_loads_back_and_compacts(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    one, two = (spark.createDataFrame(rows(k, 50, k), SCHEMA) for k in (1, 2))
    store = ValueCountStore(spark, "load_id", folder)
    store.apply(one, COLS)
    want = key(store.counts())
    store.apply(two, COLS)
    assert store.retract([2, 7]) == ["2"] and store.retract([2]) == [] and key(store.counts()) == want
    by_load = lambda s: sorted(map(tuple, profile(s.deltas(), ["load_id"]).select("load_id", "column_name", "n_rows", "n_distinct", F.round("entropy", 9)).collect()))
    before = by_load(store)
    store.compact()
    assert len(list((tmp_path / "store/batches").glob("[0-9a-f]*"))) == 1 and len(list((tmp_path / "store/manifests").glob("*.json"))) == 1
    opened = ValueCountStore(spark, "load_id", folder)
    assert opened.loads == ["1"] and by_load(opened) == before and key(opened.counts()) == want
    assert opened.apply(two, COLS) == ["2"]


def test_decimals_of_numbers(spark):
    x = [3.0, -2.5, 0.25, 1e-3, 123456.7, 1 / 3, 1e15, 1e-9, None]
    assert [r.d for r in spark.createDataFrame([(v,) for v in x], "x double").select(decimals(F.col("x")).alias("d")).collect()] == [0, 1, 2, 3, 1, 6, 0, 6, None]


def found(spark, data):
    store = ValueCountStore(spark, "load_id")
    store.apply(spark.createDataFrame(data, SCHEMA), COLS)
    return {(r.load_id, r.column_name): set(r.reasons) for r in damaged_columns(store.deltas(), "load_id").collect()}


def test_finds_each_damage_and_nothing_else(spark):
    def put(i, f):
        return lambda r, rng: r.__setitem__(i, f(r[i], rng))

    damages = {
        3: put(0, lambda v, g: None if g.random() < 0.4 else v), 4: put(0, lambda v, g: -999.0 if g.random() < 0.3 else v), 5: put(0, lambda v, g: v * 100),
        6: put(0, lambda v, g: float(round(v))), 7: put(1, lambda v, g: v and -v), 8: put(2, lambda v, g: v.upper() + "?"), 9: put(4, lambda v, g: "V1"),
    }
    got = found(spark, [r for load in range(1, 12) for r in rows(load, 300, load, damages.get(load))])
    assert set(got) == {(3, "a"), (4, "a"), (5, "a"), (6, "a"), (7, "b"), (8, "s"), (9, "value")}
    assert "missing" in got[(3, "a")] and "coded" in got[(4, "a")] and "distribution" in got[(5, "a")] and "form" in got[(8, "s")]


def test_no_or_one_load(spark):
    assert found(spark, []) == {}
    assert found(spark, rows(1, 100, 1)) == {}
    assert found(spark, [(None, *r[1:]) for r in rows(1, 30, 1)]) == {}
