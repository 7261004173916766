import datetime as dt
import random

import numpy as np

from tidemark.operators.spikes import fit_tail, flag_source, implausible_readings, tail_cutoff

D0 = dt.date(2020, 1, 1)
SCHEMA = "ticker string, date date, close double, volume double, field string, cutoff double"


def series(n=400, seed=1, t="A"):
    rng = random.Random(seed)
    p, out = 50.0, []
    for i in range(n):
        p *= 1 + rng.gauss(0, 0.01)
        out.append([t, D0 + dt.timedelta(days=i), round(p, 4), float(int(1e6 * np.exp(rng.gauss(0, 0.3)))), "x", 0.0])
    return out


def run(spark, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return {(r.ticker, (r.date - D0).days, r.field): r.rule.split()[0] for r in implausible_readings(df).collect()}


def test_spikes_impossible_and_stuck(spark):
    rows = series()
    rows[50][2] *= 10
    rows[100][2] *= 0.6
    rows[101][2] *= 0.6
    rows[150][2] = -3.0
    rows[151][2] = 0.0
    rows[170][2] = float("inf")
    rows[200][3] *= 1000
    for i in (220, 221, 222, 223):
        rows[i][3] /= 1000
    rows[230][3] = -5.0
    for i in range(300, 307):
        rows[i][2] = rows[299][2]
    for i in range(320, 326):
        rows[i][2], rows[i][3] = rows[319][2], 0.0
    got = run(spark, rows)
    want = {("A", 50, "close"): "spike", ("A", 100, "close"): "spike", ("A", 101, "close"): "spike", ("A", 150, "close"): "impossible", ("A", 151, "close"): "impossible",
            ("A", 170, "close"): "impossible", ("A", 200, "volume"): "spike", ("A", 230, "volume"): "impossible", **{("A", i, "volume"): "spike" for i in range(220, 224)},
            **{("A", i, "close"): "stuck" for i in range(300, 307)}}
    assert got == want


def test_genuine_moves_are_kept(spark):
    rows = series(seed=4)
    for i in range(100, 400):
        rows[i][2] *= 0.7  # a crash that stays
    for k, f in enumerate((1.5, 1.4, 1.3, 1.2, 1.1)):
        rows[200 + k][2] *= f  # a squeeze that fades
    for k, f in ((-1, 3), (0, 9), (1, 4), (2, 2)):
        rows[300 + k][3] *= f  # builds up and ebbs
    for k in range(3):
        rows[250 + k][2] *= 0.8  # a crash that was traded, and bought back
    rows[250][3] = 1.5e7
    rows[350][3] = 0.0
    rows[351][3] = None
    assert run(spark, rows) == {}


def test_defined_cases(spark):
    assert run(spark, []) == {}
    short = series(10, t="S")
    short[5][2] = -1.0
    none = [["N", D0, None, None, "x", 0.0], ["N", D0 + dt.timedelta(days=1), float("nan"), float("nan"), "x", 0.0]]
    assert run(spark, short + none) == {("S", 5, "close"): "impossible"}


def test_tail_cutoff_follows_the_tail():
    rng = np.random.default_rng(0)
    x = rng.exponential(1.0, 200_000)
    assert abs(tail_cutoff(x, 1e-4) - np.log(1e4)) < 0.5
    spoiled = np.concatenate([x, np.full(400, 500.0)])
    assert tail_cutoff(spoiled, 1e-4, robust=True) < 13
    assert tail_cutoff(x[:10], 1e-4) == np.inf and tail_cutoff(np.zeros(100), 1e-4) == np.inf


def test_shape_is_free_and_pooled_where_excesses_are_few():
    rng = np.random.default_rng(1)
    for xi in (-0.3, 0.0, 0.3):
        x = (rng.uniform(size=50_000) ** -xi - 1) / xi if xi else rng.exponential(size=50_000)
        got, scale = fit_tail(x)
        assert abs(got - xi) < 0.02 and abs(scale - 1) < 0.03
        assert abs(fit_tail(x[:10])[0] - 0.1) < 0.06


def test_long_unit_errors_of_volume(spark):
    rows = series(seed=7)
    for i in range(120, 129):
        rows[i][3] = float(int(rows[i][3] / 1000))
    assert run(spark, rows) == {("A", i, "volume"): "spike" for i in range(120, 129)}


def test_rows_in_any_order():
    import pandas as pd

    rows = series()
    rows[50][2] *= 10
    df = pd.DataFrame(rows, columns=["ticker", "date", "close", "volume", "field", "cutoff"])
    a = flag_source(df, 1e-4, 6, 1e12)
    b = flag_source(df.sample(frac=1, random_state=2), 1e-4, 6, 1e12)
    assert a["date"].tolist() == b["date"].tolist() == [D0 + dt.timedelta(days=50)]


def test_own_spikes_do_not_hide_a_plain_one():
    import pandas as pd

    rows = series(seed=3)
    own = [*range(20, 380, 20)]
    for i in own:
        rows[i][2] *= 2.0
    rows[210][2] *= 1.25
    df = pd.DataFrame(rows, columns=["ticker", "date", "close", "volume", "field", "cutoff"])
    got = flag_source(df, 1e-4, 6, 1e12)
    assert {(d - D0).days for d in got["date"]} == {*own, 210} and set(got["field"]) == {"close"}
