"""The robustness grid: every specification's events and statistics in one job.

Specifications are a column. The panel is windowed once for all volatility windows;
candidates at the loosest threshold are exploded over the stricter ones and the
cooldowns (a parameter table of fixed size), folded per specification and
ticker, and every statistic is a conditional aggregate of one grouping.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import normal_two_sided
from tidemark.operators import episodes as ep
from tidemark.operators.inference import clustered_sums, with_t_interval

SPEC = ("z_threshold", "vol_window", "cooldown")


def grid_candidates(rows: DataFrame, windows: Sequence[int], thresholds: Sequence[float], cooldowns: Sequence[int]) -> DataFrame:
    """Candidates of all specifications; `rows`: those at the loosest threshold in any volatility window, with `z_<w>` of each."""
    scores = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"z_{w}").alias("z")) for w in windows])).alias("_x")
    keep = [c for c in rows.columns if c != "z" and c not in [f"z_{w}" for w in windows]]
    x = rows.select(*keep, scores).select(*keep, F.col("_x.w").alias("vol_window"), F.col("_x.z").alias("z"))
    x = x.withColumn("z_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("z <= z_threshold")
    return x.withColumn("cooldown", F.explode(F.array(*[F.lit(int(k)) for k in cooldowns])))


def long_by_horizon(events: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per event and horizon with a known `car`; quartile labels are of all the specification's events."""
    # One row per specification.
    edges = events.groupBy(*SPEC).agg(F.percentile("avol", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e"))
    x = events.join(F.broadcast(edges), list(SPEC)).withColumn("q1", F.col("avol") <= F.col("_e")[0]).withColumn("q4", F.col("avol") > F.col("_e")[2]).drop("_e")
    cars = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"car_{h}").alias("c")) for h in horizons])).alias("_x")
    keep = [c for c in x.columns if not c.startswith(("car_", "fwd_ret", "bench_ret", "close_"))]
    return x.select(*keep, cars).select(*keep, F.col("_x.h").alias("horizon"), F.col("_x.c").alias("car")).where("car IS NOT NULL")


def robustness_grid(events: DataFrame, horizons: Sequence[int], quantiles: Sequence[float], min_events: int, date: str = "event_date") -> DataFrame:
    """One row per specification, horizon and volatility quantile, without the regression columns."""
    cell = [*SPEC, "horizon"]
    long = long_by_horizon(events, horizons)
    base = with_t_interval(clustered_sums(long, "car", date, cell)).where(F.col("n") >= min_events)
    mean = lambda cond: F.avg(F.when(cond, F.col("car")))
    kind = lambda k: mean(F.col("crash_type") == k)
    plain = long.groupBy(*cell).agg(
        F.avg((F.col("car") > 0).cast("double")).alias("recovery_rate"), F.percentile("car", F.lit(0.5)).alias("median_car"),
        kind("broad_market").alias("mean_car_broad"), kind("sector").alias("mean_car_sector"), kind("idiosyncratic").alias("mean_car_idio"),
        mean(F.col("q4")).alias("mean_car_avol_q4"), mean(F.col("q1")).alias("mean_car_avol_q1"),
        F.percentile("vix", F.array(*map(F.lit, quantiles))).alias("cuts"),
    )
    # One row per cell of the grid and quantile.
    cuts = plain.select(*cell, F.posexplode("cuts").alias("i", "cut"))
    qs = F.array(*map(F.lit, quantiles))
    vix = long.join(F.broadcast(cuts), cell).groupBy(*cell, F.get(qs, F.col("i")).alias("vix_high_quantile")).agg(mean(F.col("vix") >= F.col("cut")).alias("mean_car_high_vix"), mean(F.col("vix") < F.col("cut")).alias("mean_car_low_vix"))
    x = base.join(plain.drop("cuts"), cell).join(vix, cell)
    return x.select(
        *cell, "vix_high_quantile", F.col("n").alias("n_events"), F.col("n_clusters").alias("n_dates"), F.col("mean").alias("mean_car"), F.col("se").alias("se_clustered"), "ci_lo", "ci_hi", "p_value",
        "recovery_rate", "median_car", "mean_car_broad", "mean_car_sector", "mean_car_idio", (F.col("mean_car_broad") - F.col("mean_car_idio")).alias("diff_broad_minus_idio"),
        "mean_car_avol_q4", "mean_car_avol_q1", (F.col("mean_car_avol_q4") - F.col("mean_car_avol_q1")).alias("diff_avol_q4_minus_q1"),
        "mean_car_high_vix", "mean_car_low_vix", (F.col("mean_car_high_vix") - F.col("mean_car_low_vix")).alias("diff_high_minus_low_vix"),
    )


def grid_means(events: DataFrame, horizons: Sequence[int], min_events: int) -> DataFrame:
    """`spec, horizon, mean_car, recovery_rate` of the cells of `robustness_grid`,
    one row each: what asks for no more than an event's `car_<h>`."""
    known = lambda h: F.nanvl(F.col(f"car_{h}").cast("double"), F.lit(None).cast("double"))
    cell = lambda h: F.struct(F.lit(h).alias("horizon"), F.count(known(h)).alias("n"), F.avg(known(h)).alias("mean_car"), F.avg((F.col(f"car_{h}") > 0).cast("double")).alias("recovery_rate"))
    x = events.groupBy(*SPEC).agg(F.array(*map(cell, horizons)).alias("_x")).select(*SPEC, F.explode("_x").alias("_x"))
    return x.where(F.col("_x.n") >= min_events).select(*SPEC, "_x.horizon", "_x.mean_car", "_x.recovery_rate")


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def grid_regressions(long: DataFrame, xs: Sequence[str], reported: Sequence[str], min_events: int) -> DataFrame:
    """`spec, horizon, ols_adj_r2, beta_x, p_x` (HC3) of one regression per cell
    with at least `min_events` outcomes: two aggregates for all cells together.
    Rows that miss a regressor are left out of the regression only; the driver
    solves one small system per cell, and cells without a solvable one have nulls."""
    cell = [*SPEC, "horizon"]
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in xs]
    d = long.where(reduce(Column.__and__, known))
    cols: list[Column] = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col("car")]
    k = len(xs) + 1
    used = reduce(Column.__and__, known)
    # One row per cell of the grid.
    grams = long.groupBy(*cell).agg(F.count(F.lit(1)).alias("outcomes"), *[F.sum(F.when(used, cols[i] * cols[j])).alias(f"g{i}_{j}") for i, j in _pairs(k + 1)]).where(F.col("outcomes") >= min_events).collect()
    solved, unsolved = [], []
    for r in grams:
        g = np.zeros((k + 1, k + 1))
        for i, j in _pairs(k + 1):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
        n = g[0, 0]
        size = np.sqrt(np.diag(g)[:k])
        if n <= k or (size == 0).any() or np.linalg.matrix_rank(g[:k, :k] / np.outer(size, size), tol=1e-10) < k:
            unsolved.append((*[r[c] for c in cell], None, *[None] * (2 * len(reported))))
            continue
        bread = np.linalg.inv(g[:k, :k])
        beta = bread @ g[:k, k]
        tss = g[k, k] - g[0, k] ** 2 / n
        r2 = 1 - (g[k, k] - beta @ g[:k, k]) / tss if tss > 0 else float("nan")
        solved.append((*[r[c] for c in cell], beta.tolist(), bread.ravel().tolist(), float(1 - (1 - r2) * (n - 1) / (n - k))))
    spark = long.sparkSession
    kinds = ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in cell)
    fits = spark.createDataFrame(solved, f"{kinds}, beta array<double>, bread array<double>, ols_adj_r2 double")
    x = d.join(F.broadcast(fits), cell)  # one row per cell of the grid
    e = F.col("car") - reduce(lambda a, b: a + b, [F.get("beta", F.lit(i)) * cols[i] for i in range(k)])
    h = reduce(lambda a, b: a + b, [F.get("bread", F.lit(i * k + j)) * cols[i] * cols[j] * (1 if i == j else 2) for i, j in _pairs(k)])
    w = F.pow(e / (1 - h), 2)
    meats = {tuple(r[c] for c in cell): r for r in x.withColumn("_w", w).groupBy(*cell).agg(*[F.sum(F.col("_w") * cols[i] * cols[j]).alias(f"m{i}_{j}") for i, j in _pairs(k)]).collect()}
    out = unsolved
    for *key, beta, bread, adj in solved:
        r, b = meats[tuple(key)], np.array(bread).reshape(k, k)
        m = np.zeros((k, k))
        for i, j in _pairs(k):
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        se = np.sqrt(np.diag(b @ m @ b))
        row = [*key, None if adj != adj else adj]
        for name in reported:
            i = xs.index(name) + 1
            p = float(normal_two_sided(beta[i] / se[i])) if se[i] > 0 else None
            row += [float(beta[i]), p]
        out.append(tuple(row))
    return spark.createDataFrame(out, f"{kinds}, ols_adj_r2 double, " + ", ".join(f"beta_{n} double, p_{n} double" for n in reported))


def grid_summary(grid: DataFrame, horizon: int) -> DataFrame:
    """One row over the distinct builds at `horizon`: range and median of the mean
    and of the recovery rate, shares of signs; of significant ones if there is a `p_value`."""
    one = grid.where(F.col("horizon") == horizon).dropDuplicates(list(SPEC))
    share = lambda c: F.avg(c.cast("double"))
    neg = F.col("mean_car") < 0
    sure = {"share_negative_significant": neg & (F.col("p_value") < 0.05), "share_positive_significant": ~neg & (F.col("mean_car") > 0) & (F.col("p_value") < 0.05)} if "p_value" in grid.columns else {}
    return one.agg(
        F.count(F.lit(1)).alias("n"), F.min("mean_car").alias("min_mean"), F.max("mean_car").alias("max_mean"), F.percentile("mean_car", F.lit(0.5)).alias("median_mean"),
        share(neg).alias("share_negative"), *[share(c).alias(k) for k, c in sure.items()],
        F.min("recovery_rate").alias("min_recovery"), F.max("recovery_rate").alias("max_recovery"), F.percentile("recovery_rate", F.lit(0.5)).alias("median_recovery"), share(F.col("recovery_rate") < 0.5).alias("share_below_half"),
    )


def sign_consistency(grid: DataFrame) -> DataFrame:
    """Shares of all cells whose contrasts have the usual sign; an unknown contrast has none."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return grid.agg(share(F.col("diff_avol_q4_minus_q1") > 0).alias("avol_effect"), share(F.col("diff_broad_minus_idio") < 0).alias("broad_vs_idio"))
