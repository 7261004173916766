"""Queries of inference, evaluation, the grid and the tables behind the figures."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators import evaluation as va
from tidemark.operators import grid as gr
from tidemark.operators import inference as inf
from tidemark.operators import models as ml
from tidemark.operators import panel as pn
from tidemark.operators import splits as sp
from tidemark.plans import regression_sql as rq
from tidemark.plans.study import Study
from tidemark.plans.study_sql import grid_chain
from tidemark.plans.study_queries import CONFIG, HORIZONS, QUERIES, SQL, H, day, query, r6, s6
from tidemark.session import written

__all__ = ["QUERIES", "SQL"]

CAR, REC = f"car_{H}", f"recovered_{H}d"
PRIMARY = ("crash_z", "avol", "mom_20", "rv_20", "spy_ret_event", "vix")
#: A forecast that both engines compute alike.
SCORE = "1 / (1 + exp(-(crash_z + 4) / 2))"
SEED = CONFIG.get("study.seed")


def done(s: Study) -> DataFrame:
    """Events with a known primary outcome, and the fixed forecast."""
    return s.events().where(f"complete_{H}").withColumn("score", F.round(F.expr(SCORE), 6))


_DONE = f", dn AS (SELECT *, round({SCORE}, 6) score FROM ev WHERE complete_{H})\n"


# --- group tables --------------------------------------------------------------

@query(f"SELECT grp \"group\", count({CAR}) n, round(avg({CAR}), 6) mean_car, round(median({CAR}), 6) median_car, round(avg({REC}), 6) recovery_rate, round(avg(regained_precrash_{H}), 6) regained_rate FROM grp GROUP BY grp")
def group_means(s: Study) -> DataFrame:
    g = inf.with_groups(s.events())
    return g.groupBy(F.col("grp").alias("group")).agg(
        F.count(CAR).alias("n"), F.round(F.avg(CAR), 6).alias("mean_car"), F.round(F.percentile(CAR, F.lit(0.5)), 6).alias("median_car"),
        F.round(F.avg(REC), 6).alias("recovery_rate"), F.round(F.avg(f"regained_precrash_{H}"), 6).alias("regained_rate"))


@query(""", full_ AS (SELECT event_id FROM path GROUP BY event_id HAVING count(car) = 61)
SELECT g.grp "group", p.tau, count(*) n_events, round(avg(p.car), 6) mean_car FROM path p JOIN full_ USING (event_id) JOIN (SELECT event_id, grp FROM grp) g USING (event_id) GROUP BY 1, 2""")
def path_means(s: Study) -> DataFrame:
    p = s.paths()
    whole = p.groupBy("event_id").agg(F.collect_list(F.struct("tau", "car")).alias("x"), F.count("car").alias("n")).where(F.col("n") == CONFIG.get("outcomes.max_tau") + 1)  # 61 steps an event
    g = inf.with_groups(s.events()).select("event_id", "grp")
    x = whole.join(g, "event_id").select("grp", F.explode("x").alias("x"))
    return x.groupBy(F.col("grp").alias("group"), F.col("x.tau").alias("tau")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("x.car"), 6).alias("mean_car"))


@query("SELECT h horizon, count(c) n, round(avg(c), 6) mean FROM (SELECT " + f"unnest({list(HORIZONS)}) h, unnest([{', '.join(f'car_{h}' for h in HORIZONS)}]) c FROM ev) GROUP BY h")
def horizon_term_structure(s: Study) -> DataFrame:
    x = s.outcomes().unpivot(["event_id"], [f"car_{h}" for h in HORIZONS], "h", "c")
    return x.groupBy(F.regexp_extract("h", r"(\d+)", 1).cast("int").alias("horizon")).agg(F.count("c").alias("n"), F.round(F.avg("c"), 6).alias("mean"))


_PAIRS = ", ".join(f"('{h}', '{a}', '{b}')" for h, a, b in inf.CONTRASTS)


@query(f""", gm AS (SELECT grp, count({CAR}) n, avg({CAR}) m, avg({REC}) r FROM grp GROUP BY grp)
SELECT h hypothesis, ga group_a, gb group_b, a.n n_a, b.n n_b, round(a.m - b.m, 6) diff, round(a.r - b.r, 6) recovery_rate_diff
FROM (VALUES {_PAIRS}) t(h, ga, gb) JOIN gm a ON a.grp = ga JOIN gm b ON b.grp = gb""")
def contrasts_means(s: Study) -> DataFrame:
    g = inf.with_groups(s.events()).groupBy("grp").agg(F.count(CAR).alias("n"), F.avg(CAR).alias("m"), F.avg(REC).alias("r"))
    pairs = s.spark.createDataFrame(list(inf.CONTRASTS), "hypothesis string, group_a string, group_b string")
    side = lambda k: g.select(F.col("grp").alias(f"group_{k}"), F.col("n").alias(f"n_{k}"), F.col("m").alias(f"m_{k}"), F.col("r").alias(f"r_{k}"))
    x = pairs.join(side("a"), "group_a").join(side("b"), "group_b")
    return x.select("hypothesis", "group_a", "group_b", "n_a", "n_b", F.round(F.col("m_a") - F.col("m_b"), 6).alias("diff"), F.round(F.col("r_a") - F.col("r_b"), 6).alias("recovery_rate_diff"))


_KINDS = ("broad_market", "sector", "idiosyncratic", "unclassified")


@query("SELECT count(*) n_events, count(DISTINCT ticker) n_tickers, count(DISTINCT d) n_dates, strftime(min(d), '%Y-%m-%d') first_date, strftime(max(d), '%Y-%m-%d') last_date, "
       + f"count(CASE WHEN complete_{H} THEN 1 END) n_complete, " + ", ".join(f"count(CASE WHEN crash_type = '{k}' THEN 1 END) n_{k}" for k in _KINDS)
       + ", round(100.0 * count(sector) / count(*), 1) sector_known_pct, round(avg(crash_z), 6) mean_crash_z, round(avg(raw_return), 6) mean_return, "
       + ", ".join(f"round(100.0 * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*), 2) {c}_missing_pct" for c in ep.FEATURES) + " FROM e3")
def construction_summary(s: Study) -> DataFrame:
    pct = lambda c: F.round(100 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1)), 2).alias(f"{c}_missing_pct")
    return s.features().agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("event_date").alias("n_dates"), day(F.min("event_date"), "first_date"), day(F.max("event_date"), "last_date"),
        F.count_if(f"complete_{H}").alias("n_complete"), *[F.count_if(F.col("crash_type") == k).alias(f"n_{k}") for k in _KINDS],
        F.round(100 * F.count("sector") / F.count(F.lit(1)), 1).alias("sector_known_pct"), F.round(F.avg("crash_z"), 6).alias("mean_crash_z"), F.round(F.avg("raw_return"), 6).alias("mean_return"), *map(pct, ep.FEATURES))


_DESCRIBED = ("crash_z", "raw_return", "avol", "rv_20")


@query(", de AS (UNPIVOT (SELECT " + ", ".join(_DESCRIBED) + " FROM e3) ON " + ", ".join(_DESCRIBED) + " INTO NAME column_name VALUE v) SELECT column_name, count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, round(min(v), 6) min, "
       "round(quantile_cont(v, 0.25), 6) p25, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.75), 6) p75, round(max(v), 6) max FROM de GROUP BY column_name")
def describe_events(s: Study) -> DataFrame:
    x = s.features().unpivot(["event_id"], list(_DESCRIBED), "column_name", "v")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    t = x.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"))
    return t.select("column_name", "n", *r6("mean", "std", "min"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], *r6("max"))


@query("SELECT load_id, event_id, count(*) n FROM crash_events GROUP BY load_id, event_id HAVING count(*) > 1")
def duplicate_event_ids(s: Study) -> DataFrame:
    return s.table("crash_events").groupBy("load_id", "event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT mode, count(*) n FROM (SELECT CASE WHEN n > 1 THEN 'repeated' ELSE 'single' END mode FROM (SELECT event_id, count(*) n FROM e0 GROUP BY event_id)) GROUP BY mode")
def unique_event_ids(s: Study) -> DataFrame:
    ids = s.episodes(wide=False).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy(F.when(F.col("n") > 1, "repeated").otherwise("single").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


# --- multiple testing and errors ------------------------------------------------

_P = "SELECT event_id, round(least(1.0, exp(crash_z)), 9) p_value FROM e0"


@query(f""", ps AS ({_P}), rk AS (SELECT *, row_number() OVER (ORDER BY p_value) r, count(*) OVER () n FROM ps)
SELECT event_id, p_value, round(least(1.0, min(p_value * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) q_value FROM rk""")
def benjamini_hochberg(s: Study) -> DataFrame:
    p = s.episodes(wide=False).select("event_id", F.round(F.least(F.lit(1.0), F.exp("crash_z")), 9).alias("p_value"))
    return inf.benjamini_hochberg(p).select("event_id", "p_value", F.round("q_value", 9).alias("q_value"))


@query(f""", cl AS (SELECT d, sum({CAR}) s, count({CAR}) n FROM ev WHERE {CAR} IS NOT NULL GROUP BY d), t AS (SELECT sum(n) n, count(*) g, sum(s) / sum(n) m FROM cl)
SELECT t.n::BIGINT n, t.g n_clusters, round(t.m, 6) mean, round(sqrt(sum(power(s - t.m * cl.n, 2))) / t.n * sqrt(t.g / greatest(t.g - 1, 1)), 6) se FROM cl CROSS JOIN t GROUP BY t.n, t.g, t.m""")
def clustered_mean_se(s: Study) -> DataFrame:
    return inf.clustered_sums(s.events(), CAR, "event_date").select("n", "n_clusters", *r6("mean", "se"))


_CLUSTERED = f""", cl AS (SELECT d, sum({CAR}) s, count({CAR}) n FROM ev WHERE {CAR} IS NOT NULL GROUP BY d), t AS (SELECT sum(n) n, count(*) g, sum(s) / sum(n) m FROM cl),
ci AS (SELECT t.n::BIGINT n, t.g n_clusters, t.m mean, sqrt(sum(power(s - t.m * cl.n, 2))) / t.n * sqrt(t.g / greatest(t.g - 1, 1)) se FROM cl CROSS JOIN t GROUP BY t.n, t.g, t.m)
"""
_DF = "greatest(n_clusters - 1, 1)"


@query(_CLUSTERED + f"SELECT n, n_clusters, {s6('mean', 'se')}, round(mean - crit * se, 6) ci_lo, round(mean + crit * se, 6) ci_hi, round(mean / se, 6) t, round({rq.t_p('mean / se', _DF)}, 6) p_value FROM ({rq.t_quantile('ci', _DF)})")
def clustered_interval(s: Study) -> DataFrame:
    return inf.with_t_interval(inf.clustered_sums(s.events(), CAR, "event_date")).select("n", "n_clusters", *r6("mean", "se", "ci_lo", "ci_hi", "t", "p_value"))


_GRAM = [("1", "1"), ("crash_z", "crash_z"), ("crash_z", "vix"), ("vix", "vix"), ("crash_z", CAR), ("vix", CAR), (CAR, CAR)]


@query(_DONE + "SELECT unnest([" + ", ".join(f"'{a}*{b}'" for a, b in _GRAM) + "]) term, unnest([" + ", ".join(f"round(sum({a} * {b}), 6)::DOUBLE" for a, b in _GRAM) + "]) \"sum\" FROM dn WHERE crash_z IS NOT NULL AND vix IS NOT NULL")
def ols_gram(s: Study) -> DataFrame:
    names = ["crash_z", "vix", CAR]
    g = inf.gram(inf.listwise(done(s), names), names)
    at = {"1": 0, "crash_z": 1, "vix": 2, CAR: 3}
    return inf.as_frame(s.spark, pd.DataFrame([(f"{a}*{b}", round(float(g[at[a], at[b]]), 6)) for a, b in _GRAM], columns=["term", "sum"]))


@query(_DONE + f""", ln AS (SELECT count(*) n, avg(crash_z) mx, sum(power(crash_z, 2)) - count(*) * power(avg(crash_z), 2) sxx, regr_slope({CAR}, crash_z) b, regr_intercept({CAR}, crash_z) a FROM dn),
re AS (SELECT n, sxx, b, a, mx, crash_z x, ({CAR} - a - b * crash_z) / (1 - (1.0 / n + power(crash_z - mx, 2) / sxx)) u FROM dn CROSS JOIN ln)
SELECT any_value(n) n, round(any_value(a), 6) const, round(any_value(b), 6) slope, round(sqrt(sum(power(u * (1.0 / n - mx * (x - mx) / sxx), 2))), 6) se_const, round(sqrt(sum(power(u * (x - mx), 2))) / any_value(sxx), 6) se_slope FROM re""")
def ols_simple(s: Study) -> DataFrame:
    t, info = inf.ols_hc3(done(s), CAR, ["crash_z"])
    row = {"n": info["n"], "const": t["coef"][0], "slope": t["coef"][1], "se_const": t["se_hc3"][0], "se_slope": t["se_hc3"][1]}
    return inf.as_frame(s.spark, pd.DataFrame([row])).select("n", *r6("const", "slope", "se_const", "se_slope"))


_HC3 = ["coef", "std_coef", "se_hc3", "ci_lo", "ci_hi", "t", "p_value"]
_BY_DATE = ["se_cluster_date", "p_value_cluster", "ci_lo_cluster", "ci_hi_cluster"]


def _ols_sql(p: str, clustered: bool) -> str:
    z = inf.Z975
    out = f"round(beta, 6) coef, round(std, 6) std_coef, round(se, 6) se_hc3, round(beta - {z} * se, 6) ci_lo, round(beta + {z} * se, 6) ci_hi, round(beta / se, 6) t, round({rq.normal_p('beta / se')}, 6) p_value"
    if clustered:
        out += f", round(se_cluster, 6) se_cluster_date, round({rq.normal_p('beta / se_cluster')}, 6) p_value_cluster, round(beta - {z} * se_cluster, 6) ci_lo_cluster, round(beta + {z} * se_cluster, 6) ci_hi_cluster"
    return f"SELECT term, {out} FROM {p}_t"


@query(_DONE + rq.ols("o", "dn", CAR, PRIMARY) + _ols_sql("o", False))
def ols_hc3_table(s: Study) -> DataFrame:
    return inf.as_frame(s.spark, inf.ols_hc3(done(s), CAR, PRIMARY)[0]).select("term", *r6(*_HC3))


@query(_DONE + rq.ols("o", "dn", CAR, PRIMARY, cluster="d") + _ols_sql("o", True))
def ols_clustered_table(s: Study) -> DataFrame:
    return inf.as_frame(s.spark, inf.ols_hc3(done(s), CAR, PRIMARY, "event_date")[0]).select("term", *r6(*_HC3, *_BY_DATE))


_TYPES = ("type_broad_market", "type_sector")


@query(_DONE + ", dk AS (SELECT *, " + ", ".join(f"CASE WHEN crash_type = '{t[5:]}' THEN 1.0 ELSE 0.0 END {t}" for t in _TYPES) + " FROM dn)" + rq.ols("o", "dk", CAR, [*_TYPES, *PRIMARY], cluster="d") + _ols_sql("o", True))
def ols_crash_type(s: Study) -> DataFrame:
    x = done(s)
    for t in _TYPES:
        x = x.withColumn(t, F.when(F.col("crash_type") == t[5:], 1.0).otherwise(0.0))
    kept, _ = inf.drop_aliased(x, [*_TYPES, *PRIMARY])
    return inf.as_frame(s.spark, inf.ols_hc3(x, CAR, kept, "event_date")[0]).select("term", *r6(*_HC3, *_BY_DATE))


@query(_DONE + rq.logit("l", "dn", REC, PRIMARY, cluster="d") + f"SELECT term, round(beta, 6) coef_per_sd, round(exp(beta), 6) odds_ratio_per_sd, round(exp(beta - {inf.Z975} * se_cluster), 6) or_ci_lo, round(exp(beta + {inf.Z975} * se_cluster), 6) or_ci_hi, round(se_cluster, 6) se, round(beta / se_cluster, 6) z, round({rq.normal_p('beta / se_cluster')}, 6) p_value FROM l_t")
def logit_table(s: Study) -> DataFrame:
    t = inf.as_frame(s.spark, inf.logit_odds(done(s), REC, PRIMARY, "event_date")[0])
    return t.select("term", *r6("coef_per_sd", "odds_ratio_per_sd", "or_ci_lo", "or_ci_hi", "se", "z", "p_value"))


EXTENDED = [c for c in ep.FEATURES if c not in ("volume", "med_volume_60", "log_volume")]
#: What is left of them: a crash's decline is its return, its excess the return less the sector's.
INDEPENDENT = [c for c in EXTENDED if c not in ("abs_decline", "excess_vs_sector")]


@query(_DONE + rq.aliased("a", "dn", EXTENDED) + "SELECT term, kept FROM a_k")
def drop_aliased(s: Study) -> DataFrame:
    kept, dropped = inf.drop_aliased(done(s), EXTENDED)
    return s.spark.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "term string, kept boolean")


@query(_DONE + rq.ols("o", "dn", CAR, INDEPENDENT, cluster="d") + rq.logit("l", "dn", REC, INDEPENDENT, cluster="d") + f""",
fam AS (SELECT 'ols_extended' model, term, {rq.normal_p('beta / se_cluster')} p_value FROM o_t WHERE i > 1 UNION ALL SELECT 'logit_extended', term, {rq.normal_p('beta / se_cluster')} FROM l_t WHERE i > 1)
SELECT model, term, {s6('p_value', 'q_value')}, reject_fdr FROM ({rq.discoveries('fam')})""")
def fdr_family(s: Study) -> DataFrame:
    x = done(s)
    kept, _ = inf.drop_aliased(x, EXTENDED)
    ols, logit = inf.ols_hc3(x, CAR, kept, "event_date")[0], inf.logit_odds(x, REC, kept, "event_date")[0]
    fam = [("ols_extended", r.term, float(r.p_value_cluster)) for r in ols.itertuples() if r.term != "const"] + [("logit_extended", r.term, float(r.p_value)) for r in logit.itertuples() if r.term != "const"]
    return inf.benjamini_hochberg(s.spark.createDataFrame(fam, "model string, term string, p_value double")).select("model", "term", *r6("p_value", "q_value"), "reject_fdr")


# --- bootstrap -----------------------------------------------------------------

_KNOWN = f", kn AS (SELECT event_id, grp, {CAR} v FROM grp WHERE {CAR} IS NOT NULL)"
_RATES = f"count({CAR}) n, avg({CAR}) mean, avg({REC}) recovery_rate"


@query(_KNOWN + rq.weights("b", "kn", ["event_id"], SEED, ["grp", "v"]) + rq.intervals("b", "grp", "v") + f""",
fam AS (SELECT grp, n, mean, median, recovery_rate, lo, hi, p_value FROM (SELECT grp, {_RATES}, median({CAR}) median FROM grp GROUP BY grp) JOIN b_i USING (grp))
SELECT grp "group", n, {s6('mean', 'median', 'lo', 'hi', 'p_value', 'recovery_rate', 'q_value')}, reject_fdr FROM ({rq.discoveries('fam')})""")
def bootstrap_mean(s: Study) -> DataFrame:
    g = inf.with_groups(s.events())
    more = g.groupBy("grp").agg(F.percentile(CAR, F.lit(0.5)).alias("median"), F.avg(REC).alias("recovery_rate"))
    b = inf.benjamini_hochberg(inf.bootstrap_mean(g, "grp", ["event_id"], CAR, seed=SEED).join(more, "grp"))
    return b.select(F.col("grp").alias("group"), "n", *r6("mean", "median", "lo", "hi", "p_value", "recovery_rate", "q_value"), "reject_fdr")


@query(f", hz AS (SELECT event_id, unnest({list(HORIZONS)}) horizon, unnest([{', '.join(f'car_{h}' for h in HORIZONS)}]) v FROM ev), kn AS (SELECT * FROM hz WHERE v IS NOT NULL)"
       + rq.weights("b", "kn", ["event_id"], SEED, ["horizon", "v"]) + rq.intervals("b", "horizon", "v") + f"""
SELECT horizon, n, {s6('mean', 'lo', 'hi', 'p_value')} FROM (SELECT horizon, count(v) n, avg(v) mean FROM hz GROUP BY horizon) JOIN b_i USING (horizon)""")
def horizon_intervals(s: Study) -> DataFrame:
    x = s.outcomes().unpivot(["event_id"], [f"car_{h}" for h in HORIZONS], "h", "c").withColumn("horizon", F.regexp_extract("h", r"(\d+)", 1))
    return inf.bootstrap_mean(x, "horizon", ["event_id"], "c", seed=SEED).select(F.col("horizon").cast("int").alias("horizon"), "n", *r6("mean", "lo", "hi", "p_value"))


@query(_KNOWN + rq.weights("b", "kn", ["event_id", "grp"], SEED, ["grp", "v"]) + f""",
dr AS (SELECT grp, r, sum(w * v) / sum(w) m FROM b_w GROUP BY grp, r HAVING sum(w) > 0), gm AS (SELECT grp, {_RATES} FROM grp GROUP BY grp),
df AS (SELECT h, ga, gb, quantile_cont(a.m - b.m, 0.025) lo, quantile_cont(a.m - b.m, 0.975) hi, least(1.0, 2 * least(avg(CASE WHEN a.m <= b.m THEN 1.0 ELSE 0.0 END), avg(CASE WHEN a.m >= b.m THEN 1.0 ELSE 0.0 END))) p_value
  FROM (VALUES {_PAIRS}) t(h, ga, gb) JOIN dr a ON a.grp = ga JOIN dr b ON b.grp = gb AND b.r = a.r GROUP BY ALL),
fam AS (SELECT df.*, a.n n_a, b.n n_b, a.mean mean_a, b.mean mean_b, a.mean - b.mean diff, a.recovery_rate recovery_rate_a, b.recovery_rate recovery_rate_b, a.recovery_rate - b.recovery_rate recovery_rate_diff FROM df JOIN gm a ON a.grp = ga JOIN gm b ON b.grp = gb)
SELECT h hypothesis, ga group_a, gb group_b, n_a, n_b, {s6('mean_a', 'mean_b', 'diff', 'lo', 'hi', 'p_value', 'recovery_rate_a', 'recovery_rate_b', 'recovery_rate_diff', 'q_value')}, reject_fdr FROM ({rq.discoveries('fam')})""")
def bootstrap_diff(s: Study) -> DataFrame:
    g = inf.with_groups(s.events())
    rates = g.groupBy("grp").agg(F.count(CAR).alias("n"), F.avg(CAR).alias("mean"), F.avg(REC).alias("recovery_rate"))
    side = lambda k: rates.select(*[F.col(c).alias("group_" + k if c == "grp" else f"{c}_{k}") for c in rates.columns])
    d = inf.bootstrap_diff(g, "grp", ["event_id"], CAR, inf.CONTRASTS, seed=SEED).join(side("a"), "group_a").join(side("b"), "group_b")
    d = d.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("recovery_rate_diff", F.col("recovery_rate_a") - F.col("recovery_rate_b"))
    return inf.benjamini_hochberg(d).select("hypothesis", "group_a", "group_b", "n_a", "n_b", *r6("mean_a", "mean_b", "diff", "lo", "hi", "p_value", "recovery_rate_a", "recovery_rate_b", "recovery_rate_diff", "q_value"), "reject_fdr")


@query(""", fl AS (SELECT event_id FROM path GROUP BY event_id HAVING count(car) = 61), kn AS (SELECT event_id FROM fl)""" + rq.weights("b", "kn", ["event_id"], SEED, ["event_id"]) + f""",
pw AS (SELECT event_id, list(car ORDER BY tau) cars FROM path JOIN fl USING (event_id) GROUP BY event_id),
pm AS (SELECT grp, tau, sum(w * cars[tau + 1]) / sum(w) m FROM b_w JOIN pw USING (event_id) JOIN (SELECT event_id, grp FROM grp) USING (event_id) CROSS JOIN (SELECT unnest(range(0, 61)) tau) GROUP BY grp, tau, r HAVING sum(w) > 0)
SELECT grp "group", tau::INT tau, round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi FROM pm GROUP BY grp, tau""")
def bootstrap_path(s: Study) -> DataFrame:
    top = CONFIG.get("outcomes.max_tau")
    wide = s.paths().groupBy("event_id").pivot("tau", list(range(top + 1))).agg(F.first("car"))
    g = inf.with_groups(s.events()).select("event_id", "grp")
    named = wide.join(g, "event_id").select("grp", "event_id", *[F.col(str(t)).alias(f"t{t}") for t in range(top + 1)])
    return inf.bootstrap_path(named, "grp", ["event_id"], [f"t{t}" for t in range(top + 1)], seed=SEED).select(F.col("grp").alias("group"), "tau", *r6("lo", "hi"))


# --- splits and scores -----------------------------------------------------------

_SPLIT = f""", ct AS (SELECT max(CASE WHEN r = floor(n * 0.7::DOUBLE) THEN event_date END) c1, max(CASE WHEN r = floor(n * 0.85::DOUBLE) THEN event_date END) c2 FROM sp0),
spl AS (SELECT sp0.*, round({SCORE}, 6) score, CASE WHEN event_date < c1 - 29 THEN 'train' WHEN event_date >= c1 AND event_date < c2 - 29 THEN 'val' WHEN event_date >= c2 THEN 'test' ELSE 'embargo' END split FROM sp0 CROSS JOIN ct)
"""


@query(_SPLIT + "SELECT event_id, split FROM spl")
def chronological_split(s: Study) -> DataFrame:
    return sp.chronological_split(done(s), "event_date").select("event_id", "split")


def _folds(x: DataFrame) -> list[dict]:
    return sp.expanding_folds(x, "event_date", min_block=10, min_train_rows=20, min_test_rows=5)


@query(f""", ed AS (SELECT k, floor(s0 + (n - s0) * k / 5.0)::BIGINT lo, floor(s0 + (n - s0) * (k + 1) / 5.0)::BIGINT hi FROM (SELECT any_value(n) n, floor(any_value(n) * 0.4::DOUBLE) s0 FROM sp0) CROSS JOIN (SELECT unnest(range(0, 5)) k)),
fd AS (SELECT k, (SELECT event_date FROM sp0 WHERE r = lo) f, (SELECT event_date FROM sp0 WHERE r = hi - 1) t FROM ed WHERE hi - lo >= 10),
fn AS (SELECT k fold, f - 29 train_end, f test_start, t test_end, (SELECT count(*) FROM sp0 WHERE event_date < f - 29) n_train, (SELECT count(*) FROM sp0 WHERE event_date BETWEEN f AND t) n_test FROM fd)
SELECT fold, strftime(train_end, '%Y-%m-%d') train_end, strftime(test_start, '%Y-%m-%d') test_start, strftime(test_end, '%Y-%m-%d') test_end, n_train, n_test FROM fn WHERE n_train > 20 AND n_test > 5""")
def expanding_folds(s: Study) -> DataFrame:
    rows = [(f["fold"], str(f["train_end"]), str(f["test_start"]), str(f["test_end"]), f["n_train"], f["n_test"]) for f in _folds(done(s))]
    return s.spark.createDataFrame(rows, "fold bigint, train_end string, test_start string, test_end string, n_train bigint, n_test bigint")


_RANK = _DONE + f""", rr AS (SELECT {REC} y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 mid FROM dn),
th AS (SELECT score, sum(y) pos, count(*) n FROM rr GROUP BY score), cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) tp, sum(n) OVER (ORDER BY score DESC) k FROM th)
"""


@query(_RANK + "SELECT round((sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) roc_auc FROM rr")
def roc_auc(s: Study) -> DataFrame:
    return va.ranking_metrics(done(s), REC, "score").select(*r6("roc_auc"))


@query(_RANK + "SELECT round(sum(pos * tp / k) / sum(pos), 6) pr_auc FROM cu")
def average_precision(s: Study) -> DataFrame:
    return va.ranking_metrics(done(s), REC, "score").select(*r6("pr_auc"))


_POINT = f"avg(power(score - {REC}, 2)) b, avg({REC}) m"


@query(_DONE + f"SELECT round(avg(power(score - {REC}, 2)), 6) brier, round(avg(-({REC} * ln(greatest(score, 1e-9::DOUBLE)) + (1 - {REC}) * ln(greatest(1 - score, 1e-9::DOUBLE)))), 6) log_loss, round(avg(CASE WHEN (score >= 0.5) = ({REC} = 1) THEN 1.0 ELSE 0.0 END), 6) accuracy FROM dn")
def brier_logloss_accuracy(s: Study) -> DataFrame:
    return va.point_metrics(done(s), REC, "score").select(*r6("brier", "log_loss", "accuracy"))


@query(_DONE + f"SELECT round(1 - b / (m * (1 - m)), 6) brier_skill FROM (SELECT {_POINT} FROM dn)")
def brier_skill(s: Study) -> DataFrame:
    return va.point_metrics(done(s), REC, "score").select(F.round("brier_skill_vs_base_rate", 6).alias("brier_skill"))


@query(_DONE + f"""SELECT * EXCLUDE (w), round(sum(w) OVER () / sum(n) OVER (), 6) ece FROM (SELECT bin, count(*) n, round(avg(score) + 1e-9, 6) mean_pred, round(avg({REC}), 6) observed_freq, count(*) * abs(avg(score) - avg({REC})) w
FROM (SELECT *, least(len(list_filter(e[2:-2], lambda x: x < score)), len(e) - 2) bin FROM dn CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) e FROM dn)) GROUP BY bin)""")
def calibration_bins(s: Study) -> DataFrame:
    # Means of rounded scores can fall on ties of rounding; the addend moves them off.
    return va.calibration_bins(done(s), REC, "score").withColumn("bin", F.col("bin").cast("long")).withColumn("mean_pred", F.col("mean_pred") + 1e-9).select("bin", "n", *r6("mean_pred", "observed_freq", "ece"))


@query(_SPLIT + f"SELECT round(avg({REC}), 6) base_rate FROM spl WHERE split IN ('train', 'val')")
def base_rate(s: Study) -> DataFrame:
    return sp.chronological_split(done(s), "event_date").where("split IN ('train', 'val')").agg(F.round(F.avg(REC), 6).alias("base_rate"))


# --- models ---------------------------------------------------------------------

def _split_written(s: Study) -> DataFrame:
    return written(sp.chronological_split(done(s), "event_date"), "split-events")


def _fold_scores(s: Study) -> pd.DataFrame:
    x = _split_written(s)
    return ml.expanding_comparison(x, REC, ep.FEATURES, "event_date", _folds(x), seed=7)


def _explained(s: Study) -> tuple[DataFrame, ml.Fitted]:
    """The test rows, and the boosting the search chose."""
    x = _split_written(s)
    return x.where("split = 'test'"), ml.search(x, REC, ep.FEATURES, ("boosting",), seed=7)[1]["boosting"]


@query()
def model_comparison(s: Study) -> DataFrame:
    return inf.as_frame(s.spark, ml.search(_split_written(s), REC, ep.FEATURES, seed=7)[0])


@query()
def model_calibration(s: Study) -> DataFrame:
    x = _split_written(s)
    return ml.calibration(ml.search(x, REC, ep.FEATURES, seed=7)[1], x.where("split = 'test'"), REC)


@query()
def model_folds(s: Study) -> DataFrame:
    return inf.as_frame(s.spark, _fold_scores(s))


@query()
def fold_auc_pivot(s: Study) -> DataFrame:
    """AUC by fold and model; the last row, without fold, has the models' means."""
    x = inf.as_frame(s.spark, _fold_scores(s)[["fold", "model", "roc_auc"]])
    kinds = list(ml.PARAMS)
    wide = x.groupBy("fold").pivot("model", kinds).agg(F.first("roc_auc"))
    return wide.unionByName(wide.agg(*[F.avg(k).alias(k) for k in kinds]).withColumn("fold", F.lit(None).cast("bigint")))


@query()
def permutation_importance(s: Study) -> DataFrame:
    test, m = _explained(s)
    return ml.permutation_importance(m, test, REC, seed=7)


def _imputed(c: str) -> str:
    return f"coalesce({c}, (SELECT median({c}) FROM tv))"


@query(_SPLIT + ", tv AS (SELECT * FROM spl WHERE split IN ('train', 'val')), im AS (SELECT " + REC + ", " + ", ".join(f"{_imputed(c)} {c}" for c in ep.FEATURES) + " FROM tv)"
       + rq.logit("l", "im", REC, ep.FEATURES, steps=8, ridge="10.0") + "SELECT term feature, round(beta, 6) coef, round(exp(beta), 6) odds_ratio FROM l_t WHERE i > 1")
def logit_coefficients(s: Study) -> DataFrame:
    m = ml.fit(_split_written(s).where("split IN ('train', 'val')"), REC, ep.FEATURES, "logistic", {"c": 0.1})
    return inf.as_frame(s.spark, ml.logistic_ranking(m)).select("feature", *r6("coef", "odds_ratio"))


@query()
def shap_values(s: Study) -> DataFrame:
    test, m = _explained(s)
    return ml.shap_scaled(written(ml.shap_values(m, test, "event_id"), "shap-values"), m.names, "event_id")


@query()
def shap_importance(s: Study) -> DataFrame:
    test, m = _explained(s)
    return ml.shap_importance(ml.shap_values(m, test, "event_id"), m.names)


@query()
def shap_dependence(s: Study) -> DataFrame:
    test, m = _explained(s)
    return ml.shap_dependence(written(ml.shap_values(m, test, "event_id"), "shap-values"), m.names)


# --- robustness grid --------------------------------------------------------------

def _lowest(s: Study, scored: DataFrame) -> DataFrame:
    """Candidates at the loosest threshold in any volatility window."""
    g = s.config.get
    z = F.array_min(F.array(*[f"z_{w}" for w in g("robustness.vol_windows")]))
    # Membership grows with the tickers; the candidates lie by ticker already.
    return ep.candidates(scored.withColumn("z", z), s.windows.hint("merge"), max(g("robustness.z_thresholds")), g("study.start"), g("study.end"))


def grid_events(s: Study) -> DataFrame:
    """Events of all specifications, with outcomes, features and crash types, written once."""
    s.stored = True
    g = s.config.get
    thresholds, windows, cooldowns = g("robustness.z_thresholds"), g("robustness.vol_windows"), g("robustness.cooldowns")
    low = _lowest(s, pn.with_zscores(s.panel, windows))
    kept = written(ep.cooldown(gr.grid_candidates(low, windows, thresholds, cooldowns), "cooldown", [*gr.SPEC, "ticker"]), "grid-episodes")
    # An event has the same surroundings in every specification.
    around = ep.surroundings(kept.select("ticker", "pos", "close", "prev_close").distinct(), s.panel, g("robustness.horizons"), H, 1, windows).drop("episode_min_return")
    volumes = reduce(lambda x, w: x.when(F.col("vol_window") == w, F.col(f"prior_volumes_{w}")), windows, F)
    # Neither side is small; the episodes of all specifications only look so, compressed.
    x = kept.join(around.hint("merge"), ["ticker", "pos"]).withColumn("prior_volumes", volumes).drop(*[f"prior_volumes_{w}" for w in windows])
    x = x.withColumnRenamed("z", "crash_z").withColumn("raw_return", F.col("ret")).withColumnRenamed("date", "event_date")
    x = ep.with_outcomes(x, s.market, s.calendar, g("robustness.horizons"), H)
    return written(ep.with_features(x, s.market, s.calendar, s.sectors, s.sector_rets, *s.cuts, "vol_window").drop("prior_volumes"), "grid-events")


def _grid(s: Study) -> DataFrame:
    g = s.config.get
    return gr.robustness_grid(grid_events(s), g("robustness.horizons"), g("robustness.vix_high_quantiles"), g("robustness.min_events"))


def _means(s: Study) -> DataFrame:
    """Mean and recovery rate of the grid's cells. They ask for the closes at the
    horizons only: windows beside the score's, in the same pass. No features,
    sectors or crash types, and no table is written or read again: what the
    driver holds is one plan and the market."""
    g = s.config.get
    windows, horizons = g("robustness.vol_windows"), g("robustness.horizons")
    scored = pn.with_zscores(s.panel.select("ticker", "date", "pos", "close", "ret"), windows)
    low = _lowest(s, scored.withColumns({f"close_p{h}": pn.at_offset("close", h) for h in horizons}))
    low = ep.with_cars(low, s.market, s.calendar, horizons).select("ticker", "pos", *[f"z_{w}" for w in windows], *[f"car_{h}" for h in horizons])
    found = ep.cooldown(gr.grid_candidates(low, windows, g("robustness.z_thresholds"), g("robustness.cooldowns")), "cooldown", [*gr.SPEC, "ticker"])
    return gr.grid_means(found, horizons, g("robustness.min_events"))


_CELL = ["mean_car", "se_clustered", "recovery_rate", "median_car", "mean_car_broad", "mean_car_sector", "mean_car_idio", "diff_broad_minus_idio", "mean_car_avol_q4",
         "mean_car_avol_q1", "diff_avol_q4_minus_q1", "mean_car_high_vix", "mean_car_low_vix", "diff_high_minus_low_vix"]


@query(f"SELECT z_threshold, vol_window, cooldown, horizon, vix_high_quantile, n_events, n_dates, {s6(*_CELL)} FROM cl", grid_chain)
def robustness_grid(s: Study) -> DataFrame:
    return _grid(s).select(*gr.SPEC, "horizon", "vix_high_quantile", "n_events", "n_dates", *r6(*_CELL))


_ND = "greatest(n_dates - 1, 1)"


@query(f", gi AS ({rq.t_quantile('(SELECT DISTINCT z_threshold, vol_window, cooldown, horizon, mean_car, se_clustered, n_dates FROM cl)', _ND)})\nSELECT z_threshold, vol_window, cooldown, horizon, round(mean_car, 6) mean_car, round(mean_car - crit * se_clustered, 6) ci_lo, round(mean_car + crit * se_clustered, 6) ci_hi, round({rq.t_p('mean_car / se_clustered', _ND)}, 6) p_value FROM gi", grid_chain)
def grid_intervals(s: Study) -> DataFrame:
    return _grid(s).select(*gr.SPEC, "horizon", *r6("mean_car", "ci_lo", "ci_hi", "p_value")).distinct()


_REPORTED = ("crash_z", "avol", "rv_20")


@query(", gn AS (SELECT z_threshold, vol_window, cooldown, horizon FROM gl GROUP BY ALL HAVING count(*) >= " + str(CONFIG.get("robustness.min_events")) + "), gk AS (SELECT gl.* RENAME (z AS crash_z) FROM gl JOIN gn USING (z_threshold, vol_window, cooldown, horizon))"
       + rq.ols("o", "gk", "car", PRIMARY, by=("z_threshold", "vol_window", "cooldown", "horizon"))
       + "SELECT z_threshold, vol_window, cooldown, horizon, round(any_value(adj_r2), 6) ols_adj_r2, " + ", ".join(f"round(max(CASE WHEN term = '{c}' THEN beta END), 6) beta_{c}, round(max(CASE WHEN term = '{c}' THEN pv END), 6) p_{c}" for c in _REPORTED)
       + f" FROM (SELECT *, {rq.normal_p('beta / se')} pv FROM o_t) GROUP BY ALL", grid_chain)
def grid_regressions(s: Study) -> DataFrame:
    g = s.config.get
    t = gr.grid_regressions(gr.long_by_horizon(grid_events(s), g("robustness.horizons")), PRIMARY, _REPORTED, g("robustness.min_events"))
    return t.select(*gr.SPEC, "horizon", *r6("ols_adj_r2", *[f"{k}_{c}" for c in _REPORTED for k in ("beta", "p")]))


@query(f"""SELECT count(*) n, round(min(mean_car), 6) min_mean, round(max(mean_car), 6) max_mean, round(median(mean_car), 6) median_mean, round(avg(CASE WHEN mean_car < 0 THEN 1.0 ELSE 0.0 END), 6) share_negative,
  round(min(recovery_rate), 6) min_recovery, round(max(recovery_rate), 6) max_recovery, round(median(recovery_rate), 6) median_recovery, round(avg(CASE WHEN recovery_rate < 0.5 THEN 1.0 ELSE 0.0 END), 6) share_below_half FROM c1 WHERE horizon = {H}""", grid_chain)
def grid_summary(s: Study) -> DataFrame:
    t = gr.grid_summary(_means(s), H)
    return t.select("n", *r6(*[c for c in t.columns if c != "n"]))


@query(f", gp AS (SELECT *, {rq.t_p('mean_car / se_clustered', _ND)} p FROM (SELECT DISTINCT z_threshold, vol_window, cooldown, mean_car, se_clustered, n_dates FROM cl WHERE horizon = {H}))\nSELECT count(*) n, round(avg(CASE WHEN mean_car < 0 AND p < 0.05 THEN 1.0 ELSE 0.0 END), 6) share_negative_significant, round(avg(CASE WHEN mean_car > 0 AND p < 0.05 THEN 1.0 ELSE 0.0 END), 6) share_positive_significant FROM gp", grid_chain)
def grid_significance(s: Study) -> DataFrame:
    return gr.grid_summary(_grid(s), H).select("n", *r6("share_negative_significant", "share_positive_significant"))


@query("SELECT round(avg(CASE WHEN diff_avol_q4_minus_q1 > 0 THEN 1.0 ELSE 0.0 END), 6) avol_effect, round(avg(CASE WHEN diff_broad_minus_idio < 0 THEN 1.0 ELSE 0.0 END), 6) broad_vs_idio FROM cl", grid_chain)
def sign_consistency(s: Study) -> DataFrame:
    return gr.sign_consistency(_grid(s)).select(*r6("avol_effect", "broad_vs_idio"))


@query(f"SELECT z_threshold, round(median(mean_car), 6) median_mean_car FROM c1 WHERE horizon = {H} GROUP BY z_threshold", grid_chain)
def severity_gradient(s: Study) -> DataFrame:
    one = _means(s).where(F.col("horizon") == H)
    return one.groupBy("z_threshold").agg(F.round(F.percentile("mean_car", F.lit(0.5)), 6).alias("median_mean_car"))


_CDS = CONFIG.get("robustness.cooldowns")


@query("SELECT z_threshold, " + ", ".join(f"round(max(CASE WHEN cooldown = {k} THEN mean_car END), 6) cooldown_{k}" for k in _CDS) + f" FROM c1 WHERE horizon = {H} AND vol_window = 60 GROUP BY z_threshold", grid_chain)
def grid_pivot(s: Study) -> DataFrame:
    one = _means(s).where((F.col("horizon") == H) & (F.col("vol_window") == 60))
    wide = one.groupBy("z_threshold").pivot("cooldown", _CDS).agg(F.first("mean_car"))
    return wide.select("z_threshold", *[F.round(str(k), 6).alias(f"cooldown_{k}") for k in _CDS])


_HZS = CONFIG.get("robustness.horizons")
_FIRST_CD = min(_CDS)


@query("SELECT z_threshold, " + ", ".join(f"round(max(CASE WHEN horizon = {h} THEN mean_car END), 6) horizon_{h}" for h in _HZS) + f" FROM c1 WHERE vol_window = 60 AND cooldown = {_FIRST_CD} GROUP BY z_threshold", grid_chain)
def grid_horizon_pivot(s: Study) -> DataFrame:
    """Mean by threshold and horizon of the first cooldown, as a grid's rows come."""
    one = _means(s).where((F.col("vol_window") == 60) & (F.col("cooldown") == _FIRST_CD))
    wide = one.groupBy("z_threshold").pivot("horizon", _HZS).agg(F.first("mean_car"))
    return wide.select("z_threshold", *[F.round(str(h), 6).alias(f"horizon_{h}") for h in _HZS])


# --- tables behind figures ----------------------------------------------------------

@query("""SELECT strftime(q, '%Y-%m-%d') "quarter", count(e0.event_id) n FROM (SELECT unnest(generate_series(date_trunc('quarter', min(d))::TIMESTAMP, date_trunc('quarter', max(d))::TIMESTAMP, INTERVAL 3 MONTH)) q FROM e0)
LEFT JOIN e0 ON date_trunc('quarter', e0.d) = q GROUP BY q""")
def events_per_quarter(s: Study) -> DataFrame:
    e = s.episodes(wide=False).select(F.trunc("event_date", "quarter").alias("q"))
    span = e.agg(F.min("q").alias("a"), F.max("q").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 3 month)")).alias("q"))
    return span.join(e.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").select(F.date_format("q", "yyyy-MM-dd").alias("quarter"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT strftime(date_trunc('quarter', d), '%Y-%m-%d') \"quarter\", count(*) n FROM e0 GROUP BY 1 ORDER BY n DESC, \"quarter\" LIMIT 5")
def busiest_quarters(s: Study) -> DataFrame:
    return s.episodes(wide=False).groupBy(F.date_format(F.trunc("event_date", "quarter"), "yyyy-MM-dd").alias("quarter")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "quarter").limit(5)


@query("SELECT b bin, count(*) n FROM (SELECT CASE WHEN x >= -3.0 THEN 61 ELSE (floor((x + 12.0) / 0.15) + 1)::INT END b FROM (SELECT greatest(least(crash_z, -3.0), -12.0) x FROM e0)) GROUP BY b")
def severity_histogram(s: Study) -> DataFrame:
    x = F.greatest(F.least("crash_z", F.lit(-3.0)), F.lit(-12.0))
    b = F.when(x >= -3.0, F.lit(61)).otherwise((F.floor((x + 12.0) / 0.15) + 1).cast("int"))
    return s.episodes(wide=False).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT avol_quartile, {', '.join(f"round(avg(CASE WHEN severity_quartile = 'S{i}' THEN {CAR} END), 6) mean_s{i}, count(CASE WHEN severity_quartile = 'S{i}' THEN 1 END) n_s{i}" for i in range(1, 5))} FROM ev WHERE avol_quartile IS NOT NULL GROUP BY 1""")
def avol_severity_pivot(s: Study) -> DataFrame:
    aggs = [a for i in range(1, 5) for a in (F.round(F.avg(F.when(F.col("severity_quartile") == f"S{i}", F.col(CAR))), 6).alias(f"mean_s{i}"), F.count_if(F.col("severity_quartile") == f"S{i}").alias(f"n_s{i}"))]
    return s.events().where("avol_quartile IS NOT NULL").groupBy("avol_quartile").agg(*aggs)


@query(f""", q5 AS (SELECT quantile_cont(vix, [0.2, 0.4, 0.6, 0.8]) e FROM ev WHERE {REC} IS NOT NULL)
SELECT 'V' || (len(list_filter(e, lambda x: x < vix)) + 1) quintile, count(*) n, round(avg({REC}), 6) recovery_rate, round(min(vix), 6) min_vix, round(max(vix), 6) max_vix FROM ev CROSS JOIN q5 WHERE {REC} IS NOT NULL AND vix IS NOT NULL GROUP BY 1""")
def recovery_by_vix_quintile(s: Study) -> DataFrame:
    x = ep.quantile_bins(s.events().where(f"{REC} IS NOT NULL"), {"quintile": ("vix", [f"V{i}" for i in range(1, 6)])}).where("quintile IS NOT NULL")
    return x.groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(REC), 6).alias("recovery_rate"), F.round(F.min("vix"), 6).alias("min_vix"), F.round(F.max("vix"), 6).alias("max_vix"))


@query(f"SELECT b bin, count(*) n FROM (SELECT CASE WHEN x >= 0.35 THEN 71 ELSE (floor((x + 0.35) / 0.01) + 1)::INT END b FROM (SELECT greatest(least(round({CAR}, 6), 0.35::DOUBLE), -0.35::DOUBLE) + 1e-9 x FROM e2 WHERE {CAR} IS NOT NULL)) GROUP BY b")
def outcome_histogram(s: Study) -> DataFrame:
    x = F.greatest(F.least(F.round(CAR, 6), F.lit(0.35)), F.lit(-0.35)) + 1e-9
    b = F.when(x >= 0.35, F.lit(71)).otherwise((F.floor((x + 0.35) / 0.01) + 1).cast("int"))
    return s.outcomes().where(f"{CAR} IS NOT NULL").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count({CAR}) n, round(avg({CAR}), 6) mean, round(median({CAR}), 6) median, round(stddev_samp({CAR}), 6) sd, round(avg(CASE WHEN {CAR} > 0 THEN 1.0 ELSE 0.0 END), 6) share_positive FROM e2 WHERE {CAR} IS NOT NULL")
def outcome_dispersion(s: Study) -> DataFrame:
    return s.outcomes().where(f"{CAR} IS NOT NULL").agg(
        F.count(CAR).alias("n"), F.round(F.avg(CAR), 6).alias("mean"), F.round(F.percentile(CAR, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_samp(CAR), 6).alias("sd"), F.round(F.avg((F.col(CAR) > 0).cast("double")), 6).alias("share_positive"))


@query(f"""SELECT ticker, min(gap) min_gap, count(CASE WHEN gap < {CONFIG.get('events.cooldown')} THEN 1 END) violations FROM (SELECT ticker, (pos - lag(pos) OVER (PARTITION BY ticker ORDER BY pos))::BIGINT gap FROM e0) WHERE gap IS NOT NULL GROUP BY ticker""")
def min_event_gap(s: Study) -> DataFrame:
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("ticker").orderBy("pos"))
    x = s.episodes(wide=False).withColumn("gap", gap.cast("long")).where("gap IS NOT NULL")
    return x.groupBy("ticker").agg(F.min("gap").alias("min_gap"), F.count_if(F.col("gap") < CONFIG.get("events.cooldown")).alias("violations"))


@query("SELECT ticker, round(max(abs(ret)), 6) top FROM pn GROUP BY ticker ORDER BY max(abs(ret)) DESC NULLS LAST, ticker LIMIT 6")
def top_abs_returns(s: Study) -> DataFrame:
    x = s.panel.groupBy("ticker").agg(F.max(F.abs("ret")).alias("t")).orderBy(F.desc_nulls_last("t"), "ticker").limit(6)
    return x.select("ticker", F.round("t", 6).alias("top"))


@query("SELECT crash_type, count(*) n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS \"share\" FROM e3 GROUP BY crash_type")
def crash_type_share(s: Study) -> DataFrame:
    x = s.features().groupBy("crash_type").agg(F.count(F.lit(1)).alias("n"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("n").alias("t")))).select("crash_type", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row


@query("SELECT z_threshold, round(median(mean_car), 6) median_mean, round(min(mean_car), 6) min_mean, round(max(mean_car), 6) max_mean, count(*) n FROM c1 GROUP BY z_threshold", grid_chain)
def threshold_stats(s: Study) -> DataFrame:
    one = _grid(s).dropDuplicates([*gr.SPEC, "horizon"])
    return one.groupBy("z_threshold").agg(
        F.round(F.percentile("mean_car", F.lit(0.5)), 6).alias("median_mean"), F.round(F.min("mean_car"), 6).alias("min_mean"), F.round(F.max("mean_car"), 6).alias("max_mean"), F.count(F.lit(1)).alias("n"))


@query(_DONE + f""", e12 AS (SELECT quantile_cont(avol, [{', '.join(f'{i}/12::DOUBLE' for i in range(1, 12))}]) e FROM dn)
SELECT (len(list_filter(e, lambda x: x < avol)))::INT bin, count(*) n, round(median(avol), 6) mid, round(median({CAR}), 6) median_car FROM dn CROSS JOIN e12 WHERE avol IS NOT NULL GROUP BY 1""")
def dependence_bins(s: Study) -> DataFrame:
    x = ep.quantile_bins(done(s), {"bin": ("avol", [str(i) for i in range(12)])}).where("bin IS NOT NULL")
    return x.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("avol", F.lit(0.5)), 6).alias("mid"), F.round(F.percentile(CAR, F.lit(0.5)), 6).alias("median_car"))


@query("SELECT b bin, count(*) n FROM (SELECT CASE WHEN x >= 0 THEN 61 ELSE (floor((x + 0.5::DOUBLE) / (0.5::DOUBLE / 60)) + 1)::INT END b FROM (SELECT greatest(least(round(raw_return, 6), 0.0::DOUBLE), -0.5::DOUBLE) + 1e-9 x FROM e0)) GROUP BY b")
def return_histogram(s: Study) -> DataFrame:
    x = F.greatest(F.least(F.round("raw_return", 6), F.lit(0.0)), F.lit(-0.5)) + 1e-9
    b = F.when(x >= 0, F.lit(61)).otherwise((F.floor((x + 0.5) / (0.5 / 60)) + 1).cast("int"))
    return s.episodes(wide=False).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f""", q5 AS (SELECT quantile_cont(vix, [0.2, 0.4, 0.6, 0.8]) e FROM ev WHERE {REC} IS NOT NULL),
kn AS (SELECT event_id, 'V' || (len(list_filter(e, lambda x: x < vix)) + 1) quintile, {REC} v FROM ev CROSS JOIN q5 WHERE {REC} IS NOT NULL AND vix IS NOT NULL)""" + rq.weights("b", "kn", ["event_id"], SEED, ["quintile", "v"]) + rq.intervals("b", "quintile", "v") + f"""
SELECT quintile, n, {s6('mean', 'lo', 'hi', 'p_value')} FROM (SELECT quintile, count(v) n, avg(v) mean FROM kn GROUP BY quintile) JOIN b_i USING (quintile)""")
def recovery_quintile_intervals(s: Study) -> DataFrame:
    x = ep.quantile_bins(s.events().where(f"{REC} IS NOT NULL"), {"quintile": ("vix", [f"V{i}" for i in range(1, 6)])}).where("quintile IS NOT NULL")
    return inf.bootstrap_mean(x, "quintile", ["event_id"], REC, seed=SEED).select("quintile", "n", *r6("mean", "lo", "hi", "p_value"))


@query("""SELECT strftime(date_trunc('quarter', d), '%Y-%m-%d') "quarter", count(*) n FROM e0 WHERE d BETWEEN DATE '2020-03-16' - 200 AND DATE '2020-03-16' + 200 GROUP BY 1 ORDER BY n DESC, "quarter" LIMIT 1""")
def local_peak(s: Study) -> DataFrame:
    near = s.episodes(wide=False).where("event_date BETWEEN date_sub(DATE '2020-03-16', 200) AND date_add(DATE '2020-03-16', 200)")
    return near.groupBy(F.date_format(F.trunc("event_date", "quarter"), "yyyy-MM-dd").alias("quarter")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "quarter").limit(1)
