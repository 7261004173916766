"""Models of a binary outcome, chosen on validation, refitted, scored once.

Every fit is one task, a forest several, and all fits of a stage run side by
side in one job. They learn from one table of at most `max_rows` labelled rows,
which is broadcast; all else (choice of parameters, scores, metrics,
calibration, importances) goes over all rows. Missing features take the training median.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import learners
from tidemark.operators.episodes import check_features
from tidemark.operators.evaluation import calibration_bins, classification_metrics, ranking_metrics

#: The settings tried on the validation block.
PARAMS: dict[str, list[dict]] = {
    "logistic": [{"c": c} for c in (0.01, 0.1, 1.0, 10.0)],
    "random_forest": [{"leaf": n} for n in (10, 20, 50, 100)],
    "boosting": [{"rounds": n, "rate": r, "leaves": m} for n, r, m in ((200, 0.03, 15), (400, 0.03, 15), (400, 0.01, 31), (800, 0.01, 15))],
}
TREES, TREES_A_TASK = 500, 50
#: Labelled rows that models learn from at most, those of the smallest hashes; bounds the broadcast to some 10 MB.
MAX_ROWS = 50_000
#: Rows among which a feature's values are dealt anew, and cells a score is counted in.
CHUNK, CELLS = 100_000, 1 << 14


@dataclass
class Job:
    """One fit: on rows of some splits, or on those dated before a day (its number)."""

    kind: str
    params: dict
    splits: tuple[str, ...] = ()
    before: int | None = None
    seed: int = 0


@dataclass
class Fitted:
    """A model and the medians that stand for missing features."""

    kind: str
    names: list[str]
    medians: np.ndarray
    model: dict
    params: dict = field(default_factory=dict)

    def score(self, rows: DataFrame, name: str = "p") -> DataFrame:
        return score_all(rows, [self], "_all").withColumn(name, F.col("_all")[0]).drop("_all")


def _finite(name: str) -> Column:
    x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(x) < float("inf"), x).alias(name)


def labelled(rows: DataFrame, y: str, names: Sequence[str], split: str | None = None, date: str | None = None, max_rows: int = MAX_ROWS) -> dict:
    """Arrays `x`, `y`, `split`, `day` of the labelled rows, at most about `max_rows` of them, in an order of their own."""
    check_features(names)
    known = rows.where(F.col(y).isNotNull())
    share = min(1.0, max_rows / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(*names), F.lit(1_000_003)) / 1_000_003.0 < share) if share < 1 else known
    got = drawn.select(
        F.col(y).cast("double").alias("_y"), (F.col(split) if split else F.lit("train")).alias("_s"),
        (F.unix_date(F.col(date).cast("date")) if date else F.lit(0)).alias("_d"), *map(_finite, names),
    ).toPandas().sort_values(["_d", "_y", *names], kind="stable")
    return {"x": got[list(names)].to_numpy(float), "y": got["_y"].to_numpy(float), "split": got["_s"].astype(str).to_numpy(str), "day": got["_d"].to_numpy(np.int64)}


def _filled(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), medians, x)


def fit_all(spark: SparkSession, data: dict, names: Sequence[str], jobs: Sequence[Job], trees: int = TREES) -> list[Fitted]:
    """The jobs' models, in their order; one task a fit, or TREES_A_TASK trees."""
    tasks = []
    for i, j in enumerate(jobs):
        parts = -(-trees // TREES_A_TASK) if j.kind == "random_forest" else 1
        tasks += [(i, part, min(TREES_A_TASK, trees - part * TREES_A_TASK), j.kind, j.params, list(j.splits), j.before, j.seed * 1000 + part) for part in range(parts)]
    tasks.sort(key=lambda t: -t[4].get("rounds", 0))  # the longest first
    shared = spark.sparkContext.broadcast((data, tasks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, todo = shared.value
        for b in batches:
            for t in b["id"]:
                i, part, n_trees, kind, params, splits, before, seed = todo[int(t)]
                use = np.isin(given["split"], splits) if splits else given["day"] < before if before is not None else np.ones(len(given["y"]), bool)
                x, y = given["x"][use], given["y"][use]
                if not len(y):
                    raise ValueError("no rows to learn from")
                with np.errstate(all="ignore"):
                    medians = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
                model = learners.fit_model(kind, params, np.where(np.isnan(x), medians, x), y, seed, n_trees)
                yield pd.DataFrame({"job": [i], "part": [part], "blob": [pickle.dumps((medians, model))]})

    got = spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(run, "job int, part int, blob binary").collect()  # models
    out = []
    for i, j in enumerate(jobs):
        parts = [pickle.loads(r.blob) for r in sorted((r for r in got if r.job == i), key=lambda r: r.part)]
        medians, model = parts[0]
        if j.kind == "random_forest":
            models = [m for _, m in parts]
            size = np.cumsum([0, *[len(m["feature"]) for m in models]])
            whole = {c: np.concatenate([m[c] + (s if c in ("left", "right") else 0) for m, s in zip(models, size, strict=False)]) for c in learners.LEAF}
            model = {**model, **whole, "roots": np.concatenate([m["roots"] + s for m, s in zip(models, size, strict=False)]).astype(np.int32), "scale": 1.0 / trees}
        out.append(Fitted(j.kind, list(names), medians, model, j.params))
    return out


def fit(rows: DataFrame, y: str, names: Sequence[str], kind: str, params: dict, seed: int = 0, trees: int = TREES, max_rows: int = MAX_ROWS) -> Fitted:
    """One model; `names` must be event-time features."""
    return fit_all(rows.sparkSession, labelled(rows, y, names, max_rows=max_rows), names, [Job(kind, params, seed=seed)], trees)[0]


def score_all(rows: DataFrame, models: Sequence[Fitted], name: str = "p") -> DataFrame:
    """Adds an array with every model's probability."""
    names = models[0].names
    shared = rows.sparkSession.sparkContext.broadcast([(m.medians, m.model) for m in models])  # models: their size doesn't follow the rows

    @F.pandas_udf("array<double>")
    def probabilities(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(float)
        cols = [learners.probability(model, np.where(np.isnan(v), medians, v)) for medians, model in shared.value]
        return pd.Series(list(np.column_stack(cols)))

    return rows.withColumn(name, probabilities(F.struct(*map(_finite, names))))


def _long(rows: DataFrame, y: str, models: Sequence[Fitted]) -> DataFrame:
    """`m, _t, p`: one row per labelled row and model."""
    return score_all(rows.where(F.col(y).isNotNull()), models, "_p").select(F.col(y).cast("double").alias("_t"), F.posexplode("_p").alias("m", "p"))


def _metrics(rows: DataFrame, y: str, models: Sequence[Fitted]) -> list[dict]:
    got = {r.m: {k: v for k, v in r.asDict().items() if k != "m"} for r in classification_metrics(_long(rows, y, models), "_t", "p", ["m"]).collect()}  # one row a model
    return [got.get(i, {}) for i in range(len(models))]


def base_rate(rows: DataFrame, y: str) -> float:
    """The constant forecast: the outcome's mean."""
    return float(rows.agg(F.avg(F.col(y).cast("double"))).first()[0])


def _number(v) -> float:
    return float(v) if v is not None else float("nan")


def choose(split: DataFrame, y: str, names: Sequence[str], kinds: Sequence[str] = tuple(PARAMS), seed: int = 0, data: dict | None = None, trees: int = TREES) -> dict[str, tuple[float, dict]]:
    """Per kind the best validation AUC and its parameters, the first of equals.
    `split` has a column `split`."""
    data = data or labelled(split, y, names, "split")
    settings = [(k, p) for k in kinds for p in PARAMS[k]]
    models = fit_all(split.sparkSession, data, names, [Job(k, p, ("train",), seed=seed) for k, p in settings], trees)
    best: dict[str, tuple[float, dict]] = {}
    for (kind, params), m in zip(settings, _metrics(split.where("split = 'val'"), y, models), strict=True):
        a = _number(m.get("roc_auc"))
        if kind not in best or a > best[kind][0] or (np.isnan(best[kind][0]) and not np.isnan(a)):
            best[kind] = (a, params)
    return best


def search(split: DataFrame, y: str, names: Sequence[str], kinds: Sequence[str] = tuple(PARAMS), seed: int = 0, max_rows: int = MAX_ROWS, trees: int = TREES) -> tuple[pd.DataFrame, dict[str, Fitted]]:
    """Per kind: the parameters of the best validation AUC (the first of equals),
    refitted on training and validation, scored once on test; and the base rate.
    `split` has a column `split`."""
    part = lambda *p: split.where(F.col("split").isin(*p))
    data = labelled(split, y, names, "split", max_rows=max_rows)
    best = choose(split, y, names, kinds, seed, data, trees)
    finals = fit_all(split.sparkSession, data, names, [Job(k, best[k][1], ("train", "val"), seed=seed) for k in kinds], trees)
    fitted = dict(zip(kinds, finals, strict=True))
    rows = [{"model": k, "val_roc_auc": best[k][0], **m, "params": str(best[k][1])} for k, m in zip(kinds, _metrics(part("test"), y, finals), strict=True)]
    constant = part("test").withColumn("p", F.lit(base_rate(part("train", "val"), y)))
    rows.append({"model": "base_rate", "val_roc_auc": float("nan"), **classification_metrics(constant, y, "p").first().asDict(), "params": "{}"})
    return pd.DataFrame(rows), fitted


def calibration(fitted: dict[str, Fitted], test: DataFrame, y: str, bins: int = 10) -> DataFrame:
    """`model, bin, n, mean_pred, observed_freq, lo_edge, hi_edge, ece, roc_auc`
    of each model on the test rows: its reliability beside its discrimination."""
    scored = _long(test, y, list(fitted.values()))
    parts = []
    for i, name in enumerate(fitted):
        own = scored.where(F.col("m") == i)
        parts.append(calibration_bins(own, "_t", "p", bins).crossJoin(F.broadcast(ranking_metrics(own, "_t", "p").select("roc_auc"))).withColumn("model", F.lit(name)))  # one row
    return reduce(DataFrame.unionByName, parts).select("model", "bin", "n", "mean_pred", "observed_freq", "lo_edge", "hi_edge", "ece", "roc_auc")


def expanding_comparison(split: DataFrame, y: str, names: Sequence[str], date: str, folds: Sequence[dict], kinds: Sequence[str] = tuple(PARAMS), seed: int = 0, max_rows: int = MAX_ROWS, trees: int = TREES) -> pd.DataFrame:
    """Metrics of all kinds per fold, each refitted on the fold's history with the
    parameters chosen on validation. `split` has a column `split`."""
    data = labelled(split, y, names, "split", date, max_rows)
    best = choose(split, y, names, kinds, seed, data, trees)
    epoch = pd.Timestamp(0).date()
    wanted = [(f, k) for f in folds for k in kinds]
    models = fit_all(split.sparkSession, data, names, [Job(k, best[k][1], before=(f["train_end"] - epoch).days, seed=seed) for f, k in wanted], trees)
    d = F.col(date).cast("date")
    tests = []
    for i, f in enumerate(folds):
        own = _long(split.where(d.between(F.lit(f["test_start"]), F.lit(f["test_end"]))), y, models[i * len(kinds) : (i + 1) * len(kinds)])
        tests.append(own.withColumn("m", F.col("m") + i * len(kinds)))
    got = {r.m: {k: v for k, v in r.asDict().items() if k != "m"} for r in classification_metrics(reduce(DataFrame.unionByName, tests), "_t", "p", ["m"]).collect()} if tests else {}  # one row a model
    return pd.DataFrame([{**{c: str(v) if c.endswith(("end", "start")) else v for c, v in f.items()}, "model": k, **got.get(i, {})} for i, (f, k) in enumerate(wanted)])


def permutation_importance(model: Fitted, rows: DataFrame, y: str, repeats: int = 15, seed: int = 0) -> DataFrame:
    """`feature, importance_mean, importance_std`: fall of the AUC when one
    feature's values are dealt anew among the rows of a chunk (all rows, if they
    are no more than CHUNK). Each chunk is one task, which counts scores in
    CELLS cells per feature and repeat; scores within a cell count as ties."""
    names = model.names
    known = rows.where(F.col(y).isNotNull())
    chunks = max(1, -(-known.count() // CHUNK))
    shared = rows.sparkSession.sparkContext.broadcast((model.medians, model.model))

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        medians, fitted = shared.value
        part = part.sort_values(["_t", *names], kind="stable")
        x = part[names].to_numpy(float)
        x, t, out = np.where(np.isnan(x), medians, x), part["_t"].to_numpy(float), []

        def cells(f: int, rep: int, values: np.ndarray) -> None:
            cell = np.minimum((learners.probability(fitted, values) * CELLS).astype(np.int64), CELLS - 1)
            at, inverse = np.unique(cell, return_inverse=True)
            out.append(pd.DataFrame({"f": f, "rep": rep, "cell": at, "pos": np.bincount(inverse, t, len(at)), "n": np.bincount(inverse, minlength=len(at))}))

        cells(-1, 0, x)
        for f in range(len(names)):
            for rep in range(repeats):
                mixed = x.copy()
                mixed[:, f] = x[np.random.default_rng([seed, f, rep, int(key[0])]).permutation(len(x)), f]
                cells(f, rep, mixed)
        return pd.concat(out)

    counted = known.select(F.col(y).cast("double").alias("_t"), *map(_finite, names)).withColumn("_c", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int")).groupBy("_c").applyInPandas(count, "f int, rep int, cell long, pos double, n long")
    per = counted.groupBy("f", "rep", "cell").agg(F.sum("pos").alias("pos"), (F.sum("n") - F.sum("pos")).alias("neg"))
    from pyspark.sql import Window

    below = F.sum("neg").over(Window.partitionBy("f", "rep").orderBy("cell")) - F.col("neg")  # at most CELLS rows
    auc = per.withColumn("below", below).groupBy("f", "rep").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    whole = auc.where("f = -1").select(F.col("auc").alias("whole"))
    name = F.get(F.array(*map(F.lit, names)), F.col("f")).alias("feature")
    fall = F.col("whole") - F.col("auc")
    return auc.where("f >= 0").crossJoin(F.broadcast(whole)).groupBy(name).agg(F.avg(fall).alias("importance_mean"), F.stddev_pop(fall).alias("importance_std"))  # one row


def logistic_ranking(model: Fitted) -> pd.DataFrame:
    """Coefficients per standard deviation and their odds ratios, largest first."""
    coef = model.model["beta"][1:]
    t = pd.DataFrame({"feature": model.names, "coef": coef, "odds_ratio": np.exp(coef)})
    return t.iloc[np.argsort(-np.abs(coef), kind="stable")].reset_index(drop=True)


def shap_values(model: Fitted, rows: DataFrame, id_: str, max_rows: int | None = 2000) -> DataFrame:
    """`id, values, shap`: features (medians for missing ones) and their Shapley
    values, as arrays, of each row; of the `max_rows` rows of the smallest hash of
    `id_` unless it is None (the explanation's sample is part of the feature)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.medians, model.model))
    sample = rows if max_rows is None else rows.orderBy(F.xxhash64(id_), id_).limit(max_rows)
    kind = rows.schema[id_].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        medians, fitted = shared.value
        for b in batches:
            x = b[model_names].to_numpy(float)
            x = np.where(np.isnan(x), medians, x)
            yield pd.DataFrame({id_: b[id_], "values": list(x), "shap": list(learners.tree_shap(fitted, x))})

    model_names = model.names
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sample.select(id_, *map(_finite, model.names)).repartition(n).mapInPandas(explain, f"{id_} {kind}, values array<double>, shap array<double>")


def _by_feature(shap: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    return shap.select(*keep, F.posexplode(F.arrays_zip("values", "shap")).alias("i", "z")).select(*keep, F.get(F.array(*map(F.lit, names)), F.col("i")).alias("feature"), F.col("z.values").alias("value"), F.col("z.shap").alias("shap"))


def shap_importance(shap: DataFrame, names: Sequence[str]) -> DataFrame:
    """`feature, mean_abs_shap` of kept Shapley values."""
    return _by_feature(shap, names).groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def shap_scaled(shap: DataFrame, names: Sequence[str], id_: str) -> DataFrame:
    """`id, feature, value, scaled, shap`: each feature's value on a scale from its
    5th to its 95th percentile, cut to 0 and 1."""
    x = _by_feature(shap, names, id_)
    ends = x.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("e"))
    scaled = (F.col("value") - F.col("e")[0]) / F.greatest(F.col("e")[1] - F.col("e")[0], F.lit(1e-12))
    return x.join(F.broadcast(ends), "feature").select(id_, "feature", "value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("scaled"), "shap")  # one row a feature


def shap_dependence(shap: DataFrame, names: Sequence[str], top: int = 4, bins: int = 12) -> DataFrame:
    """`feature, bin, n, centre, median_shap` of the `top` features by mean
    absolute value: values cut to their 1st and 99th percentile, in bins between
    their distinct quantiles, closed on the left."""
    x = _by_feature(shap, names)
    best = shap_importance(shap, names).orderBy(F.desc("mean_abs_shap"), "feature").limit(top).select("feature")
    x = x.join(F.broadcast(best), "feature")  # `top` rows
    ends = x.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("e"))
    x = x.join(F.broadcast(ends), "feature").withColumn("value", F.least(F.greatest("value", F.col("e")[0]), F.col("e")[1]))
    edges = x.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile("value", F.array(*[F.lit(i / bins) for i in range(bins + 1)])))).alias("q"))
    x = x.join(F.broadcast(edges), "feature").where(F.size("q") > 3)
    inner = F.slice("q", 2, F.size("q") - 2)
    x = x.withColumn("bin", F.least(F.size(F.filter(inner, lambda e: e <= F.col("value"))), F.size("q") - 2))
    return x.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.first((F.get("q", F.col("bin")) + F.get("q", F.col("bin") + 1)) / 2).alias("centre"), F.percentile("shap", F.lit(0.5)).alias("median_shap"))
