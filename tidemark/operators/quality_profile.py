"""Problem 4: column profiles from maintained value-count tables.

The store holds, per load and column, how often each value occurs: signed
deltas in batches of parquet files, and a manifest that names the batches and
loads in force. Applying a load appends its delta; a load that is in force
already is not applied again; taking one back appends its delta with the sign
turned. Counts of a column over all loads are sums of deltas, those of "all
other loads" the sum less one load's delta. Profiles, entropy, ranges and damage are exact functions
of these counts; nothing is read from the table again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_within, hadoop_path, scratch, written

#: Cells on whose edges distributions are compared, placed at quantiles of the pooled values.
GRID = 40
ACCURACY = 1_000
#: Batches that make a store merge them into one.
MANY = 16
#: (load, column) pairs and frequent values up to which a table may be broadcast.
SMALL = 2_000_000
VALUE = ("column_name", "x", "value")
#: What follows from a value and is kept beside it.
KEPT = ("decimals", "form")


def _typed(c: str, kind: str) -> tuple[Column, Column]:
    """(x, value) of a column: numbers as doubles, whole numbers too long for
    one as text beside, dates as day numbers, the rest as text; missing is null in both."""
    v, none = F.col(c), F.lit(None)
    if kind in ("double", "float"):
        return F.nanvl(v.cast("double"), none.cast("double")), none.cast("string")
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return v.cast("double"), F.when(F.abs(v.cast("double")) >= 2.0**53, v.cast("string"))
    if kind == "date":
        return F.unix_date(v).cast("double"), none.cast("string")
    s = v.cast("string")
    return none.cast("double"), F.when(F.trim(s) != "", s)


def decimals(x: Column) -> Column:
    """How many decimals a number is written with, six standing for more."""
    out = F.lit(6)
    for k in range(5, -1, -1):
        t = x * 10.0**k
        out = F.when(F.abs(t - F.rint(t)) <= F.abs(t) * 1e-12, F.lit(k)).otherwise(out)
    return F.when(x.isNotNull(), out)


def form(value: Column) -> Column:
    """The written form of text: its runs of capitals as A, of small letters as a, of digits as 9."""
    shape = value
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[0-9]+", "9")):
        shape = F.regexp_replace(shape, pattern, to)
    return shape


def value_counts(table: DataFrame, columns: list[str], by: str, sign: int = 1) -> DataFrame:
    """`by, column_name, x, value, decimals, form, n` of `columns`: a delta per
    `by`. Numbers and dates are in `x`, text in `value`; null, NaN and blank
    strings are missing, null in both. `sign` -1 makes the delta that takes the
    rows away. Rows without `by` belong to no load. Counting is combined before the shuffle."""
    kinds = dict(table.dtypes)

    def entry(i: int, c: str) -> Column:
        x, value = _typed(c, kinds[c])
        return F.struct(F.lit(i).alias("i"), x.alias("x"), value.alias("value"))

    long = table.where(F.col(by).isNotNull()).select(F.col(by).alias(by), F.explode(F.array(*[entry(i, c) for i, c in enumerate(columns)])).alias("_e"))
    counted = long.groupBy(by, *[F.col(f"_e.{k}").alias(k) for k in ("i", "x", "value")]).agg((F.lit(sign) * F.count(F.lit(1))).alias("n"))
    name = F.get(F.array(*map(F.lit, columns)), F.col("i")).alias("column_name")
    return counted.select(by, name, "x", "value", decimals(F.col("x")).cast("tinyint").alias("decimals"), form(F.col("value")).alias("form"), "n")


class ValueCountStore:
    """Maintained value counts per load and column, in a folder; without one given, in a scratch folder of this application.

    Opened on a folder that holds a store, it continues at the newest manifest.
    A batch is written whole before the manifest that names it, and manifests
    are never overwritten, so a lost executor or a broken write leaves the
    version before in force; of two writers of one version the second fails.
    """

    def __init__(self, spark: SparkSession, by: str, folder: str | None = None):
        self.spark, self.by = spark, by
        self.folder = folder or scratch(spark, "counts")
        self.version, self.batches, self.loads, self.kind = 0, [], [], "string"
        fs, path = hadoop_path(spark, f"{self.folder}/manifests")
        if fs.exists(path):
            for f in fs.listStatus(path):
                if (name := f.getPath().getName()).endswith(".json"):
                    self.version = max(self.version, int(name[:-5]))
        if self.version:
            text = "\n".join(r.value for r in spark.read.text(f"{self.folder}/manifests/{self.version:08d}.json").collect())
            self.batches, self.loads = json.loads(text)["batches"], json.loads(text)["loads"]

    def _commit(self, batches: list[dict], loads: list[str]) -> None:
        fs, path = hadoop_path(self.spark, f"{self.folder}/manifests/{self.version + 1:08d}.json")
        out = fs.create(path, False)  # fails if another writer was first
        out.write(bytearray(json.dumps({"batches": batches, "loads": sorted(loads)}), "utf-8"))
        out.close()
        self.version, self.batches, self.loads = self.version + 1, batches, sorted(loads)

    def _write(self, delta: DataFrame) -> str:
        name = uuid.uuid4().hex
        delta.write.parquet(f"{self.folder}/batches/{name}")
        return name

    def _batch(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/batches/{name}")

    def apply(self, table: DataFrame, columns: list[str]) -> list[str]:
        """Applies the deltas of the loads in `table` that aren't in force; their ids, as text."""
        self.kind = table.schema[self.by].dataType.simpleString()
        ids = [r[0] for r in table.where(F.col(self.by).isNotNull()).select(F.col(self.by).cast("string")).distinct().collect()]  # one row a load
        new = sorted(set(ids) - set(self.loads))
        if new:
            rows = table if len(new) == len(ids) else table.where(~F.col(self.by).cast("string").isin(sorted(set(ids) - set(new))))
            self._commit([*self.batches, {"name": self._write(value_counts(rows, columns, self.by)), "sign": 1}], [*self.loads, *new])
            if len(self.batches) > MANY:
                self.compact()
        return new

    def retract(self, loads: Iterable) -> list[str]:
        """Takes loads back by their deltas with the sign turned; the ids of those that were in force."""
        gone = sorted({str(x) for x in loads} & set(self.loads))
        if gone:
            back = self.deltas().where(F.col(self.by).cast("string").isin(gone)).withColumn("n", -F.col("n"))
            self._commit([*self.batches, {"name": self._write(back), "sign": -1}], [x for x in self.loads if x not in gone])
        return gone

    def deltas(self) -> DataFrame:
        """`by, column_name, x, value, decimals, form, n` of the loads in force. Loads are
        counted once each, so only after a retraction must batches be summed."""
        if not self.batches:
            return self.spark.createDataFrame([], f"{self.by} {self.kind}, column_name string, x double, value string, decimals tinyint, form string, n bigint")
        rows = reduce(DataFrame.unionByName, [self._batch(b["name"]) for b in self.batches])
        if all(b["sign"] > 0 for b in self.batches):
            return rows
        return rows.groupBy(self.by, *VALUE, *KEPT).agg(F.sum("n").alias("n")).where("n <> 0")

    def counts(self) -> DataFrame:
        """`column_name, x, value, decimals, form, n` over all loads in force."""
        return self.deltas().groupBy(*VALUE, *KEPT).agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> None:
        """Merges all batches into one and deletes what no longer counts: earlier batches and manifests."""
        if self.batches:
            self._commit([{"name": self._write(self.deltas()), "sign": 1}], self.loads)
        keep = {b["name"] for b in self.batches} | {f"{self.version:08d}.json"}
        for part in ("batches", "manifests"):
            fs, path = hadoop_path(self.spark, f"{self.folder}/{part}")
            for f in fs.listStatus(path) if fs.exists(path) else ():
                if f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)


def _present() -> Column:
    return F.col("x").isNotNull() | F.col("value").isNotNull()


def profile(counts: DataFrame, by: list[str]) -> DataFrame:
    """Exact metrics per `by` and column from counts: rows, missing, distinct,
    range of numbers or text, entropy in bits, most frequent value."""
    n = F.when(_present(), F.col("n"))
    shown = F.coalesce("value", F.col("x").cast("string"))
    agg = counts.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("n_present"), F.count(n).alias("n_distinct"),
        F.min("x").alias("min_number"), F.max("x").alias("max_number"), F.min("value").alias("min_text"), F.max("value").alias("max_text"),
        F.sum(n * F.log2(n)).alias("nlogn"), F.max(F.struct(n.alias("n"), F.when(_present(), shown).alias("v"))).alias("top"),
    )
    present = F.col("n_present")
    return agg.select(
        *by, "column_name", "n_rows", (F.col("n_rows") - present).alias("n_missing"), "n_distinct", "n_present", "min_number", "max_number", "min_text", "max_text",
        F.when(present > 0, F.log2(present) - F.col("nlogn") / present).alias("entropy"),
        F.col("top.v").alias("top_value"), F.col("top.n").alias("top_count"),
    )


def damaged_columns(deltas: DataFrame, by: str, z: float = 6.0, floor: float = 0.10, ks: float = 3.0, form_floor: float = 0.25) -> DataFrame:
    """`by, column_name, reasons` of the columns that depart, in one load, from
    the same column in the other loads.

    `deltas` are the counts of the loads in force (`ValueCountStore.deltas`).
    Every comparison is between a load and the sum of all loads less that load's delta.
    - missing: the missing share departs by more than `floor` and `z` binomial deviations;
    - coded: one value is more frequent by as much (a missing value coded as a
      number, a stuck value);
    - distinct: distinct values per present value depart by more than 0.15 from the median load;
    - distribution: of numbers and dates, the largest distance of the cumulated
      shares, at quantiles of the pooled values, exceeds `ks` / sqrt(n): a
      changed scale, sign, place or range of more than that share of the values;
    - form: the shares of written forms differ by more than `form_floor` in total variation.
    A load or column without values in the other loads is never a case; a single load has none.
    """
    key = [by, "column_name"]
    present = F.when(_present(), F.col("n")).otherwise(0)
    edges = deltas.where("x IS NOT NULL").groupBy("column_name").agg(F.percentile_approx("x", [i / GRID for i in range(1, GRID)], ACCURACY).alias("edges"))
    # One pass: per load and column the counts, the numbers of each form, the cumulated counts at the edges.
    forms, cells = [f"d{k}" for k in range(7)], [f"e{i}" for i in range(GRID - 1)]
    load = deltas.join(F.broadcast(edges), "column_name", "left").groupBy(*key).agg(  # one row a column
        F.sum("n").alias("n"), F.sum(present).alias("np"), F.count(F.when(_present(), 1)).alias("nd"), F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)).alias("nx"),
        *[F.sum(F.when(F.col("decimals") == k, F.col("n")).otherwise(0)).alias(d) for k, d in enumerate(forms)],
        *[F.sum(F.when(F.col("x") <= F.get("edges", F.lit(i)), F.col("n")).otherwise(0)).alias(e) for i, e in enumerate(cells)],
    )
    load = written(load.withColumn("ratio", F.when(F.col("np") > 0, F.col("nd") / F.col("np"))), "load-statistics")  # one row a load and column, asked for several times
    counted = ["n", "np", "nx", *forms, *cells]
    total = load.groupBy("column_name").agg(F.percentile("ratio", F.lit(0.5)).alias("usual"), *[F.sum(c).alias(f"t_{c}") for c in counted])
    # o_...: what all other loads have.
    base = load.join(F.broadcast(total), "column_name").select(*key, "nd", "ratio", "usual", *counted, *[(F.col(f"t_{c}") - F.col(c)).alias(f"o_{c}") for c in counted])  # one row a column

    def apart(share: Column, other: Column, count: Column) -> Column:
        p = F.least(F.greatest(other, F.lit(0.01)), F.lit(0.99))
        return F.abs(share - other) > F.greatest(F.lit(floor), z * F.sqrt(p * (1 - p) / count))

    def share(c: str, of: str) -> Column:
        return F.col(c) / F.nullif(F.col(of), F.lit(0))

    enough = F.col("np") >= 20
    shift = F.greatest(*[F.abs(share(e, "nx") - share(f"o_{e}", "o_nx")) for e in cells])
    # Total variation is the sum of the positive differences; forms the load lacks are negative ones.
    turned = reduce(Column.__add__, [F.greatest(share(d, "nx") - share(f"o_{d}", "o_nx"), F.lit(0.0)) for d in forms])
    first = base.select(*key, F.array_compact(F.array(
        F.when((F.col("o_n") > 0) & apart(1 - share("np", "n"), 1 - share("o_np", "o_n"), F.col("n")), "missing"),
        F.when(enough & (F.abs(F.col("ratio") - F.col("usual")) > 0.15), "distinct"),
        F.when((F.col("nx") >= 20) & (shift * F.sqrt("nx") > ks), "distribution"),
        F.when((F.col("nx") >= 20) & (turned > form_floor), "form"),
    )).alias("r")).where(F.size("r") > 0)

    # A value can only be too frequent with a share above the floor: at most 1 / floor values a load and column are looked up.
    sizes = broadcast_within(base.select(*key, "np", "o_np"), SMALL)
    often = deltas.where(_present() & (F.col("n") > floor * 20)).join(sizes, key).where(enough & (F.col("o_np") > 0) & (F.col("n") > floor * F.col("np"))).select(*key, "x", "value", "n", "np", "o_np")
    often = written(often, "frequent-values")
    same = lambda a, b: F.col(f"{a}.column_name").eqNullSafe(F.col(f"{b}.column_name")) & F.col(f"{a}.x").eqNullSafe(F.col(f"{b}.x")) & F.col(f"{a}.value").eqNullSafe(F.col(f"{b}.value"))
    sought = broadcast_within(often.select(*VALUE).distinct(), SMALL, often)
    found = deltas.alias("d").join(sought.alias("s"), same("d", "s"), "left_semi").groupBy(*VALUE).agg(F.sum("n").alias("sn"))
    own, other = F.col("n") / F.col("np"), (F.col("sn") - F.col("n")) / F.col("o_np")
    coded = (
        often.alias("o").join(found.alias("f"), same("o", "f")).select(*[F.col(f"o.{c}") for c in (*key, "n", "np", "o_np")], "sn")
        .where(apart(own, other, F.col("np")) & (own > other)).select(*key, F.array(F.lit("coded")).alias("r")).distinct()
    )

    shapes = deltas.where("value IS NOT NULL").groupBy(*key, "form").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("column_name", "form")))
    written_otherwise = (
        shapes.join(sizes, key).where(enough & (F.col("o_np") > 0)).groupBy(*key)
        .agg(F.sum(F.greatest(F.col("n") / F.col("np") - (F.col("all") - F.col("n")) / F.col("o_np"), F.lit(0.0))).alias("tv"))
        .where(F.col("tv") > form_floor).select(*key, F.array(F.lit("form")).alias("r"))
    )
    return (
        first.unionByName(coded).unionByName(written_otherwise)
        .groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("reasons"))
    )
