"""Sources and sinks: parquet and CSV tables, JSON manifests."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import hadoop_path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> str:
    path = f"{folder}/{name}.parquet"
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_manifest(path: str, facts: dict) -> dict:
    """Writes `facts` and the time of writing as JSON, whole or not at all."""
    facts = facts | {"generated_utc": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    with open(f"{path}.part", "w") as f:
        json.dump(facts, f, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.part", path)
    return facts


def ensure_folders(spark: SparkSession, base: str, *names: str) -> list[str]:
    """Makes the folders below `base` that don't exist, on whatever file system it names; their paths."""
    out = []
    for name in names:
        fs, path = hadoop_path(spark, f"{base}/{name}")
        fs.mkdirs(path)
        out.append(path.toString())
    return out
