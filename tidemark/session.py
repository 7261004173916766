"""Session settings: where lineage is cut, and what may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the session's setting of `spark.checkpoint.dir`.
    Where it is unset, a temporary folder is made if everything runs inside one
    process (master `local`); on any other master executors would each write to
    a disk of their own, so it raises."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share; master is {context.master}")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[context.applicationId]


def hadoop_path(spark: SparkSession, folder: str):
    """(file system, path) of a folder, in the JVM."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends, or by `drop_written`."""
    folder = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    fs, path = hadoop_path(spark, folder)
    fs.deleteOnExit(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes `df` as a table in a scratch folder and reads it back."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_WRITTEN: dict[str, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Deletes the scratch folders of this application; how many there
    were. Only for when no DataFrame built on them is needed any more."""
    folders = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        fs, path = hadoop_path(spark, folder)
        fs.delete(path, True)
    return len(folders)


def broadcast_within(df: DataFrame, max_rows: int, bound: DataFrame | None = None) -> DataFrame:
    """Marks `df` for broadcast only if it has at most `max_rows` rows; otherwise
    the join stays with the planner. Counted is `bound` if given, a table that
    is cheaper to count and can't have fewer rows; never more than `max_rows` + 1 are read."""
    counted = df if bound is None else bound
    return F.broadcast(df) if counted.limit(max_rows + 1).count() <= max_rows else df
