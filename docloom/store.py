"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

#: Rows of a table that one task sorts or groups.
TASK_ROWS = 500_000

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder. A temporary folder stands in under a local master only."""
    sc = ship(spark).sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-docloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    return kept


def partitions(spark: SparkSession, rows: int) -> int:
    """How many partitions a table of so many rows is dealt to: the session's shuffle partitions, or one for each TASK_ROWS rows if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by hash of keys, so that the windows and groups by them that follow need no exchange; a task's share stays the same however many rows there are."""
    return df.repartition(partitions(df.sparkSession, rows), *keys)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*kept: DataFrame) -> None:
    """Remove tables of keep() that nothing reads any more."""
    for df in kept:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has kept; DataFrames that read it are of no use afterwards."""
    delete(spark, _root(spark))
