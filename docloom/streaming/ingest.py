"""Incremental ingest of a folder: new files are decoded as they come, each batch replaces its documents' records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources import docx


def ingest(spark: SparkSession, path: str, to: str, checkpoint: str) -> None:
    """Decode the files that came since the last call, and write their records under `to`, one folder per batch.

    A batch that runs again overwrites its own folder, so records are never doubled.
    """
    files = ship(spark).readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.docx").load(path)
    name = F.substring_index("path", "/", -1)
    files = files.select(F.col("path").alias("doc_id"), name.alias("file_name"), F.col("modificationTime").alias("at"), "content").where(~F.col("file_name").startswith("~$") & ~F.col("file_name").startswith("%7E$"))

    def batch(df: DataFrame, epoch: int) -> None:
        at = df.select("doc_id", "at")
        docx.decode(df).join(at, "doc_id").write.mode("overwrite").parquet(f"{to}/batch={epoch}")

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, to: str) -> DataFrame:
    """The records of each document's latest batch."""
    records = spark.read.parquet(to)
    last = records.groupBy("doc_id").agg(F.max(F.struct("at", "batch"))["batch"].alias("batch"))
    # what is grouped is ids only, and the joined side has a row for each document
    return records.join(last, ["doc_id", "batch"], "left_semi").drop("batch", "at")
