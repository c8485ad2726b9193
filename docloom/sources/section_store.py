"""Entries stored by section, so that a choice of sections reads their files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def write_by_section(entries: DataFrame, path: str) -> None:
    """Entries under path, a folder for each section; within one, files of ranges of documents, as many as Spark finds its rows worth."""
    entries.hint("rebalance", "section").sortWithinPartitions("section", "doc_id", "pos").write.partitionBy("section").parquet(path)


def read_sections(spark: SparkSession, path: str, sections: list[int] | DataFrame | None = None) -> DataFrame:
    """The entries of some sections: a list prunes folders when the query is planned, a DataFrame (section) when it runs.

    What a DataFrame of sections holds is known only then; its distinct values from 0 to 16, 17 rows at most, are told to
    all tasks, and Spark reads the folders that they name.
    """
    entries = ship(spark).read.parquet(path)
    if sections is None:
        return entries
    if isinstance(sections, list):
        return entries.where(F.col("section").isin(*sections))
    wanted = sections.select(F.col("section").cast("int").alias("section")).where("section BETWEEN 0 AND 16").distinct()
    return entries.join(F.broadcast(wanted), "section", "left_semi")
