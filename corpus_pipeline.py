"""The corpus pipeline: stages over `documents`, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import keep, table
from docloom.llm.language_id import identify_languages
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.mixing import mix
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key() -> Column:
    """128 bits of all that a row holds, nulls and empty strings apart: equal rows share it, and rows without an id, or unlike texts of one id, are told apart."""
    return F.md5(F.to_json(F.struct("doc_id", "text", "lang", "source")))


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: no letters, or unlike every language."""
    return identify_languages(docs.select(*COLUMNS)).where("not rejected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more unlike texts share go; documents stay, so that copies are left to near_dedup."""
    # equal texts count as one document: copies must not make each other's lines common
    return _documents(dedup_lines(docs.select(*COLUMNS), by=F.xxhash64(F.coalesce("text", F.lit("")))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; rows without doc_id stand alone and stay."""
    rows = keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    known = rows.where("doc_id is not null")
    groups = near_duplicates(known.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = known.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row"))
    kept = known.join(first.select("_row"), "_row", "left_semi")
    return kept.select(*COLUMNS).unionByName(rows.where("doc_id is null").select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: a document stays as many times as the mix takes it."""
    rows = docs.select(*COLUMNS, _key().alias("_key"))
    # rows of one key are equal in all columns: one of them stands for the copies of all
    copies = mix(rows, carry=("_key",)).where("copies > 0").groupBy("_key").agg(F.sum("copies").cast("int").alias("copies"))
    taken = rows.join(copies, "_key").dropDuplicates(["_key"])
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces placed in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("pack", pack)]
#: Minima of hashes, trained models and a subset-sum search are not for SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each from the table that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
