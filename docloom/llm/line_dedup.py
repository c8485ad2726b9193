"""Lines that many documents share, by levelled sorted runs of line hashes; DataFrame operations only.

The documents' line keys are hashed to 128 bits and dealt into batches, more of them for more text. A batch is first
counted, one row for each key and the documents that hold it, so that a line of a third of all documents meets no task as
more than a few rows; by a merge anti-join against the settled runs it then drops the keys already known to be common,
and adds the rest as a sorted run of its own. When a level has FANOUT runs they are compacted into one of the next level,
and keys that have reached `min_docs` there move to a settled run. A last compaction of all levels settles the rest. Runs
are bucketed and sorted by key, all alike: compactions and anti-joins shuffle no run again. Only settled runs can
take keys from a batch, since the counts of all other keys must still grow.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, new_path, table

FANOUT = 2
#: Bytes of text in a batch, about; fewest and most batches.
BATCH, LEAST, MOST = 4 << 30, 4, 16
#: Bytes of text behind a bucket of the runs, at most: buckets are no fewer than shuffles have partitions, and grow with the text.
BUCKET = 2 << 30
#: Most keys that are told to every task, those of the largest share of lines.
HOT = 10_000


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, n_lines) in levels, and the settled runs of keys in at least min_docs documents."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT, text_bytes: int = 0):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path, self.name = new_path(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // BUCKET))
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self._made = 0

    def _write(self, df: DataFrame, kind: str) -> DataFrame:
        self._made += 1
        run = f"{self.name}_{self._made}"
        held = df.select("h1", "h2", "n_docs", "n_lines").write.option("path", f"{self.path}/{kind}-{self._made}")
        held.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(run)
        kept = self.spark.table(run)
        self.spark.sql(f"DROP TABLE {run}")  # the catalog lets go of it; the files stay with their reader
        return kept

    def common(self) -> DataFrame:
        """Keys that are settled, and the lines counted until then."""
        return reduce(DataFrame.unionByName, self.settled).groupBy("h1", "h2").agg(F.sum("n_lines").alias("n_lines"))

    def others(self) -> DataFrame:
        """What the levels hold: keys that are not settled, or were counted before or beside the run that settled them."""
        return reduce(DataFrame.unionByName, [r for level in self.levels for r in level])

    def add(self, keys: DataFrame) -> None:
        """One batch of (doc_id, h1, h2), whole documents at a time; lines without doc_id count as lines only."""
        counted = keys.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.sum("n").alias("n_lines"))
        # n_lines is in the condition to hold the join above the count: on the keys alone, the optimizer moves it below, to the lines
        for run in self.settled:
            known = run.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")).hint("merge")
            counted = counted.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n_lines") > 0), "left_anti")
        self._push(0, self._write(counted, "run-0"))

    def _push(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._settle(self.levels[level], level + 1)
            self.levels[level] = []
            self._push(level + 1, merged)

    def _settle(self, runs: list[DataFrame], level: int) -> DataFrame:
        """Merge runs; a key that has its documents moves to the settled runs."""
        both = reduce(DataFrame.unionByName, runs)
        merged = self._write(both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines")), f"run-{level}")
        self.settled.append(self._write(merged.where(F.col("n_docs") >= self.min_docs), "settled"))
        return merged.where(F.col("n_docs") < self.min_docs)

    def compact(self) -> None:
        """Merge all levels into one run."""
        self.levels = [[self._settle([r for level in self.levels for r in level], len(self.levels))]]


def _dealt(lines: DataFrame, batches: int) -> DataFrame:
    """lines with a batch for each document, written so that a batch is read alone."""
    path = new_path(lines.sparkSession, "lines")
    lines = lines.withColumn("batch", F.pmod(F.xxhash64("by", F.lit(1)), F.lit(batches)).cast("int"))
    lines.write.partitionBy("batch").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = FANOUT, by: Column | None = None) -> DataFrame:
    """Every column of docs (doc_id, text and others), with `text` less its common lines, and n_lines and n_dropped.

    A line's key is `line_key`; keys of min_chars code points or more that stand in min_docs documents or more lose all
    their lines in all documents. A null or empty text is one empty line; its text becomes ''. Rows with one doc_id are
    one document when documents are counted, and each row keeps its own lines. A null doc_id counts for no document but
    loses common lines as others do. With `by` (over doc_id and text), rows of one value of it are one document instead.
    `batches` is by default one for each BATCH bytes of text, from LEAST to MOST. An empty table gives no rows. Columns
    named like n_lines and n_dropped are replaced; others may have any name.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    # all other columns travel as one, so that no name can clash; unlike texts of one id are told apart by the text itself
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("other"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches or min(MOST, max(LEAST, -(-text_bytes // BATCH)))
    lines = rows.select("doc_id", "row", (F.col("doc_id") if by is None else by).alias("by"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.length("key") >= min_chars)
    lines = _dealt(lines.select("doc_id", "row", "by", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")), batches)
    runs = LineRuns(spark, min_docs, fanout, text_bytes)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select(F.col("by").alias("doc_id"), "h1", "h2"))
    runs.compact()
    common, uncommon = runs.common(), runs.others()
    # keys of so many lines are HOT at most, common or not (the lines of one document's copies are not): told to every task,
    # they need no shuffle. A settled key's lines are counted in its own batches only: no key beyond them has a large share
    often = F.col("n_lines") >= -(-lines.count() // HOT)
    frequent = common.where(often).select("h1", "h2", F.lit(True).alias("hot"))
    spared = uncommon.where(often).select("h1", "h2", F.lit(False).alias("hot")).join(common.select("h1", "h2"), ["h1", "h2"], "left_anti")
    hot = lines.join(F.broadcast(frequent.unionByName(spared)), ["h1", "h2"], "left")
    rest = hot.where("hot is null").join(common.where(~often).select("h1", "h2"), ["h1", "h2"])
    place = ["doc_id", "row", "pos"]
    dropped = hot.where("hot").select(*place).unionByName(rest.select(*place)).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop"))
    dropped = dropped.select(F.col("doc_id").alias("doc"), F.col("row").alias("of"), "drop")
    out = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("of")), "left").withColumn("parts", F.split("text", "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(parts) - 1), drop), i -> parts[i]), '\\n')")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text")
    columns = [text if c.lower() == "text" else F.col(f"other.`{c}`") for c in docs.columns if c in others or c.lower() == "text"]
    return out.select(*columns, F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT lines.*, common.key IS NOT NULL AS gone FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
