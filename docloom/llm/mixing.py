"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document expects target / source size copies. Documents stand in a fixed order, by classes of size;
one random offset per source is added to the prefix sum of expected copies, and a document is taken once for each integer
that the sum passes in it. So a source takes its target to within about its longest document, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keep, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Cells in which the documents of one source and class of size are ranked.
CELLS = 64
SEED = "mix-1"
RESULT = ("doc_id", "size", "source_size", "target", "taken", "copies")


def numbered(df: DataFrame, *order, to: str = "number") -> DataFrame:
    """df with its rows numbered from 0 in `order`, by ranges: no task sorts more than its own range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = keep(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in held.groupBy("_range").count().collect())  # a row per range: `parts` at most
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    start = F.lit(0).cast("long")
    if offsets:
        start = F.element_at(F.create_map(*[F.lit(x) for k, n in offsets for x in (k, n)]), F.col("_range")).cast("long")
    return held.withColumn(to, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + start).drop("_range")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target: all sizes shared by weight, none above `most` times its source's size.

    Sources by code point, null last, take the weights in turn. What goes over a source's limit is shared again by
    weight; each round needs two sums, and rounds end when no further source reaches its limit.
    """
    s = numbered(sizes, F.col("source").asc_nulls_last()).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    s = keep(s.drop("number"), "sources")
    level, seen = 0.0, -1
    while True:
        limited = F.col("weight") * F.lit(level) > most * F.col("source_size")
        total, held, free, n = s.agg(F.sum("source_size"), F.sum(F.when(limited, most * F.col("source_size")).otherwise(0)), F.sum(F.when(limited, 0).otherwise(F.col("weight"))), F.count_if(limited)).first()
        if n == seen or not free:
            break
        level, seen = float(total - held) / float(free), n
    return s.withColumn("target", F.when(limited, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level)))


def size_class(size):
    """Number of digits and the first two digits: grows with size, at most 90 classes per power of ten."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def _cell() -> Column:
    """A row's cell by a hash of its id, or of its text without one, so that ids of any pattern spread."""
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("n"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % CELLS


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, carry: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs (doc_id, text, source; others are ignored).

    size is the number of words `[^\\x20\\x09-\\x0D]+` (null text: 0); taken = size * copies. A null source is a source of
    its own. Sources without words have target 0 and give nothing. Repeated rows are documents each; a null doc_id is
    placed by its text. An empty table gives no rows. The columns `carry` are passed through and order rows of one id and
    size; one with the name of a result column comes back with `_in` behind its name.
    """
    carried = [f"_carry{i}" for i in range(len(carry))]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), _cell().alias("cell"), *[F.col(f"`{c}`").alias(x) for c, x in zip(carry, carried, strict=True)])
    sized = sized.withColumns({"key": F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("n")), "class": size_class(F.col("size"))})
    sized = keep(sized, "sized")
    cells = sized.groupBy("key", "source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    cells = keep(cells, "size-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("n"))).select("key", "source_size", "target")
    # a source has 64 cells for each class at most: a bounded window
    before = F.sum("n").over(Window.partitionBy("key").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("key", "class", "cell", F.coalesce(before, F.lit(0)).alias("before")).join(targets, "key")
    nth = F.row_number().over(Window.partitionBy("key", "class", "cell").orderBy("size", "doc_id", *carried))
    rows = sized.withColumn("nth", nth).join(cells, ["key", "class", "cell"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumns({"rate": rate, "offset": offset, "rank": F.col("before") + F.col("nth")})
    copies = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"), *[F.col(x).alias(f"{c}_in" if c in RESULT else c) for c, x in zip(carry, carried, strict=True)])


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('s:' || source, 'n') AS key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'n' || coalesce(text, ''))), 1, 8))::BIGINT % 64 AS cell
  FROM documents),
sources AS (
  SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sources),
ordered AS (
  SELECT *, row_number() OVER w AS k,
         sum(3 * source_size) OVER (w ROWS UNBOUNDED PRECEDING) - 3 * source_size AS held,
         sum(weight) OVER () - (sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) - weight) AS free,
         sum(source_size) OVER () AS total
  FROM weighed WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, key)),
leveled AS (SELECT *, (total - held)::DOUBLE / free::DOUBLE AS level FROM ordered),
chosen AS (SELECT level FROM leveled WHERE NOT weight * level > 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT key, source_size, CASE WHEN weight * chosen.level > 3 * source_size THEN (3 * source_size)::DOUBLE
         ELSE weight * chosen.level END AS target FROM weighed, chosen),
ranked AS (
  SELECT s.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.key ORDER BY length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT, cell, size, doc_id) AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || s.key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM sized s JOIN targets t ON s.key = t.key),
taken AS (SELECT *, (floor(rank * rate + start) - floor((rank - 1) * rate + start))::BIGINT AS copies FROM ranked)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies::INT AS copies FROM taken
"""
