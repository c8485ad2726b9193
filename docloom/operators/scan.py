"""State that runs through a document in order: the last value so far, or the sum so far, also for documents of any length.

As windows over a document's rows, one document is one task. chunked() cuts a table into ranges of (keys, order) instead, one
for each partition, so that a long document lies in many; carried() then works in two levels: each chunk is summed up in
one row, the few rows of a document are scanned, and what the chunks before give goes into each chunk's own window. The
operators call carried() only, so each runs either way: on chunked(rows) as on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store

CHUNK = "_chunk"


def chunked(rows: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """rows with _chunk, the number of their range in `order` (document first); kept in the shared folder, so that the ranges stay."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store.keep(rows.drop(CHUNK).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _same(names: list[str]) -> Column:
    """Null-safe equality of l's and r's columns."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return out


def carried(rows: DataFrame, keys: list[str], order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, own: bool = True, back: bool = False) -> DataFrame:
    """rows with a column for each name: the last value that is not null, or the sum, of the rows so far within keys.

    own: a row's own value counts. back: the rows after instead of those before, so the next value. Sums of nothing are 0. In
    a chunked table the order must be that of the chunks within each of the keys.
    """
    last, sums = last or {}, sums or {}
    way = (lambda c: F.col(c).desc()) if back else F.col
    local = Window.partitionBy(*keys, *[c for c in (CHUNK,) if c in rows.columns]).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if CHUNK not in rows.columns:
        zero = {n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()}
        return rows.withColumns({n: F.last(c, ignorenulls=True).over(local) for n, c in last.items()} | zero)
    group = [*keys, CHUNK]
    # of a whole chunk what its end knows: the value at the greatest place, from behind at the least
    ends = [(F.min_by if back else F.max_by)(c, F.when(c.isNotNull(), F.struct(*order))).alias(n) for n, c in last.items()]
    chunks = rows.groupBy(*group).agg(*ends, *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(way(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*group, *[F.last(n, ignorenulls=True).over(before).alias(f"_in_{n}") for n in last], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_in_{n}") for n in sums])
    # one exchange by keys and chunk serves the join and the windows
    x = rows.alias("l").join(carry.alias("r"), _same(group)).select("l.*", *[f"r._in_{n}" for n in (*last, *sums)])
    new = {n: F.coalesce(F.last(c, ignorenulls=True).over(local), F.col(f"_in_{n}")) for n, c in last.items()}
    new |= {n: F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_in_{n}") for n, c in sums.items()}
    return x.withColumns(new).drop(*[f"_in_{n}" for n in (*last, *sums)])


def beside(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], back: bool = False) -> DataFrame:
    """rows with a column for each name: the value of the row before within keys, or after (back); null without one."""
    if CHUNK not in rows.columns:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({n: (F.lead if back else F.lag)(c).over(w) for n, c in values.items()})
    # a struct is never null, so the last one is that of the row beside
    held = carried(rows, keys, order, {"_beside": F.struct(*[c.alias(n) for n, c in values.items()])}, own=False, back=back)
    return held.withColumns({n: F.col("_beside")[n] for n in values}).drop("_beside")

