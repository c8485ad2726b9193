"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame operations only.

A sketch is the sorted K least distinct hashes (64 bits, signed order) of a text's five-word shingles; words are runs of
`[^\\x20\\x09-\\x0D]` with A-Z in lower case, and a text of one to four words is one shingle. Sketches of parts merge into
the sketch of the whole. A fingerprint is the sketch as text: 16 hex digits for each hash, one after another.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, ascii_lower, table

K = 128
SHINGLE = 5
#: Bytes of text in a bucket in which neighbours are found, about, and the most buckets: beyond, buckets grow with the input.
BUCKET, BUCKETS = 4 << 20, 100_000


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def shingle_hashes(text: Column) -> Column:
    """The hashes of a text's shingles in order, repeats included; an empty array without words."""
    words = F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(WORD_PATTERN), F.lit(0)), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        # one pass: a hash of each word with those after it; the last ones have too few
        each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
        return F.slice(each, 1, F.size(w) - (SHINGLE - 1))

    whole = lambda w: F.array(F.aggregate(w, F.size(w).cast("long"), _pair))
    pick = lambda w: F.when(F.size(w) >= SHINGLE, shingles(w)).when(F.size(w) > 0, whole(w)).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(words), pick), 1)


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit(""))))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets; 1 for two empty ones."""
    both = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return F.element_at(F.transform(F.array(merged(a, b, k)), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both(u))), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range below the k-th."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; null if a has none."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.least(F.lit(1.0), F.try_divide(resemblance(a, b, k) * union, distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_sketches(df: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from those of its parts: their hashes are aggregated, so no task holds a group's sketches."""
    h = df.select(key, F.explode(column).alias("h")).distinct()
    ranked = h.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def _key() -> Column:
    """A row's place in the order of rows: doc_id, nulls first, then its text."""
    return F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))


def _bucket(lows: Column, n: int, key: Column) -> Column:
    """The last of n sorted `lows` that is not above key, by binary descent: log2(n) steps for a row."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(n - 1, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & (F.get(lows, at + step) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) with sketch, next_text and next_sketch, of the next row by doc_id; the last row's next is the first.

    Rows of one doc_id, or without one (these come first), are in order of a hash of their texts. Keys alone are dealt
    into ranges, and the least key of each is told to all tasks: one for every bucket_bytes of text, BUCKETS at most.
    Then the texts are shuffled once: each range also gets the first row of the next one, so that neighbours are found
    within a range. Rows equal in id and text share a range.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = min(BUCKETS, max(1, -(-size // bucket_bytes)))
    keys = docs.select(_key().alias("k")).repartitionByRange(cuts, "k")
    rows = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).select("k.d", "k.h").collect()
    found = sorted(((r.d, r.h) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) or [(None, 0)]
    n = len(found)
    # text that the optimizer makes one constant array, not an expression for each bound
    listed = json.dumps([{"d": d, "h": h} for d, h in found])
    lows = F.from_json(F.lit(listed), "array<struct<d:bigint,h:bigint>>")
    dealt = docs.select("doc_id", "text", _key().alias("key")).withColumn("bucket", _bucket(lows, n, F.col("key")))
    first = F.get(lows, F.col("bucket")).eqNullSafe(F.col("key"))
    copies = F.when(first, F.array("bucket", F.pmod(F.col("bucket") - 1, F.lit(n)))).otherwise(F.array("bucket"))
    held = dealt.select("doc_id", "text", F.posexplode(copies).alias("ghost", "bucket"))
    held = held.repartition(n, "bucket").withColumn("sketch", sketch(F.col("text")))
    after = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    held = held.withColumns({"next_text": F.lead("text").over(after), "next_sketch": F.lead("sketch").over(after)})
    return held.where("ghost = 0").drop("ghost", "bucket")


def fingerprint_documents(docs: DataFrame, k: int = K, edit: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_distinct per row.

    The edited text has the last 1/edit of the code points replaced by as many first ones of the next text, or all that
    this has. A null text is empty; two empty texts are alike (1), an empty and another are not (0). A null doc_id comes
    first; rows with equal ids are ordered by text; one row is its own next. No rows, no result rows.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = with_next(d).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / edit).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    d = d.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), distinct_shingles(F.col("sketch"), k).alias("n_distinct"),
    )


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
