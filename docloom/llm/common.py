"""What the corpus operators share: tables, text rules, Arrow text batches and membership maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..store import drop, keep, new_path

__all__ = ["ascii_lower", "drop", "keep", "member_hash", "members", "membership", "new_path", "runs", "slices", "table", "text_bytes", "trim"]

#: ASCII white space, as every word and line rule here has it.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() does the same to ASCII text, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def trim() -> None:
    """Give freed memory back to the system: Spark keeps its workers, and the next stage's need is another."""
    import contextlib
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` (strings) holds about max_bytes in each; a longer single text stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array on end, and the n + 1 offsets of its texts (a null counts as empty)."""
    filled = pc.fill_null(texts, "").cast(pa.large_binary())
    filled = pa.concat_arrays([filled])  # offsets from 0
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows, sorted by integer `keys`, that follow each other in a partition's batches; one group is in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        cut = np.concatenate([[0], cut, [b.num_rows]])
        if held and tuple(k[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            held.append(b.slice(x, y - x))
            if y < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(k[:, -1])
    if held:
        yield pa.Table.from_batches(held)


#: Fewest and most bits of a membership map: 16 for each id, so about 1 in 16 others passes; the most are for 8 million ids.
MAP_BITS = 1 << 15, 1 << 27


def membership(ids: DataFrame, n: int) -> np.ndarray:
    """A bitmap over hashes of n ids (one long column): what is told to every task instead of a join. 16 MB at most."""
    low, high = MAP_BITS
    bits = min(high, max(low, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits)) + 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p"))).collect()
    out = np.zeros(bits // 8, np.uint8)
    for k, part in rows:
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    return out


def member_hash(column: str, bitmap: np.ndarray) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(8 * len(bitmap)))


def members(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bitmap[hashes >> 3] >> (hashes & 7).astype(np.uint8) & 1).astype(bool)
