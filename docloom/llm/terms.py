"""Terms of texts as 64-bit hashes, and the packed arrays of the inverted indexes.

A term is a maximal run of digits, letters and characters beyond ASCII, with A-Z lower-cased: of UTF-8 bytes, those that
are none of the other ASCII characters. Terms stand in the indexes as hashes; among a billion terms, one that is not
asked for has the hash of one of ten thousand that are with probability about 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .near_dedup import word_hashes

#: Bytes that part terms.
BETWEEN = np.ones(256, bool)
BETWEEN[128:] = False
for _first, _last in ("09", "AZ", "az"):
    BETWEEN[ord(_first) : ord(_last) + 1] = False
#: Terms of the queries that are told to every task at once, about.
BLOCK = 500_000


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts on end, and the n + 1 offsets of the texts among them; a null has none."""
    return word_hashes(*text_bytes(texts), between=BETWEEN)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Number of terms of each text."""
    raw, offsets = text_bytes(texts)
    inside = ~BETWEEN[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = inside[first]
    return np.diff(np.concatenate([[0], np.cumsum(opens)])[offsets])


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, after one byte that tells how many."""
    kind = np.min_scalar_type(int(numbers.max())) if len(numbers) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (size[i] of them), for each i on end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - size), size)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        h, at = term_hashes(b.column("text"))
        terms = [h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(terms, pa.binary())], names=["item", "terms"])


def query_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows of items (item, text) in blocks of about `block` terms, or one longer row: their item values and hashed terms.

    Of the queries one block at a time comes to the driver, to be told to all tasks.
    """
    kind = items.schema["item"].dataType.simpleString()
    names, terms, n = [], [], 0
    for item, raw in items.select("item", F.col("text").cast("string")).mapInArrow(_hashed, f"item {kind}, terms binary").toLocalIterator():
        names.append(item)
        terms.append(np.frombuffer(bytes(raw), np.uint64))
        n += len(terms[-1])
        if n >= block:
            yield names, terms
            names, terms, n = [], [], 0
    if names:
        yield names, terms
