"""Best-fit packing of tokenised documents by minimum bin slack.

Pieces of at most CAPACITY tokens are packed by their lengths alone, so the plan needs only how many pieces have each
length: at most CAPACITY numbers, whatever the corpus. For each bin, the longest piece left is placed and a bitset of
reachable sums over the lengths available gives the fullest feasible combination; it is removed as often as the counts
allow. Pieces then find their place by their rank among those of equal length, which is counted in salted cells.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, slices, table
from .token_counts import tokenizer_path

CAPACITY, END = 4096, 1
#: Pieces of one length that are ranked in one cell, about.
CELL = 1000
#: Words that a worker remembers, and the longest one remembered.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of text tokenised together: each word is looked at once in them.
SLICE = 3 << 20
_tokenizers: dict[str, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _tokenizer(path: str) -> tuple:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path), {"": b""}
    return _tokenizers[path]


#: Letters and the ASCII marks behind them: the tokenizer parts them, unless the marks hold an apostrophe.
_TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")


def _parts(word: str) -> tuple[str, str]:
    """A word's letters, those below U+0250 in lower case as the tokenizer has them, and the marks behind; (word, '') if it is of another kind."""
    m = _TAILED.fullmatch(word)
    stem, tail = m.groups() if m else (word, "")
    if stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and "\u0130" not in stem)):
        return stem.lower(), tail
    return word, ""


def _encode(tok, words: list[str]) -> Iterator[bytes]:
    """The ids of each word as little-endian 32-bit bytes. A word of letters is one pre-token: its merges are run directly."""
    import unicodedata

    merge = tok.model.tokenize
    for w in words:
        if w.isalpha() and (w.isascii() or max(w) < "\u0250") and w == w.lower():
            if not w.isascii():
                w = unicodedata.normalize("NFC", w).encode().decode("latin-1").translate(_LETTERS)
            ids = [t.id for t in merge(w)]
        else:
            ids = tok.encode(w, add_special_tokens=False).ids
        yield struct.pack(f"<{len(ids)}I", *ids)


def _pieces(name: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = _tokenizer(tokenizer_path(name))
        last = np.array([end], "<u4").tobytes()
        for b in slices(batches, "text", SLICE):
            # the tokenizer drops white space and merges nothing across it
            docs = [(t or "").replace("\n", " ").split(" ") for t in b.column("text").to_pylist()]
            new = set().union(*docs) - known.keys()
            if new:
                parted = {w: p for w in new if (p := _parts(w))[0] != w}
                todo = [*(set().union(*parted.values()) - known.keys() - new), *(new - parted.keys())]
                known.update(zip(todo, _encode(tok, todo), strict=True))
                for w, (stem, tail) in parted.items():
                    known[w] = known[stem] + known[tail] if tail else known[stem]
                new.update(todo)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, words in enumerate(docs):
                data = b"".join(map(known.__getitem__, words)) + last
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            # the words of the first batches are the frequent ones: those stay, and later ones only while there is room
            full = len(known) > REMEMBERED
            for w in new:
                if full or len(w) > LONGEST:
                    known.pop(w, None)
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return run


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's token ids and `end`, cut into pieces of `capacity`: doc_id, piece, start, length, ids_crc32 (and ids).

    A null text is empty and has one piece, `end` alone; repeated rows have pieces each; a null doc_id is passed through.
    """
    ids = ", ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, capacity, end, with_ids), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}")


def fullest(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """How many of which lengths fill most of `room`; lengths: those in counts, longest first.

    Bit s of `reach` says that a sum of s can be reached; stops when `room` is.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for x in lengths:
        if x > room:
            continue
        n, k = min(counts[x], room // x), 1
        while n > 0:
            k = min(k, n)
            steps.append((x, k, reach))
            reach |= (reach << (x * k)) & mask
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> total & 1:
            used[x] = used.get(x, 0) + k
            total -= x * k
    return used


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies per bin, first bin, offset): where the pieces of each length go, by rank."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    given: dict[int, int] = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = fullest(counts, capacity - top, lengths)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[x] // k for x, k in used.items())
        offset = 0
        for x, k in sorted(used.items(), reverse=True):
            rows.append((x, given[x], k, bins, offset))
            given[x] += k * times
            counts[x] -= k * times
            offset += x * k
        bins += times
        if any(not counts[x] for x in used):
            lengths = [x for x in lengths if counts[x]]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(plan: np.ndarray):
    key = (plan[:, 0] << 48) | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = plan[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
            nth = rank - at[:, 1]
            b = b.drop_columns(["rank"])
            b = b.append_column("sequence_id", pa.array(at[:, 3] + nth // at[:, 2]))
            yield b.append_column("offset", pa.array(at[:, 4] + nth % at[:, 2] * length))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length up to capacity, other columns) with sequence_id and offset; no rows, no sequences.

    Only the counts by length come to the driver: `capacity` rows at most. The pieces of one length are ranked in as many
    cells as its count asks for, so no task sorts a share of the input. Columns named like the new ones are replaced.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    # the pieces travel as one column, so that no name can clash
    pieces = pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("length").cast("long").alias("length"))
    pieces = keep(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = packing_plan(histogram, capacity)
    listed = json.dumps([-(-histogram.get(x, 1) // CELL) for x in range(capacity + 1)])
    cells_of = F.get(F.from_json(F.lit(listed), "array<bigint>"), F.col("length").cast("int"))
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("row"), cells_of))
    cells = pieces.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = keep(cells.select("length", "cell", F.coalesce(before, F.lit(0)).alias("before")), "piece-cells")
    nth = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row.doc_id", "row.piece"))
    ranked = pieces.withColumn("nth", nth).join(cells, ["length", "cell"]).select("row", "length", (F.col("before") + F.col("nth") - 1).alias("rank"))
    placed = ranked.mapInArrow(_placed(plan), f"row {ranked.schema['row'].dataType.simpleString()}, length long, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Tokenise, cut and pack docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, **how))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
