"""Benchmark decontamination by a distributed positional inverted index.

Training texts are indexed where they are read: every segment of some 8 MB of text holds its terms in order of their
hashes, and for each term the places where it stands among the segment's words, so the index takes no shuffle and grows
with the text. Phrases come in blocks that are told to every task. In a segment a phrase's lists are intersected from its
rarest term on: each place of that term, less the term's offset in the phrase, is a candidate start, and each further
term keeps those starts at whose offset it stands. Texts of any length can be searched: one that is longer than a segment
lies in several, which overlap by the longest phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, table
from .terms import pack, query_blocks, ranges, term_hashes, unpack

WINDOW = 10
#: Words of a segment, and of the longest phrase that is found where a text is cut.
SEGMENT, LONGEST = 1_300_000, 64
#: Candidate starts that are followed at once.
AT_ONCE = 200_000
SCHEMA = "rows array<long>, doc_ids array<long>, n_words array<long>, firsts array<long>, bases array<long>, terms binary, counts binary, places binary"


def _segment(docs: list[tuple], words: list[np.ndarray]) -> pa.RecordBatch:
    """One row of the index: docs are (row, doc_id, n_words, base), each with the hashes of its words from base on."""
    sizes = np.array([len(w) for w in words])
    h = np.concatenate([*words, np.zeros(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    row, doc_id, n, base = zip(*docs, strict=True)
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (row, doc_id, n, np.cumsum(sizes) - sizes, base)]
    packed = [pa.array([x], pa.binary()) for x in (h[new].tobytes(), pack(np.diff(new, append=len(h))), pack(order))]
    return pa.RecordBatch.from_arrays([*lists, *packed], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _indexed(segment: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, held = [], [], 0
        for b in slices(batches, "text"):
            h, at = term_hashes(b.column("text"))
            for row, doc_id, x, y in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                base, size = 0, y - x
                while True:  # a longer text is cut, each part with the words of the longest phrase before it
                    part = h[x + base : min(y, x + base + segment)]
                    docs.append((row, doc_id, size, base))
                    words.append(part.copy())
                    held += len(part) + 1
                    if held > segment:
                        yield _segment(docs, words)
                        docs, words, held = [], [], 0
                    if base + segment >= size:
                        break
                    base += segment - longest + 1
        if docs:
            yield _segment(docs, words)

    return run


def build_index(docs: DataFrame, segment: int = SEGMENT, longest: int = LONGEST) -> DataFrame:
    """The positional index of docs (doc_id, text; others are ignored), a row for each segment; kept in the shared folder.

    Every row is a document of its own, whatever its doc_id; null and empty texts have no words.
    """
    if longest > segment:
        raise ValueError("a segment must hold the longest phrase")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(rows.mapInArrow(_indexed(segment, longest), SCHEMA), "positions")


def indexed_documents(index: DataFrame) -> DataFrame:
    """row, doc_id, n_words of each indexed document."""
    each = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "n_words", "bases")).alias("d"))
    return each.where("d.bases = 0").select(F.col("d.rows").alias("row"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))


class _Lists:
    """The posting lists of one segment for the words of a block of phrases."""

    def __init__(self, b: pa.RecordBatch, i: int, vocabulary: np.ndarray):
        get = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False)
        self.rows, self.firsts, self.bases = get("rows"), get("firsts"), get("bases")
        terms, counts = np.frombuffer(b.column("terms")[i].as_py(), np.uint64), unpack(b.column("counts")[i].as_py()).astype(np.int64)
        self.places = unpack(b.column("places")[i].as_py()).astype(np.int64)
        self.ends = np.append(self.firsts, len(self.places))
        at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
        found = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        self.size = np.where(found, counts[at] if len(counts) else 0, 0)
        starts = np.cumsum(counts) - counts
        of = np.flatnonzero(found)
        self.first = np.zeros(len(vocabulary), np.int64)
        self.first[of] = np.cumsum(self.size[of]) - self.size[of]
        self.places = self.places[ranges(starts[at[of]] if len(of) else of, self.size[of])]
        # a word and a place in one number: all lists are one sorted array
        self.keys = np.repeat(of, self.size[of]) << 32 | self.places

    def stands(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each word (of the vocabulary) stands at each place."""
        key = word << 32 | place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def next(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each word from each place on; beyond all places without one."""
        at = np.searchsorted(self.keys, word << 32 | np.maximum(place, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == word), key & 0xFFFFFFFF, 1 << 40)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, place, side="right") - 1

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For phrases of one length (a row of words each) that have all their words here: the phrase, the order of its words by rarity, and each place of the rarest."""
        size = self.size[words]
        alive = np.flatnonzero(size.min(axis=1, initial=1) > 0)
        order = np.argsort(size[alive], axis=1, kind="stable")
        rarest = words[alive, order[:, 0]]
        ends = np.cumsum(self.size[rarest])
        at = 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
            r = rarest[at:to]
            which = np.repeat(np.arange(at, to), self.size[r])
            yield alive[which], order[which], self.places[ranges(self.first[r], self.size[r])]
            at = to

    def phrases(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that stand here word by word, and where each begins."""
        length, found = words.shape[1], []
        for phrase, order, place in self.candidates(words):
            start = place - order[:, 0]
            for k in range(1, length):
                ok = self.stands(words[phrase, order[:, k]], start + order[:, k])
                phrase, order, start = phrase[ok], order[ok], start[ok]
            ok = start + length <= self.ends[self.document(start) + 1]
            found.append((phrase[ok], start[ok]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def near(self, words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases whose distinct words stand within span words in any order: phrase, first and last place; each first place once, with the nearest last."""
        found = []
        for phrase, order, place in self.candidates(words):
            for back in range(span):
                first = place - back
                last, least = np.full(len(place), -1), np.full(len(place), 1 << 40)
                for k in range(words.shape[1]):
                    at = self.next(words[phrase, order[:, k]], first)
                    last, least = np.maximum(last, at), np.minimum(least, at)
                ok = (first >= 0) & (least == first) & (last - first < span)
                ok[ok] = last[ok] < self.ends[self.document(first[ok]) + 1]
                found.append(np.stack([phrase[ok], first[ok], last[ok]]))
        return tuple(np.unique(np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1), axis=1))


def _spans(firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges of places (last included), as ranges that do not overlap."""
    order = np.argsort(firsts, kind="stable")
    first, reach = firsts[order], np.maximum.accumulate(lasts[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:], len(first)) - 1]


def _matched(block, near: int | None, contents: bool):
    """Matches of a block of phrases, one row each, or with `contents` a row for each document: its hit ranges and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, groups = block.value
        names = pa.array(names, pa.string())
        for b in batches:
            for i in range(b.num_rows):
                lists = _Lists(b, i, vocabulary)
                if not len(lists.keys):
                    continue
                item, first, last = [], [], []
                for words, items in groups:
                    if near is None:
                        phrase, start = lists.phrases(words)
                        end = start + words.shape[1] - 1
                    else:
                        phrase, start, end = lists.near(words, near)
                    item.append(items[phrase])
                    first.append(start)
                    last.append(end)
                item, first, last = map(np.concatenate, (item, first, last))
                if not len(item):
                    continue
                if not contents:
                    d = lists.document(first)
                    shift = lists.bases[d] - lists.firsts[d]
                    yield pa.RecordBatch.from_arrays([pa.array(lists.rows[d]), names.take(pa.array(item)), pa.array(first + shift), pa.array(last + shift)], names=["row", "item", "first", "last"])
                    continue
                pairs = np.unique(np.stack([lists.document(first), item]), axis=1)
                first, last = _spans(first, last)
                d = lists.document(first)
                shift = lists.bases[d] - lists.firsts[d]
                here, at = np.unique(pairs[0], return_index=True)
                spans = pa.StructArray.from_arrays([pa.array(first + shift), pa.array(last + shift + 1)], names=["first", "stop"])
                cut = lambda starts, n: pa.array(np.append(starts, n), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(lists.rows[here]), pa.ListArray.from_arrays(cut(np.searchsorted(d, here), len(d)), spans),
                    pa.ListArray.from_arrays(cut(at, pairs.shape[1]), names.take(pa.array(pairs[1]))),
                ], names=["row", "spans", "items"])

    return run


def _windows(names: list, terms: list[np.ndarray], window: int | None) -> tuple[list, np.ndarray, list]:
    """Item names, distinct words, and for each length the phrases (indices of words) with their items (indices of names)."""
    vocabulary, words = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]), return_inverse=True)
    ends = np.cumsum([len(t) for t in terms])
    by: dict[int, tuple[list, list]] = {}
    for i, (t, end) in enumerate(zip(terms, ends, strict=True)):
        if n := len(t):
            size = min(window or n, n)
            phrases, items = by.setdefault(size, ([], []))
            phrases.append(np.lib.stride_tricks.sliding_window_view(words[end - n : end], size))
            items.append(np.full(n - size + 1, i))
    return names, vocabulary, [(np.concatenate(p).astype(np.int64), np.concatenate(i)) for p, i in by.values()]


def _search(index: DataFrame, items: DataFrame, window: int | None, near: int | None, contents: bool, longest: int) -> DataFrame:
    spark = index.sparkSession
    schema = "row long, spans array<struct<first: long, stop: long>>, items array<string>" if contents else "row long, item string, first long, last long"
    parts = []
    for names, terms in query_blocks(items):
        names, vocabulary, groups = _windows(names, terms, window)
        if any(max(words.shape[1], near or 0) > longest for words, _ in groups):
            raise ValueError(f"a phrase or span of over {longest} words: build the index for longer ones")
        parts.append(index.mapInArrow(_matched(spark.sparkContext.broadcast((names, vocabulary, groups)), near, contents), schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def phrase_matches(index: DataFrame, phrases: DataFrame, window: int | None = None, near: int | None = None, longest: int = LONGEST) -> DataFrame:
    """doc_id, item, first, last: where each phrase of phrases (item string, text) stands in the indexed documents; words count from 0.

    window: every run of so many words of a text is a phrase (a shorter text is one); else the whole text is. near: instead
    of the phrase in order, its distinct words in any order within so many words; a match begins at one of them, ends where
    the last of them first stands, and no shorter one begins there. Texts without words match nothing.
    """
    found = _search(index, phrases, window, near, False, longest)
    # parts of a long text overlap, and windows repeat
    return found.distinct().join(indexed_documents(index), "row").select("doc_id", "item", "first", "last")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, segment: int = SEGMENT, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text), by items (item_id, text); other columns are ignored.

    Every `window` consecutive words of an item are a window, all words of an item with fewer are one. A word within any
    occurrence of a window is hit. Null texts have no words. Rows with a null item_id hit words but count as no item; rows
    that share an item_id are one item; rows of docs that repeat are documents each, and a null doc_id is passed through.
    items_sha256 is of the item_ids with an occurring window, sorted as strings and joined by commas (of nothing: the
    empty string's).
    """
    index = build_index(docs, segment, longest)
    phrases = items.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    found = _search(index, phrases, window, None, True, longest)
    # a document has a row for each block of items and each part of it at most
    found = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("items"))))).alias("items"))
    none = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))
    hit = lambda acc, s: F.struct(F.greatest(acc.stop, s.stop).alias("stop"), (acc.n + F.greatest(F.lit(0).cast("long"), s.stop - F.greatest(acc.stop, s.first))).alias("n"))
    found = found.select("row", F.aggregate("spans", none, hit)["n"].alias("hit"), "items")
    out = indexed_documents(index).join(found, "row", "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
matches AS (SELECT DISTINCT r, k, size, item_id FROM doc_windows JOIN item_windows USING (size, phrase)),
hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + size)) AS p FROM matches) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM matches WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
