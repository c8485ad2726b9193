"""Ranked lexical search over a length-stratified inverted index.

A document's normaliser m grows with its length; documents of one m are a stratum. The index is built where texts are
read, in segments of some 1.5 million postings: a segment's documents stand in order of m, and each term's postings in
order of stratum and falling tf. A posting's share of a score hangs on its term, tf and m alone, so it is worked out once
for each run of equal tf in a stratum, and the first run of a term bounds what the term can give there. An item visits
the strata of a segment in order of the sum of its terms' bounds, and ends where no stratum can reach its threshold: the
score of its last place among the best so far, or among the best of a part of the segments, searched first. Both are
scores that so many documents reach, so nothing that belongs to the result is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import keep, slices, table
from .terms import pack, query_blocks, ranges, term_counts, term_hashes, unpack

TOP = 50
#: Postings of a segment, about.
SEGMENT = 1_500_000
#: Documents of an item's first round of strata in a segment; each further round takes twice as many.
ROUND = 512
SCHEMA = "first_row long, doc_ids array<long>, norms array<long>, terms binary, dfs binary, docs binary, tfs binary"
_NO_ID = (1 << 63) - 1


class Index(NamedTuple):
    """segments: the index; n_docs and n_terms: of the whole collection, as N and L of the ranking."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(term_counts(b.column("text")), pa.int64())], names=["n"])


def _segment(row: int, ids: list[int | None], sizes: list[int], postings: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row of the index; postings: document (place in ids), term and tf, in pieces."""
    norm = np.array([50 + 50 * n * n_docs // n_terms for n in sizes], np.int64)
    order = np.argsort(norm, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    doc, tf = (np.concatenate([p[k].astype(np.int64) for p in postings]) for k in (0, 2))
    doc = place[doc]
    terms, term = np.unique(np.concatenate([p[1] for p in postings]), return_inverse=True)
    at = np.lexsort((doc, -tf, norm[order][doc], term))
    ids = pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))
    packed = [pa.array([x], pa.binary()) for x in (terms.tobytes(), pack(np.bincount(term, minlength=len(terms))), pack(doc[at]), pack(tf[at]))]
    return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), ids, pa.array([norm[order]], pa.list_(pa.int64())), *packed], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _indexed(n_docs: int, n_terms: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, sizes, postings, held = 0, [], [], [], 0
        for b in slices(batches, "text"):
            h, at = term_hashes(b.column("text"))
            n = np.diff(at)
            some = np.flatnonzero(n)  # documents without a term are in no list
            if not len(some):
                continue
            terms, term = np.unique(h, return_inverse=True)
            key, tf = np.unique(term * len(some) + np.repeat(np.arange(len(some)), n[some]), return_counts=True)
            if not ids:
                row = b.column("row")[0].as_py()
            postings.append((key % len(some) + len(ids), terms[key // len(some)], tf))
            ids += b.column("doc_id").take(pa.array(some)).to_pylist()
            sizes += n[some].tolist()
            held += len(tf)
            if held >= segment:
                yield _segment(row, ids, sizes, postings, n_docs, n_terms)
                ids, sizes, postings, held = [], [], [], 0
        if ids:
            yield _segment(row, ids, sizes, postings, n_docs, n_terms)

    return run


def build_index(docs: DataFrame, segment: int = SEGMENT) -> Index:
    """The length-stratified index of docs (doc_id, text; others are ignored), a row for each segment; kept in the shared folder.

    Every row is a document of its own; those without terms (null, empty) are left out.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_terms = texts.select("text").mapInArrow(_counted, "n long").agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(keep(texts.mapInArrow(_indexed(n_docs, n_terms, segment), SCHEMA), "strata"), n_docs, n_terms)


def _frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value
        for b in batches:
            for terms, dfs in zip(b.column("terms"), b.column("dfs"), strict=True):
                _, here, there = np.intersect1d(asked, np.frombuffer(terms.as_py(), np.uint64), assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(unpack(dfs.as_py())[there].astype(np.int64))], names=["term", "df"])

    return run


def document_frequencies(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each of the sorted term hashes: a block's terms at most come to the driver."""
    asked = index.segments.sparkSession.sparkContext.broadcast(vocabulary)
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in index.segments.select("terms", "dfs").mapInArrow(_frequencies(asked), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class _Segment:
    """A segment's lists for the terms of a block, with shares of scores by runs and bounds by strata."""

    def __init__(self, b: pa.RecordBatch, i: int, vocabulary: np.ndarray, weights: np.ndarray):
        ids = b.column("doc_ids")[i].values
        self.has_id = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        norms = b.column("norms")[i].values.to_numpy(zero_copy_only=False)
        new = np.append(True, norms[1:] != norms[:-1])
        stratum = np.cumsum(new) - 1
        self.docs_in = np.bincount(stratum)
        dfs = unpack(b.column("dfs")[i].as_py()).astype(np.int64)
        self.here, asked, there = np.intersect1d(vocabulary, np.frombuffer(b.column("terms")[i].as_py(), np.uint64), assume_unique=True, return_indices=True)
        self.term = np.full(len(vocabulary), -1)
        self.term[asked] = np.arange(len(asked))
        size = dfs[there]
        at = ranges((np.cumsum(dfs) - dfs)[there], size)
        self.doc = unpack(b.column("docs")[i].as_py())[at].astype(np.int64)
        tf = unpack(b.column("tfs")[i].as_py())[at].astype(np.int64)
        term, place = np.repeat(np.arange(len(asked)), size), stratum[self.doc]
        entry = np.ones(len(at), bool)
        entry[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
        run = entry.copy()
        run[1:] |= tf[1:] != tf[:-1]
        run = np.flatnonzero(run)
        impact = 1_000_000_000 * tf[run] // (1000 * tf[run] + 20 * norms[self.doc[run]])
        share = (weights[asked][term[run]] * impact).astype(float)  # sums stay below 2^53: exact
        self.share = np.repeat(share, np.diff(np.append(run, len(at))))
        self.entry = np.flatnonzero(entry)  # a term in a stratum: where its postings begin
        self.size = np.diff(np.append(self.entry, len(at)))
        self.stratum, self.bound = place[self.entry], self.share[self.entry]
        self.entries = np.searchsorted(term[self.entry], np.arange(len(asked) + 1))

    def best(self, terms: np.ndarray, threshold: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the `top` best for the terms, of those that reach the threshold."""
        t = self.term[terms]
        t = t[t >= 0]
        e = ranges(self.entries[t], self.entries[t + 1] - self.entries[t])
        bounds = np.bincount(self.stratum[e], weights=self.bound[e], minlength=len(self.docs_in))
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= max(threshold, 1)]
        reach = np.cumsum(self.docs_in[order])
        docs, scores = np.zeros(0, np.int64), np.zeros(0)
        at, take = 0, ROUND
        while at < len(order) and bounds[order[at]] >= threshold:
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + take, side="right")))
            visited = np.zeros(len(self.docs_in), bool)
            visited[order[at:to]] = True
            some = e[visited[self.stratum[e]]]
            p = ranges(self.entry[some], self.size[some])
            sums = np.bincount(self.doc[p], weights=self.share[p])
            found = np.flatnonzero(sums >= max(threshold, 1))
            docs, scores = np.append(docs, found), np.append(scores, sums[found])
            kept = np.lexsort((self.ids[docs], -scores))[:top]
            docs, scores = docs[kept], scores[kept]
            if len(docs) == top:
                threshold = max(threshold, scores[-1])
            at, take = to, 2 * take
        return docs, scores


def _ranked(block, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, weights, items, thresholds = block.value
        for b in batches:
            for i in range(b.num_rows):
                segment = _Segment(b, i, vocabulary, weights)
                rows = [np.zeros((3, 0), np.int64)]
                for k, terms in enumerate(items):
                    docs, scores = segment.best(terms, thresholds[k], top)
                    rows.append(np.stack([np.full(len(docs), k), docs, scores.astype(np.int64)]))
                item, docs, score = np.concatenate(rows, axis=1)
                columns = [pa.array(item), names.take(pa.array(item)), pa.array(segment.ids[docs], mask=~segment.has_id[docs]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, top: int = TOP, part: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each row of items (item_id, text), ties by smaller doc_id, null last.

    Rows without item_id are no items, rows that share one are one item with the terms of all. part: one segment in so many
    is searched first for the items' thresholds (about the root of their number); any part gives the same result.
    """
    spark = items.sparkSession
    parts = []
    if index.n_terms:
        # equal texts of an item say nothing new
        texts = items.where("item_id is not null").groupBy(F.col("item_id").alias("item")).agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
        kind = to_arrow_type(texts.schema["item"].dataType)
        part = part or isqrt(index.segments.count())
        for names, terms in query_blocks(texts):
            terms = [np.unique(t) for t in terms]
            vocabulary, place = np.unique(np.concatenate(terms), return_inverse=True)
            weights = term_weights(document_frequencies(index, vocabulary), index.n_docs)
            asked = np.split(place, np.cumsum([len(t) for t in terms])[:-1])
            thresholds = np.zeros(len(names))
            schema = f"item long, item_id {texts.schema['item'].dataType.simpleString()}, doc_id long, score long"
            ranked = lambda segments: segments.mapInArrow(_ranked(spark.sparkContext.broadcast((pa.array(names, kind), vocabulary, weights, asked, thresholds)), top), schema)  # noqa: B023, E731
            if part > 1:
                first = ranked(index.segments.where(F.pmod(F.xxhash64("first_row"), F.lit(part)) == 0))
                last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") == top)
                for r in last.collect():  # a row for each item of the block at most
                    thresholds[r["item"]] = r["score"]
            parts.append(ranked(index.segments).drop("item"))
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
totals AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
norms AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * N) // L) AS m FROM d, totals WHERE len(w) > 0),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY item_id, doc_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
