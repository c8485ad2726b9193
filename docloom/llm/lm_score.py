"""Cross-entropy difference of a target and a background word model.

Both models are interpolated bigrams over one vocabulary, all words of all documents, and have the same orders, weights
and smoothing: they differ only in the documents they count. The background counts every document, the target those
labelled good. Each token's losses under the two are subtracted; their mean scores the document (below 0: closer to the
target).

Words are runs of `[^\\x20\\x09-\\x0D]` with A-Z in lower case. Words, the start of a text and bigrams are keys of 64 bits,
all counted exactly; a word is a context as often as it stands, less the texts that it ends. Documents are dealt into chunks and
keys into ranges, about CHUNK bytes of text each, so that their numbers grow with the input and no task holds a whole model:

1. each chunk sends its distinct keys, with their counts in all and in good documents, to the keys' ranges;
2. each range adds them up and answers each chunk with the totals of the keys that it sent;
3. each chunk meets its answers and scores its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, runs, slices, table, text_bytes
from .near_dedup import word_hashes

#: Bytes of text in a chunk of documents and behind a range of keys, about.
CHUNK = 1 << 23
#: Chunks of text from which the rows of one key are dealt apart.
HOT = 4
#: Weight of the bigram; added count of each word.
BIGRAM, ADDED = 0.6, 0.1
#: Kinds of keys, in their last two bits.
WORD, START, PAIR = (np.uint64(k) for k in (0, 1, 2))
#: Counts of keys, in all and in good documents: how often they stand, and how many texts end with them.
COUNTS = ("n", "good_n", "ends", "good_ends")
#: What rows of a chunk are, in place of a range: ids of good documents, or documents.
GOOD, DOCUMENT = -2, -1


def _key(h: np.ndarray, kind: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & ~np.uint64(3)) | kind


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, as many as the largest needs, compressed; before them their width and number."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(values).to_bytes(4, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(data[5:], width * n), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


class _Chunk:
    """Documents with their tokens, and the chunk's distinct keys in order; word, context, pair: places of the tokens' keys."""

    def __init__(self, docs: pa.Table):
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in slices(iter(docs.to_batches()), "text"):
            h, at = word_hashes(*text_bytes(b.column("text")))
            hashes.append(h)
            sizes.append(np.diff(at))
        self.doc_id, self.size = docs.column("doc_id").combine_chunks(), np.concatenate(sizes)
        h = np.concatenate(hashes)
        words, word = np.unique(h, return_inverse=True)
        begin = (np.cumsum(self.size) - self.size)[self.size > 0]
        before, context = np.zeros_like(h), np.zeros_like(word)
        before[1:], context[1:] = h[:-1], word[:-1]
        before[begin], context[begin] = 0, len(words)
        pairs, pair = np.unique(_key(before, START) * np.uint64(3) + h, return_inverse=True)
        keys = np.concatenate([_key(words, WORD), _key(np.zeros(1, np.uint64), START), _key(pairs, PAIR)])
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys = keys[order] if len(h) else keys[:0]
        self.start = place[len(words)]
        self.word, self.context, self.pair = place[word], place[context], place[len(words) + 1 + pair]

    def counts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key stands in the documents chosen, and how many of these it ends."""
        tokens, docs = np.repeat(docs, self.size), docs & (self.size > 0)
        n = np.bincount(self.word[tokens], minlength=len(self.keys)) + np.bincount(self.pair[tokens], minlength=len(self.keys))
        n[self.start] = docs.sum()
        return n, np.bincount(self.word[(np.cumsum(self.size) - 1)[docs]], minlength=len(self.keys))


def _counted(bits: int):
    """A row for each chunk and range with keys: the keys and their counts in all and in good documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["chunk"]):
            kind = rows.column("range")
            c = _Chunk(rows.filter(pc.equal(kind, DOCUMENT)))
            if not len(c.keys):
                continue
            good = pc.fill_null(pc.is_in(c.doc_id, rows.filter(pc.equal(kind, GOOD)).column("doc_id").combine_chunks()), False)
            hot = pc.and_(pc.fill_null(rows.filter(pc.equal(kind, DOCUMENT)).column("hot").combine_chunks(), False), pc.is_valid(c.doc_id))
            good = pc.or_(good, hot).to_numpy(zero_copy_only=False)
            (n, ends), (good_n, good_ends) = c.counts(np.ones(len(c.size), bool)), c.counts(good)
            at = (c.keys >> np.uint64(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out = []
            for x, y in zip(first, [*first[1:], len(at)], strict=True):
                steps = np.diff(c.keys[x:y], prepend=np.uint64(int(at[x]) << (64 - bits)))
                out.append((rows.column("chunk")[0].as_py(), int(at[x]), _pack(steps), *(_pack(v[x:y]) for v in (n, good_n, ends, good_ends))))
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "range", "keys", *COUNTS])

    return run


def _summed(bits: int):
    """Each chunk's keys of a range with their total counts; in a range's first row, its words and their counts besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["range"]):
            base = np.uint64(rows.column("range")[0].as_py() << (64 - bits))
            keys = [base + np.cumsum(_unpack(v.as_py()), dtype=np.uint64) for v in rows.column("keys")]
            ends = np.cumsum([len(k) for k in keys])[:-1]
            known, place = np.unique(np.concatenate(keys), return_inverse=True)
            totals = [np.bincount(place, np.concatenate([_unpack(v.as_py()) for v in rows.column(c)])).astype(np.int64) for c in COUNTS]
            word = (known & np.uint64(3)) == WORD
            about = [int(word.sum()), *(int(t[word].sum()) for t in totals[:2])]
            for k, (chunk, at) in enumerate(zip(rows.column("chunk").to_pylist(), np.split(place, ends), strict=True)):
                row = [chunk, rows.column("range")[0].as_py(), *(_pack(t[at]) for t in totals), *(about if k == 0 else (0, 0, 0))]
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["chunk", "range", *COUNTS, "words", "tokens", "good_tokens"])

    return run


def _scored(size: int, tokens: tuple[int, int]):
    """Scores of each chunk's documents; tokens: of all and of good documents."""

    def loss(c: _Chunk, count: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
        seen = (count - ends)[c.context]
        single = (count[c.word] + ADDED) / (total + ADDED * size)
        return -np.log(np.where(seen > 0, BIGRAM * count[c.pair] / np.maximum(seen, 1) + (1 - BIGRAM) * single, single))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["chunk"]):
            docs = pc.equal(rows.column("range"), DOCUMENT)
            c, answers = _Chunk(rows.filter(docs)), rows.filter(pc.invert(docs)).sort_by("range")
            sums = []
            for names, total in ((("good_n", "good_ends"), tokens[1]), (("n", "ends"), tokens[0])):
                count, ends = (np.concatenate([np.zeros(0, np.uint64), *(_unpack(v.as_py()) for v in answers.column(x))]).astype(np.int64) for x in names)
                if len(count) != len(c.keys):
                    raise ValueError(f"{len(count)} counts for {len(c.keys)} keys")
                s, full = np.zeros(len(c.size)), c.size > 0
                if full.any():
                    s[full] = np.add.reduceat(loss(c, count, ends, total), (np.cumsum(c.size) - c.size)[full])
                sums.append(s / np.maximum(c.size, 1))
            none = pa.array(c.size == 0)
            target, background = (pc.if_else(none, None, pa.array(s)) for s in sums)
            out = [c.doc_id, pa.array(c.size), target, background, pc.subtract(target, background)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, size: int | None = None, chunk_bytes: int = CHUNK) -> DataFrame:
    """Score docs (doc_id, text) by models of all docs and of those labelled quality 1 and not toxic.

    The result has doc_id, n_words, target_loss, background_loss and score: mean losses per word and their difference.
    Null or wordless texts have 0 words and null losses; a null doc_id is passed through; repeated rows are scored each.
    size is the number of words that share the added counts, by default the distinct words of docs. labels (doc_id,
    quality, toxic) may repeat or miss ids, and may have nulls (not good). Without good documents the target is uniform.
    An empty docs table gives no rows. Rows of one id, or equal texts without one, that are more than HOT chunks of text
    are dealt to chunks by their place in the table, so docs must be read in the same order each time, as files are.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key = F.coalesce("doc_id", F.xxhash64("text"))
    sizes = keep(docs.groupBy(key.alias("key")).agg(F.sum(F.octet_length("text")).alias("bytes")), "lm-sizes")
    chunks = max(1, -(-int(sizes.agg(F.sum("bytes")).first()[0] or 0) // chunk_bytes))
    bits = max(1, (chunks - 1).bit_length())
    # rows of one doc_id come to one chunk, and its label with them; without an id, equal texts do
    chunk_of = lambda c: F.pmod(F.xxhash64(c, F.lit(6)), F.lit(chunks)).alias("chunk")
    dealt = lambda df, by: df.repartition(by).sortWithinPartitions(by)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    # keys of many chunks are spread over all, with their label beside them: one for each HOT chunks of text at most
    hot = sizes.where(F.col("bytes") > HOT * chunk_bytes).join(good, F.col("key") == F.col("doc_id"), "left").select("key", F.col("doc_id").isNotNull().alias("hot"))
    spread = F.coalesce(F.when(F.col("hot").isNotNull(), F.xxhash64(F.monotonically_increasing_id())), F.col("key"))
    texts = docs.withColumn("key", key).join(F.broadcast(hot), "key", "left").select(chunk_of(spread), F.lit(DOCUMENT).alias("range"), "doc_id", "text", "hot")
    good = good.select(chunk_of(F.col("doc_id")), F.lit(GOOD).alias("range"), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("hot"))
    kinds = ", ".join(f"{c} binary" for c in COUNTS)
    docs.sparkSession.sparkContext._jvm.System.gc()  # the cleaner lets go of shuffles that nothing reads any more
    counts = dealt(texts.unionByName(good), "chunk").mapInArrow(_counted(bits), f"chunk long, range int, keys binary, {kinds}")
    answers = dealt(counts, "range").mapInArrow(_summed(bits), f"chunk long, range int, {kinds}, words long, tokens long, good_tokens long")
    answers = keep(answers, "lm-counts")
    words, tokens, good_tokens = (int(x or 0) for x in answers.agg(F.sum("words"), F.sum("tokens"), F.sum("good_tokens")).first())
    del counts
    docs.sparkSession.sparkContext._jvm.System.gc()
    both = texts.unionByName(answers.select("chunk", "range", *COUNTS), allowMissingColumns=True)
    return dealt(both, "chunk").mapInArrow(_scored(size or words, (tokens, good_tokens)), "doc_id long, n_words long, target_loss double, background_loss double, score double")


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
