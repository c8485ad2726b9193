"""MinHash near-duplicate groups by a signature-coordinate inverted join.

A document's words are runs of `[^\\x20\\x09-\\x0D]` with A-Z lower-cased; its set is its distinct five-word
shingles (with one to four words, the whole sequence; with none, empty) as 64-bit hashes. The plan:

1. one Arrow pass makes set size, a 128-bit set digest and a signature of K minima; equal sets become one class;
2. the signature is K tokens (coordinate, value). Posting lists of two or more classes are counted;
3. two signatures that agree in T or more places must share one of their K - T + 1 rarest tokens (prefix merging):
   only those lists are merged, the frequent ones are skipped and count only when a pair is compared in full;
4. each list first gives a star to its least class: pairs with T agreeing places are confirmed on full sets and joined
   to components; lists whose members still differ in component are then compared member by member, in blocks,
   inside tasks, so that every pair with T agreeing places that could still join two components is confirmed or refused;
5. components of the confirmed links go back to all documents.

At K=48 and T=22 a pair of likeness 0.75 is missed with probability about 3e-6, a likelier one far less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAP_BITS, drop, keep, member_hash, members, membership, runs, slices, table, text_bytes
from .components import connected_components

K, T = 48, 22
SHINGLE = 5
#: Shingles and rows of a posting list's members that meet in one block; longer lists are cut into pairs of blocks.
BLOCK, ROWS = 400_000, 512
#: Bytes of text whose words are hashed at once, about: a longer text is cut between words.
PART = 1 << 20
#: Most tokens that are told to every task as frequent.
FREQUENT = 100_000

_M64 = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
_ODD = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _ODD(256)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_ODD(1)[0])
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _ODD(SHINGLE)
_XOR, _MUL = _ODD(K), _ODD(K)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base in _powers and len(_powers[base]) >= n:
        return _powers[base][:n]
    p = np.full(max(n, PART + 1), base, np.uint64)
    p[0] = 1
    p = np.multiply.accumulate(p)
    if n <= 2 * PART:  # those of a very long word are not kept
        _powers[base] = p
    return p[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _hashed(raw: np.ndarray, edge: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where these begin; edge: the places where a text begins."""
    n = len(raw)
    space = between[raw]
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    inner = edge[(edge > 0) & (edge < n)]
    opens[inner] = ~space[inner]
    closes[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power(_BASE_INV, n)[start]
    return _mix(h + (end - start).astype(np.uint64)), start


def word_hashes(raw: np.ndarray, offsets: np.ndarray, part: int = PART, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words on end, and the n + 1 word offsets of the texts; between: for each of the 256 bytes, whether it parts words.

    Bytes are taken in parts that end between words, or at the end of a word longer than a part: what is held beside the
    hashes does not grow with the longest text.
    """
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        to = at + part
        while to < len(raw) and not len(gap := np.flatnonzero(between[raw[to : to + part]])):
            to += part
        to = min(len(raw), to + int(gap[0])) if to < len(raw) else len(raw)
        here = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        h, start = _hashed(raw[at:to], here, between)
        hashes.append(h)
        starts.append(start + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(*text_bytes(texts))
    wide = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        wide = h[: len(h) - SHINGLE + 1] * _PLACE[0]
        for j in range(1, SHINGLE):
            wide += h[j : len(h) - SHINGLE + 1 + j] * _PLACE[j]
        wide = _mix(wide)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(wide[a : b - SHINGLE + 1])
        elif b > a:
            yield _mix(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> np.ndarray:
    least = np.full(K, _M64, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, ((s[at : at + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        size, d1, d2, sig = [], [], [], []
        for s in shingle_sets(b.column("text")):
            size.append(len(s))
            d1.append(s.sum(dtype=np.uint64))
            d2.append(np.bitwise_xor.reduce(_mix(s)) if len(s) else np.uint64(0))
            sig.append(_signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.array(sig, pa.binary())],
            names=["doc_id", "n_shingles", "d1", "d2", "sig"],
        )


def _tokens(sig: np.ndarray) -> np.ndarray:
    """(rows, K) token hashes of (rows, K) signatures."""
    return _mix((sig.astype(np.uint64) << np.uint64(8)) ^ np.arange(K, dtype=np.uint64)).view(np.int64)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            ids = part.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_tokens(_stack(part.column("sig"))).ravel()), pa.array(np.repeat(ids, K))], names=["token", "rep"])


def _prefix_tokens(frequent: np.ndarray, counts: np.ndarray):
    """The K - T + 1 rarest tokens of each signature; frequent: sorted tokens with their counts, all others count 0."""
    width = K - T + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, tok = part.column("rep").to_numpy(), _tokens(_stack(part.column("sig")))
                first = np.take_along_axis(tok, _order(tok, frequent, counts)[:, :width], 1)
                yield pa.RecordBatch.from_arrays([pa.array(first.ravel()), pa.array(np.repeat(ids, width))], names=["token", "rep"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with signatures and sizes: keep those with T agreeing places whose sizes allow the likeness."""
    for x in batches:
        if x.num_rows:
            same = (_stack(x.column("sig_a")) == _stack(x.column("sig_b"))).sum(1) >= T
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in (x.column("a"), x.column("b"))], names=["a", "b"])


def _sets(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if bitmap is not None:
                b = b.filter(pa.array(members(bitmap.value, b.column("at").to_numpy(zero_copy_only=False))))
            for part in slices(iter([b]), "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())], names=["rep", "set"])

    return run


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, set) of the documents in ids (rep), and of a few others.

    While ids fit a membership map, that is told to all tasks and no text is shuffled; more ids meet the texts in a semi-join.
    """
    known = docs.where("doc_id is not null")
    n = ids.count()
    if n <= MAP_BITS[1] // 16:
        bitmap = membership(ids, n)
        held = docs.sparkSession.sparkContext.broadcast(bitmap)
        return known.withColumn("at", member_hash("doc_id", bitmap)).mapInArrow(_sets(held), "rep long, set binary")
    wanted = known.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    return wanted.withColumn("at", F.lit(0).cast("long")).mapInArrow(_sets(None), "rep long, set binary")


def _confirmed(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for s, t in zip(x.column("set_a").to_pylist(), x.column("set_b").to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (x.column("a"), x.column("b"))], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes whose full sets are alike."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    near = keep(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a long, b long"), "minhash-candidates")
    sets = keep(_sets_of(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs), "minhash-sets")
    full = lambda s: sets.select(F.col("rep").alias(s), F.col("set").alias(f"set_{s}"))
    good = near.join(full("b"), "b").join(full("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(num, den), "a long, b long")
    good = keep(good, "minhash-links")
    drop(near, sets)
    return good


def _order(tok: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of (rows, K) tokens from the rarest on, by one order over all tokens."""
    count = np.zeros(tok.shape, np.int64)
    if len(frequent):
        i = np.minimum(np.searchsorted(frequent, tok), len(frequent) - 1)
        count = np.where(frequent[i] == tok, counts[i], 0)
    return np.lexsort((tok, count), axis=1)


KEYS = ["token", "left", "right"]
MEMBER = "token long, left long, right long, rep long, label long, n_shingles long, block long"


class _Block:
    """Rows of one list and one pair of its blocks, in order of rep, and the pairs worth a look."""

    def __init__(self, rows: pa.Table, num: int, den: int, frequent: np.ndarray, counts: np.ndarray):
        self.rows = rows = rows.sort_by("rep")
        self.rep, self.label, self.size, block = (rows.column(c).to_numpy() for c in ("rep", "label", "n_shingles", "block"))
        self.num, self.den, self.often = num, den, (frequent, counts)
        i, j = np.flatnonzero(block == rows.column("left")[0].as_py()), np.flatnonzero(block == rows.column("right")[0].as_py())
        self.one = np.array_equal(i, j)
        self.i, self.j = (i, j) if len(i) <= len(j) else (j, i)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """x, places y in self.j: unlike labels, sizes that allow the likeness, T agreeing places, this list's token the rarest of them."""
        if not len(self.i) or self.label.min() == self.label.max():
            return
        i, j, label, size = self.i, self.j, self.label, self.size
        sig = _stack(self.rows.column("sig"))
        agree = None
        if len(i) * len(j) <= 64:  # most lists are short, and hold no pair that agrees in T places
            agree = (sig[i][:, None] == sig[j][None]).sum(2) >= T
            if not agree.any():
                return
        tok = _tokens(sig)
        order, place = _order(tok, *self.often), int(np.flatnonzero((tok == self.rows.column("token")[0].as_py()).any(0))[0])
        for n, x in enumerate(i):
            may = (label[j] != label[x]) & (self.den * np.minimum(size[j], size[x]) >= self.num * np.maximum(size[j], size[x]))
            y = np.flatnonzero(may if agree is None else may & agree[n])
            if self.one:
                y = y[j[y] > x]
            if len(y):
                same = sig[j[y]][:, order[x]] == sig[x][order[x]]
                y = y[(same.sum(1) >= T) & (order[x][same.argmax(1)] == place)]
            if len(y):
                yield x, y


def _promising(*how):
    """The members that are in a pair worth a look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, KEYS):
            block = _Block(rows, *how)
            found = np.zeros(len(block.rep), bool)
            for x, y in block.pairs():
                found[x] = True
                found[block.j[y]] = True
            if found.any():
                yield from block.rows.filter(pa.array(found)).drop_columns(["sig"]).to_batches()

    return run


def _linked(*how):
    """A confirmed link for each pair of labels that has one in a block; intersections are counted on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, KEYS):
            b = _Block(rows, *how)
            links: dict[tuple, tuple] = {}
            known = None
            for x, y in b.pairs():
                if known is None:  # all hashes of the shorter side numbered once
                    sets = [np.frombuffer(v, np.uint64) for v in b.rows.column("set").to_pylist()]
                    known = np.unique(np.concatenate([sets[k] for k in b.i]))
                    flat = np.concatenate([sets[k] for k in b.j])
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    there = known[at] == flat
                    edges = np.cumsum([0, *(len(sets[k]) for k in b.j)])[:-1]
                mine = np.zeros(len(known), bool)
                mine[np.searchsorted(known, sets[x])] = True
                both = np.add.reduceat((mine[at] & there).astype(np.int64), edges)[y]
                for k in b.j[y[b.den * both >= b.num * (b.size[x] + b.size[b.j[y]] - both)]]:
                    links.setdefault(tuple(sorted((b.label[x], b.label[k]))), tuple(sorted((b.rep[x], b.rep[k]))))
            if links:
                out = np.array(list(links.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _open_members(posts: DataFrame, info: DataFrame) -> DataFrame:
    """Members of the lists that hold two labels or more, each sent to the pairs of blocks that it belongs to.

    Those with a list's least label (blocks -1, -2, ...) need no comparing among themselves: they go to the
    blocks of the others (0, 1, ...) only, and these to all. Blocks hold BLOCK shingles or ROWS rows at most, on average.
    """
    labelled = posts.select("token", "rep").join(info.select("rep", "label", "n_shingles"), "rep")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("hi")
    labelled = keep(labelled.join(mixed, "token").withColumn("major", F.expr("label = lo")), "minhash-open")
    weight = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / BLOCK), F.ceil(F.count_if(c) / ROWS))
    sizes = labelled.groupBy("token").agg(weight(F.col("major")).alias("majors"), weight(~F.col("major")).alias("minors"))
    m = labelled.join(sizes, "token").withColumn("block", F.expr("if(major, -1 - pmod(xxhash64(rep), majors), pmod(xxhash64(rep), minors))"))
    m = m.withColumn("other", F.expr("explode(sequence(if(major, 0L, -majors), minors - 1))"))
    m = m.select("token", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "rep", "label", "n_shingles", "block")
    return m.join(info.select("rep", "sig"), "rep").select(*KEYS, "rep", "label", "n_shingles", "block", "sig")


def _remaining_links(posts: DataFrame, info: DataFrame, docs: DataFrame, *how) -> DataFrame:
    """Links between unlike labels, one for each pair of labels and block at least."""
    dealt = lambda df: df.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = keep(dealt(_open_members(posts, info)).mapInArrow(_promising(*how), MEMBER), "minhash-promising")
    sets = _sets_of(found.select("rep").distinct(), docs)
    full = keep(sets.join(info.select("rep", "sig"), "rep"), "minhash-open-sets")
    more = keep(dealt(found.join(full, "rep")).mapInArrow(_linked(*how), "a long, b long").distinct(), "minhash-more")
    drop(found, full)
    return more


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Documents are linked when den * |intersection| >= num * |union| of their shingle sets (num/den of 0.75 or more).
    Null or wordless texts have an empty set and stand alone. Rows with a null doc_id stand alone too: their
    component_id is null and they are kept. Rows that repeat a doc_id count as one document and each gets a row.
    An empty table gives an empty result.
    """
    if 4 * num < 3 * den:
        raise ValueError("signatures are sized for a likeness of 0.75 or more")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    feats = keep(docs.mapInArrow(_features, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "minhash")
    known = feats.where("doc_id is not null and n_shingles > 0")
    # equal sets: one class, led by its least doc_id; equal sets have equal signatures, so any will do
    classes = known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = keep(classes, "minhash-classes")
    sigs = classes.select("rep", "sig")
    lists = sigs.mapInArrow(_all_tokens, "token long, rep long").groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1")
    lists = keep(lists, "minhash-lists")
    # at most K * classes / least tokens can be so frequent: FREQUENT bounds what is told to every task
    least = max(64, -(-K * classes.count() // FREQUENT))
    often = lists.where(F.col("n") >= least).select("token", "n").orderBy("token").toPandas()
    often = often["token"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    posts = sigs.mapInArrow(_prefix_tokens(*often), "token long, rep long").join(lists.select("token", "hub"), "token")
    posts = keep(posts, "minhash-posts")

    stars = posts.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = _confirm(stars, classes, docs, num, den)
    label = connected_components(links)

    info = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "sig", "n_shingles", F.coalesce("component", "rep").alias("label"))
    more = _remaining_links(posts, keep(info, "minhash-labels"), docs, num, den, *often)
    if not more.isEmpty():
        label = connected_components(links.unionByName(more))
    drop(lists, posts)

    ends = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    done = known.select("doc_id", "n_shingles", "d1", "d2").join(ends, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = feats.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
