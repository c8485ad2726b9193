"""Language identification by interpolated Kneser-Ney character models.

A model of order N is fitted per language on labelled rows; the n-grams' log probabilities of all languages stand side by
side in sorted arrays of 64-bit hashes, one array per order, with back-off weights in arrays of their own. A text gets the
language of least cross-entropy per character. It is rejected when that is above a high quantile of what the language's
calibration rows, well identified and not fitted on, have shown, by a margin. Both are drawn to the language's mean by the
weight of a few characters, so that one rule holds for texts of every length.

Text is lower-cased; letters count as themselves, runs of anything else as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, slices, table

N = 4
#: Rows of each language that the models are fitted on, in expectation: a bounded sample, by hash of doc_id.
FIT_ROWS = 3000
#: Sharpness of the score; times the calibration quantile that is accepted; characters of usual text that each text is given besides.
SHARPNESS, MARGIN, PRIOR = 20.0, 2.4, 10
#: The quantile, and the number of texts as which all languages' figures count in those of one.
QUANTILE, ENOUGH = 0.98, 100
UNKNOWN = "und"
NEW = ("lang_pred", "score", "cross_entropy", "rejected")

_P = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def drawn(ce: np.ndarray, length: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Cross-entropies as if PRIOR more characters had the mean one: a few characters tell little."""
    return (ce * length + PRIOR * mean) / (length + PRIOR)


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts on end, each text after N - 1 zeros; where each text begins, pads aside; has it a letter?"""
    low = [(t or "").lower() for t in texts]
    raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.array([len(t) for t in low], np.int64)
    ends = np.cumsum(size)
    letter = is_letter(raw)
    # a space for each run of other characters
    stay = letter.copy()
    stay[1:] |= letter[:-1]
    starts = (ends - size)[size > 0]
    stay[starts] = True
    points = np.where(letter, raw, 32)[stay]
    doc = np.repeat(np.arange(len(low)), size)[stay]
    length = np.bincount(doc, minlength=len(low))
    begin = np.cumsum(length + N - 1) - length
    out = np.zeros(int(length.sum() + (N - 1) * len(low)), np.int64)
    out[np.arange(len(points)) + (N - 1) * (doc + 1)] = points
    has = np.bincount(np.repeat(np.arange(len(low)), size), weights=letter, minlength=len(low)) > 0
    return out, begin, has


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """[n]: hashes of the n-grams that end at each place (places below n - 1 are of no use), for n up to N."""
    c = points.astype(np.uint64) + np.uint64(1)
    rolled, out = c.copy(), [np.zeros(0, np.uint64), _finish(c + np.uint64(1 << 40))]
    for n in range(2, N + 1):
        before = np.zeros_like(rolled)
        before[1:] = rolled[:-1]
        rolled = before * _P + c
        out.append(_finish(rolled + np.uint64(n << 40)))
    return out


class HashArray:
    """Sorted hashes with a row of values each; found by the top bits, then by a few steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.ascontiguousarray(values[order], np.float32)
        self.bits = max(1, int(len(keys)).bit_length())
        self.start = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.steps = int(np.diff(np.append(self.start, len(keys))).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        row = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return row
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        left = None
        for k in range(self.steps):
            if left is None:
                place = np.minimum(at, len(self.keys) - 1)
                hit = self.keys[place] == h
                row[hit] = place[hit]
                left = np.flatnonzero(~hit)
            else:
                place = at[left] + k
                ok = place < len(self.keys)
                left, place = left[ok], place[ok]
                seen = self.keys[place]
                hit = seen == h[left]
                row[left[hit]] = place[hit]
                left = left[seen < h[left]]
            if not len(left):
                break
        return row


def row_hashes(points: np.ndarray) -> np.ndarray:
    """The hash of each row of code points as an n-gram, as gram_hashes has it; of no points, one constant."""
    h = np.zeros(len(points), np.uint64)
    for c in points.T.astype(np.uint64):
        h = h * _P + c + np.uint64(1)
    return _finish(h + np.uint64(points.shape[1] << 40))


class _KneserNey:
    """One language: n-grams by order with their counts, found by hash; lower orders count distinct left neighbours."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, vocabulary: int):
        self.vocabulary, self.points, self.levels = vocabulary, {}, {}
        c = counts.astype(np.float64)
        for n in range(N, 0, -1):
            keys = row_hashes(points)
            order = np.argsort(keys)
            keys, points, c = keys[order], points[order], c[order]
            one, two = (c == 1).sum(), (c == 2).sum()
            d = one / (one + 2 * two) if one and two else 0.5
            context, place = np.unique(row_hashes(points[:, :-1]), return_inverse=True)
            self.points[n], self.levels[n] = points, (keys, c, d, context, np.bincount(place, c), np.bincount(place).astype(np.float64))
            _, first, c = np.unique(row_hashes(points[:, 1:]), return_index=True, return_counts=True)
            points = points[first, 1:]

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def backoff(self, n: int, context: np.ndarray) -> np.ndarray:
        """The weight of the lower order after each context (a row of n - 1 points)."""
        _, _, d, known, total, types = self.levels[n]
        h = row_hashes(context)
        s = self._look(known, total, h)
        return np.where(s > 0, d * self._look(known, types, h) / np.maximum(s, 1), 1.0)

    def prob(self, n: int, grams: np.ndarray) -> np.ndarray:
        if n == 0:
            return np.full(len(grams), 1.0 / self.vocabulary)
        keys, c, d, known, total, _ = self.levels[n]
        s = self._look(known, total, row_hashes(grams[:, :-1]))
        lower = self.prob(n - 1, grams[:, 1:])
        own = np.maximum(self._look(keys, c, row_hashes(grams)) - d, 0) / np.maximum(s, 1)
        return np.where(s > 0, own + self.backoff(n, grams[:, :-1]) * lower, lower)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.unique(row_hashes(rows), return_index=True)[1]]


class Model:
    """All languages' models side by side; mean: each language's usual cross-entropy; limit: the highest accepted, both of texts drawn to the mean."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        """rows: (language, n-gram of N characters, count)."""
        self.langs = sorted({r[0] for r in rows})
        self.mean, self.limit = np.zeros(len(self.langs)), np.full(len(self.langs), np.inf)
        if not rows:
            return
        points = np.array([[ord(c) for c in g] for _, g, _ in rows], np.int32).reshape(-1, N)
        vocabulary = len(np.union1d(points, [0, 32])) + 1
        number = {k: i for i, k in enumerate(self.langs)}
        lang, count = np.array([number[r[0]] for r in rows]), np.array([r[2] for r in rows], np.float64)
        models = [_KneserNey(points[lang == k], count[lang == k], vocabulary) for k in range(len(self.langs))]
        self.probs, self.backoffs = {}, {}
        for n in range(N, 0, -1):
            grams = _distinct([m.points[n] for m in models])
            self.probs[n] = HashArray(row_hashes(grams), np.log(np.stack([m.prob(n, grams) for m in models], 1)))
            if n > 1:
                context = _distinct([m.points[n][:, :-1] for m in models])
                self.backoffs[n] = HashArray(row_hashes(context), np.log(np.stack([m.backoff(n, context) for m in models], 1)))
        none = np.array([[0x110000]], np.int32)  # beyond all characters
        self.unseen = np.log(np.stack([m.prob(1, none) for m in models], 1))[0].astype(np.float32)

    def calibrate(self, lang: np.ndarray, ce: np.ndarray, length: np.ndarray) -> None:
        """Set mean and limit by the cross-entropies of texts that were not fitted on, given their languages' numbers and lengths.

        A language's figures are drawn to those of all texts by the weight of ENOUGH texts: a few odd ones move nothing.
        """
        if not len(ce):
            return
        all_mean = (ce * length).sum() / length.sum()
        all_high = np.quantile(drawn(ce, length, all_mean), QUANTILE)
        for k in range(len(self.langs)):
            c, n = ce[lang == k], length[lang == k]
            share = len(c) / (len(c) + ENOUGH)
            own = (c * n).sum() / n.sum() if len(c) else 0.0
            self.mean[k] = share * own + (1 - share) * all_mean
            high = np.quantile(drawn(c, n, self.mean[k]), QUANTILE) if len(c) else 0.0
            self.limit[k] = MARGIN * (share * high + (1 - share) * all_high)

    def log_probs(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """(places, languages) log probabilities of the characters at places `at`."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        todo = np.arange(len(at))
        for n in range(N, 0, -1):
            row = self.probs[n].find(hashes[n][at[todo]])
            hit = row >= 0
            if hit.all() and n == N:
                return self.probs[n].values[row]
            out[todo[hit]] += self.probs[n].values[row[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if n > 1:
                row = self.backoffs[n].find(hashes[n - 1][at[todo] - 1])
                hit = row >= 0
                out[todo[hit]] += self.backoffs[n].values[row[hit]]
        out[todo] += self.unseen
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) nats per character, inf without any; characters; has it a letter?"""
        points, begin, has = characters(texts)
        length = np.diff(np.append(begin, len(points) + N - 1)) - (N - 1)
        hashes = gram_hashes(points)
        total = np.zeros((len(texts), len(self.langs)))
        inside = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        if len(inside):
            full = np.flatnonzero(length)
            total[full] = np.add.reduceat(self.log_probs(hashes, inside), np.cumsum(length)[full] - length[full], axis=0, dtype=np.float64)
        return np.where(length[:, None] > 0, -total / np.maximum(length, 1)[:, None], np.inf), length, has

    def decide(self, texts: list) -> tuple[list, list, list, list]:
        """Language, score, cross-entropy and rejection of each text."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, [0.0] * n, [None] * n, [True] * n
        ce, length, has = self.cross_entropy(texts)
        best = ce.argmin(1)
        low = ce[np.arange(n), best]
        with np.errstate(invalid="ignore"):
            score = 1.0 / np.exp(-SHARPNESS * (ce - low[:, None])).sum(1)
            reject = ~has | (drawn(low, length, self.mean[best]) > self.limit[best])
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0).tolist(), [float(x) if h else None for x, h in zip(low, has, strict=True)], reject.tolist()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 20):
        langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
        for lang in set(langs):
            points, begin, _ = characters([t for t, x in zip(texts, langs, strict=True) if x == lang])
            inside = np.ones(len(points), bool)
            for k in range(1, N):
                inside[begin - k] = False  # pads end no n-gram
            at = np.flatnonzero(inside)
            _, first, count = np.unique(gram_hashes(points)[N][at], return_index=True, return_counts=True)
            grams = ["".join(map(chr, points[i - N + 1 : i + 1])) for i in at[first]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(count, pa.int64())], names=["lang", "gram", "n"])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Models of the non-null `lang` values of docs (doc_id, text, lang) that are not held out.

    Each is fitted on about fit_rows rows, chosen by a hash of id and text; calibration takes as many others, and of n rows in
    all n / (2 n + 200) of them, so that a language of a few rows is fitted on nearly all. Equal rows count once. What comes
    to the driver are the labels with their counts, the n-grams of that bounded sample and its cross-entropies.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    share = {r[0]: min(1.0, 2 * fit_rows / r[1]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return Model([])
    of = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(share.items()) for x in (k, v)]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    # windows over one language's rows of a bounded sample
    all_, some = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit(12)), "doc_id", "text")
    sample = known.where(draw < of).dropDuplicates(["doc_id", "text", "lang"]).withColumns({"n": F.count("*").over(all_), "rank": F.row_number().over(some)})
    sample = keep(sample.select("text", "lang", (F.col("rank") <= F.floor(F.col("n") * F.col("n") / (2 * (F.col("n") + ENOUGH)))).alias("apart")), "lang-sample")
    rows = sample.where("not apart").select("text", "lang").mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n")).collect()
    model = Model([tuple(r) for r in rows])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    seen = sample.where("apart").select("text", "lang").mapInArrow(_calibrated(held), "lang int, cross_entropy double, length long").toPandas()
    model.calibrate(*(seen[c].to_numpy() for c in ("lang", "cross_entropy", "length")))
    return model


def _calibrated(model):
    """The language's number, cross-entropy and length of each text with letters that is told its own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            ce, length, has = model.value.cross_entropy(b.column("text").to_pylist())
            best = ce.argmin(1)
            right = has & (np.array(model.value.langs, object)[best] == np.array(b.column("lang").to_pylist(), object))
            low = ce[np.arange(len(best)), best][right]
            yield pa.RecordBatch.from_arrays([pa.array(best[right], pa.int32()), pa.array(low, pa.float64()), pa.array(length[right], pa.int64())], names=["lang", "cross_entropy", "length"])

    return run


def _identified(model, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            lang, score, ce, reject = model.value.decide(b.column("text").to_pylist())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(reject, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(f"c{i}") for i in range(len(carry))] + new, names=[*carry, *NEW])

    return run


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs with lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected.

    A null text or one without a letter is `und`, score 0 and rejected. lang and doc_id are no inputs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.select(*map(quoted, carry)).schema)
    # columns go in by number: mapInArrow finds no dotted names
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)], F.col("text").alias("text"))
    return rows.mapInArrow(_identified(held, carry), f"{schema}, lang_pred string, score double, cross_entropy double, rejected boolean")


def identify_languages(docs: DataFrame, carry: list[str] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on docs (doc_id, text, lang) and identify every row. Without labelled rows everything is `und` and rejected.

    A null doc_id is neither learned from nor held out; repeated rows are rows each; an empty table gives no rows.
    `carry` is by default every column of docs that is not named like a new one: those are replaced.
    """
    return identify(docs, fit(docs, fit_rows), carry or [c for c in docs.columns if c.lower() not in NEW])


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return found.withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
