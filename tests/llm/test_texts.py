"""Token counts, packing, near duplicates, lines, fingerprints, languages and scores against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from docloom.llm import fingerprints, language_id, line_dedup, lm_score, near_dedup, packing, token_counts
from docloom.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_groups(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_match_brute_force(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op1_minhash_near_dedup(spark, sf).collect()}
    assert got == plain_groups(texts)


def test_near_duplicates_chain_and_hot_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    texts = {}
    for d in range(150):  # copies with a few other words each: some links only through others
        w = list(base)
        for p in rng.choice(120, rng.integers(0, 5), replace=False):
            w[p] = f"n{d}-{p}"
        texts[d] = " ".join(w)
    for d in range(150, 200):
        texts[d] = " ".join(base)
    for d in range(200, 220):  # a shared passage, no links
        texts[d] = " ".join(base[:40]) + " " + " ".join(f"u{d}-{i}" for i in range(80))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == plain_groups(texts)


def test_words_are_hashed_in_parts(texts):
    import pyarrow as pa

    some = ["", *list(texts.values())[:20], " \n", "x" * 300 + " y", None, "end"]
    raw, offsets = near_dedup.text_bytes(pa.array(some, pa.string()))
    h, at = near_dedup.word_hashes(raw, offsets)
    assert list(np.diff(at)) == [len(WORD.findall(t or "")) for t in some]
    words = [w.translate(LOWER) for t in some for w in WORD.findall(t or "")]
    assert len({*zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
    for part in (7, 64, 1000):
        g, b = near_dedup.word_hashes(raw, offsets, part)
        assert (g == h).all() and (b == at).all()


def test_near_duplicates_in_small_blocks_and_by_semi_join(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS", 8)
    monkeypatch.setattr(near_dedup, "MAP_BITS", (1 << 15, 16))
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 100)]
    texts = {}
    for d in range(120):  # every text differs from every other by about a fourth: lists of many labels, few links
        w = list(base)
        for p in rng.choice(100, rng.integers(1, 6), replace=False):
            w[p] = f"n{d}-{p}"
        texts[d] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == plain_groups(texts)


def test_near_duplicates_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    by = collections.defaultdict(list)
    for d, *rest in got:
        by[d].append(tuple(rest))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[7] == [(0, 7, True)]
    assert by[3] == [(1, 3, True)] and by[4] == [(1, 3, False)] * 2  # equal but for case
    assert by[None] == [(1, None, True)]
    assert by[6][0][1:] == (5, False)
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_token_counts_match_the_library(spark, sf, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.op2_token_counts(spark, sf).collect()}
    assert got == {d: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for d, t in texts.items()}


ODD_TEXTS = ["", " ", "  ", "a ", " a", "a  b", "   a   b   ", "▁a ▁▁ b▁", "<s> </s><unk>", "\n\n \t x", "\x00 y", "日本語 テキスト　です", "é ́x", "İstanbul. İ. ΑΣ ΑΣ.", "Word### ÉTÉ&&& x_y_ a'' b's, it's!! c,'d e% f… Ĳ; ǅ!! ſt.", "x<|endoftext|>y <|startoftext|> z,", "don't WON'T I'LL 12345 3,000.", "ab., c", "ß.", "\x1c\x1da b", "𝔘𝔫𝔦 👍🏽.", "a" * 5000]


def test_token_counts_of_odd_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame(list(enumerate([*ODD_TEXTS, None])), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect()}
    assert got == {i: (len(t.encode()), len(sp.encode(t))) for i, t in enumerate([*ODD_TEXTS, ""])}


def test_token_counts_of_odd_rows(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(odd.selectExpr("*", "1 as n_tokens", "2 as n_bytes")).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert any(r.over_limit for r in got) and token_counts.count_tokens(odd.limit(0)).count() == 0


def check_packing(texts, rows, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_places_every_piece(spark, sf, texts):
    bins, bound = check_packing(texts.items(), packing.op4_best_fit_packing(spark, sf).collect())
    assert bins <= bound * 1.02 + 1


def test_packing_of_odd_texts(spark, odd):
    df = spark.createDataFrame(list(enumerate([*ODD_TEXTS, None])), "doc_id long, text string")
    check_packing(list(enumerate([*ODD_TEXTS, None])), packing.pack_documents(df).collect())
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.pack_documents(odd).collect())
    assert packing.pack_documents(odd.limit(0)).count() == 0
    pieces = packing.token_pieces(odd).selectExpr("*", "1 as rank", "2 as cell", "3 as nth", "4 as before", "5 as row", "6 as n", "7 as offset")
    got = packing.pack(pieces)
    assert got.columns == [*pieces.columns[:-1], "sequence_id", "offset"] and got.where("nth = 3 and row = 5").count() == pieces.count()
    check_packing([(r.doc_id, r.text) for r in odd.collect()], got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect())


def test_packing_ranks_a_hot_length_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 50)
    rows = [(i, 0, 4096 if i % 3 else i % 4095 + 1) for i in range(3000)] + [(None, 0, 7)] * 200
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    bins = collections.defaultdict(list)
    for r in packing.pack(df).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, bins.values())) == len(rows)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_plan_is_tight():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 4097, 3000), np.minimum(4096, rng.lognormal(6.5, 1, 20_000)).astype(int) + 0, np.array([3000] * 10 + [1096] * 10)):
        counts = collections.Counter(int(x) for x in lengths if x)
        plan = packing.packing_plan(dict(counts))
        bins = plan[:, 3].max() + 1
        assert bins <= -(-sum(k * v for k, v in counts.items()) // 4096) * 1.3 + 1
    assert packing.packing_plan({3000: 10, 1096: 10})[:, 3].max() == 0  # one pattern
    assert len(packing.packing_plan({})) == 0


def plain_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None:
                seen[key(x)].add(d)
    common = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for least in (2, 3):
        got = line_dedup.dedup_lines(odd, min_docs=least)
        assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
        got = got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows, least)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    clash = odd.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_drop", "_doc", "parts", "drop", "row", "of", "h1", "batch", "N_LINES")])
    got = line_dedup.dedup_lines(clash, min_docs=2)
    assert got.columns == [*clash.columns[:-1], "n_lines", "n_dropped"] and got.where("parts = 1 and drop = 1").count() == len(rows)


def test_line_runs_settle_over_batches(spark, monkeypatch):
    rows = [(d, "\n".join([f"Line {d % 7} ", "same", f"own {d}"])) for d in range(80)]
    rows += [(80, "often\n" * 90 + "same")] + [(None, "no id\nsame")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    # few keys told to every task leave others to the last join: "often" and "no id" are frequent and not common
    for batches, fanout, hot, bucket in ((1, 2, 10_000, 2 << 30), (5, 2, 12, 2 << 30), (8, 3, 4, 2 << 30), (4, 2, 4, 300)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)  # the last: more buckets than shuffles have partitions
        got = line_dedup.dedup_lines(df, min_docs=11, batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows, 11)


def test_fingerprints_estimate_likeness(spark, sf, texts):
    got = {r.doc_id: r for r in fingerprints.op8_document_fingerprints(spark, sf).collect()}
    ids = sorted(texts)
    errors, counts = [], []
    for d, n in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, r = texts[d], got[d]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + texts[n][:cut]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, x = shingles(t), shingles(edited), shingles(texts[n])
        errors += [r.near_edited - len(a & e) / len(a | e), r.near_next - len(a & x) / len(a | x)]
        counts.append(r.n_distinct / len(a) - 1)
    assert np.abs(errors).max() < 0.2 and np.sqrt(np.mean(np.square(errors))) < 0.045
    assert np.sqrt(np.mean(np.square(counts))) < 0.1
    same = collections.defaultdict(set)
    for d, t in texts.items():
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_odd_rows_and_merging(spark, odd):
    from pyspark.sql import functions as F

    got = fingerprints.fingerprint_documents(odd).collect()
    assert len(got) == odd.count() and fingerprints.fingerprint_documents(odd.limit(0)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "" and by[1].near_next == 1.0 and by[2].near_next == 0.0
    assert by[3].fingerprint == by[4].fingerprint
    long = " ".join(f"a{i}" for i in range(900))
    parts = [(1, long), (1, " ".join(f"b{i}" for i in range(50))), (2, "x y")]
    df = spark.createDataFrame(parts, "k long, text string").withColumn("sketch", fingerprints.sketch(F.col("text")))
    merged = {r.k: r.sketch for r in fingerprints.merge_sketches(df, "k").collect()}
    hashes = sorted(set().union(*(r.h for r in df.where("k = 1").select(fingerprints.shingle_hashes(F.col("text")).alias("h")).collect())))
    assert merged[1] == hashes[: fingerprints.K]
    two = df.where("k = 1").select(F.max(F.struct(F.length("text"), "sketch"))["sketch"].alias("a"), F.min(F.struct(F.length("text"), "sketch"))["sketch"].alias("b"))
    r = two.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.containment(F.col("a"), F.col("a")).alias("s")).first()
    assert r.c == 0 and r.s == 1


@pytest.mark.parametrize("size", [20, 300, 1 << 20])
def test_next_across_buckets(spark, size):
    df = spark.createDataFrame([(i * 3, f"text {i} {'x' * (i % 7)}") for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, size).collect()}
    assert got == {i * 3: f"text {(i + 1) % 200} {'x' * ((i + 1) % 200 % 7)}" for i in range(200)}


@pytest.mark.parametrize("size", [10, 1 << 20])
def test_next_of_equal_and_null_ids(spark, size):
    rows = [(None, f"n{i}") for i in range(40)] + [(7, f"t{i}") for i in range(40)] + [(7, "same")] * 5 + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(df, size).collect())
    from pyspark.sql import functions as F

    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    assert got == collections.Counter((d, t, n[1]) for (d, t), n in zip(order, [*order[1:], order[0]], strict=True))


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.op10_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got if r.lang_pred == langs[r.doc_id])


def test_language_model_sums_to_one():
    rows = [("x", "\0\0\0a", 2), ("x", "\0\0ab", 1), ("x", "\0abc", 1), ("x", "abca", 3), ("y", "\0\0\0b", 2), ("y", "bbba", 1)]
    m = language_id.Model(rows)
    chars = [0, 32, 97, 98, 99]
    for context in ([0, 0, 0], [0, 0, 97], [97, 98, 99], [99, 99, 99]):
        p = 0
        for c in [*chars, 0x4E00]:  # the last stands for any other character
            points = np.array([7, *context, c])
            p += np.exp(m.log_probs(language_id.gram_hashes(points), np.array([4]))[0])
        assert np.allclose(p, 1, atol=1e-5)


def plain_kneser_ney(grams, vocabulary):
    """The log probability of a character after a context, by the textbook: continuation counts below the highest order."""
    order = len(next(iter(grams)))
    counts = {order: dict(grams)}
    for n in range(order - 1, 0, -1):  # how many distinct characters stand before
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = one / (one + 2 * two) if one and two else 0.5

    def prob(context, char):
        n = len(context) + 1
        lower = prob(context[1:], char) if context else 1 / vocabulary
        after = {g: v for g, v in counts[n].items() if g[:-1] == context}
        total = sum(after.values())
        if not total:
            return lower
        return max(after.get(context + char, 0) - discount[n], 0) / total + discount[n] * len(after) / total * lower

    return prob


def test_language_models_match_plain_kneser_ney():
    texts = {"x": ["the cat sat on the mat", "a cat and a hat", "then that"], "y": ["le chat est la", "la la le chatte et"]}
    rows, grams = [], {k: collections.Counter() for k in texts}
    for lang, group in texts.items():
        for t in group:
            padded = "\0" * (language_id.N - 1) + t
            grams[lang].update(padded[i : i + language_id.N] for i in range(len(t)))
        rows += [(lang, g, n) for g, n in grams[lang].items()]
    m = language_id.Model(rows)
    chars = {c for g in grams.values() for x in g for c in x} | {"\0", " "}
    plain = {k: plain_kneser_ney(g, len(chars) + 1) for k, g in grams.items()}
    whole = ["the chat sat", "la cat zebra", "xyz", "hat", "et then a"]
    ce, length, _ = m.cross_entropy(whole)
    for t, row in zip(whole, ce, strict=True):
        padded = "\0" * (language_id.N - 1) + t
        want = [-np.mean([np.log(plain[k](padded[i : i + language_id.N - 1], padded[i + language_id.N - 1])) for i in range(len(t))]) for k in m.langs]
        assert np.allclose(row, want, rtol=1e-5)


def test_language_models_of_more_characters_than_16_bits():
    rows = [("x", "".join(map(chr, (0x4E00 + i, 0x20000 + i, 0x25000 + i, 0xAC00 + i % 11_000))), 1) for i in range(20_000)] + [("y", "aabb", 2)]
    m = language_id.Model(rows)
    ce, _, _ = m.cross_entropy([r[1] for r in rows[:19_999]] + ["aabb", "zzzz"])
    assert m.langs == ["x", "y"] and np.isfinite(ce).all() and (ce[:19_999, 0] < ce[:19_999, 1]).all() and ce[-2, 1] < ce[-2, 0]


def test_language_rejection_by_one_rule_for_all_lengths(spark):
    m = language_id.Model([("x", "\0\0\0a", 2), ("y", "\0\0\0b", 2)])
    m.calibrate(np.array([0] * 900 + [1]), np.array([1.0] * 900 + [50.0]), np.full(901, 200))
    assert abs(m.mean[0] - 1) < 0.1 and m.limit[1] < 5  # one odd text of y moves little
    ce = np.full(2000, 6.0)
    over = language_id.drawn(ce, np.arange(1, 2001), m.mean[0]) > m.limit[0]
    assert not over[0] and over[-1] and (np.diff(over.astype(int)) >= 0).all()
    # every language is learned, however few its rows; many copies of one row count once
    docs = [(d, t, k) for d, t, k in ((2, "yksi kaksi", "fi"), (1, "one two three", "en"))] + [(9, "copy", "en")] * 500
    held = [d for d in (1, 2, 9) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert language_id.fit(spark.createDataFrame([x for x in docs if x[0] not in held], "doc_id long, text string, lang string")).langs == ["en", "fi"]


def test_language_id_odd_rows(spark, odd):
    got = language_id.identify_languages(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for d in (1, 2, 7, 8):
        assert (by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True)
    assert by[3].lang_pred in ("en", "de", "es", "fr")
    assert language_id.identify_languages(odd.limit(0)).count() == 0
    clash = odd.selectExpr("*", "7 as rejected", "8 as Score", "9 as `a.b`")
    assert language_id.identify_languages(clash).columns == [*odd.columns, "a.b", *language_id.NEW]
    assert {r.lang_pred for r in language_id.identify_languages(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_lm_score_against_plain_counts(spark, odd):
    docs = [(i, t) for i, t in enumerate(["good text here is good", "bad words there", "good text again", "", None, "unseen tokens only"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, None), (1, 0, 1), (5, None, None), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, labels, size=16).collect()}
    pairs = {m: collections.Counter() for m in (0, 1)}
    words, ctx = {m: collections.Counter() for m in (0, 1)}, {m: collections.Counter() for m in (0, 1)}
    for d, t in docs:
        w = WORD.findall(t or "")
        for m in (0, 1) if d in (0, 2) else (0,):
            words[m].update(w)
            ctx[m].update([None, *w[:-1]] if w else [])
            pairs[m].update(zip([None, *w[:-1]], w, strict=True) if w else [])
    for d, t in docs:
        w = WORD.findall(t or "")
        if not w:
            assert got[d].n_words == 0 and got[d].score is None
            continue
        loss = []
        for m in (1, 0):
            total, s = sum(words[m].values()), 0
            for a, b in zip([None, *w[:-1]], w, strict=True):
                one = (words[m][b] + 0.1) / (total + 1.6)
                s -= np.log(0.6 * pairs[m][a, b] / ctx[m][a] + 0.4 * one if ctx[m][a] else one)
            loss.append(s / len(w))
        assert np.allclose([got[d].target_loss, got[d].background_loss, got[d].score], [*loss, loss[0] - loss[1]])
    assert got[0].score < got[1].score
    assert lm_score.cross_entropy_difference(odd, labels).count() == odd.count()
    assert lm_score.cross_entropy_difference(odd.selectExpr("*", "1 as n_words", "2 as chunk", "3 as range", "4 as n", "5 as score"), labels).count() == odd.count()
    assert lm_score.cross_entropy_difference(odd.limit(0), labels).count() == 0


def test_lm_score_spreads_rows_of_one_key(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 300, 40))
    same = text()
    docs = [(None, same)] * 200 + [(7, text()) for _ in range(200)] + [(8, text()) for _ in range(100)] + [(100 + i, text()) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df.write.parquet(path := new_path(spark, "t"))
    df = spark.read.parquet(path)
    labels = spark.createDataFrame([(7, 1, 0), (120, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    rows = lambda **how: sorted((str(r.doc_id), r.n_words, round(r.target_loss, 9), round(r.background_loss, 9)) for r in lm_score.cross_entropy_difference(df, labels, **how).collect())
    want = rows()  # one chunk
    monkeypatch.setattr(lm_score, "HOT", 2)
    assert rows(chunk_bytes=4000) == want


def test_lm_score_keeps_every_word_and_bigram(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(90_000)]  # each word twice, so over 65,535 words and nearly as many bigrams as words
    words = [vocabulary[i] for i in [*rng.permutation(90_000), *rng.permutation(90_000)]]
    docs = [(i, " ".join(words[i * 300 : i * 300 + 300])) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 3)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, labels, chunk_bytes=1 << 17).collect()}
    n, total = [collections.Counter(), collections.Counter()], [180_000, 60_000]
    for d, t in docs:
        w = t.split()
        for m in (0, 1) if d % 3 == 0 else (0,):
            n[m].update(w)
            n[m].update(zip([None, *w[:-1]], ["-"] * 300, strict=True))
            n[m].update(zip([None, *w[:-1]], w, strict=True))
    for d, t in docs:
        w = t.split()
        for m, loss in ((1, got[d].target_loss), (0, got[d].background_loss)):
            s = 0
            for a, b in zip([None, *w[:-1]], w, strict=True):
                one = (n[m][b] + 0.1) / (total[m] + 0.1 * 90_000)
                s -= np.log(0.6 * n[m][a, b] / n[m][a, "-"] + 0.4 * one if n[m][a, "-"] else one)
            assert np.isclose(loss, s / len(w))


def test_language_id_rejects_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    hexes = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(9))
    rng = np.random.default_rng(0)
    alien = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)),
    ]
    # an odd labelled row or two must not move the limits
    odd = spark.createDataFrame([(10**6 + i, hexes, "de") for i in range(4)], docs.schema)
    model = language_id.fit(docs.unionByName(odd))
    assert model.decide(alien)[3] == [True] * 3
    assert not any(model.decide([r.text for r in docs.collect()])[3])
