"""Conversation repair, ranked search and decontamination against brute force, with rows of every shape."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from docloom.llm import conversations, decontamination, lexical_search
from docloom.llm.conversations import Audits, chunk_paths, join_chunks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words = lambda t: TERM.findall((t or "").translate(LOWER))


def every_repair(rows):
    """All edits of rows (role, text, fault) with up to two inserts in a row that end in a legal conversation: cost, audit, turns."""
    inserts = [(2 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    steps = [inserts]
    for role, text, fault in rows:
        options = [(3, "D", [])]
        if fault not in ("b", "d"):
            more = fault == "t"
            options += [(more, "K", [(role, text)])] + [(2 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        steps += [options, inserts]
    for choice in itertools.product(*steps):
        turns = [t for c in choice for t in c[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
            yield sum(c[0] for c in choice), "".join(c[1] for c in choice), turns


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The same by a table of whole strings, for any number of rows: cost, audit, turns."""
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    put = lambda at, state, x: at.update({state: min(x, at.get(state, x), key=lambda y: y[:2])})

    def insert(at):
        for _ in range(3):
            for state, (c, a, turns) in list(at.items()):
                for r in ("user", "assistant"):
                    if (to := legal.get((state, r[0]))) is not None:
                        put(at, to, (c + 2, a + "I", [*turns, (r, "")]))
        return at

    at = insert({0: (0, "", [])})
    for role, text, fault in plain_faults(rows):
        to = {}
        for state, (c, a, turns) in at.items():
            put(to, state, (c + 3, a + "D", turns))
            if fault not in ("b", "d"):
                for extra, letter, r in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                    if (new := legal.get((state, r[:1]))) is not None:
                        put(to, new, (c + extra + (fault == "t"), a + letter, [*turns, (r, text)]))
        at = insert(to)
    return min((at[s] for s in (0, 3) if s in at), key=lambda y: y[:2])


def random_rows(rng, n):
    roles, texts = ("user", "assistant", "system", "user", "assistant", "tool", " ", ""), ("Yes.", "No!", "cut off", "", " \t\x0b", "A. B", "Well? ", "é…")
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def audit_of(rows, chunk=None):
    light = [(r[:1], f) for r, _, f in plain_faults(rows)]
    chunk = chunk or max(1, len(light))
    cost, edits = join_chunks([[chunk_paths(light[i : i + chunk], s) for s in range(4)] for i in range(0, len(light), chunk)])
    return cost, "".join(e for _, e in edits)


def test_audits_are_the_cheapest_of_all_edits():
    rng = random.Random(3)
    for _ in range(25):
        rows = random_rows(rng, rng.randint(0, 3))
        assert audit_of(rows) == min(x[:2] for x in every_repair(plain_faults(rows))) == plain_repair(rows)[:2]


def test_audits_of_long_conversations_and_chunks():
    rng = random.Random(4)
    for n in (5, 17, 60, 300):
        rows = random_rows(rng, n) if n < 100 else [(r, f"{t}{i}") for i, (r, t) in enumerate(random_rows(rng, n))]
        want = plain_repair(rows)[:2]
        assert audit_of(rows) == want
        for chunk in (1, 2, 7):
            assert audit_of(rows, chunk) == want


def test_equal_hashes_of_unlike_audits_are_verified():
    rng = random.Random(5)
    for mod in (1, 2, 3, 1 << 61):
        audits = Audits(base=7, mod=mod)
        nodes = [0]
        for _ in range(300):
            nodes.append(audits.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
        for _ in range(400):
            x, y = rng.choice(nodes), rng.choice(nodes)
            assert audits.less(x, y) == (audits.text(x) < audits.text(y))
            assert audits.text(audits.ancestor(x, audits.depth[x] // 2)) == audits.text(x)[: audits.depth[x] // 2]


def plain_conversations(rows):
    """The contract of op11 on rows (conv_id, turn, role, text), from the damage on."""
    by = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by[c] += [(t is not None, t or 0, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for c, x in by.items():
        x.sort()
        turns = {t for known, t, *_ in x if known}
        pairs = [r for *_, r, t in x], [f[2] for f in plain_faults([r[2:] for r in x])]
        cost, audit, done = plain_repair([r[2:] for r in x])
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs[0]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[c] = (gaps, *(pairs[1].count(f) for f in "bdt"), illegal, cost, audit, sha)
    return out


@pytest.mark.parametrize("chunk", [4, 4096])
def test_conversations_match_a_plain_version(spark, chunk):
    rng = random.Random(6)
    rows = [(c, t, *r) for c in range(60) for t, r in enumerate(random_rows(rng, rng.randint(1, 9)))]
    rows += [(100, t, rng.choice(("user", "assistant", "system")), f"{t} {rng.choice(('end.', 'open', '!'))}") for t in range(400)]  # one long conversation
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (101, None, "user", None), (101, None, None, "x."), (102, 5, "user", "Same."), (102, 5, "user", "Same."), (102, 9, "assistant", "y" * 300_000), (103, -4, "system", "S.")]
    dropped = next(c for c in range(10**6, 10**7) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, place int")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(df), df, chunk).collect()}
    assert got == plain_conversations(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_conversations_without_rows_and_their_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(empty), empty).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Why?"), (1, 1, "user", "So."), (1, 2, "assistant", "cut")], empty.schema)
    rows = conversations.faulted(df, 2)
    turns = conversations.repaired_turns(rows, conversations.repair_plans(rows, 2)).orderBy("chunk", "step").collect()
    cost, audit, done = plain_repair([("user", "Why?"), ("user", "So."), ("assistant", "cut")])
    assert [(r.role, r.text) for r in turns] == done and "".join(r.edit for r in turns) == audit.replace("D", "") and cost == 3


def plain_ranking(docs, items, top):
    terms = [(d, collections.Counter(words(t))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(w for _, c in terms for w in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(words(text))
    out = []
    for item, ws in asked.items():
        scored = []
        for d, c in terms:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if w in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def random_text(rng, n):
    return rng.choice((" ", "\n", "-", "…")).join(rng.choice(("the", "The", "of", "Été", "été", "x1", "日本", "a'b")) if rng.random() < 0.6 else f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(n))


@pytest.mark.parametrize(("segment", "part", "top"), [(40, None, 5), (400, 3, 50), (10**6, None, 50)])
def test_ranking_matches_brute_force(spark, monkeypatch, segment, part, top):
    monkeypatch.setattr(lexical_search, "ROUND", 4)
    rng = random.Random(7)
    docs = [(d, random_text(rng, rng.choice((1, 5, 30, 30, 200)))) for d in range(300)]
    docs += [(None, "the w1 w2"), (7, "the"), (7, docs[7][1]), (900, None), (901, ""), (902, " .,;! "), (-5, "The OF"), (903, "of " * 5000 + "w1")]
    items = [(i, random_text(rng, rng.choice((1, 8, 40)))) for i in range(12)] + [(20, None), (21, "zzz unknown"), (None, "the"), (0, "extra the w3"), (22, "the the of"), (-1, "été")]
    df = spark.createDataFrame([(*r, 1.5) for r in docs], "doc_id long, text string, score double").repartition(3)
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, item string")
    index = lexical_search.build_index(df, segment)
    got = sorted((tuple(r) for r in lexical_search.search(index, asked, top, part).collect()), key=str)
    assert got == plain_ranking(docs, items, top)


def test_ranking_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    search = lambda d, i: lexical_search.search(lexical_search.build_index(d), i).collect()
    assert search(docs.limit(0), items) == [] == search(docs, items.limit(0)) and search(docs.selectExpr("doc_id", "' ' AS text"), items) == []
    assert [tuple(r)[:3] for r in search(docs, items)] == [(1, 1, 1)]


def plain_hits(docs, items, window=10):
    rows = []
    phrases = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k : k + window])].add(item)
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in phrases:
                    hit |= set(range(k, k + size))
                    found |= phrases[p]
        ids = sorted(str(i) for i in found if i is not None)
        rows.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


@pytest.mark.parametrize(("segment", "block"), [(64, 50), (500, 10**6), (10**6, 10**6)])
def test_decontamination_matches_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(decontamination, "AT_ONCE", 50)
    monkeypatch.setattr(decontamination, "query_blocks", lambda items, f=decontamination.query_blocks: f(items, block))
    rng = random.Random(8)
    items = [(i, random_text(rng, rng.choice((3, 9, 10, 25)))) for i in range(30)] + [(40, None), (41, " . "), (None, "zq zr zs"), (42, "Alone"), (43, "the of the of the of the of the of the"), (3, "second text of three")]
    docs = [(d, random_text(rng, rng.choice((0, 4, 60, 300)))) for d in range(60)]
    for k in range(40):  # passages, whole and with a word changed
        w = words(items[rng.randrange(30)][1])
        if k % 4 == 0:
            w[len(w) // 2] = "changed"
        docs.append((100 + k, random_text(rng, rng.choice((0, 40))) + " " + ", ".join(w).upper() + "! " + random_text(rng, 20)))
    docs += [(None, "ZQ zr  zs"), (500, None), (501, ""), (100, "alone"), (502, ("the of " * 400) + "alone. ALONE"), (503, "last words: the of the of the"), (504, "of the of the of the of next")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, row int").repartition(3)
    asked = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, terms string")
    got = sorted((tuple(r) for r in decontamination.contamination(df, asked, segment=segment, longest=16).collect()), key=str)
    assert got == plain_hits(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert [tuple(r)[:4] for r in decontamination.contamination(docs, items.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert [tuple(r)[:4] for r in decontamination.contamination(docs, items).collect()] == [(1, 2, 1, 1)]
    with pytest.raises(ValueError, match="longer"):
        decontamination.phrase_matches(decontamination.build_index(docs), items.selectExpr("'i' AS item", "repeat('w ', 80) AS text"))


def test_phrases_and_proximity(spark):
    rng = random.Random(9)
    docs = {d: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((5, 50, 200)))) for d in range(40)}
    phrases = {"p": "a b", "q": "c d c", "r": "e", "s": "a b c d", "t": "zz a"}
    index = decontamination.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 60, 16)
    asked = spark.createDataFrame(list(phrases.items()), "item string, text string")
    exact, near = set(), set()
    for d, text in docs.items():
        w = words(text)
        for item, phrase in phrases.items():
            p = words(phrase)
            exact |= {(d, item, k, k + len(p) - 1) for k in range(len(w)) if w[k : k + len(p)] == p}
            for k in range(len(w)):
                stops = [next((j for j in range(k, len(w)) if w[j] == x), 10**6) for x in p]
                if w[k] in p and max(stops) - k < 6:
                    near.add((d, item, k, max(stops)))
    assert {tuple(r) for r in decontamination.phrase_matches(index, asked, longest=16).collect()} == exact
    assert {tuple(r) for r in decontamination.phrase_matches(index, asked, near=6, longest=16).collect()} == near
