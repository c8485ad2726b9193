"""Conversation structure repair: the cheapest edits that make turns alternate, as an audit string, by a persistent DP.

A conversation's rows stand in order of turn (nulls first), role and text. They are sorted by ranges, so a long conversation
lies in several tasks, and cut into chunks of rows. For each chunk, and each state in which it can be entered, the DP finds
the cheapest edits to each state in which it can be left. Edit prefixes are linked nodes that share their beginnings; a node
knows its ancestors at 1, 2, 4, ... steps and the rolling hash of its string, so two prefixes of equal cost are compared at
their longest common prefix, which a search over the ancestors finds; where it rests on equal hashes, the letters are
compared as well. A conversation's chunks are then joined in order in the same way, on their strings alone; texts are read
once more with the chosen edits beside them and go through the hash as a stream.

Of two prefixes of one cost that end in one state after the same rows, neither continues the other: the rest would be
inserts that lead back to the state, and those cost something. So the least prefix stays the least whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep, table

#: Rows of a chunk at most.
CHUNK = 4096
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. What each expects beside the
#: system's turn (which only the first state takes), and where that leads.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = "uuau"
AFTER = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NAMES = {"u": "user", "a": "assistant"}
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)


class Audits:
    """Strings as linked nodes: node 0 is the empty string, any other is its parent's string and one letter more."""

    def __init__(self, base: int = _BASE, mod: int = _MOD):
        self.base, self.mod = base, mod
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]  # up[x][k]: the ancestor 2^k letters before

    def add(self, parent: int, letter: str) -> int:
        up, at, k = [parent], parent, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.mod)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, x: int, depth: int) -> int:
        steps, k = self.depth[x] - depth, 0
        while steps:
            if steps & 1:
                x = self.up[x][k]
            steps, k = steps >> 1, k + 1
        return x

    def _equal(self, x: int, y: int) -> bool:
        """Letter by letter, up to where the two share a node."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hash[a] == self.hash[b]:
            if self._equal(a, b):
                return self.depth[x] < self.depth[y]
            return self.text(x) < self.text(y)
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if self._equal(self.up[a][0], self.up[b][0]):
            return self.letter[a] < self.letter[b]
        return self.text(x) < self.text(y)

    def text(self, x: int) -> str:
        out = []
        while x:
            out.append(self.letter[x])
            x = self.up[x][0]
        return "".join(reversed(out))


def _take(audits: Audits, best: list, state: int, cost: int, parent: int, letter: str) -> bool:
    """Put the string parent + letter at `state` if it is cheaper, or as cheap and less, than what stands there."""
    if best[state] is not None and best[state][0] < cost:
        return False
    node = audits.add(parent, letter) if letter else parent
    if best[state] is None or cost < best[state][0] or audits.less(node, best[state][1]):
        best[state] = (cost, node)
        return True
    return False


def _inserts(audits: Audits, best: list) -> list:
    for _ in range(2):  # two inserts in a row lead from any state to a final one; more lead back
        for state in range(4):
            if best[state] is not None:
                _take(audits, best, AFTER[state], best[state][0] + INSERT, best[state][1], "I")
    return best


def chunk_paths(rows: list[tuple[str, str]], start: int) -> list[tuple[int, str] | None]:
    """For each state at the end, cost and least audit of the cheapest edits from `start`; rows: initial of the role, and the fault (b, d, t or none)."""
    audits = Audits()
    best: list = [None] * 4
    best[start] = (0, 0)
    best = _inserts(audits, best)
    for initial, fault in rows:
        after: list = [None] * 4
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _take(audits, after, state, cost + DELETE, node, "D")
            if fault in ("b", "d"):
                continue
            cost += TRUNCATED * (fault == "t")
            if state == START and initial == "s":
                _take(audits, after, SYSTEM, cost, node, "K")
            if initial == EXPECTED[state]:
                _take(audits, after, AFTER[state], cost, node, "K")
            else:
                _take(audits, after, AFTER[state], cost + REROLE, node, "R")
        best = _inserts(audits, after)
    return [x and (x[0], audits.text(x[1])) for x in best]


class Joined:
    """Audits of a conversation's chunks on end as linked nodes: node 0 is the empty one, any other a chunk's audit after its parent."""

    def __init__(self):
        self.label, self.start, self.up = [""], [START], [[]]

    def add(self, parent: int, start: int, label: str) -> int:
        up, at = [parent], parent
        while len(up) <= len(self.up[at]):
            at = self.up[at][len(up) - 1]
            up.append(at)
        self.label.append(label)
        self.start.append(start)
        self.up.append(up)
        return len(self.label) - 1

    def ancestor(self, x: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                x = self.up[x][k]
            steps, k = steps >> 1, k + 1
        return x

    def less(self, x: int, y: int) -> bool:
        """Whether x's string is less; both end with the same chunk. Compared are the chunks from where the two part, until they differ."""
        a, b, steps = x, y, 0  # the highest ancestors that differ, and the steps to them
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b, steps = self.up[a][k], self.up[b][k], steps + (1 << k)
        left = right = ""
        for back in range(steps, -1, -1):
            left, right = left + self.label[self.ancestor(x, back)], right + self.label[self.ancestor(y, back)]
            n = min(len(left), len(right))
            if left[:n] != right[:n]:
                break
            left, right = left[n:], right[n:]
        return left < right


def join_chunks(chunks: Iterator[list[list]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and for each chunk the state at its beginning and its audit; chunks: for each state at the beginning the paths to each at the end, or None."""
    joined = Joined()
    best: list = [(0, 0), None, None, None]

    def better(cost: int, node: int, held: tuple[int, int] | None) -> bool:
        return held is None or cost < held[0] or cost == held[0] and joined.less(node, held[1])

    for paths in chunks:
        after: list = [None] * 4
        for start, held in enumerate(best):
            for end, path in enumerate(paths[start] if held else ()):
                if path is None or after[end] and after[end][0] < held[0] + path[0]:
                    continue
                node = joined.add(held[1], start, path[1])
                if better(held[0] + path[0], node, after[end]):
                    after[end] = (held[0] + path[0], node)
        best = after
    cost, node = best[START]
    if best[ASSISTANT] and better(*best[ASSISTANT], best[START]):
        cost, node = best[ASSISTANT]
    out = []
    while node:
        out.append((joined.start[node], joined.label[node]))
        node = joined.up[node][0]
    return cost, out[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows with faults made by crc32("conv_id:turn") % 20 (a null counts as one space in it, and as role or text).

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    rows = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times)
    return rows.select("conv_id", "turn", "role", "text")


def _key(conv_id: Column) -> Column:
    """A conversation's name that is never null."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("none"))


def faulted(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, chunk, place, turn, role, text, fault of rows (conv_id, turn, role, text), kept in the shared folder; place is the order of all rows.

    fault: b for a text that is blank, d for a role and text that stood in the conversation before, t for a text whose last
    character that is no white space is none of `.!?`; the first of these, or none. Order: turn (nulls first), role, text.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(_key(F.col("conv_id")).alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["key", F.asc_nulls_first("turn"), "role"]
    rows = rows.repartitionByRange(parts, *order, F.left("text", F.lit(100))).sortWithinPartitions(*order, "text")
    rows = keep(rows.withColumn("place", F.monotonically_increasing_id()), "turns").withColumn("same", F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256))
    first = rows.groupBy("key", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["key", "same"], "left")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(F.rtrim("text", F.lit(SPACES)) == "", "b").when(F.col("place") > F.col("first"), "d").when(~last.isin(*".!?"), "t").otherwise("")
    return keep(rows.select("key", F.floor(F.col("place") / chunk).alias("chunk"), "place", "turn", "role", "text", fault.alias("fault")), "faults")


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of sorted batches by their first n columns, as they come."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, lambda row: row[:n])


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of 1 MB of strings or `most` rows, about."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= 1 << 20:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


_CHUNKS = pa.schema([("key", pa.string()), ("chunk", pa.int64()), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_PLANS = pa.schema([("key", pa.string()), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("chunks", pa.list_(pa.int64())), ("states", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])
_TURNS = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_ddl = lambda schema: ", ".join(f"{f.name} {'array<' * pa.types.is_list(f.type)}{'string' if 'string' in str(f.type) else 'long'}{'>' * pa.types.is_list(f.type)}" for f in schema)  # noqa: E731


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _chunked(chunk: int):
    def summaries(batches):
        for (key, number), rows in _groups(batches, 2):
            places, initials, faults = zip(*(r[2:] for r in rows), strict=True)
            paths = [chunk_paths(list(zip(initials, faults, strict=True)), s) for s in (range(1) if places[0] % chunk else range(4))]
            paths = [p for s in paths for p in s] + [None] * 4 * (4 - len(paths))  # a conversation that begins within a chunk begins at the start
            illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
            yield key, number, faults.count("b"), faults.count("d"), faults.count("t"), illegal, initials[0], initials[-1], [p and p[0] for p in paths], [p and p[1] for p in paths]

    return lambda batches: _batched(summaries(batches), _CHUNKS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plans():
        for (key,), rows in _groups(batches, 1):
            chunks, last, sums = [], None, [0] * 4

            def paths(rows=rows, chunks=chunks, sums=sums):
                nonlocal last
                for _, number, *counts, first, end, costs, audits in rows:
                    sums[:] = map(sum, zip(sums, counts, strict=True))
                    sums[3] += last is not None and not _legal(last, first)
                    last = end
                    chunks.append(number)
                    both = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
                    yield [both[s : s + 4] for s in range(0, 16, 4)]

            cost, edits = join_chunks(paths())
            yield key, *sums, cost, "".join(e for _, e in edits), chunks, [s for s, _ in edits], [e for _, e in edits]

    return _batched(plans(), _PLANS)


def repair_plans(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, blank, duplicate, truncated, illegal, cost, audit, chunks, states, edits of each conversation of faulted() rows; kept in the shared folder."""
    light = rows.select("key", "chunk", "place", F.left("role", F.lit(1)).alias("initial"), "fault")
    chunks = light.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place").mapInArrow(_chunked(chunk), _ddl(_CHUNKS))
    return keep(chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_joined, _ddl(_PLANS)), "repairs")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def turns():
        for (key, chunk), rows in _groups(batches, 2):
            _, _, _, letters, state, *_ = next(rows)  # the chunk's edits come first
            letters, step = iter(letters), 0
            for row in [*rows, None]:
                for letter in letters:
                    turn, role, text = row[5:] if row else (None, None, None)
                    if letter == "I":
                        yield key, chunk, step, letter, None, NAMES[EXPECTED[state]], ""
                        state = AFTER[state]
                    elif letter == "D":
                        break
                    else:
                        yield key, chunk, step, letter, turn, role if letter == "K" else NAMES[EXPECTED[state]], text
                        state = SYSTEM if letter == "K" and state == START and role[0] == "s" else AFTER[state]
                        step += 1
                        break
                    step += 1

    return _batched(turns(), _TURNS)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """key, chunk, step, edit, turn, role, text: what faulted() rows become by their plans; a conversation's turns stand by chunk and step."""
    edits = plans.select("key", F.explode(F.arrays_zip("chunks", "states", "edits")).alias("e")).select("key", "e.*")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)  # noqa: E731
    heads = edits.select("key", F.col("chunks").alias("chunk"), F.lit(-1).cast("long").alias("place"), F.col("edits").alias("letters"), F.col("states").alias("state"), none("long", "turn"), none("string", "role"), none("string", "text"))
    turns = rows.select("key", "chunk", "place", none("string", "letters"), none("long", "state"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return heads.unionAll(turns).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place").mapInArrow(_edited, _ddl(_TURNS))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests():
        for (key,), rows in _groups(batches, 1):
            h, parted = hashlib.sha256(), b""
            for _, role, text in rows:
                h.update(parted + f"{role}:{text}".encode())
                parted = b"\n"
            yield key, h.hexdigest()

    return _batched(digests(), pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))


def repair(rows: DataFrame, conversations: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of rows (conv_id, turn, role, text) and of `conversations`.

    Null role and text count as one space; rows with a null conv_id are one conversation; repeated rows are rows each, the
    later ones duplicates; rows of one turn stand by role and text; other columns are ignored. A role of no known initial
    is never kept. A conversation without rows has zeros, an empty audit and the empty string's hash. chunk is a power of
    two. A task holds a chunk's rows without their texts, then a conversation's audits, a letter a row; texts pass as a stream.
    """
    known = (rows if conversations is None else conversations).select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    rows = faulted(rows, chunk)
    turns = rows.groupBy("key", "turn").count().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    plans = repair_plans(rows, chunk)
    texts = repaired_turns(rows, plans).repartition("key").sortWithinPartitions("key", "chunk", "step").select("key", "role", "text")
    digests = texts.mapInArrow(_digests, "key string, repaired_sha256 string")
    out = known.join(turns, "key", "left").join(plans, "key", "left").join(digests, "key", "left")
    numbers = [F.coalesce(F.col(x).cast("long"), F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda x: ascii(substr(k, x, 1))::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS f
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM drawn)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '[ 	-]+$', '') AS stripped FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN stripped = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM ordered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS s0, {'c': 1000000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS s1,
         {'c': 2::BIGINT, 'a': 'I', 'r': ['user:']::VARCHAR[]} AS s2, {'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']::VARCHAR[]} AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, n, i, d0, d1, e2, least(d3, {'c': e2.c + 2, 'a': e2.a || 'I', 'r': list_append(e2.r, 'assistant:')})
  FROM (
    SELECT *, least(d2, {'c': d0.c + 2, 'a': d0.a || 'I', 'r': list_append(d0.r, 'user:')}, {'c': d1.c + 2, 'a': d1.a || 'I', 'r': list_append(d1.r, 'user:')},
                        {'c': d3.c + 2, 'a': d3.a || 'I', 'r': list_append(d3.r, 'user:')}) AS e2
    FROM (
      SELECT conv_id, n, i,
             {'c': s0.c + 3, 'a': s0.a || 'D', 'r': s0.r} AS d0,
             least({'c': s1.c + 3, 'a': s1.a || 'D', 'r': s1.r}, {'c': s0.c + w + CASE WHEN initial = 's' THEN 0 ELSE 1000000000000 END, 'a': s0.a || 'K', 'r': list_append(s0.r, kept)}) AS d1,
             least({'c': s2.c + 3, 'a': s2.a || 'D', 'r': s2.r}, {'c': s0.c + w + pu, 'a': s0.a || eu, 'r': list_append(s0.r, ru)},
                   {'c': s1.c + w + pu, 'a': s1.a || eu, 'r': list_append(s1.r, ru)}, {'c': s3.c + w + pu, 'a': s3.a || eu, 'r': list_append(s3.r, ru)}) AS d2,
             least({'c': s3.c + 3, 'a': s3.a || 'D', 'r': s3.r}, {'c': s2.c + w + pa, 'a': s2.a || ea, 'r': list_append(s2.r, ra)}) AS d3
      FROM (
        SELECT k.conv_id, k.n, m.i, s0, s1, s2, s3, initial, role || ':' || text AS kept,
               CASE WHEN fault IN ('b', 'd') THEN 1000000000000 WHEN fault = 't' THEN 1 ELSE 0 END::BIGINT AS w,
               CASE WHEN initial = 'u' THEN 0 ELSE 2 END AS pu, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS eu, CASE WHEN initial = 'u' THEN role || ':' || text ELSE 'user:' || text END AS ru,
               CASE WHEN initial = 'a' THEN 0 ELSE 2 END AS pa, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS ea, CASE WHEN initial = 'a' THEN role || ':' || text ELSE 'assistant:' || text END AS ra
        FROM walk k JOIN marked m ON m.conv_id IS NOT DISTINCT FROM k.conv_id AND m.i = k.i + 1)))),
ended AS (SELECT conv_id, least(s0, s3) AS s FROM walk WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
