"""Nearest neighbours by inner product with vantage-point trees per shard.

Largest inner product becomes smallest distance: with M the largest norm, a vector x gets one more component
sqrt(M^2 - |x|^2) and a query 0, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x. Rows go to the nearest of a few pivots, and the
rows of a pivot to as many shards as they fill; each shard is a vantage-point tree over those points. A search goes down
the nearer side first and enters the other side only if the triangle inequality allows a point within `tau / factor` of
the query, tau being the distance of its k-th best so far: factor 1 is exact, and a larger factor prunes more and may
miss. Shards are pruned alike: a query first searches one shard of its nearest pivot, and with the tau found there only
those of pivots whose ring of distances may hold a nearer point.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Rows of a shard and queries of a block, on average; points of a leaf; queries scored at once.
SHARD, QUERIES, LEAF, SCORED = 8192, 4096, 128, 256
#: Most pivots, the bounded sample that the index is fitted on: rows of least hash of vec_id. Every row is indexed.
PIVOTS = 1024
#: Rounding allowed for in distances and scores, of the norms' sizes.
SLACK = 1e-12


class Tree:
    """A vantage-point tree over the rows of `points`, as flat arrays."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        if len(points):
            self._grow(np.arange(len(points)))

    def _grow(self, ids: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        p = self.points
        # the point farthest from the first one: no chance, so reruns agree
        v = ids[np.argmax(((p[ids] - p[ids[0]]) ** 2).sum(1))]
        d = np.sqrt(((p[ids] - p[v]) ** 2).sum(1))
        mu = float(np.median(d))
        near = d <= mu
        if len(ids) <= LEAF or near.all() or not near.any():
            self.nodes[at] = (None, ids)
            return at
        inner, outer = d[near], d[~near]
        # the bounds of both sides' distances to the vantage point prune more than the median alone
        bounds = (float(inner.min()), float(inner.max()), float(outer.min()), float(outer.max()))
        self.nodes[at] = (v, mu, bounds, self._grow(ids[near]), self._grow(ids[~near]))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int, factor: float, tau: np.ndarray):
        """The k best (score, row) of each query, as arrays padded with -inf and -1.

        own: each query's own id, not to be found; tau: distances beyond which nothing is wanted.
        """
        n = len(queries)
        self.score, self.row = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.tau, self.norm2 = tau.copy(), (queries**2).sum(1)
        if self.nodes:
            lifted = np.hstack([queries, np.zeros((n, 1))])
            self._visit(0, np.arange(n), lifted, queries, own, ids, exact, k, factor)
        return self.score, self.row

    def _visit(self, at, q, lifted, queries, own, ids, exact, k, factor) -> None:
        node = self.nodes[at]
        if node[0] is None:
            for a in range(0, len(q), SCORED):
                self._leaf(node[1], q[a : a + SCORED], queries, own, ids, exact, k)
            return
        v, mu, (a, b, c, e), inner, outer = node
        d = np.sqrt(((lifted[q] - self.points[v]) ** 2).sum(1))
        low = {inner: np.maximum(a - d, d - b), outer: np.maximum(c - d, d - e)}
        first = d <= mu
        for group, order in ((first, (inner, outer)), (~first, (outer, inner))):
            for side in order:
                go = group & (low[side] <= reach(self.tau[q], factor, self.norm2[q], self.top2))
                if go.any():
                    self._visit(side, q[go], lifted, queries, own, ids, exact, k, factor)

    def _leaf(self, rows, q, queries, own, ids, exact, k) -> None:
        about = queries[q] @ exact[rows].T
        about[own[q][:, None] == ids[rows][None]] = -np.inf
        slack = SLACK * (self.norm2[q] + self.top2)
        i, j = np.nonzero((about >= (self.score[q, k - 1] - slack)[:, None]) & ~np.isneginf(about))
        if not len(i):
            return
        s = np.full(about.shape, -np.inf)
        s[i, j] = scores(queries[q[i]], exact[rows[j]])
        some = np.unique(i)
        q, s = q[some], s[some]
        score, row = np.hstack([self.score[q], s]), np.hstack([self.row[q], np.broadcast_to(rows, s.shape)])
        row = np.where(np.isneginf(score), -1, row)
        row_id = np.where(row >= 0, ids[row], np.iinfo(np.int64).max)
        best = np.lexsort((row_id, -score), axis=1)[:, :k]
        self.score[q], self.row[q] = np.take_along_axis(score, best, 1), np.take_along_axis(row, best, 1)
        self.tau[q] = np.minimum(self.tau[q], distance(self.score[q, k - 1], self.norm2[q], self.top2))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of vectors, summed component by component: the one rule by which rows are ranked."""
    return np.cumsum(queries * rows, axis=1)[:, -1]


def distance(score: np.ndarray, norm2: np.ndarray, top2: float) -> np.ndarray:
    """The distance of a score, rounded up; infinite for none."""
    gap = norm2 + top2 - 2 * score
    return np.where(np.isneginf(score), np.inf, np.sqrt(np.maximum(gap, 0) + 4 * SLACK * (norm2 + top2)))


def reach(tau: np.ndarray, factor: float, norm2: np.ndarray, top2: float) -> np.ndarray:
    """How far a search goes, with a hair more, so that rounding can't hide a tie."""
    return tau / factor + SLACK * np.sqrt(norm2 + top2)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): without null, empty or zero vectors, those with null or non-finite components, and those of another length than most rows have (of lengths that are as frequent, the least)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == (most[0] if most else 0))


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column], np.float64)


def _lift(x: np.ndarray, top2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top2 - (x**2).sum(1), 0))[:, None]])


def _build(top2: float):
    def run(key, pdf):
        import pickle

        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        x = _matrix(pdf["v"])
        tree = Tree(_lift(x, top2))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps((tree.nodes, tree.points, x, pdf["vec_id"].to_numpy(np.int64)), protocol=5)]})

    return run


@dataclass
class Index:
    """Trees by shard, and what is told to every task: for each pivot its point, its first shard, its shards, and its rows' least and greatest distance."""

    trees: DataFrame
    top2: float
    pivots: np.ndarray
    first: np.ndarray
    shards: np.ndarray
    near: np.ndarray
    far: np.ndarray


def _to_pivot(pivots: np.ndarray, top2: float):
    def run(batches):
        for pdf in batches:
            x = _lift(_matrix(pdf["v"]), top2) if len(pdf) else np.zeros((0, pivots.shape[1]))
            # all lifted points have one norm: the nearest pivot is that of largest inner product
            at = (x @ pivots.T).argmax(1)
            yield pdf.assign(pivot=at.astype(np.int32), away=np.sqrt(((x - pivots[at]) ** 2).sum(1)))

    return run


def build_index(vectors: DataFrame, shard_rows: int = SHARD, pivots: int = PIVOTS) -> Index:
    """An index over usable(vectors), its trees kept in the shared folder. Every row is in a shard; a pivot's rows are dealt to its shards by hash."""
    n, top2 = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    top2 = float(top2 or 0)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(1, min(pivots, -(-n // shard_rows)))).toPandas()
    points = _lift(_matrix(chosen["v"]), top2) if n else np.zeros((1, 1))
    rows = keep(vectors.mapInPandas(_to_pivot(points, top2), "vec_id long, v array<double>, pivot int, away double"), "vectors-by-pivot")
    size, near, far = np.zeros(len(points), np.int64), np.full(len(points), np.inf), np.full(len(points), -np.inf)
    for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect():
        size[r.pivot], near[r.pivot], far[r.pivot] = r.n, r.near, r.far
    shards = -(-size // shard_rows)
    first = np.cumsum(shards) - shards
    of = lambda a: F.get(F.from_json(F.lit(json.dumps(a.tolist())), "array<int>"), F.col("pivot"))
    dealt = rows.select("vec_id", "v", (of(first) + F.pmod(F.xxhash64("vec_id"), of(shards))).cast("int").alias("shard"))
    return Index(keep(dealt.groupBy("shard").applyInPandas(_build(top2), "shard int, tree binary"), "vp-trees"), top2, points, first, shards, near, far)


def _visits(x: Index, factor: float, home: bool):
    """The shards that a query has to search: one of its nearest pivot, or with its tau all others that may hold a nearer row."""
    top2, pivots, first, shards, near, far = x.top2, x.pivots, x.first, x.shards, x.near, x.far

    def run(batches):
        for pdf in batches:
            out = []
            for part in (pdf.iloc[a : a + SCORED] for a in range(0, len(pdf), SCORED)):
                q = _matrix(part["v"])
                norm2 = (q**2).sum(1)
                d = np.sqrt(np.maximum(norm2[:, None] + (pivots**2).sum(1) - 2 * q @ pivots[:, :-1].T, 0))
                at = np.where(shards > 0, d, np.inf).argmin(1)
                own = first[at] + part["vec_id"].to_numpy(np.int64) % np.maximum(shards[at], 1)
                if home:
                    out += [[int(s)] for s in own]
                    continue
                # d comes from a difference: it may be off by the root of its rounding
                low = np.maximum(near - d, d - far) - np.sqrt(SLACK * (norm2 + top2))[:, None]
                go = (low <= reach(part["tau"].to_numpy(), factor, norm2, top2)[:, None]) & (shards > 0)
                for g, s in zip(go, own, strict=True):
                    all_ = np.concatenate([np.arange(first[p], first[p] + shards[p]) for p in np.flatnonzero(g)] or [np.zeros(0, np.int64)])
                    out.append(all_[all_ != s].tolist())
            yield pdf.assign(shards=out)

    return run


def _search(top2: float, k: int, factor: float):
    def run(key, queries, shard):
        import pickle

        import pandas as pd

        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "tau": pd.Series(dtype="float64")})
        if not len(queries) or not len(shard):
            return out
        nodes, lifted, exact, ids = pickle.loads(shard["tree"].iloc[0])
        tree = Tree(np.zeros((0, 0)))
        tree.nodes, tree.points, tree.top2 = nodes, lifted, top2
        q, own = _matrix(queries["v"]), queries["vec_id"].to_numpy(np.int64)
        score, row = tree.search(q, own, ids, exact, k, factor, queries["tau"].to_numpy(np.float64))
        i, j = np.nonzero(row >= 0)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids[row[i, j]], "score": score[i, j], "tau": tree.tau[i]})

    return run


def search(index: Index, queries: DataFrame, k: int = 20, factor: float = 1.0, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query (vec_id, v), ties to smaller vec_id.

    A query meets its shards in blocks, each with one shard in a task of its own; a shard goes only to blocks that have
    queries for it. A shard gives k rows per query, and those are ranked. Rows of a query's own id are no candidates;
    queries of one id count once, by the least vector.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumns({"tau": F.lit(float("inf")), "block": F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")})
    visited = "vec_id long, v array<double>, tau double, block int, shards array<int>"

    def found(queries: DataFrame, home: bool) -> DataFrame:
        asked = queries.select("vec_id", "v", "tau", "block").mapInPandas(_visits(index, factor, home), visited)
        asked = keep(asked.select("vec_id", "v", "tau", "block", F.explode("shards").alias("shard")), "ann-visits")
        wanted = asked.select(F.col("block").alias("for_block"), F.col("shard").alias("of")).distinct()
        trees = index.trees.join(wanted, F.col("shard") == F.col("of")).select("for_block", "of", "tree")
        both = asked.groupBy("block", "shard").cogroup(trees.groupBy("for_block", "of"))
        return keep(both.applyInPandas(_search(index.top2, k, factor), "query_id long, vec_id long, score double, tau double"), "ann-found")

    first = found(queries, True)
    known = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("tau").alias("known"))
    more = found(queries.join(known, "vec_id", "left").withColumn("tau", F.coalesce("known", "tau")), False)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    both = first.unionByName(more).withColumn("rank", rank.cast("int"))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`.

    vectors (vec_id, embedding; others are ignored). Null, zero or empty vectors, those with null or non-finite
    components, those of another length than most rows and rows without vec_id take no part. vec_id is a key: rows that
    repeat one are candidates each, though not for their own id, and one query. No rows, no result.
    """
    rows = keep(usable(vectors), "vectors")
    return search(build_index(rows), rows.where(F.col("vec_id") % every == 0), k, factor)


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
