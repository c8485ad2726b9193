"""A gram index over entries, for any number of queries at once.

Every entry's normalised text is posted under its grams of one to three characters. A query's words need all their grams
(a word of one or two characters is a gram itself), so its hits are among the postings of any of them: the rarest few are
joined and intersected, once for all queries that have the same, and only what is left is read and tested word by word. Nothing is compared with nothing in common:
queries and entries meet by equality of grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from . import hierarchy

#: Longest gram, and the grams of a query that are intersected before its candidates are read.
LONGEST, MET = 3, 3
#: A gram is intersected with a query's rarest one only if it has at most so many times its postings: more cost more than the texts that they spare.
WITHIN = 2
#: The gram of every entry: a query without words keeps all.
EVERY = ""


@dataclass
class SearchIndex:
    """texts: doc_id, pos, text (normalised); postings: gram, doc_id, pos; frequencies: gram, n."""

    texts: DataFrame
    postings: DataFrame
    frequencies: DataFrame

    def drop(self) -> None:
        store.drop(self.texts, self.postings, self.frequencies)


def _runs(text: Column, n: int) -> Column:
    """All substrings of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def text_grams(text: Column) -> Column:
    """Distinct grams of an entry; no word has a space, so grams with one are of no use."""
    every = F.concat(*[_runs(text, n) for n in range(1, LONGEST + 1)])
    return F.array_append(F.array_distinct(F.filter(every, lambda g: ~g.contains(" "))), F.lit(EVERY))


def word_grams(word: Column) -> Column:
    """The longest grams that a word has all of."""
    return F.when(F.length(word) <= LONGEST, F.array(word)).otherwise(_runs(word, LONGEST))


def build_index(entries: DataFrame, scope: str = "all") -> SearchIndex:
    """Index entries (doc_id, pos and what hierarchy.haystack of the scope reads); kept in the shared folder, postings where their texts are read."""
    texts = store.keep(entries.select("doc_id", "pos", hierarchy.haystack(scope).alias("text")), "search-texts")
    # neither shuffled nor sorted: a gram of very many entries lies in many files
    postings = store.keep(texts.select(F.explode(text_grams(F.col("text"))).alias("gram"), "doc_id", "pos"), "search-postings")
    return SearchIndex(texts, postings, store.keep(postings.groupBy("gram").agg(F.count("*").alias("n")), "search-frequencies"))


def _chosen(index: SearchIndex, queries: DataFrame, met: int) -> DataFrame:
    """query_id, terms, grams: the grams of each query to intersect, the rarest first; queries with a gram that no entry has are dropped."""
    needed = F.array_distinct(F.flatten(F.transform(F.filter("terms", lambda t: t != ""), word_grams)))
    needed = F.when(F.size(needed) > 0, needed).otherwise(F.array(F.lit(EVERY)))
    grams = queries.select("query_id", "terms", F.explode(needed).alias("gram"))
    # a gram that no entry has ends its query: it is the rarest
    by = grams.join(index.frequencies, "gram", "left").select("query_id", "terms", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    best = by.groupBy("query_id", "terms").agg(F.slice(F.array_sort(F.collect_list("g")), 1, met).alias("g")).where(F.col("g")[0]["n"] > 0)
    near = F.filter("g", lambda x: x["n"] <= WITHIN * F.col("g")[0]["n"])
    return store.keep(best.select("query_id", "terms", F.transform(near, lambda x: x["gram"]).alias("grams")), "search-chosen")


def _entries_with(index: SearchIndex, chosen: DataFrame) -> DataFrame:
    """grams, doc_id, pos: the entries that hold all of each distinct set of grams, however many queries have it."""
    sets = chosen.select("grams").distinct().select("grams", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    return index.postings.join(sets, "gram").groupBy("grams", "size", "doc_id", "pos").agg(F.count("*").alias("n")).where("n = size").select("grams", "doc_id", "pos")


def candidates(index: SearchIndex, queries: DataFrame, met: int = MET) -> DataFrame:
    """query_id, terms, doc_id, pos: the entries that hold the rarest grams, `met` at most, of each query (query_id, terms array<string>)."""
    chosen = _chosen(index, queries, met)
    return _entries_with(index, chosen).join(chosen, "grams").select("query_id", "terms", "doc_id", "pos")


def search(index: SearchIndex, queries: DataFrame, met: int = MET) -> DataFrame:
    """query_id, doc_id, pos of the entries that hold every word of each query: the hits of hierarchy.search_many, for any number of queries."""
    chosen = _chosen(index, queries, met)
    # texts are read before queries multiply the entries
    found = _entries_with(index, chosen).join(index.texts, ["doc_id", "pos"]).join(chosen, "grams")
    return found.where(F.forall("terms", lambda t: F.col("text").contains(t))).select("query_id", "doc_id", "pos")
