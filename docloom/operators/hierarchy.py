"""Entries, the three-level tree, search and lookup.

entries: doc_id, pos, section, big_title, seq, label, value, kind (sub, field, note, component), and sub_title once made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .scan import carried


def _so_far():
    return Window.partitionBy("doc_id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def opens_sub():
    """A sub row, or a field with a number, opens a sub-title."""
    return (F.col("kind") == "sub") | ((F.col("kind") == "field") & (F.col("seq") != ""))


def with_sub_titles(entries: DataFrame) -> DataFrame:
    """sub_title and full_label: the running sub-title of each entry, '' before the first."""
    full = T.full_label(F.col("seq"), F.col("label"))
    x = carried(entries.withColumn("full_label", full), ["doc_id", "section"], ["pos"], {"sub_title": F.when(opens_sub(), full)})
    return x.withColumn("sub_title", F.when(F.col("kind") == "component", "成分").otherwise(F.coalesce("sub_title", F.lit(""))))


def document_entries(rows: DataFrame, sections: DataFrame, components: DataFrame) -> DataFrame:
    """Entries of unified rows (doc_id, section, ord, ...), sections (with full_title, is_component_table, component_header) and ingredients.

    Sections of ingredients add a header entry and one entry per ingredient after the section's rows.
    """
    s = sections.select("doc_id", "section", F.col("full_title").alias("big_title"), "is_component_table", "component_header")
    base = rows.join(s, ["doc_id", "section"]).select("doc_id", F.col("ord").alias("pos"), "section", "big_title", "seq", "label", "value", "kind", "editable")
    tables = s.where("is_component_table")
    after = F.lit(1 << 40)
    head = tables.select("doc_id", after.alias("pos"), "section", "big_title", F.lit("").alias("seq"), F.lit("成分表头").alias("label"), F.coalesce(F.nullif("component_header", F.lit("")), F.lit(X.DEFAULT_COMPONENT_HEADER)).alias("value"), F.lit("component_header").alias("kind"), F.lit(False).alias("editable"))
    value = F.concat("name", F.lit(" | CAS: "), "cas", F.lit(" | 含量: "), "conc")
    parts = components.join(tables, ["doc_id", "section"]).select("doc_id", (after + 1 + F.col("idx")).alias("pos"), "section", "big_title", F.lit("").alias("seq"), F.col("name").alias("label"), value.alias("value"), F.lit("component").alias("kind"), F.lit(True).alias("editable"))
    e = with_sub_titles(base)
    extra = head.unionByName(parts).withColumns({"full_label": T.full_label(F.col("seq"), F.col("label")), "sub_title": F.lit("成分")})
    return e.unionByName(extra)


def flatten_tree(entries: DataFrame) -> DataFrame:
    """The tree as rows: fields with a number but no value go, entries before any sub-title come last in their section.

    Adds ord, the place in the document: (section, direct or not, pos).
    """
    x = entries.withColumn("_big", F.last(F.when(opens_sub(), F.col("pos")), ignorenulls=True).over(_so_far())).where("kind <> 'component_header'")
    direct = F.col("_big").isNull() | (F.col("kind") == "component")
    x = x.withColumn("is_direct", direct).withColumn("sub_title", F.when(direct, "").otherwise(F.col("sub_title")))
    x = x.where(~((F.col("kind") == "field") & (F.col("seq") != "") & (F.col("value") == "")))
    return x.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "is_direct", "pos")).cast("long")).drop("_big")


def terms_of(query: str, norm=None) -> list[str]:
    """The words of a query, as the search normaliser has them."""
    import re

    drop = re.compile(r"[\s：:，,。；;（）()\-]")
    return [drop.sub("", t).lower() for t in query.split()]


def haystack(scope: str):
    n = T.search_norm
    full = n(T.full_label(F.col("seq"), F.col("label")))
    if scope == "label":
        return full
    if scope == "value":
        return n(F.col("value"))
    if scope == "section":
        return F.col("section").cast("string")
    return F.concat_ws(" ", full, n(F.col("sub_title")), n(F.col("big_title")), n(F.col("value")))


def search_all(entries: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """Entries that hold every word of the query; a query without words keeps all."""
    hay = haystack(scope)
    return entries.where(reduce(lambda a, b: a & b, [hay.contains(t) for t in terms_of(query)], F.lit(True)))


#: Most queries of one search_many call; more are searched in several calls.
MOST_QUERIES = 10_000


def search_many(entries: DataFrame, queries: DataFrame, scope: str = "all", most: int = MOST_QUERIES) -> DataFrame:
    """Hits of a table of queries (query_id, terms array<string>, normalised): one pass, each entry tested against all.

    Words are found anywhere in an entry, so no key can join them: queries is a stated set of `most` at most (an error
    beyond), told to every task as one constant, and each entry is read once.
    """
    import json

    rows = queries.select("query_id", "terms").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} queries: search them in parts")
    kind = queries.schema["query_id"].dataType.simpleString()
    listed = F.from_json(F.lit(json.dumps([{"query_id": r.query_id, "terms": r.terms} for r in rows])), f"array<struct<query_id:{kind},terms:array<string>>>")
    x = entries.withColumn("_hay", haystack(scope))
    hit = F.filter(listed, lambda q: F.forall(q["terms"], lambda t: F.col("_hay").contains(t)))
    return x.withColumn("query_id", F.explode(F.transform(hit, lambda q: q["query_id"]))).drop("_hay")


def search_any(entries: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """Tree search: any word; a hit section keeps all, a hit sub-title its subtree, a hit entry itself and its sub-title.

    Two windows mark the hits of sections and sub-titles, then one filter keeps their rows.
    """
    terms = terms_of(query)
    if not terms:
        return entries
    n = T.search_norm
    any_in = lambda c: reduce(lambda a, b: a | b, [c.contains(t) for t in terms])
    full, value = n(T.full_label(F.col("seq"), F.col("label"))), n(F.col("value"))
    section_hit = any_in(F.col("section").cast("string")) if scope == "section" else any_in(n(F.col("big_title"))) if scope == "all" else F.lit(False)
    opener = opens_sub()
    own = any_in(full) if scope == "label" else any_in(value) if scope == "value" else any_in(F.concat_ws(" ", full, value))
    leaf = any_in(n(F.col("label"))) if scope == "label" else any_in(value) if scope == "value" else any_in(F.concat_ws(" ", n(F.col("label")), value))
    x = entries.withColumns({"_big": F.when(F.col("kind") != "component", F.last(F.when(opener, F.col("pos")), ignorenulls=True).over(_so_far())), "_opener": opener, "_hit": F.when(opener, own).otherwise(leaf)})
    big = Window.partitionBy("doc_id", "section", "_big")
    x = x.withColumns({"_section": section_hit, "_big_hit": F.col("_big").isNotNull() & F.coalesce(F.max(F.when(F.col("_opener"), F.col("_hit"))).over(big), F.lit(False)), "_any": F.col("_big").isNotNull() & F.max("_hit").over(big)})
    return x.where(F.col("_section") | F.col("_big_hit") | F.col("_hit") | (F.col("_opener") & F.col("_any"))).drop("_big", "_opener", "_hit", "_section", "_big_hit", "_any")


def hit_sections(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "section", "big_title").distinct()


def get_field(entries: DataFrame, section: int, label: str) -> DataFrame:
    """Per document the first field or ingredient of the section with this label (normalised)."""
    (want,) = terms_of(label) or [""]
    hit = entries.where((F.col("section") == section) & F.col("kind").isin("field", "component") & (T.search_norm(F.col("label")) == want))
    return hit.groupBy("doc_id").agg(F.min(F.struct("pos", "label", "value", "seq", "kind")).alias("f")).select("doc_id", "f.*")


def extract_many(documents: DataFrame, entries: DataFrame, query: str = "", scope: str = "all", sections: list[int] | None = None) -> DataFrame:
    """Entries of each document that match, with one null entry for a document that has none."""
    e = entries.where(F.col("section").isin(*sections)) if sections else entries
    return documents.select("doc_id").distinct().join(search_all(e, query, scope), "doc_id", "left")


def hit_counts(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, n_hits, and the total with a null doc_id."""
    per = documents.select("doc_id").distinct().join(hits.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return per.rollup("doc_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_hits"))


def field_map(entries: DataFrame) -> DataFrame:
    """doc_id, section, label, value: of fields with one label the last."""
    return entries.where("kind = 'field'").groupBy("doc_id", "section", "label").agg(F.max_by("value", "pos").alias("value"))


def tree(entries: DataFrame) -> DataFrame:
    """doc_id, section, big_title, big_titles (each with its children) and direct_fields, in order."""
    opener = opens_sub()
    x = entries.where("kind <> 'component_header'").withColumns({"_big": F.when(F.col("kind") != "component", F.last(F.when(opener, F.col("pos")), ignorenulls=True).over(_so_far())), "_opener": opener})
    leaf = F.struct("pos", "label", "value", "kind")
    ordered = lambda c: F.array_sort(F.collect_list(c))
    big = x.groupBy("doc_id", "section", "big_title", "_big").agg(
        F.first(F.when(F.col("_opener"), F.struct("seq", "label", "value", "kind")), ignorenulls=True).alias("o"), ordered(F.when(~F.col("_opener"), leaf)).alias("children")
    )
    node = F.struct(F.col("_big").alias("pos"), F.col("o.seq").alias("seq"), F.col("o.label").alias("title"), F.col("o.value").alias("value"), F.col("o.kind").alias("kind"), "children")
    return big.groupBy("doc_id", "section", "big_title").agg(
        ordered(F.when(F.col("_big").isNotNull(), node)).alias("big_titles"), F.flatten(F.collect_list(F.when(F.col("_big").isNull(), F.col("children")))).alias("direct_fields")
    )
