"""The corpus pivot: one row per document, one column per section and label."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import fixed as X
from ..functions import text as T

#: Most columns of one wide table, and labels that are told to every task at once.
MOST_COLUMNS = 20_000


def pivot_input(entries: DataFrame) -> DataFrame:
    """doc_id, doc_ord, pos, section, kind (field, note, comp), norm_label, seq, value; sub rows and headers are no columns.

    A field without a label counts as a note. doc_ord orders documents; without it doc_id does.
    """
    x = entries if "doc_ord" in entries.columns else entries.withColumn("doc_ord", F.col("doc_id"))
    blank = (F.col("kind") == "field") & (T.strip(T.text(F.col("label"))) == "")
    kind = F.when(F.col("kind").isin("note") | blank, "note").when(F.col("kind") == "comp", "comp").otherwise("field")
    label = F.when(kind == "note", X.SUMMARY_COLUMN).when(kind == "comp", F.col("label")).otherwise(T.pivot_label(F.col("section"), F.col("label")))
    return x.where("kind in ('field', 'note', 'comp')").select("doc_id", "doc_ord", "pos", "section", kind.alias("kind"), label.alias("norm_label"), "seq", "value")


def pivot_columns(p: DataFrame) -> DataFrame:
    """section, kind, norm_label, seq, col_ord: the columns with any value, in order of section and first sight.

    seq is the most frequent number of a column; ties go to the shorter, then to the first seen.
    """
    seen = F.struct("doc_ord", "pos")
    keys = ["section", "kind", "norm_label"]
    cols = p.groupBy(*keys).agg(F.min(seen).alias("first"), F.max((T.strip(T.text(F.col("value"))) != "") | (F.col("kind") == "comp")).alias("any"))
    per = p.where("seq <> '' and kind <> 'comp'").groupBy(*keys, "seq").agg(F.count("*").alias("n"), F.min(seen).alias("at"))
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("seq").alias("len"), "at", "seq")).alias("b")).select(*keys, F.col("b.seq").alias("seq"))
    x = cols.where("any").join(best, keys, "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    return x.withColumn("col_ord", F.row_number().over(Window.partitionBy("section").orderBy("first", "kind"))).drop("first", "any")


def pivot_head(columns: DataFrame, sections: DataFrame) -> DataFrame:
    """The two-row header: section_title (of the first document that has it; 第N节 without one) and head (seq and label)."""
    title = sections.groupBy("section").agg(F.min_by("full_title", "doc_id").alias("t"))
    t = F.when(F.col("section") == 0, X.PAGE_SECTION_TITLE).otherwise(F.coalesce("t", F.concat(F.lit("第"), F.col("section").cast("string"), F.lit("节"))))
    return columns.join(title, "section", "left").select("section", "col_ord", t.alias("section_title"), F.concat_ws(" ", F.nullif("seq", F.lit("")), "norm_label").alias("head"), "kind")


def pivot_cells(p: DataFrame) -> DataFrame:
    """doc_id, section, kind, norm_label, value: the first value that is not empty; notes of a section joined by line."""
    has = T.strip(T.text(F.col("value"))) != ""
    first = F.min(F.when(has, F.struct("pos", "value")))["value"]
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has & (F.col("kind") == "note"), F.struct("pos", "value")))), lambda s: s["value"]), "\n")
    return p.groupBy("doc_id", "section", "kind", "norm_label").agg(F.when(F.col("kind") == "note", notes).otherwise(F.coalesce(first, F.lit(""))).alias("value"))


def numbered_columns(columns: DataFrame) -> DataFrame:
    """columns with number, their place from 0 in order of section and col_ord: what comes to the driver is a count for each section."""
    before, offsets = 0, []
    for section, n in sorted(columns.groupBy("section").count().collect()):
        offsets += [F.lit(section), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*offsets), F.col("section")) if offsets else F.lit(0)
    return columns.withColumn("number", (offset + F.col("col_ord") - 1).cast("long"))


def column_slices(columns: DataFrame, most: int = MOST_COLUMNS) -> Iterator[list[tuple]]:
    """(section, kind, norm_label) of the columns in order, `most` at a time: one slice is on the driver at once."""
    numbered = store.keep(numbered_columns(columns), "columns")
    for at in range(0, numbered.count(), most):
        part = numbered.where(F.col("number").between(at, at + most - 1)).select("section", "kind", "norm_label", "number").orderBy("number").collect()
        yield [(r.section, r.kind, r.norm_label) for r in part]
    store.drop(numbered)


def listed_columns(columns: DataFrame, most: int = MOST_COLUMNS) -> list[tuple]:
    """(section, kind, norm_label) of the columns of one wide table, in order; more than `most` of them need several, see write_slices."""
    rows = columns.select("section", "kind", "norm_label", "col_ord").orderBy("section", "col_ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} columns: write_slices makes several tables of them")
    return [(r.section, r.kind, r.norm_label) for r in rows]


def pivot_grid(documents: DataFrame, columns: DataFrame, cells: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """The long form, a cell for each document and column: '' where there is none, 无数据 for a field of section 9.

    The columns are told to every task `most` at a time; a document's cells meet them in one row, so nothing is joined.
    """
    key = lambda c: F.struct(*[F.col(f"{c}{x}").cast(t).alias(x) for x, t in (("section", "int"), ("kind", "string"), ("norm_label", "string"))])
    held = cells.select("doc_id", F.struct(key("").alias("key"), "value").alias("cell")).unionByName(documents.select("doc_id", F.lit(None).alias("cell")), allowMissingColumns=True)
    held = held.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))
    v = T.clean_cell(F.coalesce(F.try_element_at("cells", key("c.")), F.lit("")))
    empty = F.when((F.col("c.section") == 9) & (F.col("c.kind") == "field"), X.NO_DATA).otherwise("")

    def part(listed: list[tuple]) -> DataFrame:
        head = F.from_json(F.lit(json.dumps([{"section": s, "kind": k, "norm_label": n} for s, k, n in listed])), "array<struct<section:int,kind:string,norm_label:string>>")
        return held.withColumn("c", F.explode(head)).select("doc_id", "c.*", F.when(v == "", empty).otherwise(v).alias("value"))

    parts = [part(x) for x in column_slices(columns, most)]
    return reduce(DataFrame.unionAll, parts or [part([])])


def pivot_wide(documents: DataFrame, cells: DataFrame, columns: list[tuple]) -> DataFrame:
    """One row per document; columns: (section, kind, norm_label) in order, so that no extra job looks for them.

    Only cells that exist are shuffled; what is missing is filled in the wide row: 无数据 for a field of section 9, else ''.
    """
    name = F.concat_ws("_", F.col("section").cast("string"), "norm_label")
    wide = cells.withColumn("col", name).groupBy("doc_id").pivot("col", [f"{s}_{n}" for s, _, n in columns]).agg(F.first(T.clean_cell(F.col("value"))))
    filled = [F.coalesce(F.nullif(F.col(f"`{s}_{n}`"), F.lit("")), F.lit(X.NO_DATA if s == 9 and k == "field" else "")).alias(f"{s}_{n}") for s, k, n in columns]
    return documents.select("doc_id").distinct().join(wide, "doc_id", "left").select("doc_id", *filled)


def component_rows(tables: DataFrame, components: DataFrame) -> DataFrame:
    """Ingredients of component tables as entries of kind comp: three for each, and in all sections with a table as many columns as the longest has.

    tables: doc_id, section of component tables (and doc_ord, else doc_id orders documents); components: doc_id, section,
    idx, name, cas, conc; those of other sections are no columns. They come after their section's other entries.
    """
    t = tables if "doc_ord" in tables.columns else tables.withColumn("doc_ord", F.col("doc_id"))
    mine = components.join(t.select("doc_id", "section", "doc_ord"), ["doc_id", "section"])
    most = mine.agg(F.max("idx")).first()[0]
    # the first document with a table in the section shows all columns, empty where it has fewer ingredients
    first = t.groupBy("section").agg(F.min(F.struct("doc_ord", "doc_id")).alias("f")).select("f.*", "section")
    slots = first.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(-1 if most is None else most)) if most is not None else F.array().cast("array<int>")))
    blank = slots.select("doc_id", "section", "doc_ord", F.col("idx").cast("int"), *[F.lit("").alias(c) for c in ("name", "cas", "conc")])
    both = mine.select("doc_id", "section", "doc_ord", F.col("idx").cast("int"), "name", "cas", "conc").unionByName(blank)
    n = (F.col("idx") + 1).cast("string")
    parts = [F.struct((F.lit(1 << 41) + 3 * F.col("idx") + k).alias("pos"), F.concat(F.lit("成分"), n, F.lit(s)).alias("label"), F.col(c).alias("value")) for k, (s, c) in enumerate((("名称", "name"), ("CAS", "cas"), ("含量", "conc")))]
    return both.select("doc_id", "section", "doc_ord", F.inline(F.array(*parts))).withColumns({"kind": F.lit("comp"), "seq": F.lit("")})


def build_pivot(documents: DataFrame, entries: DataFrame, tables: DataFrame | None = None, components: DataFrame | None = None, most: int = MOST_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(wide table, column table), with ingredient columns where component tables and components are given (see component_rows).

    The column list, one row per distinct label, is what the driver gets; for more than `most` labels see write_slices.
    """
    p = pivot_input(entries)
    if tables is not None and components is not None:
        p = p.unionByName(pivot_input(component_rows(tables, components)))
    columns = pivot_columns(p)
    return pivot_wide(documents, pivot_cells(p), listed_columns(columns, most)), columns


def write_slices(documents: DataFrame, columns: DataFrame, cells: DataFrame, path: str, most: int = MOST_COLUMNS) -> DataFrame:
    """Wide tables of any number of columns: `most` columns each, as Parquet under path; returns what is written to path/columns.

    That is section, kind, norm_label, seq, col_ord and number of each column, with the slice it is in (path/cells/slice=n)
    and its name there. Every slice has a row for each document, and its job reads the cells of its own columns only.
    """
    spark = documents.sparkSession
    named = numbered_columns(columns).withColumns({"slice": F.floor(F.col("number") / most).cast("int"), "name": F.concat_ws("_", F.col("section").cast("string"), "kind", "norm_label")})
    named.repartitionByRange("number").write.parquet(f"{path}/columns")
    named = spark.read.parquet(f"{path}/columns")
    at = store.new_path(spark, "pivot-cells")
    keys = ["section", "kind", "norm_label"]
    cells.join(named.select(*keys, "slice", "name"), keys).repartition("slice", "doc_id").write.partitionBy("slice").parquet(at)
    ids = store.keep(documents.select("doc_id").distinct(), "pivot-documents")
    n = named.agg(F.max("slice")).first()[0]
    for k in range(0 if n is None else n + 1):
        listed = [(r.name, r.section == 9 and r.kind == "field") for r in named.where(F.col("slice") == k).orderBy("number").select("name", "section", "kind").collect()]
        wide = spark.read.parquet(at).where(F.col("slice") == k).groupBy("doc_id").pivot("name", [name for name, _ in listed]).agg(F.first(T.clean_cell(F.col("value"))))
        quoted = lambda c: f"`{c.replace('`', '``')}`"
        filled = [F.coalesce(F.nullif(F.col(quoted(c)), F.lit("")), F.lit(X.NO_DATA if nine else "")).alias(c) for c, nine in listed]
        ids.join(wide, "doc_id", "left").select("doc_id", *filled).write.parquet(f"{path}/cells/slice={k}")
    store.delete(spark, at)
    store.drop(ids)
    return named


def single_pivot(documents: DataFrame, entries: DataFrame, doc_id, tables: DataFrame | None = None, components: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pivot of one document."""
    mine = lambda df: df.where(F.col("doc_id") == doc_id) if df is not None else None
    return build_pivot(mine(documents), mine(entries), mine(tables), mine(components))


def row_keys(documents: DataFrame, entries: DataFrame, section: int = 1, label: str = X.PRODUCT_NAME) -> DataFrame:
    """doc_id, row_key: the first product name that is not empty, else the file name's stem up to white space."""
    named = entries.where((F.col("section") == section) & (F.col("kind") == "field") & (F.col("label") == label) & (T.strip(F.col("value")) != ""))
    first = named.groupBy("doc_id").agg(F.min(F.struct("pos", "value"))["value"].alias("v"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return documents.join(first, "doc_id", "left").select("doc_id", F.coalesce(T.strip(F.col("v")), F.get(F.split(stem, r"[\s\p{Z}]+"), F.lit(0))).alias("row_key"))


def pivot_stats(documents: DataFrame, columns: DataFrame, failed: int = 0) -> DataFrame:
    """One row: files, columns, rows, sections, failed."""
    c = columns.agg(F.count("*").alias("columns"), F.countDistinct("section").alias("sections"))
    d = documents.agg(F.countDistinct("doc_id").alias("rows"))
    return d.join(c).select((F.col("rows") + failed).alias("files"), "columns", "rows", "sections", F.lit(failed).cast("long").alias("failed"))
