"""From a folder of Word files to the long tables: documents, sections, rows, ingredients, entries, images, anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import fixed as X
from ..functions import text as T
from ..operators import blocks, components, hierarchy, quality, rows, sections
from ..sources import docx, pages


@dataclass
class Corpus:
    documents: DataFrame
    sections: DataFrame
    items: DataFrame
    rows: DataFrame
    components: DataFrame
    entries: DataFrame
    images: DataFrame
    anomalies: DataFrame


def page_items(paragraphs: DataFrame) -> DataFrame:
    """Items of section 0: a header sub-title and a footer sub-title, each before its fields, only where it has one."""
    x = paragraphs.where("ev in ('header', 'footer')").withColumn("side", F.when(F.col("ev") == "header", 1).otherwise(2))
    cell = F.col("tc").isNotNull()
    x = x.groupBy("doc_id", "ev", "side", F.coalesce("tc", F.concat(F.lit("p"), "pos")).alias("tc")).agg(F.min("pos").alias("pos"), F.max(cell).alias("cell"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "para", "text"))), lambda s: s["text"]), "\n").alias("text"))
    x = x.where(T.strip(F.col("text")) != "")
    product = F.array(F.struct(F.lit(X.PRODUCT_NAME).alias("label"), T.strip(F.col("text")).alias("value"), F.lit(True).alias("editable")))
    parts = F.when(F.col("cell") & (F.col("ev") == "header"), product).otherwise(T.page_fields(F.col("text")))
    fields = x.select("doc_id", "side", "pos", F.posexplode(parts).alias("k", "f"))
    fields = fields.select("doc_id", "side", "pos", "k", F.lit("field").alias("kind"), F.col("f.label").alias("label"), F.col("f.value").alias("value"), F.col("f.editable").alias("editable"))
    heads = fields.select("doc_id", "side").distinct().select("doc_id", "side", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("k"), F.lit("line").alias("kind"), F.lit("").alias("label"), F.when(F.col("side") == 1, "0.1 页眉").otherwise("0.2 页脚").alias("value"), F.lit(False).alias("editable"))
    both = _numbered(fields.unionByName(heads), "side", "pos", "k")
    return both.select("doc_id", F.lit(0).alias("section"), "pos", F.lit(0).alias("sub"), "kind", "label", "value", F.array().cast("array<boolean>").alias("bold"), "editable")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place in the document, however many paragraphs or lines a place of `order` has."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long")).drop("pos").withColumnRenamed("_at", "pos")


def _content_items(content: DataFrame, keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, ingredients and headers of routed rows (doc_id, section, pos, cells, bold0)."""
    # what several of the tables below read is written once
    latched = keep(rows.component_latch(content), "latched")
    c0 = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    caption = (F.size("cells") <= 2) & F.rtrim(c0, F.lit(" /／")).isin(*X.COMPONENT_CAPTIONS)
    open_ = latched.where(~F.col("is_header") & ~(caption & ~F.col("in_components")))
    before, inside = open_.where("not in_components"), open_.where("in_components")
    flat = keep(components.flat_tables(before.where(F.size("cells") == 1).select("doc_id", "pos", c0.alias("text"))), "flat-tables")
    stacked = keep(components.stacked_tables(before.select("doc_id", "pos", "cells")), "stacked-tables")
    tabled = flat.select("doc_id", "pos").distinct().unionByName(stacked.select("doc_id", "pos").distinct())
    place = content.select("doc_id", "pos", "section")
    plain = before.join(tabled, ["doc_id", "pos"], "left_anti")
    mix = components.mixture_candidates(plain)
    w = Window.partitionBy("doc_id", "section").orderBy("pos")
    head = (F.col("section") == 3) & T.is_mixture_header(c0)
    plain = plain.withColumn("_head", head).withColumn("_after", F.coalesce(F.lag(F.col("_head") & ~c0.contains("\n")).over(w), F.lit(False)) & (F.col("section") == 3))
    items = rows.row_items(plain.where("not _head and not _after").select("doc_id", "section", "pos", "cells", "bold0", "bold_lines"))
    title = T.strip(F.substring_index(c0, "\n", 1))
    named = plain.where("_head").select("doc_id", "section", "pos", title.alias("label")).groupBy("doc_id", "section", "label").agg(F.min("pos").alias("pos"))
    col = lambda df, sub, kind, label, value: df.select("doc_id", "section", "pos", sub.alias("sub"), kind.alias("kind"), label.alias("label"), value.alias("value"), F.array().cast("array<boolean>").alias("bold"))
    parts = components.flat_parts(flat).join(place, ["doc_id", "pos"])
    comp_rows = components.components_of_rows(inside.select("doc_id", "section", "pos", "cells"))
    items = items.unionByName(col(named, F.lit(0), F.lit("field"), F.col("label"), F.lit("")))
    items = items.unionByName(col(parts.where("kind <> 'component'"), F.col("i"), F.col("kind"), F.col("label"), F.col("value")))
    items = items.unionByName(col(comp_rows.where("kind <> 'component'"), F.lit(0), F.col("kind"), F.col("label"), F.col("value")))
    # a continuation joins the latest field of its section, whichever source that is from
    items = rows.attach_items(items)
    place_of = ("doc_id", "section", "pos", "i")
    cells = parts.where("kind = 'component'").select(*place_of, "name", "cas", "conc").unionByName(stacked.join(place, ["doc_id", "pos"]).select(*place_of, "name", "cas", "conc"))
    split = components.split_cells(cells.select(*place_of, F.col("name").alias("name_cell"), F.col("cas").alias("cas_cell"), F.col("conc").alias("conc_cell")), place_of)
    direct = comp_rows.where("kind = 'component'").select("doc_id", "section", "pos", F.lit(0).alias("i"), "idx", "name", "cas", "conc", "raw_name", "raw_cas", "raw_conc")
    found = split.unionByName(direct)
    found = found.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos", "i", "idx")) - 1).cast("int")).drop("pos", "i")
    tables = latched.where("in_components or is_header").groupBy("doc_id", "section").agg(F.max_by("component_header", "pos").alias("component_header"))
    flat_head = flat.where("part = 'header'").join(place, ["doc_id", "pos"]).select("doc_id", "section", F.array_join(rows.flat_columns(F.col("line")), " | ").alias("flat_header"))
    stack_head = stacked.select("doc_id", "pos").distinct().join(content.select("doc_id", "pos", "section", F.array_join(F.transform("cells", lambda c: F.substring_index(c, "\n", 1)), " | ").alias("flat_header")), ["doc_id", "pos"]).select("doc_id", "section", "flat_header")
    heads = flat_head.unionByName(stack_head).groupBy("doc_id", "section").agg(F.min("flat_header").alias("flat_header"))
    tables = tables.join(heads, ["doc_id", "section"], "full").select("doc_id", "section", F.coalesce("component_header", "flat_header", F.lit("")).alias("component_header"))
    return items, components.promote_if_empty(found, mix), tables


def content_rows(routed: DataFrame) -> DataFrame:
    """Table rows and the lines of text boxes (doc_id, section, pos, cells, bold0, bold_lines) in order; titles are no content."""
    none = F.lit(None).cast("array<boolean>").alias("bold_lines")
    box = routed.where("is_box").select("doc_id", "section", "pos", F.posexplode("cells").alias("k", "line"), "title_n").where("title_n is null or k > 0")
    box = box.select("doc_id", "section", "pos", "k", F.array("line").alias("cells"), F.lit(False).alias("bold0"), none)
    table = routed.where("not is_box and title_n is null").select("doc_id", "section", "pos", F.lit(0).alias("k"), "cells", "bold0", "bold_lines")
    return _numbered(table.unionByName(box), "pos", "k").drop("k")


def read_documents(spark: SparkSession, path: str, keep=store.keep) -> Corpus:
    """All tables of the .docx files under path; keep(df, name) writes a table and reads it back, so that no file is decoded twice.

    A file that can't be read is in `documents` with its error. The tables stay in the shared folder while they are read;
    store.clear(spark) removes them.
    """
    files = docx.scan(spark, path)
    records = keep(docx.decode(files), "records")
    docx.require_any(docx.file_status(records, files))
    return corpus_tables(files, records, keep)


def corpus_tables(files: DataFrame, records: DataFrame, keep=store.keep) -> Corpus:
    """All tables of decoded files: files (doc_id, file_name, sha256), and their records. One exchange on doc_id serves the windows."""
    status = docx.file_status(records, files)
    p = docx.paragraphs(records)
    levels = records.where("kind = 'level'").select("doc_id", "num_id", "ilvl", "start", "lvl_text")
    clean = keep(docx.clean_paragraphs(p, levels), "paragraphs")
    story = pages.story(p.where("ev = 'header'")).withColumnRenamed("story", "header").join(pages.story(p.where("ev = 'footer'")).withColumnRenamed("story", "footer"), "doc_id", "full")
    documents = status.join(story, "doc_id", "left")

    events = keep(docx.cell_rows(clean), "events")
    routed = keep(sections.route_textboxes(events), "routed")
    items, comps, tables = _content_items(keep(content_rows(routed), "content"), keep)
    first = sections.section_table(events.select("doc_id", "pos", "c0"))
    opened = routed.groupBy("doc_id", "section").agg(F.min_by("c0", "pos").alias("opening"))
    s = opened.join(first, ["doc_id", "section"], "left").join(sections.textbox_titles(events).withColumnRenamed("title", "box_title"), ["doc_id", "section"], "left")
    s = s.select("doc_id", "section", F.coalesce("box_title", "title").alias("title"), F.coalesce("full_title", "opening").alias("full_title"))
    s = sections.with_default_titles(s).join(tables.withColumn("is_component_table", F.lit(True)), ["doc_id", "section"], "left")
    page = page_items(p)
    zero = page.select("doc_id").distinct().select("doc_id", F.lit(0).alias("section"), F.lit("页眉页脚").alias("title"), F.lit("0.页眉页脚").alias("full_title"), F.lit(None).cast("string").alias("component_header"), F.lit(None).cast("boolean").alias("is_component_table"))
    s = keep(s.select(*zero.columns).unionByName(zero).withColumn("is_component_table", F.coalesce("is_component_table", F.lit(False))), "sections")
    items = keep(items.withColumn("editable", F.lit(True)).unionByName(page), "items")
    unified = keep(blocks.unified_rows(items), "rows")
    comps = keep(comps, "components")
    entries = hierarchy.document_entries(unified, s, comps)
    titles = sections.with_titles(events).select("doc_id", "pos", F.coalesce("title_n", "hint_n").alias("n")).where("n is not null")
    images = docx.image_sections(records.where("kind = 'image'").select("doc_id", "pos", "tbl", "row", "cell", "ord", "ext", "width", "height", "content"), titles)
    labels = items.where("section = 9 and kind = 'field'").select("doc_id", "label")
    cells = comps.select("doc_id", F.col("name").alias("name_cell"), F.col("cas").alias("cas_cell"), F.col("conc").alias("conc_cell"))
    found = quality.anomalies(documents.where("status = 'ok'"), s, labels, cells)
    return Corpus(documents, s, items, unified, comps, entries, images, found)
