"""Checks and annotations: number gaps, missing sections, counts, digests, editability, overrides, images and their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T


#: Missing numbers of one gap that are listed one by one; a longer gap is written as its first and last number.
LISTED = 100


def gap_ranges(labels: DataFrame) -> DataFrame:
    """doc_id, first, last (whole numbers): the ranges of n between the least and the greatest 9.n of a document that no label has; labels: doc_id, label.

    A label can hold several numbers, each at the beginning of a line. Numbers of over 37 digits take no part. A gap is one
    row however wide it is.
    """
    n = labels.select("doc_id", F.explode(F.regexp_extract_all("label", F.lit(r"(?m)^9\.(\p{Nd}+)"), F.lit(1))).alias("n")).withColumn("n", T.whole_number(F.col("n"))).where("n is not null").distinct()
    after = n.withColumn("next", F.lead("n").over(Window.partitionBy("doc_id").orderBy("n"))).where("next > n + 1")
    return after.select("doc_id", (F.col("n") + 1).cast("decimal(38,0)").alias("first"), (F.col("next") - 1).cast("decimal(38,0)").alias("last"))


def number_gaps(labels: DataFrame, listed: int = LISTED) -> DataFrame:
    """doc_id, missing (like '9.3, 9.5'): the numbers of gap_ranges in order; a gap of more than `listed` is '9.first-9.last'."""
    name = lambda c: F.concat(F.lit("9."), c.cast("string"))
    size = F.col("last") - F.col("first")
    each = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(listed)).cast("int")), lambda k: name((F.col("first") + k).cast("decimal(38,0)")))
    text = F.when(size < listed, F.array_join(each, ", ")).otherwise(F.concat(name(F.col("first")), F.lit("-"), name(F.col("last"))))
    g = gap_ranges(labels).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))).alias("g"))
    return g.select("doc_id", F.array_join(F.transform("g", lambda x: x["text"]), ", ").alias("missing"))


def missing_sections(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section for each of the 16 sections that a document lacks."""
    want = documents.select("doc_id").distinct().withColumn("section", F.explode(F.sequence(F.lit(1), F.lit(16))))
    return want.join(sections.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")


def component_stats(cells: DataFrame) -> DataFrame:
    """doc_id, n_split (further ingredients from line breaks), n_full_width (rows with full-width marks)."""
    from .components import component_structs

    n = F.size(component_structs(F.col("name_cell"), F.col("cas_cell"), F.col("conc_cell")))
    wide = T.has_full_width(F.col("name_cell")) | T.has_full_width(F.col("cas_cell")) | T.has_full_width(F.col("conc_cell"))
    return cells.groupBy("doc_id").agg(F.sum(n - 1).alias("n_split"), F.count_if(wide).alias("n_full_width"))


def anomalies(documents: DataFrame, sections: DataFrame, labels: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, level, section, message, detail of all checks."""
    row = lambda df, level, section, message, detail: df.select("doc_id", F.lit(level).alias("level"), F.lit(section).alias("section"), message.alias("message"), detail.alias("detail"))
    s = component_stats(cells)
    count = lambda a, c, b: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))
    out = row(s.where("n_split > 0"), "warn", 3, count("S3 成分拆分 ", "n_split", " 行"), F.lit("一行多成分单元格按换行符拆分 (名称/CAS/含量三列对齐)"))
    out = out.unionByName(row(s.where("n_full_width > 0"), "warn", 3, count("S3 全角符号归一 ", "n_full_width", " 行"), F.lit("全角 ＞＜～％－（）等转半角")))
    out = out.unionByName(row(number_gaps(labels), "warn", 9, F.lit("S9 编号不连续"), F.concat(F.lit("缺失: "), "missing")))
    return out.unionByName(row(missing_sections(documents, sections), "error", 0, F.concat(F.lit("缺失第"), F.col("section").cast("string"), F.lit("节")), F.lit("")))


def anomaly_digest(found: DataFrame, *order, top: int = 12) -> DataFrame:
    """The first `top` anomalies of each document, with n, and how many more there are."""
    w = Window.partitionBy("doc_id")
    x = found.withColumns({"n": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - top, F.lit(0))})
    return x.where(F.col("n") <= top)


def document_summary(documents: DataFrame, items: DataFrame, components: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """doc_id, n_sections, n_fields, n_lines, n_components, n_anomalies."""
    g = items.groupBy("doc_id").agg(F.countDistinct("section").alias("n_sections"), F.count_if(F.col("kind") == "field").alias("n_fields"), F.count_if(F.col("kind") == "line").alias("n_lines"))
    out = documents.select("doc_id").distinct().join(g, "doc_id", "left")
    for df, name in ((components, "n_components"), (found, "n_anomalies")):
        out = out.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left") if df is not None else out.withColumn(name, F.lit(0).cast("long"))
    return out.na.fill(0)


def default_editable(rows: DataFrame) -> DataFrame:
    """rows with editable: titles and sub-titles not, page fields by their words, fields and notes yes."""
    page = (F.col("section") == 0) & (F.col("kind") == "field")
    fixed = F.col("label").rlike(r"^\p{Nd}+[\s\p{Z}]*/[\s\p{Z}]*\p{Nd}+$") | T.any_word(F.col("label"), X.PAGE_FIXED_WORDS)
    return rows.withColumn("editable", F.when(F.col("kind").isin("section", "sub"), False).when(page, ~fixed).otherwise(True))


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows (doc_id, section, kind, idx, editable) with the latest override of each; overrides: the keys, editable, at."""
    keys = ["doc_id", "section", "kind", "idx"]
    latest = overrides.groupBy(*keys).agg(F.max_by("editable", "at").alias("_o"))
    return rows.join(latest, keys, "left").withColumn("editable", F.coalesce("_o", "editable")).drop("_o")


#: Pictures that a mark of a larger number covers: more than a section has.
ALL = 1 << 40


def allocate_images(places: DataFrame, images: DataFrame) -> DataFrame:
    """images (doc_id, section, ord) with nth (from 0 in the section) and place, the pos of the placeholder that covers them, or null.

    places: doc_id, section, pos, text with [象形图] or [象形图×n]; the first mark of a text counts. Placeholders take images
    in order: one covers the n that follow those before it, none at ×0, all that are left at a number beyond 2^40. Placeholders
    and images are one ordered union, in which the latest placeholder is filled forward, so the work is linear in both.
    """
    mark = r"\[象形图(?:×(\p{Nd}+))?\]"
    digits = F.regexp_extract("text", mark, 1)
    n = F.when(digits == "", F.lit(1).cast("long")).otherwise(F.least(F.coalesce(T.whole_number(digits, "long"), F.lit(ALL)), F.lit(ALL)))
    w = Window.partitionBy("doc_id", "section")
    p = places.where(F.col("text").rlike(mark)).withColumn("n", n).where("n > 0").withColumn("stop", F.sum("n").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.select("doc_id", "section", (F.col("stop") - F.col("n")).alias("at"), F.struct("pos", "stop").alias("cover"))
    i = images.select("doc_id", "section", "ord", (F.row_number().over(w.orderBy("ord")) - 1).alias("nth"))
    both = p.withColumn("is_image", F.lit(False)).unionByName(i.select("*", F.col("nth").cast("long").alias("at"), F.lit(True).alias("is_image")), allowMissingColumns=True)
    last = F.last("cover", ignorenulls=True).over(w.orderBy("at", "is_image").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("last", last).where("is_image")
    return both.select("doc_id", "section", "ord", "nth", F.when(F.col("nth") < F.col("last.stop"), F.col("last.pos")).alias("place"))
