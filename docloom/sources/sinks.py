"""Outputs: TSV, JSON, nested JSON, full documents, pivot tables and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hierarchy

#: Image files of one subfolder, which one task writes.
FOLDER_FILES = 2000
TSV_COLUMNS = ("节", "大标题", "小标题", "标签", "内容")


def _flat(c):
    return F.translate(F.regexp_replace(T.text(c), "\r\n?", "\n"), "\t\n", "  ")


def tsv_lines(entries: DataFrame, file_column: str | None = None) -> DataFrame:
    """entries with `line`: (file,) section, titles, label and value by tab; tabs and line breaks inside become spaces."""
    cells = ([file_column] if file_column else []) + ["section", "big_title", "sub_title", "full_label", "value"]
    full = entries if "full_label" in entries.columns else hierarchy.with_sub_titles(entries)
    return full.withColumn("line", F.concat_ws("\t", *[_flat(F.col(c)) for c in cells]))


def write_tsv(entries: DataFrame, path: str, file_column: str | None = None) -> None:
    full = entries if "full_label" in entries.columns else hierarchy.with_sub_titles(entries)
    names = dict(zip(("section", "big_title", "sub_title", "full_label", "value"), TSV_COLUMNS, strict=True))
    cells = ([_flat(F.col(file_column)).alias("文件")] if file_column else []) + [_flat(F.col(c)).alias(n) for c, n in names.items()]
    order = [file_column] if file_column else ["doc_id"]
    full.sortWithinPartitions(*order, "section", "pos").select(*cells).write.csv(path, sep="\t", header=True, quote="", escape="")


def json_lines(entries: DataFrame) -> DataFrame:
    """doc_id, pos, json of each entry."""
    keys = [c for c in ("section", "big_title", "sub_title", "label", "value", "seq", "kind", "editable") if c in entries.columns]
    return entries.select("doc_id", "pos", F.to_json(F.struct(*keys)).alias("json"))


def write_json(entries: DataFrame, path: str) -> None:
    entries.drop("full_label").write.json(path)


def tree_json(entries: DataFrame) -> DataFrame:
    """doc_id, json: the whole tree of each document, sections in order."""
    t = hierarchy.tree(entries)
    node = F.struct("section", "big_title", "big_titles", "direct_fields")
    return t.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(node))).alias("json"))


def document_json(documents: DataFrame, sections: DataFrame, rows: DataFrame, components: DataFrame, items: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """doc_id, json: header and footer, and per section its rows, field map (label to the last value), lines and ingredients.

    Fields and lines are those of the section's items (pos, sub), before lines are split into rows; overrides (section,
    kind, idx) reach rows and, by kind component, ingredients, which are editable otherwise.
    """
    from ..operators import quality

    r, c = rows, components.withColumns({"kind": F.lit("component"), "editable": F.lit(True)})
    if overrides is not None:
        r, c = quality.apply_overrides(r, overrides), quality.apply_overrides(c, overrides)
    place = F.struct("pos", "sub")
    fields = items.where("kind = 'field'").groupBy("doc_id", "section", "label").agg(F.max_by("value", place).alias("value"))
    lines = items.where("kind = 'line'").select("doc_id", "section", place.alias("at"), "value")
    ordered = lambda c: F.array_sort(F.collect_list(c))
    per = sections.select("doc_id", "section", "title", "full_title")
    for df, name, cols in ((r, "rows", ("ord", "kind", "seq", "label", "value", "editable")), (fields, "fields", ("label", "value")), (lines, "lines", ("at", "value")), (c, "components", ("idx", "name", "cas", "conc", "editable"))):
        per = per.join(df.groupBy("doc_id", "section").agg(ordered(F.struct(*cols)).alias(name)), ["doc_id", "section"], "left")
    texts = F.transform("lines", lambda s: s["value"]).alias("lines")
    node = F.struct("section", "title", "full_title", "rows", F.map_from_entries("fields").alias("fields"), texts, "components")
    docs = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("section").alias("k"), F.to_json(node).alias("j")))).alias("s"))
    body = F.concat(F.lit('"sections":['), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]}"))
    head = F.to_json(F.struct("file_name", "sha256", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("footer", F.lit("")).alias("footer")))
    return documents.join(docs, "doc_id").select("doc_id", F.concat(F.regexp_replace(head, r"\}$", ","), body).alias("json"))


def write_pivot(wide: DataFrame, columns: DataFrame, path: str) -> None:
    """The wide table and its columns, as Parquet under path."""
    wide.write.parquet(f"{path}/cells")
    columns.write.parquet(f"{path}/columns")


def image_files(images: DataFrame, documents: DataFrame, prefix: str = "") -> DataFrame:
    """images (doc_id, section, ord, ext, content) with their file names {prefix}{stem}_s{section}_{i}.{ext}.

    i counts a document's pictures from 0. Documents whose files have one stem (a/x.docx and b/x.docx) have a hash of
    doc_id behind it, so that no two pictures share a name. Slashes in a name become underscores; a nameless file is doc.
    """
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    stem = F.coalesce(F.nullif(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit("")), F.lit("doc"))
    d = documents.select("doc_id", F.translate(stem, "/\\", "__").alias("stem")).distinct()
    shared = d.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").select("stem", F.lit(True).alias("shared"))
    d = d.join(shared, "stem", "left").select("doc_id", F.when(F.col("shared"), F.concat("stem", F.lit("-"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(16)))).otherwise(F.col("stem")).alias("stem"))
    name = F.concat(F.lit(prefix), "stem", F.lit("_s"), F.col("section").cast("string"), F.lit("_"), i.cast("string"), F.lit("."), "ext")
    return images.join(d, "doc_id").withColumn("name", name).drop("stem")


def export_images(images: DataFrame, documents: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """Write the images as rows (doc_id, section, name, content) of one Parquet table; returns doc_id, name and path, the place of each."""
    image_files(images, documents, prefix).select("doc_id", "section", "name", "content").write.parquet(path)
    return images.sparkSession.read.parquet(path).select("doc_id", "name", F.concat(F.lit(path.rstrip("/") + "#"), "name").alias("path"))


def write_image_files(images: DataFrame, documents: DataFrame, path: str, prefix: str = "", folders: int | None = None) -> DataFrame:
    """Write each image as a file of its own under the new folder `path`, a URI of any store that pyarrow or a mount reaches; returns doc_id, name, path.

    Files lie in `folders` subfolders (by default one for each 2,000 images, the number of shuffle partitions at least) by a
    hash of their document. The writer (picture_files) writes in a folder of each task attempt and moves whole subfolders when the job commits; of a
    failed attempt or job nothing stays.
    """
    from .picture_files import PictureFiles

    spark = images.sparkSession
    folders = folders or max(int(spark.conf.get("spark.sql.shuffle.partitions")), images.count() // FOLDER_FILES)
    folder = F.concat(F.lit("f"), F.lpad(F.pmod(F.xxhash64("doc_id"), F.lit(folders)).cast("string"), len(str(folders)), "0"))
    named = image_files(images, documents, prefix).select("doc_id", "name", "content", folder.alias("folder"))
    spark.dataSource.register(PictureFiles)
    # all files of a subfolder come from one task
    named.select("folder", "name", "content").repartition(folders, "folder").write.format(PictureFiles.name()).option("path", path).mode("append").save()
    return named.select("doc_id", "name", F.concat_ws("/", F.lit(path.rstrip("/")), "folder", "name").alias("path"))
