"""Registered queries of Word packages: files of a folder, damaged ones, text boxes, headers, pictures, syncs, documents as JSON.

A package is made of each row of `part`, with its own values as texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..operators import quality, sections
from ..sources import adapters as A
from ..sources import docx, files, packages, sinks
from ..sources.picture_files import PictureFiles
from ..streaming import library
from . import documents
from .queries import query

DAMAGED = "p_partkey % 7 = 0"
#: What stands behind the text of a cell with pictures.
MARK = "CASE p_size % 3 WHEN 1 THEN ' [象形图]' WHEN 2 THEN ' [象形图×2]' ELSE '' END"


def _documents(spark, d, changed: str | None = None, tasks: int | None = None, by="p_partkey") -> DataFrame:
    """What the packages are made of, dealt to tasks by a key; with `changed` also what they were made of before, another type where it holds."""
    # rows are short and packages long: a small table would be one task
    part = A.table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string")).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), by)
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    rows = lambda kind: F.array(row("1.物料及供应商标识", ""), row("产品名称：", F.col("p_name")), row("9.理化特性", ""), row("9.1 外观：", kind), row("", F.concat(F.lit("more of "), "p_brand")))
    before = [rows(F.when(F.expr(changed), F.concat(F.lit("changed "), "p_type")).otherwise(F.col("p_type"))).alias("before")] if changed else []
    box = F.when(F.col("p_partkey") % 2 == 0, row(F.concat(F.lit("10.1 Reactivity "), "p_brand"), F.concat(F.lit("stable with "), "p_type"))).otherwise(F.array().cast("array<string>"))
    pictures = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k < F.col("p_size") % 3), lambda k: F.concat_ws("-", F.lit("PNG"), "id", k.cast("string")))
    k = F.col("p_partkey") % 3
    footer = F.when(k == 0, F.concat_ws(" / ", F.col("p_size").cast("string"), "id")).when(k == 1, F.concat(F.lit("某某公司  PEA-"), "id", F.lit("-MSDS"))).otherwise(F.concat(F.lit("PRevision: "), "p_brand"))
    return part.select("p_partkey", F.col("id").alias("doc_id"), rows(F.col("p_type")).alias("rows"), box.alias("box"), F.col("p_name").alias("header"), footer.alias("footer"), pictures.alias("pictures"), F.expr(DAMAGED).alias("damaged"), *before)


def _records(spark, d) -> DataFrame:
    return store.keep(docx.decode(packages.of_documents(_documents(spark, d))), "package-records")


def _routed(records: DataFrame) -> DataFrame:
    """Rows and text boxes with their sections, written between the steps so that none is worked out twice."""
    return store.keep(sections.route_textboxes(store.keep(docx.cell_rows(_clean(records)), "package-rows")), "package-routed")


def _clean(records: DataFrame) -> DataFrame:
    levels = records.where("kind = 'level'").select("doc_id", "num_id", "ilvl", "start", "lvl_text")
    return store.keep(docx.clean_paragraphs(docx.paragraphs(records), levels), "package-paragraphs")


@query("scanned_files", f"""SELECT p_partkey || '.docx' AS file_name, CASE WHEN {DAMAGED} THEN 'failed' ELSE 'ok' END AS status, CASE WHEN {DAMAGED} THEN NULL ELSE 1 END AS tables_count,
    CASE WHEN {DAMAGED} THEN NULL ELSE (p_partkey + 1) % 2 END AS paragraphs_count FROM part""")
def scanned_files(spark, d):
    """Packages written as files, with a lock file beside each, then scanned and decoded."""
    path = store.new_path(spark, "package-files")
    names = F.explode(F.array(F.concat("doc_id", F.lit(".docx")), F.concat(F.lit("~$"), "doc_id", F.lit(".docx")), F.concat("doc_id", F.lit(".txt"))))
    spark.dataSource.register(PictureFiles)
    # a folder is written by one task and moved whole; it holds some thousand files, however many there are in all
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), A.table(spark, d, "part").count() // 2000)
    folder = lambda key: F.concat(F.lit("in/f"), F.pmod(F.xxhash64(key), F.lit(n)).cast("string"))
    # rows are dealt by folder before packages are made of them: no package goes through an exchange
    made = packages.of_documents(_documents(spark, d, tasks=n, by=folder("id")))
    made.select(folder("doc_id").alias("folder"), names.alias("name"), "content").write.format(PictureFiles.name()).option("path", path).mode("append").save()
    found = docx.scan(spark, f"{path}/in/*")
    # written once: neither the checks nor the result decode again
    status = store.keep(docx.file_status(docx.decode(found), found), "package-status")
    docx.require_any(status)
    return status.select("file_name", "status", "tables_count", "paragraphs_count")


@query("package_images", f"SELECT p_partkey::VARCHAR AS doc_id, k::INT AS ord, 9 AS section, 'png' AS ext, (100 + k)::INT AS width, 200 AS height, sha256('PNG-' || p_partkey || '-' || k) AS sha256 FROM part, range(0, 3) t(k) WHERE k < p_size % 3 AND NOT {DAMAGED}")
def package_images(spark, d):
    records = _records(spark, d)
    titles = sections.with_titles(docx.cell_rows(_clean(records))).select("doc_id", "pos", F.coalesce("title_n", "hint_n").alias("n")).where("n is not null")
    images = docx.image_sections(records.where("kind = 'image'").select("doc_id", "pos", "ord", "ext", "width", "height", "content"), titles)
    return images.select("doc_id", "ord", "section", "ext", "width", "height", F.sha2("content", 256).alias("sha256"))


@query("image_files", f"SELECT p_partkey || '_s9_' || k || '.png' AS name, sha256('PNG-' || p_partkey || '-' || k) AS sha256, true AS there FROM part, range(0, 3) t(k) WHERE k < p_size % 3 AND NOT {DAMAGED}")
def image_files(spark, d):
    """Pictures as files, read back and found at the paths that were returned."""
    images = _records(spark, d).where("kind = 'image'").select("doc_id", F.lit(9).alias("section"), "ord", "ext", "content")
    path = store.new_path(spark, "pictures")
    docs = images.select("doc_id", F.concat("doc_id", F.lit(".docx")).alias("file_name")).distinct()
    out = sinks.write_image_files(images, docs, path)
    read = files.contents(files.listed(spark, path, recursive=True)).select(F.substring_index("path", "/", -2).alias("at"), F.sha2("content", 256).alias("sha256"))
    found = read.join(out.select(F.substring_index("path", "/", -2).alias("at"), "name"), "at", "left")
    return found.select("name", "sha256", F.col("at").endswith(F.col("name")).alias("there"))


@query("textbox_rows", f"SELECT p_partkey::VARCHAR AS doc_id, 4::BIGINT AS pos, 10 AS section, '10.1 Reactivity ' || p_brand AS line FROM part WHERE p_partkey % 2 = 0 AND NOT {DAMAGED} UNION ALL SELECT p_partkey::VARCHAR, 5, 10, 'stable with ' || p_type FROM part WHERE p_partkey % 2 = 0 AND NOT {DAMAGED}")
def textbox_rows(spark, d):
    return documents.content_rows(_routed(_records(spark, d))).where("section = 10").select("doc_id", "pos", "section", F.array_join("cells", "|").alias("line"))


PAGE_ITEMS = f"""WITH u AS (SELECT p_partkey::VARCHAR AS doc_id, p_partkey % 3 AS k, * FROM part WHERE NOT {DAMAGED}),
    items AS (SELECT doc_id, 1::BIGINT AS pos, 'line' AS kind, '' AS label, '0.1 页眉' AS value, false AS editable FROM u UNION ALL SELECT doc_id, 2, 'field', '产品名称', p_name, true FROM u
    UNION ALL SELECT doc_id, 3, 'line', '', '0.2 页脚', false FROM u UNION ALL SELECT doc_id, 4, 'field', '页码', p_size || ' / ' || p_partkey, false FROM u WHERE k = 0
    UNION ALL SELECT doc_id, 4, 'field', '公司名称', '某某公司', false FROM u WHERE k = 1 UNION ALL SELECT doc_id, 5, 'field', '产品型号', 'PEA-' || p_partkey || '-MSDS', false FROM u WHERE k = 1
    UNION ALL SELECT doc_id, 4, 'field', 'PRevision', p_brand, true FROM u WHERE k = 2)"""


@query("header_items", PAGE_ITEMS + " SELECT * FROM items")
def header_items(spark, d):
    """Page numbers, company and product in one line, and labelled fields."""
    return documents.page_items(docx.paragraphs(_records(spark, d))).select("doc_id", "pos", "kind", "label", "value", "editable")


@query("page_editable", PAGE_ITEMS + " SELECT doc_id, pos, label, label NOT IN ('页码', '公司名称') AS editable FROM items")
def page_editable(spark, d):
    """What may be edited of section 0, by its labels."""
    return quality.default_editable(documents.page_items(docx.paragraphs(_records(spark, d)))).select("doc_id", "pos", "label", "editable")


def _content(files: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    return {"content": documents.content_rows(_routed(records))}


@query("library_refresh", f"""WITH u AS (SELECT p_partkey::VARCHAR AS doc_id, * FROM part WHERE NOT {DAMAGED})
    SELECT doc_id, 1 AS section, 1::BIGINT AS pos, '产品名称：|' || p_name AS cells FROM u UNION ALL SELECT doc_id, 9, 2, '9.1 外观：|' || p_type FROM u UNION ALL SELECT doc_id, 9, 3, '|more of ' || p_brand || {MARK} FROM u
    UNION ALL SELECT doc_id, 10, 4, '10.1 Reactivity ' || p_brand FROM u WHERE p_partkey % 2 = 0 UNION ALL SELECT doc_id, 10, 5, 'stable with ' || p_type FROM u WHERE p_partkey % 2 = 0""")
def library_refresh(spark, d):
    """Two syncs: first with other contents, and a file more for each, then with the files as they are."""
    to = store.new_path(spark, "library")

    def files(doc_id, at, content: str) -> DataFrame:
        return made.select(doc_id.alias("doc_id"), F.concat(doc_id, F.lit(".docx")).alias("file_name"), at.alias("at"), F.col(f"{content}_length").alias("length"), F.col(content).alias("content"))

    # both contents of a file are made at once: the second sync has no need to look the first one up
    both = packages.of_documents(_documents(spark, d, "p_size % 2 = 1"))
    made = store.keep(both.select("*", *[F.length(c).cast("long").alias(f"{c}_length") for c in ("content", "before")], (F.col("content") == F.col("before")).alias("same")), "package-files")
    first, second = (F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp") for k in (1, 2))
    library.sync(files(F.col("doc_id"), first, "before").unionByName(files(F.concat(F.lit("old-"), "doc_id"), first, "before")), to, 8, _content)
    # what was sent again unchanged keeps its time
    library.sync(files(F.col("doc_id"), F.when(F.col("same"), first).otherwise(second), "content"), to, 8, _content)
    return library.read_tables(spark, to)["content"].select("doc_id", "section", "pos", F.array_join("cells", "|").alias("cells"))


@query("document_json", PAGE_ITEMS + """ SELECT doc_id, 0 AS section, label, value FROM items WHERE kind = 'field' UNION ALL SELECT doc_id, 1, '产品名称', p_name FROM u
    UNION ALL SELECT doc_id, 9, '9.1 外观', p_type || chr(10) || 'more of ' || p_brand || """ + MARK + " FROM u")
def document_json(spark, d):
    """Documents as JSON, read again: their fields."""
    made = _documents(spark, d)
    files = made.select("doc_id", F.concat("doc_id", F.lit(".docx")).alias("file_name"), F.lit("").alias("sha256"))
    c = documents.corpus_tables(files, _records(spark, d))
    j = sinks.document_json(c.documents.where("status = 'ok'"), c.sections, c.rows, c.components, c.items)
    parsed = j.select("doc_id", F.explode(F.from_json("json", "sections array<struct<section: int, fields: map<string,string>>>")["sections"]).alias("s"))
    return parsed.select("doc_id", "s.section", F.explode("s.fields").alias("label", "value"))
