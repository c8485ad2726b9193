"""Registered queries of the rules that plain tables show only in a made-up shape: tabs, stacked labels, bold rows, section 2, packages.

Every row's cells are taken from a table's own values, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import store
from ..functions import fixed as X
from ..functions import text as T
from ..operators import blocks, components, hierarchy, pivot, rows
from ..sources import adapters as A
from ..sources import docx, packages, sinks
from .queries import END_RE, FLATTED, HEAD, INLINE_RE, NORM, SPLITTED, STRIPPED, SUBTITLED, UNIT_SEQ, WHITE, query

TEXT = lambda c: F.col(c).cast("string")


def _items(spark, d):
    """A row of each shape for every five parts: tab, several numbers, stacked labels, a one-character rest, a sub-heading."""
    k, size = F.col("p_partkey") % 5, TEXT("p_size")
    lines = lambda *cs: F.concat_ws("\n", *cs)
    tail = lambda c: F.concat(c, F.lit("："))
    cells = (
        F.when(k == 0, F.array(F.concat(tail("p_name"), F.lit("\t"), "p_type"), size))
        .when(k == 1, F.array(lines(tail(F.concat(F.lit("9.1 "), "p_name")), F.concat(F.lit("9.2 "), "p_type")), lines(size, "p_brand")))
        .when(k == 2, F.array(lines(tail("p_name"), tail("p_type"), F.lit("· more"), tail("p_brand")), lines(size, TEXT("p_partkey"), "p_brand")))
        .when(k == 3, F.array(F.lit("制："), F.col("p_name"))).otherwise(F.array(F.concat(F.lit("8.1 "), "p_name"), F.lit("")))
    )
    part = A.table(spark, d, "part")
    return part.select(F.floor(F.col("p_partkey") / 5).alias("doc_id"), F.lit(9).alias("section"), F.col("p_partkey").alias("pos"), cells.alias("cells"), F.lit(False).alias("bold0"))


@query("field_shapes", """WITH p AS (SELECT *, p_partkey // 5 AS doc_id, p_partkey % 5 AS k, p_size::VARCHAR AS size, lead(p_name) OVER (PARTITION BY p_partkey // 5 ORDER BY p_partkey) AS nxt FROM part)
    SELECT doc_id, p_partkey AS pos, 0 AS sub, 'field' AS kind, p_name AS label, p_type || ' / ' || size AS value FROM p WHERE k = 0
    UNION ALL SELECT doc_id, p_partkey, 0, 'field', '9.1 ' || p_name, size FROM p WHERE k = 1 UNION ALL SELECT doc_id, p_partkey, 1, 'field', '9.2 ' || p_type, p_brand FROM p WHERE k = 1
    UNION ALL SELECT doc_id, p_partkey, 0, 'field', p_name, size FROM p WHERE k = 2 UNION ALL SELECT doc_id, p_partkey, 1, 'field', p_type, p_partkey::VARCHAR || chr(10) || '· more' FROM p WHERE k = 2
    UNION ALL SELECT doc_id, p_partkey, 2, 'field', p_brand, p_brand || coalesce(chr(10) || nxt, '') FROM p WHERE k = 2
    UNION ALL SELECT doc_id, p_partkey, 0, 'line', '', '8.1 ' || p_name FROM p WHERE k = 4""")
def field_shapes(spark, d):
    return rows.section_items(_items(spark, d)).select("doc_id", "pos", "sub", "kind", "label", "value")


@query("row_class_bold", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND length(c0) <= 30 AND NOT regexp_matches(c0, '^[0-9·]') THEN 'field' ELSE 'joined' END AS row_class
    FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_size || '%' ELSE '· ' || p_name END AS c0 FROM part)""")
def row_class_bold(spark, d):
    k = F.col("p_partkey")
    c0 = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(TEXT("p_size"), F.lit("%"))).otherwise(F.concat(F.lit("· "), "p_name"))
    x = A.table(spark, d, "part").select("p_partkey", F.array(c0, "p_type").alias("cells"), (k % 2 == 0).alias("bold0"))
    return rows.classify(x).select("p_partkey", "row_class")


@query("section_two_units", """WITH u AS (SELECT p_partkey AS doc_id, * FROM part)
    SELECT doc_id, 1 AS ord, 'sub' AS kind, '健康危害' AS label, '' AS value FROM u UNION ALL SELECT doc_id, 2, 'field', p_name, '1B类' FROM u
    UNION ALL SELECT doc_id, 3, 'sub', '标签要素', '' FROM u UNION ALL SELECT doc_id, 4, 'field', 'GHS-象形图', p_type FROM u
    UNION ALL SELECT doc_id, 5, 'field', '存储', p_name || chr(10) || 'H302: ' || p_brand FROM u UNION ALL SELECT doc_id, 6, 'field', 'Waste Disposal Method of ' || p_name, '' FROM u""")
def section_two_units(spark, d):
    texts = [F.lit("健康危害"), F.concat("p_name", F.lit("    1B类")), F.lit("标签要素"), F.concat(F.lit("GHS-象形图 "), "p_type"), F.concat(F.lit("存储"), "p_name"), F.concat(F.lit("H302: "), "p_brand"), F.concat(F.lit("Waste Disposal Method of "), "p_name")]
    lines = A.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(*texts)).alias("pos", "line")).withColumn("bold", F.col("pos") == 6)
    units = blocks.text_block_units(lines, ["doc_id"], F.lit(2))
    return units.select("doc_id", F.col("ord").cast("int").alias("ord"), "kind", "label", "value")


@query("torn_labels", """WITH u AS (SELECT p_partkey AS doc_id, * FROM part)
    SELECT doc_id, 1 AS ord, 'sub' AS kind, '2.5' AS seq, p_type AS label, '' AS value FROM u UNION ALL SELECT doc_id, 2, 'field', '', p_name || '制', p_brand || chr(10) || 'H302: ' || p_brand FROM u
    UNION ALL SELECT doc_id, 3, 'sub', '9.1', p_name, '' FROM u""")
def torn_labels(spark, d):
    texts = [F.concat("p_name", F.lit("：")), F.lit("制："), F.col("p_brand"), F.concat(F.lit("2.5\t"), "p_type"), F.concat(F.lit("H302: "), "p_brand"), F.concat(F.lit("9.1 "), "p_name")]
    lines = A.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(*texts)).alias("pos", "line")).withColumn("bold", F.lit(False))
    return blocks.text_block_units(lines, ["doc_id"]).select("doc_id", F.col("ord").cast("int").alias("ord"), "kind", "seq", "label", "value")


@query("unified_blocks", """WITH u AS (SELECT p_partkey AS doc_id, * FROM part)
    SELECT doc_id, 1 AS ord, 2 AS idx, 'sub' AS kind, '8.1' AS seq, p_type AS label, '' AS value, false AS editable FROM u
    UNION ALL SELECT doc_id, 2, 0, 'field', '8.2', p_name, p_size::VARCHAR, true FROM u
    UNION ALL SELECT doc_id, 3, 3, 'field', '', 'Waste Disposal Method of ' || p_name, 'it is long enough to be content ' || p_brand || chr(10) || 'and goes on in the next line of it', true FROM u
    UNION ALL SELECT doc_id, 4, 1, 'field', '', '', p_brand, true FROM u""")
def unified_blocks(spark, d):
    flags = lambda *b: F.array(*[F.lit(x) for x in b])
    item = lambda kind, label, value, bold: F.struct(F.lit(kind).alias("kind"), label.alias("label"), value.alias("value"), bold.alias("bold"))
    none, text = F.lit(""), lambda s, c: F.concat(F.lit(s), c)
    block = F.concat_ws("\n", text("Waste Disposal Method of ", "p_name"), text("it is long enough to be content ", "p_brand"))
    items = F.array(item("line", none, text("8.1 ", "p_type"), flags(False)), item("field", text("8.2 ", "p_name"), TEXT("p_size"), flags()), item("line", none, block, flags(True, False)), item("line", none, F.lit("and goes on in the next line of it"), flags(False)), item("field", none, F.col("p_brand"), flags()))
    part = A.table(spark, d, "part")
    # dealt by doc_id before rows become five, to tasks that grow in number and not in size
    part = store.dealt(part.withColumnRenamed("p_partkey", "doc_id"), 5 * part.count(), "doc_id")
    x = part.select("doc_id", F.lit(8).alias("section"), F.posexplode(items).alias("pos", "i")).select("doc_id", "section", "pos", "i.*")
    return blocks.unified_rows(x).select("doc_id", F.col("ord").cast("int").alias("ord"), "idx", "kind", "seq", "label", "value", "editable")


LAB = f"CASE WHEN regexp_matches(t, '{END_RE}') THEN trim(regexp_extract(t, '{END_RE}', 1), {WHITE}) WHEN kind = 'field' AND regexp_matches(t, '{INLINE_RE}') AND cls = 'F' THEN trim(regexp_extract(t, '{INLINE_RE}', 1), {WHITE}) WHEN kind = 'note' THEN '' ELSE t END"


@query("split_line", f"""WITH s AS (SELECT doc_id, pos, trim(line, {WHITE}) AS t FROM lines),
    c AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '^\\s*[HP]\\s*\\p{{Nd}}{{3}}') OR regexp_matches(t, '^[一-鿿][：:]$') THEN 'C' WHEN regexp_matches(t, '{END_RE}') THEN 'P'
        WHEN regexp_matches(t, '{INLINE_RE}') AND trim(regexp_extract(t, '{INLINE_RE}', 1), {WHITE}) <> '' AND NOT regexp_matches(trim(regexp_extract(t, '{INLINE_RE}', 1), {WHITE}), '^\\p{{Nd}}{{2,}}') THEN 'F'
        WHEN regexp_matches(t, '^\\p{{Nd}}+\\.\\p{{Nd}}+[\\s\\p{{Z}}]*[^\\s\\p{{Z}}]+') THEN 'S' WHEN regexp_matches(t, '^\\p{{Nd}}{{2,}}[\\s\\p{{Z}}]*[^\\s\\p{{Z}}]') THEN 'C' WHEN {HEAD} THEN 'P' ELSE 'C' END AS cls FROM s),
    k AS (SELECT *, CASE cls WHEN 'S' THEN 'sub' WHEN 'C' THEN 'note' ELSE 'field' END AS kind FROM c),
    l AS (SELECT *, {LAB} AS lab FROM k)
    SELECT doc_id, pos, kind, CASE WHEN regexp_matches(lab, '{UNIT_SEQ}') THEN trim(regexp_extract(lab, '{UNIT_SEQ}', 2), {WHITE}) ELSE lab END AS label,
    CASE cls WHEN 'F' THEN trim(regexp_extract(t, '{INLINE_RE}', 2), {WHITE}) WHEN 'C' THEN t ELSE '' END AS value FROM l""", "lines")
def split_line(spark, d):
    return blocks.split_lines(A.lines(spark, d))


# ---- ingredients ----


@query("component_row_parts", f"""WITH {SPLITTED} SELECT doc_id, 0 AS pos, 'field' AS kind, '{X.PRODUCT_TYPE}' AS label, 'mix' AS value, NULL::INT AS idx, NULL AS name FROM component_cells
    UNION ALL SELECT doc_id, 2, 'line', '', name_cell, NULL, NULL FROM component_cells UNION ALL SELECT doc_id, 3, 'component', '', '', idx, name FROM parts""", "component_cells")
def component_row_parts(spark, d):
    cells = F.array(F.array(F.lit(f"{X.PRODUCT_TYPE}："), F.lit("mix")), F.array(F.lit("成分"), F.lit("")), F.array("name_cell"), F.array("name_cell", "cas_cell", "conc_cell"))
    x = A.component_cells(spark, d).select("doc_id", F.lit(3).alias("section"), F.posexplode(cells).alias("pos", "cells"))
    return components.components_of_rows(x).select("doc_id", "pos", "kind", "label", "value", "idx", "name")


def _flat_cells(spark, d):
    zipped = F.arrays_zip(*[F.split(c, "\n").alias(c) for c in ("name_cell", "cas_cell", "conc_cell")])
    body = F.array_join(F.transform(zipped, lambda z: F.concat_ws("\t", z["name_cell"], z["cas_cell"], z["conc_cell"])), "\n")
    return A.component_cells(spark, d).select("doc_id", F.lit(0).alias("pos"), F.concat(F.lit("About\tmix\nChemical Name\tCAS No.\t%\n"), body).alias("text"))


@query("flat_component_parts", f"""WITH flat AS ({FLATTED}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS i FROM flat),
    p AS (SELECT *, contains(line, '商业机密') OR regexp_matches(line, '\\b\\d{{2,7}}-\\d{{2}}-\\d\\b') AS comp, string_split(line, chr(9)) AS c FROM l)
    SELECT doc_id, i, CASE WHEN i = 0 THEN 'field' WHEN comp THEN 'component' ELSE 'line' END AS kind, CASE WHEN i = 0 THEN 'About' ELSE '' END AS label, CASE WHEN i = 0 THEN 'mix' WHEN comp THEN '' ELSE line END AS value,
    CASE WHEN comp THEN c[1] END AS name, CASE WHEN comp THEN c[2] END AS cas, CASE WHEN comp THEN c[3] END AS conc FROM p WHERE i <> 1 AND doc_id IN (SELECT doc_id FROM p WHERE comp)""", "component_cells")
def flat_component_parts(spark, d):
    return components.flat_parts(components.flat_tables(_flat_cells(spark, d))).drop("pos")


@query("mixture_rows", f"WITH {SPLITTED} SELECT doc_id, 2 * idx + 1 AS pos, raw_name AS name, '20±1%' AS conc FROM parts", "component_cells")
def mixture_rows(spark, d):
    x = components.split_cells(A.component_cells(spark, d))
    both = F.array(F.array(F.lit("3.1 Mixtures")), F.array(F.concat(F.lit("· Description: "), "raw_name", F.lit(" 20±1% /"))))
    x = x.select("doc_id", F.lit(3).alias("section"), "idx", F.posexplode(both).alias("k", "cells"))
    return components.mixture_candidates(x.select("doc_id", "section", (2 * F.col("idx") + F.col("k")).alias("pos"), "cells")).select("doc_id", "pos", "name", "conc")


# ---- entries, pivot and sinks ----

THIRD = "c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS idx, label AS name, seq AS cas, value AS conc FROM entries WHERE section = 3 AND kind = 'field')"


def _third(spark, d):
    """Fields of section 3 as its ingredients."""
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int")
    return A.entries(spark, d).where("section = 3 and kind = 'field'").select("doc_id", "section", idx.alias("idx"), F.col("label").alias("name"), F.col("seq").alias("cas"), F.col("value").alias("conc"))


@query("document_entries", f"""WITH {SUBTITLED}, {THIRD}, t AS (SELECT DISTINCT doc_id FROM entries WHERE section = 3) SELECT doc_id, section, pos, sub_title, label, value, kind FROM subtitled
    UNION ALL SELECT doc_id, 3, 1099511627776, '成分', '成分表头', '{X.DEFAULT_COMPONENT_HEADER}', 'component_header' FROM t
    UNION ALL SELECT doc_id, 3, 1099511627777 + idx, '成分', name, name || ' | CAS: ' || cas || ' | 含量: ' || conc, 'component' FROM c""", "entries")
def document_entries(spark, d):
    e = A.entries(spark, d)
    s = e.select("doc_id", "section", F.col("big_title").alias("full_title"), (F.col("section") == 3).alias("is_component_table"), F.lit("").alias("component_header")).distinct()
    r = e.select("doc_id", "section", F.col("pos").alias("ord"), "kind", "seq", "label", "value", F.lit(True).alias("editable"))
    return hierarchy.document_entries(r, s, _third(spark, d)).select("doc_id", "section", "pos", "sub_title", "label", "value", "kind")


@query("extract_many", f"WITH {SUBTITLED}, h AS (SELECT doc_id, pos, label, value FROM subtitled WHERE section IN (2, 9) AND contains({NORM('value')}, '5')) SELECT d.doc_id, h.pos, h.label, h.value FROM (SELECT DISTINCT doc_id FROM entries) d LEFT JOIN h USING (doc_id)", "entries")
def extract_many(spark, d):
    e = hierarchy.with_sub_titles(A.entries(spark, d))
    return hierarchy.extract_many(e, e, "5", "value", [2, 9]).select("doc_id", "pos", "label", "value")


@query("pivot_labels", """SELECT doc_id, pos, CASE WHEN section = 9 AND pos % 3 = 0 THEN 'pH值' WHEN section = 9 THEN label ELSE CASE WHEN pos % 3 = 0 THEN 'PH值' ELSE label || '（' || pos || '）' END END AS norm_label FROM entries WHERE kind = 'field'""", "entries")
def pivot_labels(spark, d):
    label = F.when(F.col("pos") % 3 == 0, "PH值").otherwise(F.concat("label", F.lit("（"), F.col("pos").cast("string"), F.lit("）")))
    return pivot.pivot_input(A.entries(spark, d).where("kind = 'field'").withColumn("label", label)).select("doc_id", "pos", "norm_label")


@query("pivot_components", f"""WITH {THIRD}, t AS (SELECT DISTINCT doc_id FROM entries WHERE section = 3), slots AS (SELECT min(doc_id) AS doc_id, unnest(range(0, (SELECT max(idx) + 1 FROM c))) AS idx FROM t),
    every AS (SELECT * FROM c UNION ALL SELECT doc_id, idx::INT, '', '', '' FROM slots), long AS (SELECT doc_id, '成分' || (idx + 1) || s AS norm_label, CASE s WHEN '名称' THEN name WHEN 'CAS' THEN cas ELSE conc END AS value FROM every, (VALUES ('名称'), ('CAS'), ('含量')) v(s))
    SELECT doc_id, norm_label, max(value) AS value FROM long GROUP BY ALL""", "entries")
def pivot_components(spark, d):
    tables = A.entries(spark, d).where("section = 3").select("doc_id", "section").distinct()
    return pivot.pivot_cells(pivot.pivot_input(pivot.component_rows(tables, _third(spark, d)))).select("doc_id", "norm_label", "value")


@query("file_tsv", f"WITH {SUBTITLED} SELECT doc_id, pos, concat_ws(chr(9), 'doc-' || doc_id || '.docx', section::VARCHAR, big_title, sub_title, full_label, translate(value, chr(9) || chr(10), '  ')) AS line FROM subtitled", "entries")
def file_tsv(spark, d):
    e = hierarchy.with_sub_titles(A.entries(spark, d)).withColumn("file", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".docx")))
    return sinks.tsv_lines(e, "file").select("doc_id", "pos", "line")


@query("flat_json_values", f"WITH {SUBTITLED} SELECT doc_id, pos, section, big_title, sub_title, label, value, seq, kind, kind <> 'sub' AS editable FROM subtitled", "entries")
def flat_json_values(spark, d):
    j = sinks.json_lines(hierarchy.with_sub_titles(A.entries(spark, d)).withColumn("editable", F.col("kind") != "sub"))
    schema = "section int, big_title string, sub_title string, label string, value string, seq string, kind string, editable boolean"
    return j.select("doc_id", "pos", F.from_json("json", schema).alias("j")).select("doc_id", "pos", "j.*")


@query("tree_nodes", f"""WITH {SUBTITLED}, m AS (SELECT *, kind = 'sub' OR (kind = 'field' AND seq <> '') AS opener FROM subtitled)
    SELECT doc_id, section, big_title, big, -1 AS at, seq, label, value, kind FROM m WHERE opener
    UNION ALL SELECT doc_id, section, big_title, big, (row_number() OVER (PARTITION BY doc_id, section, big ORDER BY pos) - 1)::INT, '', label, value, kind FROM m WHERE NOT opener""", "entries")
def tree_nodes(spark, d):
    leaf = "array<struct<pos:bigint,label:string,value:string,kind:string>>"
    schema = f"array<struct<section:int,big_title:string,big_titles:array<struct<pos:bigint,seq:string,title:string,value:string,kind:string,children:{leaf}>>,direct_fields:{leaf}>>"
    s = sinks.tree_json(A.entries(spark, d)).select("doc_id", F.inline(F.from_json("json", schema)))
    b = s.select("doc_id", "section", "big_title", F.explode("big_titles").alias("b"))
    heads = b.select("doc_id", "section", "big_title", F.col("b.pos").alias("big"), F.lit(-1).alias("at"), "b.seq", F.col("b.title").alias("label"), "b.value", "b.kind")
    under = b.select("doc_id", "section", "big_title", F.col("b.pos").alias("big"), F.posexplode("b.children").alias("at", "c"))
    direct = s.select("doc_id", "section", "big_title", F.lit(None).cast("long").alias("big"), F.posexplode("direct_fields").alias("at", "c"))
    return heads.unionByName(under.unionByName(direct).select("doc_id", "section", "big_title", "big", "at", F.lit("").alias("seq"), "c.label", "c.value", "c.kind"))


# ---- Word packages made of rows, decoded again ----


@query("package_rows", f"""WITH r AS (SELECT doc_id, pos - 1 AS pos, trim(regexp_replace(c0, ' {{2,}}', ' ', 'g'), {WHITE}) AS c0, trim(c1, {WHITE}) AS c1 FROM rows_)
    SELECT doc_id::VARCHAR AS doc_id, pos, CASE WHEN c0 = c1 THEN c0 ELSE c0 || '|' || c1 END AS cells, pos % 3 = 0 AND c0 <> '' AS bold0 FROM r WHERE c0 <> '' OR c1 <> ''""", "rows")
def package_rows(spark, d):
    # written between the steps: packages are made and decoded once, paragraphs cleaned once
    records = store.keep(docx.decode(packages.of_rows(A.rows(spark, d), F.col("pos") % 3 == 1)), "row-records")
    levels = records.where("kind = 'level'").select("doc_id", "num_id", "ilvl", "start", "lvl_text")
    clean = store.keep(docx.clean_paragraphs(docx.paragraphs(records), levels), "row-paragraphs")
    return docx.cell_rows(clean).select("doc_id", "pos", F.array_join("cells", "|").alias("cells"), "bold0")
