"""Views of plain tables as document rows, so that every operator can run on data that is no Word file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import fixed as X
from ..shipping import ship
from .pages import page_paragraphs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    """doc_id, pos, line: the lines of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _lines_with_parts(spark, sf_dir, *columns: str) -> tuple[DataFrame, int]:
    """Order lines joined with columns of their parts, and the number of order lines: tasks grow in number with them, not in size."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), *columns)
    n = item.count()
    # a join that sorts both sides takes its number of tasks from the parts; a broadcast one deals only them
    return item.join(store.dealt(part, n, "l_partkey"), "l_partkey"), n


def rows(spark, sf_dir) -> DataFrame:
    """doc_id, pos, c0, c1: order lines of a supplier as rows of titles, continuations and numbered fields; dealt by doc_id."""
    item, n = _lines_with_parts(spark, sf_dir, "p_name", "p_type")
    c0 = (
        F.when(F.col("l_linenumber") == 1, F.concat((F.col("l_orderkey") % 16 + 1).cast("string"), F.lit("."), "p_type")).when(F.col("l_linenumber") % 3 == 0, "")
        .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit(" "), "p_name", F.lit("：")))
    )
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")).cast("long")
    # dealt by the name that later steps know: one exchange serves their windows over doc_id, too
    x = item.select(F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", c0.alias("c0"), F.col("l_quantity").cast("int").cast("string").alias("c1"))
    return store.dealt(x, n, "doc_id").select("doc_id", pos.alias("pos"), "c0", "c1")


def component_cells(spark, sf_dir) -> DataFrame:
    """doc_id, name_cell, cas_cell, conc_cell: an order's lines as one ingredient row of three multi-line cells."""
    item, n = _lines_with_parts(spark, sf_dir, "p_name")
    k, q = F.col("l_partkey"), F.col("l_quantity").cast("int").cast("string")
    cas = F.when(k % 3 == 0, "商业机密").when(k % 3 == 1, F.concat((k + 100).cast("string"), F.lit("-"), (k % 90 + 10).cast("string"), F.lit("-"), (k % 10).cast("string"))).otherwise("——")
    x = item.withColumns({"cas": cas, "conc": F.concat(F.lit("＞"), q, F.lit("～"), q, F.lit("％"))})
    x = store.dealt(x.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "p_name", "cas", "conc"), n, "doc_id")
    # an order's lines in order, put together by windows over one sort: its first line has all of them
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "p_name", "cas", "conc")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = lambda c: F.collect_list(c).over(every)
    x = x.select("doc_id", F.row_number().over(order).alias("first"), cell("p_name").alias("names"), cell("cas").alias("cas"), cell("conc").alias("conc")).where("first = 1")
    return x.select("doc_id", F.array_join("names", "\n").alias("name_cell"), F.array_join("cas", "\n").alias("cas_cell"), F.array_join("conc", "\n").alias("conc_cell"))


def entries(spark, sf_dir) -> DataFrame:
    """doc_id, pos, section, big_title, seq, label, value, kind: a user's events as entries of a document."""
    k = F.get_json_object("props", "$.k").cast("int")
    section = (F.lit(1) + k % 16).cast("int")
    seq = F.when(k % 2 == 0, F.concat(section.cast("string"), F.lit("."), (k % 7 + 1).cast("string"))).otherwise("")
    value = F.when(F.col("event_id") % 10 == 0, "").otherwise(F.floor("value").cast("int").cast("string"))
    kind = F.when(F.col("event_type") == "signup", "sub").when(F.col("event_type") == "error", "note").otherwise("field")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), section.alias("section"), F.concat(section.cast("string"), F.lit(".节")).alias("big_title"), seq.alias("seq"), F.col("event_type").alias("label"), value.alias("value"), kind.alias("kind")
    )


def paragraphs(spark, sf_dir) -> DataFrame:
    """doc_id, pos, tag, text, bold and links of all visible text of web pages."""
    return page_paragraphs(table(spark, sf_dir, "pages"))


def _page_sql() -> str:
    """Pages by replacing what is no text, step by step, instead of reading tokens: blocks become marks, other tags nothing."""
    blocks, bold = "|".join(X.HTML_BLOCKS), "|".join(X.HTML_BOLD)
    text = "html"
    for pattern, to in (
        ("(?is)<!--.*?(-->|$)", "''"), ("(?is)<script\\b[^>]*>.*?(</script\\s*>|$)", "''"), ("(?is)<style\\b[^>]*>.*?(</style\\s*>|$)", "''"), ("<![^>]*>", "''"), ("(?i)<br\\s*/?>", "chr(3)"),
        (f"(?i)<({bold})(\\s[^>]*)?>", "chr(4)"), (f"(?i)</({bold})\\s*>", "chr(5)"), (f"(?i)<(/?)({blocks})(\\s[^>]*|/)?>", "chr(1) || '\\1\\2' || chr(2)"), ("</?[A-Za-z][^>]*>", "''"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    words = "regexp_replace(regexp_replace(translate(t, chr(4) || chr(5), ''), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ?\x03 ?', chr(10), 'g')"
    for entity, character in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\xa0"), ("amp", "&")):
        words = f"replace({words}, '&{entity};', '{character}')"
    return f"""page_runs AS (SELECT page_id, i, CASE WHEN i > 1 THEN split_part(x, chr(2), 1) ELSE '' END AS name, CASE WHEN i > 1 THEN split_part(x, chr(2), 2) ELSE x END AS t
        FROM (SELECT page_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT page_id, string_split({text}, chr(1)) AS s FROM pages))),
    page_levels AS (SELECT *, sum(CASE WHEN name IN ('', 'p', '/p', 'hr', '/hr') THEN 0 WHEN name LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS level FROM page_runs),
    page_tags AS (SELECT *, coalesce(CASE WHEN name LIKE '/%' THEN last_value(CASE WHEN name NOT LIKE '/%' AND name <> 'p' THEN nullif(name, '') END IGNORE NULLS) OVER (PARTITION BY page_id, level ORDER BY i ROWS UNBOUNDED PRECEDING)
        ELSE name END, '') AS tag, {words} AS words FROM page_levels),
    paragraphs AS (SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, tag, trim(words, ' ' || chr(10) || chr(160)) AS text, regexp_matches(t, '\x04[^\x05]*[^\\s\x04\x05\x03]') AS bold
        FROM page_tags WHERE trim(words, ' ' || chr(10) || chr(160)) <> '')"""


#: The same views in DuckDB, as named parts of a WITH clause.
SQL = {
    "lines": "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos FROM documents)",
    "rows": """rows_ AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos,
        CASE WHEN l_linenumber = 1 THEN (l_orderkey % 16 + 1)::VARCHAR || '.' || p_type WHEN l_linenumber % 3 = 0 THEN ''
             ELSE l_linenumber::VARCHAR || '.' || (l_partkey % 9 + 1)::VARCHAR || ' ' || p_name || '：' END AS c0,
        trunc(l_quantity)::INT::VARCHAR AS c1 FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "component_cells": """component_cells AS (SELECT l_orderkey AS doc_id, string_agg(p_name, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)::INT::VARCHAR || '～') AS name_cell,
        string_agg(CASE l_partkey % 3 WHEN 0 THEN '商业机密' WHEN 1 THEN (l_partkey + 100)::VARCHAR || '-' || (l_partkey % 90 + 10)::VARCHAR || '-' || (l_partkey % 10)::VARCHAR
                   ELSE '——' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)::INT::VARCHAR || '～') AS cas_cell,
        string_agg('＞' || trunc(l_quantity)::INT::VARCHAR || '～' || trunc(l_quantity)::INT::VARCHAR || '％', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)::INT::VARCHAR || '～') AS conc_cell
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)""",
    "entries": """entries AS (SELECT user_id AS doc_id, event_id AS pos, section, section::VARCHAR || '.节' AS big_title,
        CASE WHEN k % 2 = 0 THEN section::VARCHAR || '.' || (k % 7 + 1)::VARCHAR ELSE '' END AS seq, event_type AS label,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE floor(value)::INT::VARCHAR END AS value,
        CASE event_type WHEN 'signup' THEN 'sub' WHEN 'error' THEN 'note' ELSE 'field' END AS kind
        FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k, 1 + json_extract_string(props, '$.k')::INT % 16 AS section FROM events))""",
    "paragraphs": _page_sql(),
}
