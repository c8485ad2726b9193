"""The registered queries over plain tables, each with the same rows in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import fixed as X
from ..functions import text as T
from ..operators import blocks, components, hierarchy, pivot, quality, rows, search_index, sections
from ..sources import adapters as A
from ..sources import pages, section_store, sinks
from ..sources.numbering import auto_numbers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [A.SQL[v] for v in views]
            body = sql.strip()
            if parts:
                body = "WITH " + ", ".join(parts) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            ORACLE_SQL[name] = body
        return f

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---- pieces of SQL ----

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
NORM = lambda c: f"lower(regexp_replace({c}, '[\\s\\p{{Z}}：:，,。；;（）()\\-]', '', 'g'))"
FULL = "concat_ws(' ', nullif(seq, ''), nullif(label, ''))"
OPENS = "(kind = 'sub' OR (kind = 'field' AND seq <> ''))"
SUBTITLED = f"""subtitled AS (SELECT *, {FULL} AS full_label, coalesce(last_value(CASE WHEN {OPENS} THEN {FULL} END IGNORE NULLS)
    OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS sub_title,
    last_value(CASE WHEN {OPENS} THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS big FROM entries)"""
HAY = f"{NORM(FULL)} || ' ' || {NORM('sub_title')} || ' ' || {NORM('big_title')} || ' ' || {NORM('value')}"
TITLE = r"^(?:[a-zA-Z]\s*)?(\d{1,2})\s*[.、．]\s*(.+?)\s*$"
TITLED = f"""titled AS (SELECT doc_id, pos, c0, c1, CASE WHEN ok THEN n END AS title_n, CASE WHEN ok THEN title END AS title FROM (
    SELECT *, length(t) <= 60 AND n BETWEEN 1 AND 16 AND NOT regexp_matches(title, '[：:]|\\d+\\.\\d|^\\d') AS ok FROM (
    SELECT doc_id, pos, c0, c1, t, TRY_CAST(regexp_extract(t, '{TITLE}', 1) AS INT) AS n, regexp_extract(t, '{TITLE}', 2) AS title
    FROM (SELECT *, trim(regexp_replace(c0, '\\s+', ' ', 'g')) AS t FROM rows_))))"""
HINT = "CASE " + " ".join(f"WHEN contains(lower(c0), '{k.lower()}') THEN {n}" for k, n in X.SECTION_HINTS) + " END"
CARRIED = f"""carried AS (SELECT *, last_value(coalesce(title_n, hint_n) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section
    FROM (SELECT *, CASE WHEN title_n IS NULL AND coalesce(max(CASE WHEN coalesce(title_n, h) IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN h END AS hint_n
          FROM (SELECT *, {HINT} AS h FROM titled)))"""
LABEL = lambda c: f"rtrim(trim(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g')), '：:。 .')"
SEQ = r"^(\d+(?:\.\d+)*)\.?\s*([一-鿿A-Za-z].*)$"
SPLIT = lambda c: (f"CASE WHEN regexp_matches({c}, '{SEQ}') THEN regexp_extract({c}, '{SEQ}', 1) ELSE '' END", f"CASE WHEN regexp_matches({c}, '{SEQ}') THEN trim(regexp_extract({c}, '{SEQ}', 2)) ELSE {c} END")
WORDY = " OR ".join(f"contains(lower(c0), '{w.lower()}')" for w in X.FIELD_WORDS)
CONTENT = f"content AS (SELECT doc_id, pos, c0, c1, section FROM carried WHERE section IS NOT NULL AND title_n IS NULL)"
ROWCLASS = f"""classed AS (SELECT *, CASE WHEN trim(c0) = '' AND trim(c1) <> '' THEN 'continuation' WHEN trim(c0) = '' THEN 'blank'
    WHEN trim(c1) = '' AND regexp_matches(trim(c0), '^\\d+\\.\\d+\\s*\\S+') AND NOT regexp_matches(c0, '[：:]') THEN 'sub'
    WHEN regexp_matches(c0, '[：:]') OR {WORDY} THEN 'field' ELSE 'joined' END AS row_class FROM content)"""
HALF = lambda c: f"translate({c}, '{X.FULL_WIDTH}', '{X.HALF_WIDTH}')"
NAME = lambda c: f"trim(regexp_replace(trim(regexp_replace({HALF(c)}, '[\\s\\p{{Z}}]+', ' ', 'g')), '-{{2,}}', '-', 'g'), '{X.EDGE_PUNCTUATION}')"
CAS = lambda c: f"CASE WHEN regexp_matches(trim({c}), '(?i)^(trade\\s*secrets?|business\\s*secrets?|proprietary|confidential|unknown)$') THEN trim({c}) WHEN regexp_matches(replace({HALF('trim(' + c + ')')}, ' ', ''), '^[\\-—–－~·]+$') THEN '' ELSE replace({HALF('trim(' + c + ')')}, ' ', '') END"
CONC = lambda c: f"replace({HALF(c)}, ' ', '')"
SPLITTED = f"""pieces AS (SELECT doc_id, i - 1 AS idx, coalesce(ns[i], '') AS raw_name, coalesce(cs[i], '') AS raw_cas, coalesce(ps[i], '') AS raw_conc FROM (
    SELECT *, unnest(range(1, greatest(len(ns), len(cs), len(ps)) + 1)) AS i FROM (
    SELECT doc_id, string_split(name_cell, chr(10)) AS ns, string_split(cas_cell, chr(10)) AS cs, string_split(conc_cell, chr(10)) AS ps FROM component_cells))),
    parts AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS idx, {NAME('raw_name')} AS name, {CAS('raw_cas')} AS cas, {CONC('raw_conc')} AS conc, raw_name, raw_cas, raw_conc
    FROM pieces WHERE {NAME('raw_name')} <> '')"""
PIVOTED = f"""p AS (SELECT doc_id, pos, section, CASE WHEN kind = 'note' THEN 'note' ELSE 'field' END AS kind,
    CASE WHEN kind = 'note' THEN '{X.SUMMARY_COLUMN}' ELSE label END AS norm_label, seq, value FROM entries WHERE kind <> 'sub')"""
CELLS = """cells AS (SELECT doc_id, section, kind, norm_label, CASE WHEN kind = 'note' THEN coalesce(string_agg(value, chr(10) ORDER BY pos) FILTER (value <> ''), '')
    ELSE coalesce(arg_min(value, pos) FILTER (value <> ''), '') END AS value FROM p GROUP BY doc_id, section, kind, norm_label)"""
COLUMNS = """seqs AS (SELECT section, kind, norm_label, seq, row_number() OVER (PARTITION BY section, kind, norm_label ORDER BY count(*) DESC, length(seq), min((doc_id, pos))) AS r
    FROM p WHERE seq <> '' GROUP BY section, kind, norm_label, seq),
    columns_ AS (SELECT c.section, c.kind, c.norm_label, coalesce(s.seq, '') AS seq, row_number() OVER (PARTITION BY c.section ORDER BY c.first, c.kind)::INT AS col_ord FROM (
    SELECT section, kind, norm_label, min((doc_id, pos)) AS first FROM p GROUP BY ALL HAVING bool_or(value <> '')) c
    LEFT JOIN seqs s ON s.section = c.section AND s.kind = c.kind AND s.norm_label = c.norm_label AND s.r = 1)"""


# ---- search and hierarchy over entries ----


def _entries(spark, d):
    return hierarchy.with_sub_titles(A.entries(spark, d))


@query("search_all_terms", f"WITH {SUBTITLED} SELECT doc_id, pos, section, sub_title, label, value FROM subtitled WHERE contains({HAY}, 'c') AND contains({HAY}, '1') AND contains({HAY}, 'ick')", "entries")
def search_all_terms(spark, d):
    return hierarchy.search_all(_entries(spark, d), "C： 1 (ick)").select("doc_id", "pos", "section", "sub_title", "label", "value")


@query("search_scopes", f"WITH {SUBTITLED} SELECT 'label' AS scope, count(*) AS n FROM subtitled WHERE contains({NORM(FULL)}, 'view') UNION ALL SELECT 'value', count(*) FROM subtitled WHERE contains({NORM('value')}, '12') UNION ALL SELECT 'section', count(*) FROM subtitled WHERE contains(section::VARCHAR, '1')", "entries")
def search_scopes(spark, d):
    e = _entries(spark, d)
    found = [hierarchy.search_all(e, q, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s, q in (("label", "view"), ("value", "12"), ("section", "1"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("search_many_queries", f"WITH {SUBTITLED}, q AS (SELECT * FROM (VALUES (1, ['click', '12']), (2, ['purchase']), (3, ['nothing', 'here'])) t(query_id, terms)) SELECT query_id, count(*) AS n FROM subtitled JOIN q ON len(list_filter(terms, lambda t: contains({HAY}, t))) = len(terms) GROUP BY query_id", "entries")
def search_many_queries(spark, d):
    q = spark.createDataFrame([(i, hierarchy.terms_of(t)) for i, t in ((1, "click 12"), (2, "Purchase："), (3, "nothing here"))], "query_id int, terms array<string>")
    return hierarchy.search_many(_entries(spark, d), q).groupBy("query_id").agg(F.count("*").alias("n"))


@query("search_lines", f"SELECT doc_id, pos, line FROM lines WHERE contains({NORM('line')}, 'the') AND contains({NORM('line')}, 'erst')", "lines")
def search_lines(spark, d):
    n = T.search_norm(F.col("line"))
    return A.lines(spark, d).where(n.contains("the") & n.contains("erst"))


TREE_HIT = f"""WITH {SUBTITLED}, hit AS (SELECT *, {OPENS} AS opener, CASE WHEN {OPENS} THEN contains({NORM(FULL)} || ' ' || {NORM('value')}, '33') OR contains({NORM(FULL)} || ' ' || {NORM('value')}, '7.2')
    ELSE contains({NORM('label')} || ' ' || {NORM('value')}, '33') OR contains({NORM('label')} || ' ' || {NORM('value')}, '7.2') END AS hit FROM subtitled),
    marked AS (SELECT *, max(CASE WHEN opener THEN hit::INT END) OVER (PARTITION BY doc_id, section, big) AS big_hit, max(hit::INT) OVER (PARTITION BY doc_id, section, big) AS any_hit FROM hit),
    kept AS (SELECT * FROM marked WHERE hit OR (big IS NOT NULL AND (big_hit = 1 OR (opener AND any_hit = 1))))"""


@query("search_tree_any", TREE_HIT + " SELECT doc_id, pos, section, sub_title, label, value, kind FROM kept", "entries")
def search_tree_any(spark, d):
    return hierarchy.search_any(_entries(spark, d), "33 7.2").select("doc_id", "pos", "section", "sub_title", "label", "value", "kind")


@query("section_hits", TREE_HIT + " SELECT DISTINCT doc_id, section, big_title FROM kept WHERE section IN (3, 8, 9)", "entries")
def section_hits(spark, d):
    return hierarchy.hit_sections(hierarchy.search_any(_entries(spark, d).where(F.col("section").isin(3, 8, 9)), "33 7.2"))


@query("search_index", f"""WITH {SUBTITLED}, q AS (SELECT DISTINCT label, seq FROM entries WHERE seq <> ''), h AS (SELECT pos, {HAY} AS hay FROM subtitled)
    SELECT label || ' ' || seq AS query_id, count(*) AS n, sum(pos)::BIGINT AS places FROM h JOIN q ON contains(hay, {NORM('q.label')}) AND contains(hay, q.seq) GROUP BY ALL""", "entries")
def search_index_hits(spark, d):
    e = _entries(spark, d)
    # every label with every number beside it is a query
    q = e.where("seq <> ''").select(F.concat_ws(" ", "label", "seq").alias("query_id"), F.array(T.search_norm(F.col("label")), T.search_norm(F.col("seq"))).alias("terms")).distinct()
    return search_index.search(search_index.build_index(e), q).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("pruned_sections", "SELECT doc_id, pos, section, label, value FROM entries WHERE section IN (SELECT section FROM entries GROUP BY section HAVING count(*) % 3 = 0)", "entries")
def pruned_sections(spark, d):
    path = store.new_path(spark, "by-section")
    e = A.entries(spark, d)
    section_store.write_by_section(e, path)
    chosen = e.groupBy("section").agg(F.count("*").alias("n")).where("n % 3 = 0")
    return section_store.read_sections(spark, path, chosen).select("doc_id", "pos", "section", "label", "value")


@query("batch_extract_counts", f"WITH {SUBTITLED}, docs AS (SELECT DISTINCT doc_id FROM entries), hits AS (SELECT doc_id, count(*) AS n FROM subtitled WHERE section IN (2, 9) AND contains({NORM('value')}, '5') GROUP BY doc_id), per AS (SELECT docs.doc_id, coalesce(n, 0) AS n FROM docs LEFT JOIN hits USING (doc_id)) SELECT doc_id, sum(n)::BIGINT AS n_hits FROM per GROUP BY ROLLUP (doc_id)", "entries")
def batch_extract_counts(spark, d):
    e = _entries(spark, d)
    return hierarchy.hit_counts(e, hierarchy.search_all(e.where(F.col("section").isin(2, 9)), "5", "value"))


@query("field_lookup", "SELECT doc_id, min(pos) AS pos, arg_min(value, pos) AS value, arg_min(seq, pos) AS seq FROM entries WHERE section = 9 AND kind = 'field' AND label = 'view' GROUP BY doc_id", "entries")
def field_lookup(spark, d):
    return hierarchy.get_field(A.entries(spark, d), 9, " View：").select("doc_id", "pos", "value", "seq")


@query("entries_subtitle", f"WITH {SUBTITLED} SELECT doc_id, pos, sub_title, full_label FROM subtitled", "entries")
def entries_subtitle(spark, d):
    return _entries(spark, d).select("doc_id", "pos", "sub_title", "full_label")


FLAT = f"""flat AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, direct, pos) AS ord FROM (SELECT *, big IS NULL AS direct FROM subtitled
    WHERE NOT (kind = 'field' AND seq <> '' AND value = '')))"""


@query("flatten_tree", f"WITH {SUBTITLED}, {FLAT} SELECT doc_id, ord, section, CASE WHEN direct THEN '' ELSE sub_title END AS sub_title, label, value, kind FROM flat", "entries")
def flatten_tree(spark, d):
    return hierarchy.flatten_tree(_entries(spark, d)).select("doc_id", "ord", "section", "sub_title", "label", "value", "kind")


@query("field_map_last", "SELECT doc_id, section, label, arg_max(value, pos) AS value FROM entries WHERE kind = 'field' GROUP BY ALL", "entries")
def field_map_last(spark, d):
    return hierarchy.field_map(A.entries(spark, d))


@query("tree_json")
def tree_json(spark, d):
    return sinks.tree_json(A.entries(spark, d))


@query("flat_tsv", f"""WITH {SUBTITLED} SELECT doc_id, pos, concat_ws(chr(9), section::VARCHAR, big_title, sub_title, full_label, translate(value, chr(9) || chr(10), '  ')) AS line FROM subtitled""", "entries")
def flat_tsv(spark, d):
    return sinks.tsv_lines(_entries(spark, d)).select("doc_id", "pos", "line")


@query("flat_json", f"""WITH {SUBTITLED} SELECT doc_id, count(*) AS n, sum(length(value)) AS chars FROM subtitled GROUP BY doc_id""", "entries")
def flat_json(spark, d):
    j = sinks.json_lines(_entries(spark, d).withColumn("editable", F.lit(True)))
    back = j.select("doc_id", F.from_json("json", "value string").alias("v"))
    return back.groupBy("doc_id").agg(F.count("v").alias("n"), F.sum(F.length("v.value")).alias("chars"))


# ---- sections and rows ----


@query("section_titles", f"WITH {TITLED} SELECT doc_id, pos, title_n, title FROM titled WHERE title_n IS NOT NULL", "rows")
def section_titles(spark, d):
    t = T.section_title(F.col("c0"))
    return A.rows(spark, d).withColumn("t", t).where("t.n is not null").select("doc_id", "pos", F.col("t.n").alias("title_n"), F.col("t.title").alias("title"))


@query("section_carry", f"WITH {TITLED}, {CARRIED} SELECT doc_id, pos, section, c0 FROM carried WHERE section IS NOT NULL", "rows")
def section_carry(spark, d):
    return sections.carry_sections(A.rows(spark, d)).select("doc_id", "pos", "section", "c0")


@query("section_defaults", f"""WITH {TITLED}, {CARRIED}, firsts AS (SELECT doc_id, section, arg_min(coalesce(title, c0), pos) AS title, arg_min(c0, pos) AS full_title FROM carried WHERE coalesce(title_n, hint_n) IS NOT NULL GROUP BY ALL),
    d AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{t}')" for n, t in X.SECTION_TITLES)}) v(section, default_title))
    SELECT doc_id, section, coalesce(nullif(CASE WHEN section % 2 = 0 THEN '' ELSE title END, ''), default_title) AS title, full_title FROM firsts JOIN d USING (section)""", "rows")
def section_defaults(spark, d):
    s = sections.section_table(A.rows(spark, d)).withColumn("title", F.when(F.col("section") % 2 == 0, "").otherwise(F.col("title")))
    return sections.with_default_titles(s).select("doc_id", "section", "title", "full_title")


@query("textbox_routing", f"""WITH boxes AS (SELECT doc_id, pos, pos % 4 = 0 AS is_box, CASE WHEN pos % 8 = 0 THEN (pos % 13 + 1)::VARCHAR || '.2 text' WHEN pos % 12 = 4 THEN 'Chemical stability of it' ELSE c0 END AS c0, c1 FROM rows_),
    {TITLED.replace('FROM rows_', 'FROM boxes')}, {CARRIED},
    own AS (SELECT c.*, b.is_box, CASE WHEN b.is_box AND c.title_n IS NULL THEN coalesce(TRY_CAST(regexp_extract(c.c0, '^\\s*(\\d{{1,2}})\\.\\d+\\s', 1) AS INT),
        CASE WHEN contains(lower(c.c0), 'reactivity') OR contains(lower(c.c0), 'chemical stability') OR contains(lower(c.c0), 'thermal decomposition') OR contains(lower(c.c0), 'hazardous decomposition') THEN 10
             WHEN contains(lower(c.c0), 'additional information about design') THEN 8 WHEN contains(lower(c.c0), 'relevant safety') THEN 15 WHEN contains(lower(c.c0), 'this information is based') THEN 16 END) END AS own
        FROM carried c JOIN boxes b USING (doc_id, pos)),
    done AS (SELECT *, max(CASE WHEN is_box AND title_n IS NULL AND hint_n IS NULL THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS boxed FROM own)
    SELECT doc_id, pos, coalesce(own, section, boxed) AS section FROM done WHERE coalesce(own, section, boxed) IS NOT NULL""", "rows")
def textbox_routing(spark, d):
    p = F.col("pos")
    c0 = F.when(p % 8 == 0, F.concat((p % 13 + 1).cast("string"), F.lit(".2 text"))).when(p % 12 == 4, "Chemical stability of it").otherwise(F.col("c0"))
    return sections.route_textboxes(A.rows(spark, d).withColumns({"is_box": p % 4 == 0, "c0": c0})).select("doc_id", "pos", "section")


def _content(spark, d):
    x = sections.content_rows(A.rows(spark, d))
    return x.select("doc_id", "section", "pos", F.array("c0", "c1").alias("cells"), F.lit(False).alias("bold0"))


@query("row_class", f"WITH {TITLED}, {CARRIED}, {CONTENT}, {ROWCLASS} SELECT doc_id, section, pos, row_class FROM classed", "rows")
def row_class(spark, d):
    return rows.classify(_content(spark, d)).select("doc_id", "section", "pos", "row_class")


ITEMS = f"""items AS (SELECT doc_id, section, anchor AS pos, arg_min(label, pos) AS label, coalesce(string_agg(c1, chr(10) ORDER BY pos) FILTER (c1 <> ''), '') AS value, arg_min(kind, pos) AS kind FROM (
    SELECT *, CASE WHEN kind = 'append' THEN last_value(CASE WHEN kind = 'field' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) ELSE pos END AS anchor FROM (
    SELECT doc_id, section, pos, c1, CASE WHEN row_class = 'continuation' AND had = 1 THEN 'append' ELSE 'field' END AS kind, CASE WHEN row_class = 'continuation' THEN '' ELSE {LABEL('c0')} END AS label FROM (
    SELECT *, coalesce(max(CASE WHEN row_class IN ('field', 'continuation') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM classed WHERE row_class IN ('field', 'continuation')))) GROUP BY ALL)"""


@query("continuation_merge", f"WITH {TITLED}, {CARRIED}, {CONTENT}, {ROWCLASS}, {ITEMS} SELECT doc_id, section, pos, kind, label, value FROM items", "rows")
def continuation_merge(spark, d):
    return rows.section_items(_content(spark, d)).where("kind = 'field'").select("doc_id", "section", "pos", "kind", "label", "value")


@query("component_latch", f"WITH {TITLED}, {CARRIED}, {CONTENT}, headed AS (SELECT *, pos % 97 = 0 AS is_header FROM content) SELECT doc_id, section, pos, is_header, latched AS in_components, hdr AS component_header FROM (SELECT *, coalesce(max(is_header::INT) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS latched, last_value(CASE WHEN is_header THEN 'Chemical Name | CAS No. | ' || pos || '%' END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hdr FROM headed)", "rows")
def component_latch(spark, d):
    header = F.array(F.lit("Chemical Name "), F.lit("CAS No."), F.concat(F.col("pos").cast("string"), F.lit("%")))
    x = _content(spark, d).withColumn("cells", F.when(F.col("pos") % 97 == 0, header).otherwise(F.col("cells")))
    return rows.component_latch(x).select("doc_id", "section", "pos", "is_header", "in_components", "component_header")


S_SEQ, S_LABEL = SPLIT("label")


@query("unified_rows", f"WITH {TITLED}, {CARRIED}, {CONTENT}, {ROWCLASS}, {ITEMS} SELECT doc_id, section, row_number() OVER w AS ord, (row_number() OVER w - 1)::INT AS idx, kind, {S_SEQ} AS seq, {S_LABEL} AS label, value, {S_LABEL} = '' AS span FROM items WINDOW w AS (PARTITION BY doc_id, section ORDER BY pos)", "rows")
def unified_rows(spark, d):
    # written between the steps: what fields and lines both read is made once, and plans stay small
    content = store.keep(_content(spark, d), "content")
    parts = store.keep(rows.row_items(content), "row-items")
    items = store.keep(rows.attach_items(store.dealt(parts, parts.count(), "doc_id")), "items")
    return blocks.unified_rows(store.dealt(items, items.count(), "doc_id")).select("doc_id", "section", "ord", "idx", "kind", "seq", "label", "value", "span")


@query("split_seq", f"SELECT doc_id, pos, {SPLIT(LABEL('c0'))[0]} AS seq, {SPLIT(LABEL('c0'))[1]} AS label FROM rows_", "rows")
def split_seq(spark, d):
    return A.rows(spark, d).withColumn("s", T.split_seq(T.normalize_label(F.col("c0")))).select("doc_id", "pos", "s.*")


CELL_VIEW = "cells AS (SELECT doc_id, pos, k, CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN CASE WHEN pos % 2 = 0 THEN c1 ELSE c0 END ELSE c0 END AS text FROM rows_, range(4) t(k))"


@query("cell_dedupe", f"""WITH {CELL_VIEW}, once AS (SELECT *, CASE WHEN pos % 3 = 0 AND k >= 2 THEN 't' ELSE 'k' || k END AS tc FROM cells),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, tc ORDER BY k) AS r FROM once) WHERE r = 1),
    kept AS (SELECT * FROM (SELECT doc_id, pos, k, trim(text) AS text, lag(trim(text)) OVER (PARTITION BY doc_id, pos ORDER BY k) AS b FROM firsts) WHERE b IS NULL OR b <> text)
    SELECT doc_id, pos, count(*) AS n, string_agg(text, '|' ORDER BY k) AS cells FROM kept GROUP BY ALL""", "rows")
def cell_dedupe(spark, d):
    x = A.rows(spark, d).select("doc_id", "pos", "c0", "c1", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    text = F.when(F.col("k") == 0, F.col("c0")).when(F.col("k") == 1, F.col("c1")).when((F.col("k") == 2) & (F.col("pos") % 2 == 0), F.col("c1")).otherwise(F.col("c0"))
    x = x.select("doc_id", "pos", "k", text.alias("text"), F.when((F.col("pos") % 3 == 0) & (F.col("k") >= 2), "t").alias("tc"))
    r = rows.cells_to_rows(rows.dedupe_cells(x))
    return r.select("doc_id", "pos", F.size("cells").cast("long").alias("n"), F.array_join("cells", "|").alias("cells"))


@query("auto_numbering", """WITH x AS (SELECT doc_id, pos, (pos * pos % 7 >= 3)::INT AS ilvl FROM rows_),
    g AS (SELECT *, count(*) FILTER (ilvl = 0) OVER w AS tops FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT *, count(*) FILTER (ilvl = 1) OVER (PARTITION BY doc_id, tops ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS subs FROM g)
    SELECT doc_id, pos, CASE WHEN ilvl = 0 THEN '9.' || tops ELSE (tops + 1)::VARCHAR || '.' || CASE WHEN subs > 0 THEN 1 + subs ELSE 1 END END AS number FROM n""", "rows")
def auto_numbering(spark, d):
    p = F.col("pos")
    x = A.rows(spark, d).select("doc_id", "pos", F.lit("1").alias("num_id"), F.when(p * p % 7 >= 3, 1).otherwise(0).alias("ilvl"))
    # of the order lines alone: their documents are known without a second look at the rows made of them
    lists = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit("1").alias("num_id")).distinct()
    levels = lists.select("doc_id", "num_id", F.inline(F.expr("array(named_struct('ilvl', 0, 'start', 1, 'lvl_text', '9.%1'), named_struct('ilvl', 1, 'start', 1, 'lvl_text', '%1.%2'))")))
    return auto_numbers(x, levels).select("doc_id", "pos", "number")


# ---- text blocks ----

HEAD = f"(NOT (t IN ({quoted(X.NOT_HEADINGS)}) OR starts_with(t, '[象形图]') OR regexp_matches(t, '^[A-Za-z]{{1,8}}[-\\s\\p{{Z}}]?\\p{{Nd}}|^\\p{{Nd}}+[A-Za-z]|[。.！？!?]$')) AND length(t) <= 15)"
STRIPPED = f"stripped AS (SELECT doc_id, pos, trim(line, {WHITE}) AS t FROM lines WHERE trim(line, {WHITE}) <> '')"


@query("heading_lines", f"WITH {STRIPPED} SELECT doc_id, pos, t FROM stripped WHERE {HEAD}", "lines")
def heading_lines(spark, d):
    t = T.strip(F.col("line"))
    return A.lines(spark, d).select("doc_id", "pos", t.alias("t")).where((F.col("t") != "") & T.is_heading(F.col("t")))


END_RE, INLINE_RE = r"^(.+?)[：:][\s\p{Z}]*$", r"^(.+?)[：:][\s\p{Z}]*(.*)$"
UNITS = f"""{STRIPPED}, near AS (SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS n FROM stripped WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    c AS (SELECT *, CASE WHEN regexp_matches(t, '^\\s*[HP]\\s*\\p{{Nd}}{{3}}') THEN 'C' WHEN regexp_matches(t, '^[一-鿿][：:]$') THEN 'T' WHEN regexp_matches(t, '{END_RE}') THEN 'P'
        WHEN regexp_matches(t, '{INLINE_RE}') AND trim(regexp_extract(t, '{INLINE_RE}', 1), {WHITE}) <> '' AND NOT regexp_matches(trim(regexp_extract(t, '{INLINE_RE}', 1), {WHITE}), '^\\p{{Nd}}{{2,}}') THEN 'F'
        WHEN regexp_matches(t, '^\\p{{Nd}}+\\.\\p{{Nd}}+[\\s\\p{{Z}}]*[^\\s\\p{{Z}}]+') THEN 'S' WHEN regexp_matches(t, '^\\p{{Nd}}{{2,}}[\\s\\p{{Z}}]*[^\\s\\p{{Z}}]') THEN 'C'
        WHEN {HEAD} AND regexp_matches(coalesce(b, ''), '{END_RE}') THEN 'CP'
        WHEN {HEAD} AND regexp_matches(coalesce(n, ''), '{END_RE}') AND NOT contains(trim(regexp_extract(n, '{END_RE}', 1), {WHITE}), t) THEN 'CP'
        WHEN {HEAD} THEN 'P' ELSE 'C' END AS cls FROM near),
    a AS (SELECT *, last_value(CASE WHEN cls IN ('F', 'P', 'S') THEN pos END IGNORE NULLS) OVER w AS ap, last_value(CASE WHEN cls IN ('F', 'P', 'S') THEN cls END IGNORE NULLS) OVER w AS ac
        FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    j AS (SELECT *, (ac = 'P' AND cls IN ('C', 'CP')) OR (ac = 'F' AND cls = 'C' AND coalesce(max((cls = 'CP')::INT) OVER (PARTITION BY doc_id, ap ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) = 0) AS joins FROM a WHERE cls <> 'T'),
    u AS (SELECT doc_id, CASE WHEN joins THEN ap ELSE pos END AS unit, arg_min(cls, pos) AS cls, arg_min(t, pos) AS t, string_agg(t, chr(10) ORDER BY pos) FILTER (joins) AS body FROM j GROUP BY ALL),
    l AS (SELECT *, CASE cls WHEN 'P' THEN CASE WHEN regexp_matches(t, '{END_RE}') THEN trim(regexp_extract(t, '{END_RE}', 1), {WHITE}) ELSE t END WHEN 'F' THEN trim(regexp_extract(t, '{INLINE_RE}', 1), {WHITE}) WHEN 'S' THEN t ELSE '' END AS lab FROM u)"""
UNIT_SEQ = r"^(\p{Nd}+(?:\.\p{Nd}+)*)\.?[\s\p{Z}]*([一-鿿A-Za-z].*)$"


@query("text_block_units", f"""WITH {UNITS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS ord, CASE cls WHEN 'S' THEN 'sub' WHEN 'P' THEN 'field' WHEN 'F' THEN 'field' ELSE 'note' END AS kind,
    CASE WHEN regexp_matches(lab, '{UNIT_SEQ}') THEN regexp_extract(lab, '{UNIT_SEQ}', 1) ELSE '' END AS seq, CASE WHEN regexp_matches(lab, '{UNIT_SEQ}') THEN trim(regexp_extract(lab, '{UNIT_SEQ}', 2), {WHITE}) ELSE lab END AS label,
    CASE cls WHEN 'P' THEN coalesce(body, '') WHEN 'F' THEN trim(concat_ws(chr(10), trim(regexp_extract(t, '{INLINE_RE}', 2), {WHITE}), body), {WHITE}) WHEN 'S' THEN '' ELSE t END AS value FROM l""", "lines")
def text_block_units(spark, d):
    return blocks.text_block_units(A.lines(spark, d).withColumn("bold", F.lit(False)), ["doc_id"]).select("doc_id", "ord", "kind", "seq", "label", "value")


CLASS_RE = r"^([^\s\p{Z}].*?)[\s\p{Z}]{2,}(未分类|类别[\s\p{Z}]*\p{Nd}+(?:[A-Z])?|\p{Nd}+(?:[A-Z]?B?类))[\s\p{Z}]*[。.]?[\s\p{Z}]*$"


@query("class_rows", f"WITH x AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN trim(line, {WHITE}) || '   ' || (pos % 5) || 'B类。' ELSE line END AS line FROM lines), s AS (SELECT doc_id, pos, trim(line, {WHITE}) AS t FROM x) SELECT doc_id, pos, trim(regexp_extract(t, '{CLASS_RE}', 1), {WHITE}) AS name, regexp_extract(t, '{CLASS_RE}', 2) AS category FROM s WHERE regexp_matches(t, '{CLASS_RE}')", "lines")
def class_rows(spark, d):
    line = F.when(F.col("pos") % 3 == 0, F.concat(T.strip(F.col("line")), F.lit("   "), (F.col("pos") % 5).cast("string"), F.lit("B类。"))).otherwise(F.col("line"))
    return A.lines(spark, d).withColumn("c", T.class_row(line)).where("c.name is not null").select("doc_id", "pos", "c.name", "c.category")


SHAPED = "v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '±2%' WHEN 1 THEN p_name WHEN 2 THEN '约' || p_size || ' °C' WHEN 3 THEN p_size || '.1 ' || p_type WHEN 4 THEN 'EN ' || p_size ELSE '乳白色液体' END AS t FROM part)"


@query("value_shape", f"""WITH {SHAPED} SELECT p_partkey, t, NOT (t = '' OR length(t) > 24 OR regexp_matches(t, '[：:]') OR {" OR ".join(f"contains(t, '{w}')" for w in X.FIELD_WORDS)} OR regexp_matches(t, '^\\d+\\.\\d+\\s+\\S') OR regexp_matches(t, '^\\d+\\.\\d+\\s*[A-Za-z][A-Za-z0-9\\-]+[A-Za-z]$'))
    AND (regexp_matches(t, '^[-−+±＞≥≤<>]?\\s*\\d') OR (regexp_matches(t, '\\d\\s*(%|％|℃|°C|°F)') AND length(t) <= 12) OR t = '乳白色液体' OR regexp_matches(t, '^[A-Z]{{1,6}}[-\\s]?\\d')) AS is_value FROM v""")
def value_shape(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    t = F.when(k % 6 == 0, F.concat(s, F.lit("±2%"))).when(k % 6 == 1, F.col("p_name")).when(k % 6 == 2, F.concat(F.lit("约"), s, F.lit(" °C"))).when(k % 6 == 3, F.concat(s, F.lit(".1 "), "p_type")).when(k % 6 == 4, F.concat(F.lit("EN "), s)).otherwise("乳白色液体")
    return A.table(spark, d, "part").select("p_partkey", t.alias("t")).withColumn("is_value", T.is_value_shape(F.col("t")))


# ---- ingredients ----


@query("component_split", f"WITH {SPLITTED} SELECT doc_id, idx, name, cas, conc, raw_name, raw_cas, raw_conc FROM parts", "component_cells")
def component_split(spark, d):
    return components.split_cells(A.component_cells(spark, d))


@query("component_extract", f"""WITH {SPLITTED}, free AS (SELECT doc_id, idx, raw_name || ' ' || cas || ' ' || replace(conc, '~', ' - ') AS line FROM parts),
    one AS (SELECT *, CASE WHEN contains(line, '商业机密') THEN '商业机密' ELSE regexp_extract(line, '\\b(\\d{{2,7}}-\\d{{2}}-\\d)\\b', 1) END AS found FROM free),
    two AS (SELECT *, CASE WHEN found = '' THEN line ELSE left(line, instr(line, found) - 1) || ' ' || substr(line, instr(line, found) + length(found)) END AS rest FROM one WHERE found <> ''),
    three AS (SELECT *, regexp_extract(rest, '([<>]?\\s*\\d+\\s*-\\s*\\d+\\s*%?)', 1) AS c FROM two)
    SELECT doc_id, idx, trim(regexp_replace(left(rest, instr(rest, c) - 1) || ' ' || substr(rest, instr(rest, c) + length(c)), '\\s+', ' ', 'g')) AS name, found AS cas, replace(c, ' ', '') AS conc FROM three""", "component_cells")
def component_extract(spark, d):
    x = components.split_cells(A.component_cells(spark, d))
    line = F.concat_ws(" ", "raw_name", "cas", F.replace("conc", F.lit("~"), F.lit(" - ")))
    return x.select("doc_id", "idx", T.component_of_text(line).alias("c")).where("c is not null").select("doc_id", "idx", "c.*")


@query("component_expand", f"WITH {SPLITTED} SELECT doc_id, '成分' || (idx + 1) || s AS label, CASE s WHEN '名称' THEN name WHEN 'CAS' THEN cas ELSE conc END AS value FROM parts, (VALUES ('名称'), ('CAS'), ('含量')) t(s)", "component_cells")
def component_expand(spark, d):
    return components.expand(components.split_cells(A.component_cells(spark, d)).withColumn("section", F.lit(3))).select("doc_id", "label", "value")


@query("promote_if_empty", f"""WITH {SPLITTED}, real AS (SELECT doc_id, idx, name, cas, conc FROM parts WHERE doc_id % 3 <> 0), cand AS (SELECT doc_id, raw_name AS name, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx FROM parts)
    SELECT doc_id, idx, name, cas, conc FROM real UNION ALL SELECT doc_id, idx::INT, name, '', '20±1%' FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM real)""", "component_cells")
def promote_if_empty(spark, d):
    # written once: ingredients, the sections that have some and the candidates are all made of it
    x = store.keep(components.split_cells(A.component_cells(spark, d)).select("doc_id", "idx", "name", "cas", "conc", "raw_name").withColumn("section", F.lit(3)), "promotion-cells")
    c = x.withColumn("m", T.mixture_row(F.concat(F.lit("· Description: "), "raw_name", F.lit(" 20±1% /")))).select("doc_id", "section", F.col("idx").alias("pos"), F.lit(0).alias("k"), "m.*")
    return components.promote_if_empty(x.where("doc_id % 3 <> 0"), c).select("doc_id", "idx", "name", "cas", "conc")


FLATTED = "SELECT doc_id, 0 AS pos, 'About' || chr(9) || 'mix' || chr(10) || 'Chemical Name' || chr(9) || 'CAS No.' || chr(9) || '%' || chr(10) || list_aggregate(list_transform(range(1, len(string_split(name_cell, chr(10))) + 1), lambda i: string_split(name_cell, chr(10))[i] || chr(9) || string_split(cas_cell, chr(10))[i] || chr(9) || string_split(conc_cell, chr(10))[i]), 'string_agg', chr(10)) AS text FROM component_cells"


@query("flat_component_tables", f"""WITH flat AS ({FLATTED}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM flat),
    p AS (SELECT *, CASE WHEN i = 0 THEN 'pre' WHEN i = 1 THEN 'header' WHEN contains(line, '商业机密') OR regexp_matches(line, '\\b\\d{{2,7}}-\\d{{2}}-\\d\\b') THEN 'component' ELSE 'post' END AS part FROM l)
    SELECT doc_id, part, count(*) AS n, sum(i)::BIGINT AS places FROM p WHERE doc_id IN (SELECT doc_id FROM p WHERE part = 'component') GROUP BY ALL""", "component_cells")
def flat_component_tables(spark, d):
    zipped = F.arrays_zip(*[F.split(c, "\n").alias(c) for c in ("name_cell", "cas_cell", "conc_cell")])
    body = F.array_join(F.transform(zipped, lambda z: F.concat_ws("\t", z["name_cell"], z["cas_cell"], z["conc_cell"])), "\n")
    cells = A.component_cells(spark, d).select("doc_id", F.lit(0).alias("pos"), F.concat(F.lit("About\tmix\nChemical Name\tCAS No.\t%\n"), body).alias("text"))
    return components.flat_tables(cells).groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


@query("stacked_component_tables", f"WITH {SPLITTED} SELECT doc_id, (idx + 1)::INT AS i, raw_name AS name, raw_cas AS cas, raw_conc AS conc FROM parts", "component_cells")
def stacked_component_tables(spark, d):
    cells = A.component_cells(spark, d)
    head = lambda h, c: F.concat(F.lit(f"{h}\n"), F.col(c))
    x = cells.select("doc_id", F.lit(0).alias("pos"), F.array(head("Chemicals 名称", "name_cell"), head("CAS NO.", "cas_cell"), head("Content%（w/w）", "conc_cell")).alias("cells"))
    return components.stacked_tables(x).select("doc_id", "i", "name", "cas", "conc")


@query("fullwidth_stats", "SELECT doc_id, (len(string_split(name_cell, chr(10))) - 1)::BIGINT AS n_split, (regexp_matches(name_cell || cas_cell || conc_cell, '[＞＜～％－（），；：]'))::BIGINT AS n_full_width FROM component_cells", "component_cells")
def fullwidth_stats(spark, d):
    return quality.component_stats(A.component_cells(spark, d))


# ---- pivot ----


@query("pivot_columns", f"WITH {PIVOTED}, {COLUMNS} SELECT section, kind, norm_label, seq, col_ord FROM columns_", "entries")
def pivot_columns(spark, d):
    return pivot.pivot_columns(pivot.pivot_input(A.entries(spark, d)))


@query("pivot_head", f"WITH {PIVOTED}, {COLUMNS} SELECT section, col_ord, section::VARCHAR || '.节' AS section_title, concat_ws(' ', nullif(seq, ''), norm_label) AS head, kind FROM columns_", "entries")
def pivot_head(spark, d):
    e = A.entries(spark, d)
    s = e.select("doc_id", "section", F.col("big_title").alias("full_title")).distinct()
    return pivot.pivot_head(pivot.pivot_columns(pivot.pivot_input(e)), s)


@query("pivot_cells", f"WITH {PIVOTED}, {COLUMNS}, {CELLS}, docs AS (SELECT DISTINCT doc_id FROM entries) SELECT doc_id, section, kind, norm_label, CASE WHEN coalesce(value, '') = '' AND section = 9 AND kind = 'field' THEN '无数据' ELSE coalesce(value, '') END AS value FROM docs CROSS JOIN columns_ LEFT JOIN cells USING (doc_id, section, kind, norm_label)", "entries")
def pivot_cells(spark, d):
    e = A.entries(spark, d)
    p = pivot.pivot_input(e)
    return pivot.pivot_grid(e, pivot.pivot_columns(p), pivot.pivot_cells(p))


@query("pivot_slices", ORACLE_SQL["pivot_cells"])
def pivot_slices(spark, d):
    e, path = A.entries(spark, d), store.new_path(spark, "pivot-slices")
    p = pivot.pivot_input(e)
    # all columns, in several wide tables, read back into the long form
    named = pivot.write_slices(e, pivot.pivot_columns(p), pivot.pivot_cells(p), path, 24)
    wide = [spark.read.parquet(f"{path}/cells/slice={k}") for k in range(named.agg(F.max("slice")).first()[0] + 1)]
    long = reduce(DataFrame.unionAll, [t.unpivot("doc_id", None, "name", "value") for t in wide])
    return long.join(named.select("name", "section", "kind", "norm_label"), "name").drop("name")


MOST_ENTRIES = "mine AS (SELECT * FROM entries WHERE doc_id = (SELECT doc_id FROM entries GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 1))"
OF_MINE = lambda sql: sql.replace("FROM entries", "FROM mine")


@query("single_pivot", f"WITH {MOST_ENTRIES}, {OF_MINE(PIVOTED)}, {COLUMNS}, {CELLS}, docs AS (SELECT DISTINCT doc_id FROM mine) SELECT doc_id, section || '_' || norm_label AS name, CASE WHEN coalesce(value, '') = '' AND section = 9 AND kind = 'field' THEN '无数据' ELSE coalesce(value, '') END AS value FROM docs CROSS JOIN columns_ LEFT JOIN cells USING (doc_id, section, kind, norm_label)", "entries")
def single_pivot(spark, d):
    e = A.entries(spark, d)
    # of all documents the one with the most entries
    most = e.groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").first()
    if most is None:
        return e.select("doc_id", F.lit("").alias("name"), "value")
    wide, _ = pivot.single_pivot(e, e, most.doc_id)
    return wide.unpivot("doc_id", None, "name", "value")


WIDE = [(s, x) for s in (1, 9) for x in ("click", "view", "purchase")]


@query("pivot_wide", f"WITH {PIVOTED}, {CELLS}, docs AS (SELECT DISTINCT doc_id FROM entries) SELECT doc_id, " + ", ".join(f"coalesce(nullif(max(value) FILTER (section = {s} AND norm_label = '{x}'), ''), '{'无数据' if s == 9 else ''}') AS \"{s}_{x}\"" for s, x in WIDE) + " FROM docs LEFT JOIN cells USING (doc_id) GROUP BY doc_id", "entries")
def pivot_wide(spark, d):
    e = A.entries(spark, d)
    p = pivot.pivot_input(e)
    return pivot.pivot_wide(e, pivot.pivot_cells(p), [(s, "field", x) for s, x in WIDE])


@query("pivot_notes", "SELECT doc_id, section, coalesce(string_agg(value, chr(10) ORDER BY pos) FILTER (value <> ''), '') AS value FROM entries WHERE kind = 'note' GROUP BY ALL", "entries")
def pivot_notes(spark, d):
    return pivot.pivot_cells(pivot.pivot_input(A.entries(spark, d))).where("kind = 'note'").select("doc_id", "section", "value")


@query("row_key", "WITH docs AS (SELECT DISTINCT doc_id FROM entries), f AS (SELECT doc_id, arg_min(value, pos) AS v FROM entries WHERE section = 1 AND kind = 'field' AND label = 'click' AND value <> '' GROUP BY doc_id) SELECT doc_id, coalesce(v, 'doc-' || doc_id) AS row_key FROM docs LEFT JOIN f USING (doc_id)", "entries")
def row_key(spark, d):
    e = A.entries(spark, d)
    docs = e.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(" v2.docx")).alias("file_name")).distinct()
    return pivot.row_keys(docs, e, 1, "click")


@query("pivot_stats", f"WITH {PIVOTED}, {COLUMNS} SELECT (SELECT count(DISTINCT doc_id) FROM entries) AS files, count(*) AS columns, (SELECT count(DISTINCT doc_id) FROM entries) AS rows, count(DISTINCT section) AS sections, 0::BIGINT AS failed FROM columns_", "entries")
def pivot_stats(spark, d):
    e = A.entries(spark, d)
    return pivot.pivot_stats(e, pivot.pivot_columns(pivot.pivot_input(e)))


# ---- quality and annotations ----


@query("number_gaps", """WITH o AS (SELECT DISTINCT doc_id FROM entries WHERE section = 9 AND seq <> '' AND doc_id % 7 = 0),
    n AS (SELECT doc_id, split_part(seq, '.', 2)::BIGINT * (1 + pos % 2) AS n FROM entries WHERE section = 9 AND seq <> '' UNION SELECT doc_id, unnest([2000000000, 99999999999]) FROM o),
    g AS (SELECT doc_id, n + 1 AS a, lead(n) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS b FROM n)
    SELECT doc_id, string_agg(CASE WHEN b - a < 100 THEN array_to_string(list_transform(range(a, least(b, a + 99) + 1), lambda k: '9.' || k), ', ') ELSE '9.' || a || '-9.' || b END, ', ' ORDER BY a) AS missing
    FROM g WHERE b >= a GROUP BY doc_id""", "entries")
def number_gaps(spark, d):
    e = A.entries(spark, d).where("section = 9 and seq <> ''")
    n = F.substring_index("seq", ".", -1).cast("int") * (1 + F.col("pos") % 2)
    labels = e.select("doc_id", F.concat(F.lit("9."), n.cast("string"), F.lit(" "), "label").alias("label"))
    # and two numbers far away in one label
    return quality.number_gaps(labels.unionByName(e.where("doc_id % 7 = 0").select("doc_id", F.lit("9.2000000000 a\n9.99999999999 b").alias("label"))))


@query("missing_sections", "WITH s AS (SELECT DISTINCT doc_id, section FROM entries WHERE section % 5 <> doc_id % 5) SELECT d.doc_id, k::INT AS section FROM (SELECT DISTINCT doc_id FROM entries) d, range(1, 17) t(k) WHERE (d.doc_id, k) NOT IN (SELECT doc_id, section FROM s)", "entries")
def missing_sections(spark, d):
    e = A.entries(spark, d)
    return quality.missing_sections(e, e.where("section % 5 <> doc_id % 5"))


@query("doc_summary", f"WITH {TITLED}, {CARRIED}, {CONTENT}, {ROWCLASS}, {ITEMS} SELECT doc_id, count(DISTINCT section) AS n_sections, count(*) AS n_fields, 0::BIGINT AS n_lines, count(*) FILTER (section = 3) AS n_components, 16 - count(DISTINCT section) AS n_anomalies FROM items GROUP BY doc_id", "rows")
def doc_summary(spark, d):
    # written once: documents, fields, ingredients and anomalies are all counted from it
    items = store.keep(rows.section_items(_content(spark, d)).select("doc_id", "section", "kind"), "summary-items")
    # the fields of section 3 as ingredients, the sections that a document lacks as anomalies
    return quality.document_summary(items, items, items.where("section = 3"), quality.missing_sections(items, items))


@query("anomaly_digest", "WITH a AS (SELECT DISTINCT d.doc_id, k::INT AS section FROM (SELECT DISTINCT doc_id FROM entries) d, range(1, 17) t(k) WHERE k % 5 <> d.doc_id % 4) SELECT doc_id, section, n, greatest(total - 12, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section)::INT AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM a) WHERE n <= 12", "entries")
def anomaly_digest(spark, d):
    docs = A.entries(spark, d).select("doc_id").distinct()
    found = quality.missing_sections(docs, docs.withColumn("section", F.explode(F.sequence(F.lit(1), F.lit(16)))).where("section % 5 = doc_id % 4"))
    return quality.anomaly_digest(found, "section").select("doc_id", "section", "n", "more")


@query("editable_override", """WITH r AS (SELECT doc_id, section, kind, (row_number() OVER (PARTITION BY doc_id, section, kind ORDER BY pos) - 1)::INT AS idx, pos, kind <> 'sub' AS editable FROM entries),
    o AS (SELECT doc_id, section, kind, (idx // 2) AS idx, arg_max(pos % 3 = 0, pos) AS o FROM r WHERE pos % 7 < 3 GROUP BY ALL) SELECT r.doc_id, r.pos, coalesce(o.o, r.editable) AS editable FROM r LEFT JOIN o USING (doc_id, section, kind, idx)""", "entries")
def editable_override(spark, d):
    idx = F.row_number().over(Window.partitionBy("doc_id", "section", "kind").orderBy("pos")) - 1
    r = quality.default_editable(A.entries(spark, d).withColumn("idx", idx)).select("doc_id", "section", "kind", "idx", "pos", "editable")
    o = r.where("pos % 7 < 3").select("doc_id", "section", "kind", F.floor(F.col("idx") / 2).cast("int").alias("idx"), (F.col("pos") % 3 == 0).alias("editable"), F.col("pos").alias("at"))
    return quality.apply_overrides(r, o).select("doc_id", "pos", "editable")


@query("image_allocation", """WITH p AS (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS lo, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS hi
        FROM (SELECT doc_id, pos, CASE WHEN tag = 'footer' THEN 99999999999 WHEN tag = 'p' THEN pos % 4 WHEN tag = 'h1' THEN 1 ELSE 0 END AS n FROM paragraphs) WHERE n > 0),
    i AS (SELECT doc_id, pos + k AS ord, row_number() OVER (PARTITION BY doc_id ORDER BY pos + k) - 1 AS nth FROM paragraphs, (SELECT unnest([0.0, 0.5]) AS k))
    SELECT i.doc_id, i.ord::DOUBLE AS ord, i.nth::INT AS nth, p.pos AS place FROM i LEFT JOIN p ON i.doc_id = p.doc_id AND i.nth >= p.lo AND i.nth < p.hi""", "paragraphs")
def image_allocation(spark, d):
    p = A.paragraphs(spark, d).withColumn("section", F.lit(2))
    of = lambda n: F.concat(F.lit("[象形图×"), n.cast("string"), F.lit("]"))
    mark = F.when(F.col("tag") == "footer", of(F.lit(99999999999))).when(F.col("tag") == "p", of(F.col("pos") % 4)).when(F.col("tag") == "h1", "[象形图]").otherwise("")
    images = p.select("doc_id", "section", "pos", F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("k")).select("doc_id", "section", (F.col("pos") + F.col("k")).cast("double").alias("ord"))
    return quality.allocate_images(p.withColumn("text", mark), images).select("doc_id", "ord", "nth", "place")


# ---- pages and fingerprints ----


SIDES = lambda sep: (f"trim(split_part(t, '{sep}', 1), {WHITE})", f"trim(substr(t, instr(t, '{sep}') + 1), {WHITE})")
PARTED = lambda sep: f"(contains(t, '{sep}') AND {SIDES(sep)[0]} <> '' AND {SIDES(sep)[1]} <> '')"
PAGE_SPACE = "\\s\\x0B\\p{Z}"
PAGE_COMPOUND = f"^([^A-Za-z0-9][^A-Za-z0-9{PAGE_SPACE}]*)[{PAGE_SPACE}]+([A-Za-z][\\w\\-]*[-_][A-Za-z0-9][\\w\\-]*)$"


@query("page_footer_fields", f"""WITH f AS (SELECT doc_id, pos, trim(text, {WHITE}) AS t FROM paragraphs WHERE tag IN ('footer', 'title')),
    s AS (SELECT *, {PARTED('：')} AS wide, {PARTED(':')} AS narrow, regexp_matches(t, '^\\p{{Nd}}+[{PAGE_SPACE}]*/[{PAGE_SPACE}]*\\p{{Nd}}+$') AS numbered, regexp_matches(t, '{PAGE_COMPOUND}') AS compound FROM f WHERE t <> ''),
    l AS (SELECT doc_id, pos, CASE WHEN wide THEN {SIDES('：')[0]} WHEN narrow THEN {SIDES(':')[0]} ELSE t END AS label, CASE WHEN wide THEN {SIDES('：')[1]} WHEN narrow THEN {SIDES(':')[1]} ELSE '' END AS value
        FROM s WHERE NOT numbered AND (wide OR narrow OR NOT compound))
    SELECT doc_id, pos, CASE WHEN regexp_matches(label, '^[PFD]\\p{{L}}') AND NOT regexp_matches(label, '^.[\\x00-\\x7F]') THEN substr(label, 2) ELSE label END AS label, value FROM l
    UNION ALL SELECT doc_id, pos, '页码', t FROM s WHERE numbered
    UNION ALL SELECT doc_id, pos, unnest(['公司名称', '产品型号']), unnest([trim(regexp_extract(t, '{PAGE_COMPOUND}', 1), {WHITE}), trim(regexp_extract(t, '{PAGE_COMPOUND}', 2), {WHITE})]) FROM s WHERE compound AND NOT numbered AND NOT wide AND NOT narrow""", "paragraphs")
def page_footer_fields(spark, d):
    f = A.paragraphs(spark, d).where(F.col("tag").isin("footer", "title"))
    return f.select("doc_id", "pos", F.inline(T.page_fields(F.col("text")))).select("doc_id", "pos", "label", "value")


@query("page_paragraphs", "SELECT doc_id, pos, tag, text, bold FROM paragraphs", "paragraphs")
def page_paragraphs(spark, d):
    return A.paragraphs(spark, d).select("doc_id", "pos", "tag", "text", "bold")


@query("page_links", """WITH l AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT doc_id, href, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, d):
    return A.paragraphs(spark, d).select("doc_id", F.explode("links").alias("href")).groupBy("doc_id", "href").agg(F.count("*").alias("n"))


@query("page_story", f"SELECT doc_id, coalesce(string_agg(trim(text, {WHITE}), chr(10) ORDER BY pos) FILTER (trim(text, {WHITE}) <> ''), '') AS story FROM paragraphs GROUP BY doc_id", "paragraphs")
def page_story(spark, d):
    return pages.story(A.paragraphs(spark, d))


@query("fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


from . import package_queries, row_queries  # noqa: E402, F401  (they register their queries, and need the pieces above)
