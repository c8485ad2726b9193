"""Rows of a section to fields and lines. rows: doc_id, section, pos, cells array<string>, bold0 boolean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .scan import carried

ITEM = "array<struct<kind:string,label:string,value:string>>"


def dedupe_cells(cells: DataFrame) -> DataFrame:
    """cells (doc_id, pos, k, tc, text): a merged cell (tc) once, then no cell equal to the one before it in its row."""
    # stripped before the windows, where each text is met once
    cells = cells.withColumn("text", T.strip(T.text(F.col("text"))))
    once = cells.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "pos", F.coalesce("tc", F.concat(F.lit("k"), "k"))).orderBy("k"))).where("_first = 1").drop("_first")
    before = F.lag("text").over(Window.partitionBy("doc_id", "pos").orderBy("k"))
    return once.withColumn("_same", F.col("text").eqNullSafe(before)).where("not _same").drop("_same")


def cells_to_rows(cells: DataFrame, *also: Column) -> DataFrame:
    """One row per pos with the array of its cells in order, and other aggregates of them."""
    return cells.groupBy("doc_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("cells"), *also)


def classify(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_class", T.row_class(F.col("cells"), F.coalesce(F.col("bold0"), F.lit(False))))


def _numbered_parts(label):
    """Lines of a label, broken again before each further N.N number."""
    lines = F.split(label, "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?=\p{Nd}{1,2}\.\p{Nd}{1,2}(?:[\s\p{Z}]+|[.、．：:][一-鿿A-Za-z]|[一-鿿]))")))
    # a digit of a two-digit number may not begin a part of its own
    return F.filter(parts, lambda x: T.strip(x) != "")


def _with_field_items(rows: DataFrame) -> DataFrame:
    """rows (with _first and _rest) with _items, the fields of a field row: by tab, by numbers, by stacked labels, a one-character rest, or plain.

    Each step is a column of its own: what several later steps read is worked out once.
    """
    first = F.col("_first")
    tail = F.when(F.instr(first, "\t") > 0, T.strip(F.substring(first, F.instr(first, "\t") + 1, F.length(first)))).otherwise("")
    x = rows.withColumns({"_tail": tail, "_value": T.strip(F.array_join("_rest", " / "))})
    tabbed = F.col("_tail") != ""
    x = x.withColumns({"_label": F.when(tabbed, F.substring_index(first, "\t", 1)).otherwise(first), "_value": F.when(tabbed, F.btrim(F.concat("_tail", F.lit(" / "), "_value"), F.lit(" /"))).otherwise(F.col("_value"))})
    x = x.withColumns({"_parts": _numbered_parts(F.col("_label")), "_values": F.split("_value", "\n"), "_name": T.normalize_label(F.col("_label"))})
    x = with_stacked(x)
    struct = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("label"), b.alias("value"))
    numbered = (F.size("_parts") > 1) & F.forall("_parts", lambda x: x.rlike(r"^[\s\p{Z}]*\p{Nd}+\.\p{Nd}+[\s\p{Z}]*[^\s\p{Z}]"))
    by_number = F.transform("_parts", lambda x, i: struct("field", T.normalize_label(x), T.strip(F.coalesce(F.get("_values", i), F.lit("")))))
    residue = (F.length("_name") <= 1) & ~T.is_value_shape(F.col("_name"))
    left = F.when(F.col("_value") != "", F.array(struct("append?", F.lit(""), F.col("_value")))).otherwise(F.array().cast(ITEM))
    items = (
        F.when(numbered, by_number).when(F.col("_stacked").isNotNull(), F.transform("_stacked", lambda s: struct("field", T.normalize_label(s["label"]), s["value"])))
        .when(residue, left).otherwise(F.array(struct("field", F.col("_name"), F.col("_value"))))
    )
    return x.withColumn("_items", items)


def with_stacked(rows: DataFrame) -> DataFrame:
    """rows (with _label and _value) with _stacked, array<struct(label, value)> of a row of stacked labels and values, null for any other row.

    Three labels or more, two values or more, their numbers within one. Bullets without a number go to the value of the
    label before them; values that are left over go to the last label.
    """
    clean = lambda c: F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != "")
    bullet = lambda x: x.rlike(r"^[·•\-]") & ~x.rlike(r"^[·•\-][\s\p{Z}]*\p{Nd}+(?:\.\p{Nd}+)?[\s\p{Z}]*[^\s\p{Z}]")
    keep = lambda x: ~bullet(x) & (F.length(x) > 1)
    x = rows.withColumns({"_lines": clean("_label"), "_vals": clean("_value")})
    # the place of each tag, and one past the last line: a tag's bullets lie before the next tag
    at = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: keep(F.get("_lines", i)))
    x = x.withColumn("_at", F.when((F.size("_lines") >= 3) & (F.size("_vals") >= 2), at))
    n = F.size("_at")
    over = F.array_join(F.slice("_vals", n + 1, F.greatest(F.size("_vals") - n, F.lit(0))), "\n")
    x = x.withColumn("_over", F.when(F.col("_at").isNotNull(), over))

    def entry(i, k):
        end = F.coalesce(F.get("_at", k + 1), F.size("_lines"))
        bullets = F.filter(F.slice("_lines", i + 2, end - i - 1), bullet)
        text = F.concat_ws("\n", F.nullif(F.coalesce(F.get("_vals", k), F.lit("")), F.lit("")), bullets, F.when(k == F.size("_at") - 1, F.nullif("_over", F.lit(""))))
        return F.struct(T.strip(F.regexp_replace(F.get("_lines", i), r"^[·•\-][\s\p{Z}]*", "")).alias("label"), T.strip(text).alias("value"))

    fits = (n >= 3) & (F.abs(n - F.size("_vals")) <= 1)
    return x.withColumn("_stacked", F.when(F.col("_at").isNotNull() & fits, F.transform("_at", entry)))


def row_items(rows: DataFrame) -> DataFrame:
    """Items of rows before they meet: doc_id, section, pos, sub (place in the row), kind (field, line, append, append?), label, value, bold.

    bold has a flag for each line of the value of a single-cell row: from bold_lines (those of its first cell) where the
    rows have it, else bold0 for all.
    """
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    first = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    x = _with_field_items(classify(rows).withColumns({"_first": first, "_rest": rest}))
    filled = lambda a: F.filter(a, lambda c: T.strip(c) != "")
    item = lambda k, a, b: F.array(F.struct(F.lit(k).alias("kind"), a.alias("label"), b.alias("value")))
    none = F.lit("")
    items = (
        F.when(F.col("row_class") == "continuation", item("append", none, T.strip(F.array_join(F.transform(filled(F.col("_rest")), T.strip), " / "))))
        .when(F.col("row_class").isin("line", "sub"), item("line", none, F.col("_first"))).when(F.col("row_class") == "field", F.col("_items"))
        .when(F.col("row_class") == "joined", item("line", none, F.array_join(filled(F.col("cells")), " / "))).otherwise(F.array().cast(ITEM))
    )
    flags = F.array_repeat(F.coalesce("bold0", F.lit(False)), F.size(F.split("_first", "\n")))
    flags = F.coalesce("bold_lines", flags) if "bold_lines" in rows.columns else flags
    bold = F.when(F.col("row_class") == "line", flags).otherwise(F.array().cast("array<boolean>"))
    return x.select("doc_id", "section", "pos", bold.alias("bold"), F.posexplode(items).alias("sub", "i")).select("doc_id", "section", "pos", "sub", "i.*", "bold")


def attach_items(items: DataFrame) -> DataFrame:
    """Items of a section from all sources, in order of pos and sub, with continuations in the latest field before them.

    A continuation without a field before it is a field without label, or (append?) a line.
    """
    of, order, kind = ["doc_id", "section"], ["pos", "sub"], F.col("kind")
    x = carried(items, of, order, {"_had": F.when(kind.isin("field", "append"), True)}, own=False)
    none = F.col("_had").isNull()
    x = x.withColumns({"kind": F.when((kind == "append") & none, "field").when((kind == "append?") & none, "line").when(kind == "append?", "append").otherwise(kind), "place": F.struct("pos", "sub")})
    x = carried(x, of, order, {"_field": F.when(kind == "field", F.col("place"))})
    anchor = F.when(kind == "append", F.col("_field")).otherwise(F.col("place"))
    parts = F.array_sort(F.collect_list(F.struct("place", "kind", "label", "value", "bold")))
    g = x.withColumn("anchor", anchor).groupBy("doc_id", "section", "anchor").agg(parts.alias("p"))
    value = F.array_join(F.filter(F.transform("p", lambda s: s["value"]), lambda v: v != ""), "\n")
    first = F.get("p", F.lit(0))
    return g.select("doc_id", "section", "anchor.*", first["kind"].alias("kind"), first["label"].alias("label"), value.alias("value"), first["bold"].alias("bold"))


def section_items(rows: DataFrame) -> DataFrame:
    """doc_id, section, pos, sub, kind (field or line), label, value, bold, in document order of pos and sub.

    A blank first cell continues the latest field of the section, across lines; without one it is a field without label.
    A one-character label's value goes to the latest field, else it is a line.
    """
    return attach_items(row_items(rows))


def component_latch(rows: DataFrame) -> DataFrame:
    """rows with is_header, in_components (a latching row was before it in its section) and component_header (the last header row's cells).

    Latching rows: a caption alone, a whole table in one cell, a column-stacked table, a header row.
    """
    c0 = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    caption = (F.size("cells") <= 2) & F.rtrim(c0, F.lit(" /／")).isin(*X.COMPONENT_CAPTIONS)
    header = T.is_component_header(F.col("cells"))
    flat = (F.size("cells") == 1) & c0.contains("\n") & F.exists(F.split(c0, "\n"), _flat_header)
    stacked = (F.size("cells") >= 2) & F.exists("cells", lambda c: c.contains("\n")) & _stacked_header()
    x = rows.withColumns({"is_header": header, "_latch": caption | header | flat | stacked})
    text = F.array_join(F.filter(F.transform("cells", T.strip), lambda c: c != ""), " | ")
    x = carried(x, ["doc_id", "section"], ["pos"], {"_latched": F.when(F.col("_latch"), True)}, own=False)
    x = carried(x, ["doc_id", "section"], ["pos"], {"component_header": F.when(F.col("is_header"), text)})
    return x.withColumn("in_components", F.col("_latched").isNotNull()).drop("_latch", "_latched")


def flat_columns(line):
    """Columns of a line: by tab where it has one, else by white space."""
    t = T.strip(line)
    return F.filter(F.transform(F.when(t.contains("\t"), F.split(t, "\t")).otherwise(F.split(t, r"[\s\p{Z}]+")), T.strip), lambda c: c != "")


def _flat_header(line):
    return F.element_at(F.transform(F.array(F.transform(flat_columns(line), T.column_kind)), lambda k: (F.size(k) >= 2) & F.array_contains(k, "cas") & (F.array_contains(k, "name") | F.array_contains(k, "conc"))), 1)


def _stacked_header():
    kinds = F.transform("cells", lambda c: T.column_kind(F.coalesce(F.get(F.filter(F.transform(F.split(c, "\n"), T.strip), lambda p: p != ""), F.lit(0)), F.lit(""))))
    return F.element_at(F.transform(F.array(kinds), lambda k: F.array_contains(k, "cas") | (F.array_contains(k, "name") & F.array_contains(k, "conc"))), 1)
