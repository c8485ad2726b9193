"""Free text to rows: each line gets a class, classes attach to each other, attached lines become units.

lines: doc_id and other keys, pos, line, bold. Blank lines are dropped. Rules are tried from the top:
F a field, P a heading whose content follows, S a sub-title, S0 a sub-title that leaves an open heading open, C content,
CP content of an open heading only, T the torn-off last character of a label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .scan import CHUNK, beside, carried, chunked

ENDS = r"^(.+?)[：:][\s\p{Z}]*$"
INLINE = r"^(.+?)[：:][\s\p{Z}]*(.*)$"
TAB = r"^(.+?)\t+[\s\p{Z}]*(.+)$"


def classify_lines(lines: DataFrame, keys: list[str], section=None) -> DataFrame:
    """lines with class, label and value; section: column of the section number (rules of section 2), null for none.

    What several rules read is a column of its own, and the number of the rule that holds is found once.
    """
    two = F.coalesce((section if section is not None else F.lit(0)) == 2, F.lit(False))
    x = lines.withColumn("t", T.strip(T.text(F.col("line")))).where("t <> ''").withColumn("bold", F.coalesce("bold", F.lit(False)))
    t, nxt, no = F.col("t"), F.col("_next"), F.lit("")
    x = x.withColumns({
        # no pattern is tried on a line that lacks what it needs
        "_ends": F.when(T.has_colon(t), T.strip(T.group(t, ENDS))), "_left": F.when(T.has_colon(t), T.strip(F.regexp_extract(t, INLINE, 1))).otherwise(""), "_tab": F.when(t.contains("\t"), F.regexp_extract(t, TAB, 1)).otherwise(""), "_head": T.is_heading(t, F.col("bold")),
        "_class": F.when(two, T.class_row(t)),
    })
    x = beside(x, keys, ["pos"], {"_before": F.col("_ends")})
    x = beside(x, keys, ["pos"], {"_next": F.col("_ends"), "_next_class": F.col("_class.name")}, back=True)
    tab_l, plain = T.strip(F.col("_tab")), F.col("_head") & ~F.col("bold")
    tab = (F.col("_tab") != "") & ~F.col("_tab").rlike(r"\p{Nd}{2,}") & (F.length(tab_l) <= 20)
    pict = t.startswith(X.PICTOGRAM_LABEL) & (F.length(t) > len(X.PICTOGRAM_LABEL) + 1)
    joined = lambda n: F.regexp_extract(t, X.JOINED_P_LABEL, n)
    tab_r = T.strip(F.regexp_extract(t, TAB, 2))
    rules = [
        (F.col("_class.name").isNotNull(), "F", F.col("_class.name"), F.col("_class.category")),
        (two & t.isin(*X.LABEL_ELEMENTS), "S", t, no),
        (F.col("_next_class").isNotNull() & ~T.has_colon(t) & (F.length(t) <= 15), "S", t, no),
        (two & t.rlike(X.JOINED_P_LABEL), "F", joined(1), T.strip(joined(2))),
        (t.rlike(X.HAZARD_CODE), "C", no, t),
        (t.rlike(r"^[一-鿿][：:]$"), "T", F.substring(t, 1, 1), no),
        (F.col("_ends").isNotNull(), "P", F.col("_ends"), no),
        ((F.col("_left") != "") & ~F.col("_left").rlike(r"^\p{Nd}{2,}"), "F", F.col("_left"), T.strip(F.regexp_extract(t, INLINE, 2))),
        (tab & tab_l.rlike(r"^\p{Nd}+(?:\.\p{Nd}+)*\.?$"), "S0", F.concat(tab_l, F.lit(" "), tab_r), no),
        (tab, "F", tab_l, tab_r),
        (pict, "F", F.lit(X.PICTOGRAM_LABEL), T.strip(F.substring(t, F.lit(len(X.PICTOGRAM_LABEL) + 1), F.length(t)))),
        (t.rlike(r"^\p{Nd}+\.\p{Nd}+[\s\p{Z}]*[^\s\p{Z}]+"), "S", t, no),
        (t.rlike(r"^\p{Nd}{2,}[\s\p{Z}]*[^\s\p{Z}]"), "C", no, t),
        (plain & F.col("_before").isNotNull(), "CP", no, t),
        (plain & nxt.isNotNull() & ~nxt.contains(t), "CP", no, t),
        (F.col("_head"), "P", t, no),
    ]
    number = reduce(lambda a, r: a.when(r[1][0], r[0]), enumerate(rules[1:], 1), F.when(rules[0][0], 0))
    x = x.withColumn("_rule", F.coalesce(number, F.lit(-1)))
    chosen = lambda k, last: reduce(lambda a, r: a.when(F.col("_rule") == r[0], r[1][k] if k > 1 else F.lit(r[1][k])), enumerate(rules[1:], 1), F.when(F.col("_rule") == 0, rules[0][k] if k > 1 else F.lit(rules[0][k]))).otherwise(last)
    x = x.withColumns({"class": chosen(1, F.lit("C")), "label": chosen(2, no), "value": chosen(3, t)})
    return x.drop("_ends", "_left", "_tab", "_head", "_class", "_before", "_next", "_next_class", "_rule")


def text_block_units(lines: DataFrame, keys: list[str], section=None) -> DataFrame:
    """keys, ord, kind (field, sub, note), seq, label, value: the units of each block in order.

    With A the last F, P or S line so far: content joins A if that is P, or F with no CP or S0 since; else it is a note.
    CP joins an open P only. A P unit stands where it is closed, by the next F, P or S, so S0 lines inside come before it.
    """
    x = classify_lines(lines, keys, section)
    opens = F.col("class").isin("F", "P", "S")
    x = carried(x, keys, ["pos"], {"a_pos": F.when(opens, F.col("pos")), "a": F.when(opens, F.col("class")), "_broke": F.when(F.col("class").isin("CP", "S0"), F.col("pos"))})
    x = carried(x, keys, ["pos"], {"closed": F.when(opens, F.col("pos"))}, own=False, back=True)
    x = x.withColumn("broken", F.coalesce(F.col("_broke") > F.col("a_pos"), F.lit(False)))
    joins = ((F.col("a") == "P") & F.col("class").isin("C", "CP", "T")) | ((F.col("a") == "F") & F.col("class").isin("C", "T") & ~F.col("broken"))
    joins = F.coalesce(joins, F.lit(False))
    x = x.where(~(F.col("class") == "T") | joins).withColumn("unit", F.when(joins, F.col("a_pos")).otherwise(F.col("pos")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "class", "label", "value", "closed")))
    g = x.groupBy(*keys, "unit").agg(parts.alias("p"))
    first = F.get("p", F.lit(0))
    kind = first["class"]
    torn = F.array_join(F.transform(F.filter("p", lambda s: s["class"] == "T"), lambda s: s["label"]), "")
    body = F.array_join(F.transform(F.filter(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda s: s["class"] != "T"), lambda s: s["value"]), "\n")
    is_p = kind == "P"
    split = T.split_seq(F.when(is_p, F.concat(first["label"], torn)).otherwise(first["label"]))
    g = g.withColumns({"k": kind, "_s": split, "_torn": torn, "_body": body, "_first": first})
    value = F.when(F.col("k") == "P", F.col("_body")).when(F.col("k") == "F", F.when(F.col("_body") == "", F.col("_first.value")).otherwise(T.strip(F.concat(F.col("_first.value"), F.lit("\n"), F.col("_body"))))).when(F.col("k").isin("S", "S0"), "").otherwise(F.col("_first.value"))
    closed = F.col("_first.closed")
    # where a unit stands: before the line that closes it, after all lines where none does
    order = F.when(F.col("k") == "P", F.struct(closed.isNull().alias("last"), closed.alias("at"), F.lit(0).alias("side"))).otherwise(F.struct(F.lit(False).alias("last"), F.col("unit").alias("at"), F.lit(1).alias("side")))
    named = F.col("k").isin("F", "P", "S", "S0")
    out = g.select(
        *keys, order.alias("_order"), F.when(F.col("k").isin("F", "P"), "field").when(F.col("k").isin("S", "S0"), "sub").otherwise("note").alias("kind"),
        F.when(named, F.col("_s.seq")).otherwise("").alias("seq"), F.when(F.col("k") == "F", F.concat("_s.label", "_torn")).when(named, F.col("_s.label")).otherwise("").alias("label"), value.alias("value"),
    )
    if CHUNK in lines.columns:  # units have an order of their own
        out = chunked(out, *keys, "_order")
    return carried(out, keys, ["_order"], sums={"ord": F.lit(1).cast("long")}).drop("_order", CHUNK)


def split_lines(lines: DataFrame) -> DataFrame:
    """doc_id, pos, kind, label, value: each line (doc_id, pos, line) as a block of its own, its first unit; an empty note without one."""
    alone = lines.select("doc_id", F.col("pos").alias("at"), F.posexplode(F.split(T.text(F.col("line")), "\n")).alias("pos", "line"), F.lit(False).alias("bold"))
    first = text_block_units(alone, ["doc_id", "at"]).where("ord = 1").select("doc_id", F.col("at").alias("pos"), "kind", "label", "value")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return lines.select("doc_id", "pos").join(first, ["doc_id", "pos"], "left").select("doc_id", "pos", none("kind", "note"), none("label", ""), none("value", ""))


def unified_rows(items: DataFrame) -> DataFrame:
    """Fields and units of line blocks in document order: doc_id, section, ord, kind, seq, label, value, editable, idx, span.

    items: doc_id, section, pos (and sub, the place in a row), kind (field or line), label, value, bold (of all lines of
    the value, or an array with a flag for each). Lines that follow each other are one block. idx: fields from 0, then
    the units of blocks.
    """
    x = items if "sub" in items.columns else items.withColumn("sub", F.lit(0))
    x = carried(x, ["doc_id", "section"], ["pos", "sub"], sums={"block": (F.col("kind") == "field").cast("long")})
    parts = [c for c in (CHUNK,) if c in x.columns]
    fields = x.where("kind = 'field'").withColumn("_s", T.split_seq(F.col("label")))
    editable = F.col("editable") if "editable" in items.columns else F.lit(True)
    fields = fields.select("doc_id", "section", "block", F.lit(0).cast("long").alias("ord"), "kind", F.col("_s.seq").alias("seq"), F.col("_s.label").alias("label"), "value", editable.alias("editable"))
    flag = F.get("bold", F.col("k")) if items.schema["bold"].dataType.typeName() == "array" else F.col("bold")
    lines = x.where("kind = 'line'").select("doc_id", "section", "block", "bold", "pos", "sub", *parts, F.posexplode(F.split("value", "\n")).alias("k", "line"))
    # a line's place has three parts, however many lines a row or a cell has
    lines = lines.select("doc_id", "section", "block", F.struct("pos", "sub", "k").alias("pos"), "line", flag.alias("bold"), *parts)
    units = text_block_units(lines, ["doc_id", "section", "block"], F.col("section")).withColumn("editable", F.col("kind") != "sub")
    both = fields.unionByName(units.select(*fields.columns)).withColumn("is_field", F.col("ord") == 0)
    of, order, one = ["doc_id", "section"], ["block", "ord"], F.lit(1).cast("long")
    if parts:
        both = chunked(both, *of, *order)
    both = carried(both, of, order, sums={"row": one, "field_i": F.col("is_field").cast("long")})
    both = carried(both, of, order, sums={"after": F.col("is_field").cast("long")}, own=False, back=True)
    # all fields: those so far and those after
    idx = F.when(F.col("is_field"), F.col("field_i") - 1).otherwise(F.col("after") + F.col("row") - 1)
    return both.select("doc_id", "section", F.col("row").alias("ord"), "kind", "seq", "label", "value", "editable", idx.cast("int").alias("idx"), ((F.col("kind") == "note") | (F.col("is_field") & (F.col("label") == ""))).alias("span"))
