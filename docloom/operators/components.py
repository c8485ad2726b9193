"""Ingredient tables: cells, whole tables in one cell, column-stacked tables, mixtures, promotion, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .rows import flat_columns


def component_structs(name, cas, conc):
    """array<struct(name, cas, conc, raw_name, raw_cas, raw_conc)> of three cells split by line and zipped by place.

    Lines without a name go; if none is left, one struct holds the name alone (its cas and conc are lost).
    """
    split = lambda c: F.split(T.text(c), "\n")
    zipped = F.arrays_zip(split(name).alias("n"), split(cas).alias("c"), split(conc).alias("p"))
    one = lambda n, c, p: F.struct(T.component_name(n).alias("name"), T.component_cas(c).alias("cas"), T.component_conc(p).alias("conc"), T.strip(T.text(n)).alias("raw_name"), T.strip(T.text(c)).alias("raw_cas"), T.strip(T.text(p)).alias("raw_conc"))
    all_rows = F.filter(F.transform(zipped, lambda z: one(z["n"], z["c"], z["p"])), lambda s: s["name"] != "")
    only = F.array(one(name, F.lit(""), F.lit("")))
    return T.once(all_rows, lambda a: F.when(F.size(a) > 0, a).otherwise(only))


def split_cells(cells: DataFrame, keys=("doc_id",)) -> DataFrame:
    """keys, idx and the ingredient of each line of name_cell, cas_cell, conc_cell."""
    return cells.select(*keys, F.posexplode(component_structs(F.col("name_cell"), F.col("cas_cell"), F.col("conc_cell"))).alias("idx", "c")).select(*keys, "idx", "c.*")


def components_of_rows(rows: DataFrame) -> DataFrame:
    """Rows of a latched section (doc_id, section, pos, cells) to their parts: kind (component, field, line), label, value and the ingredient's columns.

    A product type is a field, a caption alone is dropped, a single cell is a line, others are ingredient cells.
    """
    at = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    kind = (
        F.when(at(0).startswith(X.PRODUCT_TYPE), "field").when((F.size("cells") <= 2) & F.rtrim(at(0), F.lit(" /／")).isin(*X.COMPONENT_CAPTIONS), "drop")
        .when(F.size("cells") == 1, "line").otherwise("component")
    )
    x = rows.withColumn("kind", kind).where("kind <> 'drop'")
    rest = F.array_join(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), " / ")
    x = x.withColumns({"label": F.when(F.col("kind") == "field", X.PRODUCT_TYPE).otherwise(""), "value": F.when(F.col("kind") == "field", rest).when(F.col("kind") == "line", at(0)).otherwise("")})
    parts = F.when(F.col("kind") == "component", component_structs(at(0), at(1), at(2)))
    return x.select("doc_id", "section", "pos", "kind", "label", "value", F.posexplode_outer(parts).alias("idx", "c")).select("doc_id", "section", "pos", "kind", "label", "value", "idx", "c.*")


def flat_tables(cells: DataFrame) -> DataFrame:
    """A whole table in one cell (doc_id, pos, text): doc_id, pos, i, part (pre, header, component, post), line, name, cas, conc.

    The first line with a CAS column and a name or concentration column is the header; cells without one give no rows,
    and so do those whose lines after it hold no ingredient.
    """
    x = cells.select("doc_id", "pos", F.posexplode(F.split(T.text(F.col("text")), "\n")).alias("i", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    kinds = F.transform(flat_columns(F.col("line")), T.column_kind)
    # a header names CAS: the kinds of other lines' columns are not asked for
    x = x.withColumn("_k", F.when(F.lower("line").contains("cas"), kinds)).withColumn("_header", F.coalesce((F.size("_k") >= 2) & F.array_contains("_k", "cas") & (F.array_contains("_k", "name") | F.array_contains("_k", "conc")), F.lit(False)))
    w = Window.partitionBy("doc_id", "pos")
    x = x.withColumn("_at", F.min(F.when(F.col("_header"), F.col("i"))).over(w)).where("_at is not null")
    c = T.component_of_text(F.array_join(flat_columns(F.col("line")), " "))
    x = x.withColumn("c", F.when(F.col("i") > F.col("_at"), c))
    part = F.when(F.col("i") < F.col("_at"), "pre").when(F.col("i") == F.col("_at"), "header").when(F.col("c").isNotNull(), "component").otherwise("post")
    x = x.withColumn("part", part).withColumn("_any", F.max(F.col("part") == "component").over(w)).where("_any")
    return x.select("doc_id", "pos", "i", "part", "line", "c.name", "c.cas", "c.conc")


def flat_parts(flat: DataFrame) -> DataFrame:
    """What a flat table adds to its section: kind (field, line, component), label, value and cells, by pos and i."""
    has_tab = (F.col("part") == "pre") & F.col("line").contains("\t")
    a, b = T.strip(F.substring_index("line", "\t", 1)), T.strip(F.substring(F.col("line"), F.instr("line", "\t") + 1, F.length("line")))
    pair = has_tab & (a != "") & (b != "")
    number = a.rlike(r"^\p{Nd}+(?:\.\p{Nd}+)*\.?$")
    x = flat.where("part <> 'header'")
    return x.select(
        "doc_id", "pos", "i", F.when(F.col("part") == "component", "component").when(pair, "field").otherwise("line").alias("kind"),
        F.when(pair & number, T.normalize_label(F.concat(a, F.lit(" "), b))).when(pair, T.normalize_label(a)).otherwise("").alias("label"),
        F.when(pair & number, "").when(pair, b).when(F.col("part") == "component", "").otherwise(F.col("line")).alias("value"), "name", "cas", "conc",
    )


def stacked_tables(rows: DataFrame) -> DataFrame:
    """Column-stacked tables (doc_id, pos, cells): doc_id, pos, i, name, cas, conc, one row for each line below the headers.

    Each cell's first line is a header; its kind sends the lines below to name, cas or conc. A line without a name is read
    as free text. Rows without a line break, with an empty cell or without the needed headers give nothing.
    """
    lines = F.transform("cells", lambda c: F.filter(F.transform(F.split(T.text(c), "\n"), T.strip), lambda p: p != ""))
    kinds = lambda ls: F.transform(ls, lambda a: T.column_kind(F.get(a, F.lit(0))))
    x = rows.where((F.size("cells") >= 2) & F.exists("cells", lambda c: c.contains("\n")))
    # exploded, a cell's lines and the kinds of its columns are worked out once, and not for each test of them
    x = x.select("doc_id", "pos", F.explode(F.array(lines)).alias("_l")).where(F.forall("_l", lambda a: F.size(a) > 0))
    x = x.select("doc_id", "pos", "_l", F.explode(F.array(kinds("_l"))).alias("_k"))
    x = x.where(F.array_contains("_k", "cas") | (F.array_contains("_k", "name") & F.array_contains("_k", "conc")))
    # a table's lines are put together in its row: nothing is grouped again
    longest = F.array_max(F.transform("_l", F.size))
    table = F.when(longest > 1, F.transform(F.sequence(F.lit(1), F.greatest(longest - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.transform("_l", lambda a: F.get(a, i)).alias("v"))))
    x = x.select("doc_id", "pos", "_k", F.explode(table).alias("z")).select("doc_id", "pos", "_k", F.col("z.i").alias("i"), F.col("z.v").alias("v"))
    joined = lambda cond: F.array_join(F.zip_with("_k", "v", lambda k, v: F.when(cond(k), v)), " ")  # noqa: E731  without nulls
    last = lambda kind: F.coalesce(F.get(F.reverse(F.filter(F.zip_with("_k", "v", lambda k, v: F.when(k == kind, v)), lambda v: v.isNotNull())), F.lit(0)), F.lit(""))
    line = F.struct(joined(lambda k: ~k.isin("cas", "conc")).alias("name"), last("cas").alias("cas"), last("conc").alias("conc"), F.array_join("v", " ").alias("all"))
    g = x.select("doc_id", "pos", "i", F.inline(F.array(line)))
    c = T.component_of_text(F.col("all"))
    g = g.withColumn("c", F.when(F.col("name") != "", F.struct("name", "cas", "conc")).otherwise(c)).where("c is not null")
    return g.select("doc_id", "pos", "i", "c.*")


def mixture_candidates(rows: DataFrame) -> DataFrame:
    """doc_id, section, pos, k, name, conc: the row after a mixture header, or the further lines of the header's own cell; section 3 only."""
    w = Window.partitionBy("doc_id", "section").orderBy("pos")
    c0 = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    x = rows.where("section = 3").withColumn("_head", T.is_mixture_header(c0))
    x = x.withColumn("_alone", F.coalesce(F.lag(F.col("_head") & ~c0.contains("\n")).over(w), F.lit(False)))
    lines = F.split(c0, "\n")
    texts = F.when(F.col("_head"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).when(F.col("_alone"), F.array(c0))
    x = x.select("doc_id", "section", "pos", F.posexplode(texts).alias("k", "line")).withColumn("c", T.mixture_row(F.col("line"))).where("c is not null")
    return x.select("doc_id", "section", "pos", "k", "c.*")


def promote_if_empty(components: DataFrame, candidates: DataFrame) -> DataFrame:
    """components (doc_id, section, idx, name, cas, conc) and, for sections that have none, the mixture candidates."""
    free = candidates.join(components.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    idx = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos", "k")) - 1
    return components.select("doc_id", "section", "idx", "name", "cas", "conc").unionByName(free.select("doc_id", "section", idx.alias("idx"), "name", F.lit("").alias("cas"), "conc"))


def expand(components: DataFrame) -> DataFrame:
    """doc_id, section, label, value: three long rows for each ingredient (成分1名称, 成分1CAS, 成分1含量, ...)."""
    n = (F.col("idx") + 1).cast("int").cast("string")
    label = lambda s: F.concat(F.lit("成分"), n, F.lit(s))
    parts = F.array(*[F.struct(label(s).alias("label"), F.col(c).alias("value")) for s, c in (("名称", "name"), ("CAS", "cas"), ("含量", "conc"))])
    return components.select("doc_id", "section", F.inline(parts))
