"""Which section a row belongs to: titles, keyword hints, carry-forward, text-box routing and default titles.

rows: doc_id, pos, c0 (first cell's text) and others. State runs over doc_id in order of pos, so one exchange on doc_id
serves all of it; scan.chunked(rows, "doc_id", "pos") spreads documents of any length over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .scan import carried


def with_titles(rows: DataFrame) -> DataFrame:
    """title_n and title of section-title rows; hint_n of rows that open a section by a keyword, only while none is open."""
    rows = rows.withColumn("_q", T.squeeze(F.col("c0"))).withColumns({"_t": T.section_title_of(F.col("_q")), "_h": T.hint_section(F.col("c0"))}).drop("_q").withColumns({"title_n": F.col("_t.n"), "title": F.col("_t.title")})
    rows = carried(rows, ["doc_id"], ["pos"], {"_open": F.coalesce("title_n", "_h")}, own=False)
    return rows.withColumn("hint_n", F.when(F.col("title_n").isNull() & F.col("_open").isNull(), F.col("_h"))).drop("_t", "_h", "_open")


def carry_sections(rows: DataFrame) -> DataFrame:
    """section of each row: the last title or hint at or before it; rows before the first are dropped."""
    return carried(with_titles(rows), ["doc_id"], ["pos"], {"section": F.coalesce("title_n", "hint_n")}).where("section is not null")


def content_rows(rows: DataFrame) -> DataFrame:
    """Carried rows without the title rows themselves; a hint row stays as content."""
    return carry_sections(rows).where("title_n is null").drop("title_n", "title", "hint_n")


def section_table(rows: DataFrame) -> DataFrame:
    """doc_id, section, title, full_title: the first title or hint row of each section of a document."""
    first = carry_sections(rows).where("title_n is not null or hint_n is not null")
    lead = F.struct("pos", F.coalesce("title", "c0").alias("title"), F.col("c0").alias("full_title"))
    return first.groupBy("doc_id", "section").agg(F.min(lead).alias("f")).select("doc_id", "section", "f.title", "f.full_title")


def default_titles(spark) -> DataFrame:
    return spark.createDataFrame(list(X.SECTION_TITLES), "section int, default_title string")


def with_default_titles(sections: DataFrame) -> DataFrame:
    """title, or the standard one where it is null or empty (16 fixed rows are broadcast)."""
    d = sections.join(F.broadcast(default_titles(sections.sparkSession)), "section", "left")
    return d.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "default_title")).drop("default_title")


def route_textboxes(events: DataFrame) -> DataFrame:
    """Section of every event; events: doc_id, pos, is_box, c0.

    Table rows carry as usual. A text box whose first line is a title switches the carried section; another goes to the
    section of its N.N number, else to that of a phrase, else to the carried one; a first block of all opens section 1.
    """
    e = with_titles(events).withColumn("own", F.when(F.col("is_box") & F.col("title_n").isNull(), F.coalesce(T.textbox_section(F.col("c0")), T.textbox_hint(F.col("c0")))))
    opens = F.col("is_box") & F.col("title_n").isNull() & F.coalesce("title_n", "hint_n").isNull()
    first_box = F.when(opens, F.lit(1))
    e = carried(e, ["doc_id"], ["pos"], {"carried": F.coalesce("title_n", "hint_n"), "started": F.coalesce("title_n", "hint_n", first_box)})
    return e.withColumn("section", F.coalesce("own", "carried", F.when(F.col("started").isNotNull(), F.lit(1)))).where("section is not null").drop("own", "carried", "started")


def textbox_titles(events: DataFrame) -> DataFrame:
    """The title that stands for each section: the last text-box title, else the first title of all."""
    t = with_titles(events).where("title_n is not null")
    last_box = F.max_by("title", F.when(F.col("is_box"), F.col("pos")))
    boxed = F.max(F.when(F.col("is_box"), F.lit(True)))
    return t.groupBy("doc_id", F.col("title_n").alias("section")).agg(F.when(boxed, last_box).otherwise(F.min_by("title", "pos")).alias("title"))
