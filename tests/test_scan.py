"""Documents that are cut into chunks against the same operators over whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, hierarchy, rows, scan, sections
from docloom.sources.numbering import auto_numbers


def same(a, b):
    columns = sorted(set(a.columns) - {scan.CHUNK})
    assert columns == sorted(set(b.columns) - {scan.CHUNK})
    of = lambda df: sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    x, y = of(a), of(b)
    assert len(x) > 0 and x == y


def cut(df, *order, parts=7):
    out = scan.chunked(df, *order, parts=parts)
    # the long document lies in most of the chunks
    assert out.where("doc_id = 1").select(scan.CHUNK).distinct().count() >= parts - 2
    return out


@pytest.fixture(scope="module")
def texts(spark):
    """A long document, and short ones."""
    rng = random.Random(1)
    lines = ["1. Identification", "9.1 外观：", "液体", "", "闪点： 95", "8.2 防护", "H302: harmful", "SECTION 3: Composition", "名称\t值 多", "2.5 \t子标题", "制：", "备注 x", "16. Other", "Water：", "成分", "tail text that goes on, and on.", "12 more", "Waste Disposal Method of it"]
    out = [(d, p, rng.choice(lines), rng.random() < 0.2) for d, n in ((1, 2500), (2, 6), (3, 1), (4, 90)) for p in range(n)]
    return spark.createDataFrame(out, "doc_id long, pos long, line string, bold boolean").repartition(5)


def test_values_so_far(spark, texts):
    x = texts.withColumns({"v": F.when(F.length("line") % 5 == 0, F.col("line")), "n": F.length("line")})
    for back in (False, True):
        for own in (False, True):
            same(*[scan.carried(t, ["doc_id"], ["pos"], {"l": F.col("v")}, {"s": F.col("n"), "c": F.when(F.col("v").isNotNull(), 1)}, own, back) for t in (x, cut(x, "doc_id", "pos"))])
        same(*[scan.beside(t, ["doc_id"], ["pos"], {"a": F.col("v"), "b": F.col("n")}, back) for t in (x, cut(x, "doc_id", "pos"))])
    none = x.withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))  # a document without an id is one of its own
    same(*[scan.carried(t, ["doc_id"], ["pos"], {"l": F.col("v")}, {"s": F.col("n")}) for t in (none.distinct(), scan.chunked(none.distinct(), "doc_id", "pos", parts=5))])


def test_sections_and_sub_titles(spark, texts):
    e = texts.select("doc_id", "pos", F.col("line").alias("c0"), F.col("bold").alias("is_box"))
    same(sections.carry_sections(e), sections.carry_sections(cut(e, "doc_id", "pos")))
    same(sections.route_textboxes(e), sections.route_textboxes(cut(e, "doc_id", "pos")))
    x = texts.select("doc_id", "pos", (F.col("pos") % 3).alias("section"), F.lit("").alias("seq"), F.col("line").alias("label"), F.when(F.col("bold"), "sub").otherwise("note").alias("kind"))
    same(hierarchy.with_sub_titles(x), hierarchy.with_sub_titles(cut(x, "doc_id", "pos")))


def test_continuations_and_latches(spark, texts):
    cells = texts.select("doc_id", F.when(F.col("pos") < 2000, 3).otherwise(4).alias("section"), "pos", F.when(F.col("bold"), F.array(F.lit(""), F.col("line"))).otherwise(F.array(F.col("line"), F.lit("x"))).alias("cells"), F.lit(False).alias("bold0"))
    same(rows.component_latch(cells), rows.component_latch(cut(cells, "doc_id", "pos")))
    items = rows.row_items(cells)
    same(rows.attach_items(items), rows.attach_items(cut(items, "doc_id", "pos", "sub")))


def test_list_numbers(spark, texts):
    p = texts.select("doc_id", "pos", F.lit("1").alias("num_id"), F.when(F.col("bold"), 0).otherwise((F.length("line") % 3).cast("int")).alias("ilvl"))
    levels = spark.createDataFrame([(d, "1", k, 1 + k, ".".join(f"%{j + 1}" for j in range(k + 1))) for d in (1, 2, 3, 4) for k in range(3)], "doc_id long, num_id string, ilvl int, start int, lvl_text string")
    same(auto_numbers(p, levels), auto_numbers(cut(p, "doc_id", "pos"), levels))


def test_blocks_and_unified_rows(spark, texts):
    same(blocks.text_block_units(texts, ["doc_id"]), blocks.text_block_units(cut(texts, "doc_id", "pos"), ["doc_id"]))
    items = texts.select("doc_id", F.lit(9).alias("section"), "pos", F.when(F.length("line") % 4 == 0, "field").otherwise("line").alias("kind"), F.lit("label").alias("label"), F.concat_ws("\n", "line", F.when(F.col("bold"), F.lit("second：")), "line").alias("value"), "bold")
    same(blocks.unified_rows(items), blocks.unified_rows(cut(items, "doc_id", "pos")))
