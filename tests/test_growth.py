"""Work and memory of a task as tables grow: a table's rows are dealt to more tasks, and no step is done twice."""

import re

import pytest
from pyspark.sql import functions as F

from docloom import store
from docloom.functions import text as T
from docloom.operators import components, search_index
from docloom.plans.queries import QUERIES
from docloom.sources import adapters as A
from docloom.sources.numbering import auto_numbers

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().simpleString()


def dealt_to(df) -> int:
    return max(int(n) for n in re.findall(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan(df)))


@pytest.mark.parametrize("name", ["row_class", "continuation_merge", "component_latch", "cell_dedupe", "component_row_parts", "stacked_component_tables"])
def test_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch, name):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    n = A.table(spark, SF, "lineitem").count()
    df = QUERIES[name](spark, SF)
    assert dealt_to(df) == -(-n // 100)
    # one exchange serves all windows over a document, and one the parts of the join
    assert plan(df).count("Exchange hashpartitioning(") - plan(df).count("Exchange hashpartitioning(l_partkey") == 1


@pytest.mark.parametrize(("name", "rows"), [("unified_blocks", "part"), ("unified_rows", None)])
def test_kept_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch, name, rows):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    least = A.table(spark, SF, rows).count() // 100 if rows else 20
    p = plan(QUERIES[name](spark, SF))
    assert max(int(n) for n in re.findall(r"hashpartitioning\(doc_id#\d+L?[^)]*, (\d+)\)", p)) >= least


@pytest.mark.parametrize("name", ["doc_summary", "promote_if_empty"])
def test_what_several_steps_read_is_made_once(spark, name):
    assert "lineitem.parquet" not in plan(QUERIES[name](spark, SF))


def test_stacked_tables_are_put_together_without_groups(spark):
    df = spark.createDataFrame([(1, 0, ["Name\na\nb\n\nc", "CAS No.\n1\n2", "Other\nx", "%\n5\n6\n7\n8"]), (2, 0, ["Name", "CAS No.\n"]), (3, 0, ["Name\n", "\n"])], "doc_id int, pos int, cells array<string>")
    out = components.stacked_tables(df)
    assert "Aggregate" not in plan(out) and "Exchange" not in plan(out)
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, 0, 1, "a x", "1", "5"), (1, 0, 2, "b", "2", "6"), (1, 0, 3, "c", "", "7")]


def test_a_frequent_gram_is_not_intersected_with_a_rare_one(spark):
    e = spark.range(200).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit("").alias("seq"), F.lit("common").alias("label"), F.when(F.col("id") % 50 == 0, "zq9").otherwise("no").alias("value"), F.lit("").alias("sub_title"), F.lit("").alias("big_title"), F.lit("common").alias("full_label"))
    index = search_index.build_index(e)
    queries = spark.createDataFrame([(1, ["common", "zq9"]), (2, ["zq9"]), (3, ["zq9", "absent"]), (4, [])], "query_id int, terms array<string>")
    chosen = {r.query_id: r.grams for r in search_index._chosen(index, queries, search_index.MET).collect()}
    assert chosen == {1: ["zq9"], 2: ["zq9"], 4: [""]}
    # queries that share their rarest gram meet its postings once
    assert search_index._entries_with(index, search_index._chosen(index, queries, search_index.MET)).where("grams[0] = 'zq9'").count() == 4
    found = search_index.search(index, queries).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {1: 4, 2: 4, 4: 200}


def test_titles_need_no_pattern_for_text_that_can_have_none(spark):
    texts = ["1. Name", "a 1. Name", "SECTION 2: Hazards", "section 3 - x：y", "1.2 Name：", "", "SECTION", "16、" + "t" * 57, "16、" + "t" * 58, "Section 4: " + "t" * 89, "Section 4: " + "t" * 90]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.section_title(F.col("t")).alias("s"))
    assert [r.s.n for r in df.collect()] == [1, 1, 2, 3, None, None, None, 16, None, 4, None]


def test_auto_numbers_keep_rows_where_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    n = A.table(spark, SF, "lineitem").count()
    df = QUERIES["auto_numbering"](spark, SF)
    assert dealt_to(df) == -(-n // 100)
    p = plan(df)
    # rows met their levels and their numbers by other keys, in a fixed number of tasks
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, (pos|ilvl|num_id)", p) and p.count("Window [") == 3


def test_auto_numbers_of_lists_defined_twice_and_beyond_nine_levels(spark):
    p = spark.createDataFrame([("d", k, "1", lvl, "kept") for k, lvl in enumerate([0, 1, 10, 0, 11])] + [("d", 8, None, 0, "no list"), ("e", 0, "1", 0, "no lists")], "doc_id string, pos long, num_id string, ilvl int, c0 string")
    levels = spark.createDataFrame([("d", "1", 0, 1, "9.%1")] * 2 + [("d", "1", 1, 1, "%1.%2"), ("d", "1", 10, 1, "deep"), ("d", None, 0, 1, "x%1")], "doc_id string, num_id string, ilvl int, start int, lvl_text string")
    got = auto_numbers(p, levels)
    assert got.columns == [*p.columns, "number"]
    assert [(r.c0, r.number) for r in got.orderBy("doc_id", "pos").collect()] == [("kept", "9.1"), ("kept", "2.1"), ("kept", "deep"), ("kept", "9.2"), ("kept", ""), ("no list", ""), ("no lists", "")]
