"""Every registered query over plain tables against its SQL, and the entry's contract."""

import importlib
import sys

import pytest

from docloom.plans.queries import ORACLE_SQL, QUERIES

from .oracle import database, same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_tree_json_holds_every_entry(spark):
    import json

    from docloom.sources.adapters import entries

    rows = QUERIES["tree_json"](spark, SF).collect()
    n = 0
    for r in rows:
        for s in json.loads(r.json):
            n += len(s["direct_fields"]) + sum(1 + len(b["children"]) for b in s["big_titles"])
    assert n == entries(spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "pipeline" not in e.queries() and "search_all_terms" in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_the_rest_does_not_need_the_corpus_operators():
    from pathlib import Path

    import docloom

    root = Path(docloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(encoding="utf-8"), p


def test_page_footer_fields_states_the_whole_rule(spark, tmp_path):
    from .oracle import TABLES

    texts = ["Für. Erein", "P修订日期：2020", "PEA-4139", "3 / 5", "某某公司  BL-8128W-MSDS", "a：b:c", ":x", "Dé: é", "F5", "批次: 7", "页　X_1"]
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet") if t != "pages" else None
    rows = [(k, "u", f"<html><body><footer>{t}</footer></body></html>") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    next((tmp_path / "pages").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    same_rows(QUERIES["page_footer_fields"](spark, str(tmp_path)), database(str(tmp_path)), ORACLE_SQL["page_footer_fields"])
