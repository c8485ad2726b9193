"""A folder followed by syncs, a gram index, and entries by section."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from docloom.operators import hierarchy, search_index
from docloom.sources import docx, section_store
from docloom.streaming import library

from .test_documents import cell, par, save, tbl


def light(files, records):
    """Two tables stand for all: what the library does with tables does not hang on what they are."""
    return {"documents": docx.file_status(records, files), "paragraphs": docx.paragraphs(records)}


def full_read(spark, path):
    files = docx.scan(spark, path)
    return light(files, docx.decode(files))


def same_tables(a, b):
    assert set(a) == set(b)
    for name in a:
        x, y = a[name], b[name]
        columns = sorted(x.columns)
        assert columns == sorted(y.columns), name
        rows = lambda df, c=columns: sorted(str(tuple(r[k] for k in c)) for r in df.collect())
        assert rows(x) == rows(y), name


def document(path, name, n):
    rows = [["9.理化特性"], [cell(par("外观：", num=(1, 0))), f"液体{n}"], ["9.4 闪点：", str(n)]]
    save(path, tbl(["1.物料及供应商标识"], ["产品名称：", name]), tbl([cell("3.成分/组成资料", par(images=1))], ["化学品名称", "CAS编号", "含量%（w/w）"], [f"水{n}", "7732-18-5", "＞40"]), tbl(*rows), footer=par(f"{n} / 5"))


def test_syncs_follow_a_folder(spark, tmp_path):
    docs, to = tmp_path / "in", f"file://{tmp_path}/library"
    docs.mkdir()
    build = light
    with pytest.raises(FileNotFoundError):
        library.read_tables(spark, to)
    assert library.sync(library.folder_files(spark, str(docs)), to, build=build) == library.Synced(0, 0, 0, 0)
    for n in range(5):
        document(docs / f"d{n}.docx", f"P{n}", n)
    shutil.copy(docs / "d0.docx", docs / "copy.docx")  # copies share one decode
    (docs / "broken.docx").write_bytes(b"no zip")
    first = library.sync(library.folder_files(spark, str(docs)), to, build=build)
    assert (first.changed, first.removed, first.decoded) == (7, 0, 6)
    assert library.sync(library.folder_files(spark, str(docs)), to, build=build) == library.Synced(0, 0, 0, 0)  # nothing is read again

    document(docs / "d1.docx", "P1 changed", 11)
    os.remove(docs / "d2.docx")
    os.utime(docs / "d3.docx", (1, 1))  # sent again, the same bytes
    os.rename(docs / "d4.docx", docs / "moved.docx")
    (docs / "broken.docx").write_bytes(b"no zip either")
    second = library.sync(library.folder_files(spark, str(docs)), to, build=build)
    assert (second.changed, second.removed, second.decoded) == (4, 2, 2)
    same_tables(library.read_tables(spark, to), full_read(spark, str(docs)))
    held = library.read_tables(spark, to)["paragraphs"].count()
    # a sync that dies before its state is whole leaves the last one to readers, and the next one goes on from there
    document(docs / "d5.docx", "P5", 5)
    build = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        library.sync(library.folder_files(spark, str(docs)), to, build=build)
    build = light
    assert library.read_tables(spark, to)["paragraphs"].count() == held
    third = library.sync(library.folder_files(spark, str(docs)), to, build=build)
    assert (third.changed, third.removed, third.decoded) == (1, 0, 0)  # decoded already
    after = library.read_tables(spark, to)["paragraphs"].count()
    assert after > held and library.vacuum(spark, to) > 0
    same_tables(library.read_tables(spark, to), full_read(spark, str(docs)))
    for f in docs.iterdir():
        f.unlink()
    gone = library.sync(library.folder_files(spark, str(docs)), to, build=build)
    assert gone.removed == 7 and all(t.isEmpty() for t in library.read_tables(spark, to).values())


@pytest.fixture(scope="module")
def many(spark):
    rows = [(d, p, p % 5, f"{p % 5}.节", "" if p % 3 else f"{p % 5}.{p}", f"标签{(d * 7 + p) % 40} Label", f"value {d * p} µx" if p % 2 else "", "field") for d in range(30) for p in range(40)]
    return hierarchy.with_sub_titles(spark.createDataFrame(rows, "doc_id long, pos long, section int, big_title string, seq string, label string, value string, kind string"))


def test_index_finds_what_a_scan_finds(spark, many):
    asked = ["标签7", "label value", "x", "µ", "3.18 标签", "value 841", "none such", "标签1 label 2", "", " ： ", "节", "el", "abel va"]
    queries = spark.createDataFrame([(k, hierarchy.terms_of(q)) for k, q in enumerate(asked)] + [(50, ["value841"]), (51, [""]), (52, ["qqqq", "label"])], "query_id int, terms array<string>")
    index = search_index.build_index(many)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "pos").collect()))
    want = rows(hierarchy.search_many(many, queries))
    assert len(want) > 2000
    for met in (1, 3, 10):
        assert rows(search_index.search(index, queries, met)) == want
    # what is read and tested, of all pairs of queries and entries
    share = search_index.candidates(index, queries.where("query_id in (0, 4, 5, 6, 7, 50, 52)")).count() / (7 * many.count())
    assert share < 0.12, share
    assert search_index.search(index, queries.limit(0)).count() == 0
    assert search_index.search(search_index.build_index(many.limit(0)), queries).count() == 0
    index.drop()


def test_sections_are_read_by_folder(spark, many, tmp_path):
    path = str(tmp_path / "entries")
    section_store.write_by_section(many, path)
    row = lambda df: sorted(str(tuple(r)) for r in df.select(*many.columns).collect())
    some = section_store.read_sections(spark, path, [1, 3])
    assert row(some) == row(many.where("section in (1, 3)")) and "PartitionFilters: [section#" in str(some._jdf.queryExecution().executedPlan().toString())
    assert row(section_store.read_sections(spark, path)) == row(many)
    chosen = many.where("label = '标签7 Label' and section < 3").select("section")
    joined = section_store.read_sections(spark, path, chosen)
    assert row(joined) == row(many.join(chosen.distinct(), "section", "left_semi"))
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([(2,), (99,), (None,)], "section int")
    assert section_store.read_sections(spark, path, one).select(F.input_file_name()).distinct().collect()[0][0].count("section=2") == 1


def test_syncs_make_packages_once_and_compare_no_records(spark, monkeypatch):
    from docloom import store
    from docloom.plans.queries import QUERIES

    kept, keep = [], store.keep
    monkeypatch.setattr(store, "keep", lambda df, name: kept.append((name, df._jdf.queryExecution().simpleString())) or keep(df, name))
    QUERIES["library_refresh"](spark, "/root/testdata/sf0.001")
    names = [name for name, _ in kept]
    assert names.count("package-files") == 1
    assert not any(re.search(r"Aggregate\(keys=\[[^\]]*content#", p) for name, p in kept if name == "library-records")
    # what is joined is a file's hash: no content goes through an exchange
    assert not any("sha2(" in p.split("Join")[0] for name, p in kept if name == "library-hashed")


def test_a_content_that_two_syncs_decoded_counts_once(spark, tmp_path):
    docs, to = tmp_path / "in", f"file://{tmp_path}/library"
    docs.mkdir()
    for n in range(2):
        document(docs / f"d{n}.docx", f"P{n}", n)
    library.sync(library.folder_files(spark, str(docs)), to, build=light)
    twice = spark.read.parquet(f"{to}/decoded").where("sha256 = (select min(sha256) from {d})".replace("{d}", f"parquet.`{to}/decoded`")).collect()
    spark.createDataFrame(twice, library._RECORDS).write.mode("append").parquet(f"{to}/decoded")
    for f in docs.iterdir():
        os.utime(f, (1, 1))
    library.sync(library.folder_files(spark, str(docs)), to, build=light)
    same_tables(library.read_tables(spark, to), full_read(spark, str(docs)))
