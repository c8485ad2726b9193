"""Word packages made here, read end to end."""

import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import pivot
from docloom.plans.documents import read_documents
from docloom.sources import docx, sinks
from docloom.streaming.ingest import ingest, latest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:v="urn:schemas-microsoft-com:vml"'


def par(text="", bold=False, num=None, images=0):
    pr = f'<w:pPr><w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr></w:pPr>' if num else ""
    body = "".join(f'<w:t xml:space="preserve">{x}</w:t>' if i == 0 else f"<w:tab/><w:t>{x}</w:t>" for i, x in enumerate(text.split("\t")))
    pics = '<w:r><w:drawing><wp:inline><wp:extent cx="100" cy="200"/><a:graphic><a:blip r:embed="rId9"/></a:graphic></wp:inline></w:drawing></w:r>' * images
    return f"<w:p>{pr}<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{body}</w:r>{pics}</w:p>"


def cell(*paragraphs, span=1):
    return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>{"".join(p if p.startswith("<") else par(p) for p in paragraphs)}</w:tc>'


def tbl(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(c if c.startswith("<w:tc") else cell(c) for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def box(*lines):
    return f"<w:p><w:r><w:pict><v:textbox><w:txbxContent>{''.join(par(x) for x in lines)}</w:txbxContent></v:textbox></w:pict></w:r></w:p>"


def save(path, *body, header="", footer=""):
    refs = ('<w:headerReference w:type="default" r:id="rId1"/>' if header else "") + ('<w:footerReference w:type="default" r:id="rId2"/>' if footer else "")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}<w:sectPr>{refs}</w:sectPr></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Target="header1.xml"/><Relationship Id="rId2" Target="footer1.xml"/><Relationship Id="rId9" Target="media/image1.png"/></Relationships>')
        z.writestr("word/numbering.xml", f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:lvlText w:val="9.%1"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {NS}>{footer}</w:ftr>")
        z.writestr("word/media/image1.png", b"PNG")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docx")
    save(
        d / "PU-1 v2.docx",
        tbl([cell(par("1.物料及供应商标识", bold=True), span=2)], ["产品名称：", "PU-1"], [cell(par("merged", bold=False), span=2), "merged"]),
        par("body text is not read"),
        tbl(["2.危险性概述"], [cell(par("图", images=0)), cell(par("", images=2))]),
        tbl([cell("3.成分/组成资料", par(images=1))], ["化学品名称", "CAS编号", "含量%（w/w）"], [cell("水", "乙醇"), cell("7732-18-5", "64-17-5"), cell("＞40", "＜1")], ["4.急救措施", ""], ["吸入：", "新鲜空气"], ["", "就医"]),
        tbl(["9.理化特性"], [cell(par("外观：", num=(1, 0))), "液体"], [cell(par("气味：", num=(1, 0))), ""], ["9.4 闪点：", "95"]),
        header=tbl(["PEA-4139"]), footer=par("英德市精细有限公司 BL-8128W-MSDS") + par("3 / 5"),
    )
    save(d / "box.docx", box("10.1 Reactivity none", "stable product in use"), box("SECTION 10: Stability and reactivity"), box("This information is based on us"), tbl([cell("11. Toxicological information")], ["free line"]))
    save(d / "mix.docx", tbl(["3.Composition"], ["3.1 Mixtures"], ["polyether urethane 20±1%（w/w） /"]))
    flat = "Note\nChemical Name\tCAS No.\t%\nWater\t7732-18-5\t60±1\nend of it".split("\n")
    save(d / "flat.docx", tbl(["3.Composition"], [cell(*flat)]))
    (d / "broken.docx").write_bytes(b"no zip")
    (d / "~$lock.docx").write_bytes(b"lock")
    return d


def test_files_of_one_folder_by_many_tasks(spark, tmp_path):
    from docloom.sources.picture_files import PictureFiles

    spark.dataSource.register(PictureFiles)
    rows = [(f, f"{i}.bin", f"{f}-{i}".encode()) for i in range(40) for f in ("in", "in/deep", "x/y")]
    write = lambda r, n, at: spark.createDataFrame(r, "folder string, name string, content binary").repartition(n).write.format(PictureFiles.name()).option("path", str(at)).mode("append").save()
    for n in (1, 5):
        at = tmp_path / f"files{n}"
        write(rows, n, at)
        assert {(str(p.parent.relative_to(at)), p.name, p.read_bytes()) for p in at.rglob("*") if p.is_file()} == set(rows) and not (at / "_attempts").exists()
        # two files of one name: an error, and nothing is left
        with pytest.raises(Exception, match="two files|aborted|Failed|FAILED"):
            write([("in", "a.bin", b"1"), ("in", "a.bin", b"2")] * 3, n, tmp_path / f"twice{n}")
        assert not (tmp_path / f"twice{n}" / "in" / "a.bin").exists()


def test_image_files_of_equal_stems_and_failed_jobs(spark, tmp_path):
    docs = spark.createDataFrame([("/a/x.docx", "x.docx"), ("/b/x.docx", "x.docx"), ("/c/y.docx", "y.docx"), ("/d/", "")], "doc_id string, file_name string")
    rows = [(d, s, k, "png", f"{d}{k}".encode()) for d in ("/a/x.docx", "/b/x.docx", "/c/y.docx", "/d/") for s, k in ((1, 0), (1, 1), (9, 2))]
    images = spark.createDataFrame(rows, "doc_id string, section int, ord int, ext string, content binary")
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        out = sinks.write_image_files(images, docs, path, folders=3).collect()
        held = sorted(f.read_bytes() for f in (tmp_path / path.rpartition("/")[2]).rglob("*.png"))
        assert held == sorted(r[4] for r in rows) and len({r.name for r in out}) == len(rows)
        assert all(open(r.path.removeprefix("file://"), "rb").read().startswith(r.doc_id.encode()) for r in out)
        assert {r.name for r in out if r.doc_id == "/c/y.docx"} == {"y_s1_0.png", "y_s1_1.png", "y_s9_2.png"}
        assert not list(tmp_path.rglob("_attempts"))
    with pytest.raises(Exception, match="there already"):
        sinks.write_image_files(images, docs, str(tmp_path / "plain"))
    bad = images.withColumn("content", F.when(F.col("doc_id") != "/c/y.docx", F.col("content")))
    with pytest.raises(Exception, match="no content"):
        sinks.write_image_files(bad, docs, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


@pytest.fixture(scope="module")
def corpus(spark, folder, tmp_path_factory):
    d = tmp_path_factory.mktemp("kept")

    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{d}/{name}")
        return spark.read.parquet(f"{d}/{name}")

    return read_documents(spark, str(folder), keep)


def by_name(corpus, df):
    names = {r.doc_id: r.file_name for r in corpus.documents.select("doc_id", "file_name").collect()}
    return [(names[r.doc_id].split(".")[0].split(" ")[0], r) for r in df.collect()]


def test_files(corpus):
    got = {r.file_name.replace("%20", " "): (r.status, r.tables_count) for r in corpus.documents.collect()}
    assert got == {"PU-1 v2.docx": ("ok", 4), "box.docx": ("ok", 1), "mix.docx": ("ok", 1), "flat.docx": ("ok", 1), "broken.docx": ("failed", None)}
    assert all(len(r.sha256) == 64 for r in corpus.documents.collect())


def test_rows(corpus):
    rows = sorted(((n.replace("%20v2", ""), r.section, r.ord, r.kind, r.seq, r.label, r.value) for n, r in by_name(corpus, corpus.rows)), key=str)
    pu = [x[1:] for x in rows if x[0] == "PU-1"]
    assert (1, 1, "field", "", "产品名称", "PU-1") in pu and (4, 1, "field", "", "吸入", "新鲜空气\n就医") in pu
    assert [x[3:] for x in pu if x[0] == 9] == [("9.1", "外观", "液体"), ("9.2", "气味", ""), ("9.4", "闪点", "95")]
    assert [x[2:] for x in pu if x[0] == 0] == [("sub", "0.1", "页眉", ""), ("field", "", "产品名称", "PEA-4139"), ("sub", "0.2", "页脚", ""), ("field", "", "公司名称", "英德市精细有限公司"), ("field", "", "产品型号", "BL-8128W-MSDS"), ("field", "", "页码", "3 / 5")]
    assert any("[象形图×2]" in x[4] + x[5] for x in pu if x[0] == 2)
    boxes = {(x[1], x[6]) for x in rows if x[0] == "box"} | {(x[1], x[5]) for x in rows if x[0] == "box"}
    assert (10, "Reactivity none") in boxes and any(s == 16 for s, _ in boxes)


def test_components(corpus):
    got = sorted((n.replace("%20v2", ""), r.section, r.idx, r.name, r.cas, r.conc) for n, r in by_name(corpus, corpus.components))
    assert got == [("PU-1", 3, 0, "水", "7732-18-5", ">40"), ("PU-1", 3, 1, "乙醇", "64-17-5", "<1"), ("flat", 3, 0, "Water", "7732-18-5", "60±1"), ("mix", 3, 0, "polyether urethane", "", "20±1%（w/w）")]
    entries = [(r.label, r.value) for n, r in by_name(corpus, corpus.entries) if r.kind == "component"]
    assert ("水", "水 | CAS: 7732-18-5 | 含量: >40") in entries and len(entries) == 3  # the promoted one is in no table


def test_images_and_sinks(spark, corpus, tmp_path):
    images = sorted((r.ord, r.section, r.width, bytes(r.content)) for _, r in by_name(corpus, corpus.images))
    assert images == [(0, 2, 100, b"PNG"), (1, 2, 100, b"PNG"), (2, 2, 100, b"PNG")]  # the one in a title row is of the section before
    at = sinks.export_images(corpus.images, corpus.documents, str(tmp_path / "img"), "x_").collect()
    assert len(at) == 3 and all(r.path == f"{tmp_path}/img#{r.name}" and r.name.startswith("x_PU-1") and "_s2_" in r.name for r in at)
    out = sinks.write_image_files(corpus.images, corpus.documents, str(tmp_path / "files"), "x_").collect()
    assert len({r.path for r in out}) == 3 and all(open(r.path, "rb").read() == b"PNG" for r in out)
    sinks.write_tsv(corpus.entries, str(tmp_path / "tsv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "tsv")).collect()]
    assert "节\t大标题\t小标题\t标签\t内容" in lines
    over = corpus.components.where("name = '水'").select("doc_id", "section", F.lit("component").alias("kind"), "idx", F.lit(False).alias("editable"), F.lit(1).alias("at"))
    j = sinks.document_json(corpus.documents.where("status = 'ok'"), corpus.sections, corpus.rows, corpus.components, corpus.items, over).collect()
    import json

    docs = [json.loads(r.json) for r in j]
    assert len(docs) == 4 and all(isinstance(d["sections"], list) for d in docs)
    pu = {s["section"]: s for d in docs if d["file_name"].startswith("PU-1") for s in d["sections"]}
    assert pu[9]["fields"] == {"9.1 外观": "液体", "9.2 气味": "", "9.4 闪点": "95"} and pu[4]["fields"] == {"吸入": "新鲜空气\n就医"}
    assert [(c["name"], c["editable"]) for c in pu[3]["components"]] == [("水", False), ("乙醇", True)] and "merged" in pu[1]["lines"]
    wide, columns = pivot.build_pivot(corpus.documents.where("status = 'ok'"), corpus.entries, corpus.sections.where("is_component_table").select("doc_id", "section"), corpus.components)
    got = {r["3_成分1名称"]: r for r in wide.collect()}
    assert got["水"]["3_成分2CAS"] == "64-17-5" and got["Water"]["3_成分2名称"] == "" and "" in got
    assert columns.where("kind = 'comp'").count() == 6


@pytest.fixture(scope="module")
def odd_rows(spark, tmp_path_factory):
    """Rows of packages with long cells and boxes, single bold paragraphs and a continuation after a table in one cell."""
    d = tmp_path_factory.mktemp("odd")
    save(d / "long.docx", tbl(["9.Title"], [cell(*MANY)], ["Density:", "1"], [cell(*(par(f"item {i} in a long cell", num=(1, 0)) for i in range(1200)))]), box("10.1 Reactivity", *BOXES))
    save(d / "bold.docx", tbl(["13.Disposal"], [cell(par("Waste Disposal Method of all", bold=True), par(PROSE), par("Other heading, bold no"))]))
    flat = "Type:\tmixture\nChemical Name\tCAS No.\t%\nWater\t7732-18-5\t60±1".split("\n")
    save(d / "flat.docx", tbl(["3.Composition"], ["Use:", "paint"], [cell(*(par(x) for x in flat))]), tbl(["4.First aid"], ["Eyes:", "rinse"], ["", "more"]))
    rows = read_documents(spark, str(d)).rows.orderBy("doc_id", "section", "ord").collect()
    return {n: [r for r in rows if r.doc_id.endswith(f"{n}.docx")] for n in ("long", "bold", "flat")}


MANY, BOXES = [f"line number {i} of these" for i in range(1500)], [f"box line {i} that stands alone" for i in range(150)]
PROSE = "send it to a plant that is licensed for such waste of all kinds"


def test_rows_of_many_lines_keep_them_all(odd_rows):
    values = "\n".join(r.value for r in odd_rows["long"])
    assert all(x in values for x in (*MANY, *BOXES))
    assert {(r.seq, r.label) for r in odd_rows["long"]} >= {(f"9.{i + 1}", f"item {i} in a long cell") for i in range(1200)}


def test_bold_of_single_paragraphs(odd_rows):
    assert [(r.kind, r.label, r.value) for r in odd_rows["bold"]] == [("field", "Waste Disposal Method of all", f"{PROSE}\nOther heading, bold no")]


def test_continuation_after_a_table_in_one_cell(odd_rows):
    got = {(r.section, r.label): r.value for r in odd_rows["flat"]}
    assert got[3, "Use"] == "paint" and got[3, "Type"] == "mixture" and got[4, "Eyes"] == "rinse\nmore"


def test_anomalies(corpus):
    got = {(n, r.level, r.section, r.message, r.detail) for n, r in by_name(corpus, corpus.anomalies) if r.section == 9}
    assert {x[1:] for x in got} == {("warn", 9, "S9 编号不连续", "缺失: 9.3")}  # numbers made by Word count
    assert any(r.message == "缺失第16节" for _, r in by_name(corpus, corpus.anomalies))


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"x")
    with pytest.raises(ValueError, match="every file failed"):
        read_documents(spark, str(tmp_path))


def test_incremental_ingest(spark, folder, tmp_path):
    src, to, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.docx").write_bytes((folder / "mix.docx").read_bytes())
    ingest(spark, str(src), to, check)
    assert docx.paragraphs(latest(spark, to)).count() > 0
    (src / "b.docx").write_bytes((folder / "flat.docx").read_bytes())
    ingest(spark, str(src), to, check)
    assert latest(spark, to).select("doc_id").distinct().count() == 2


def test_records_of_many_files_go_to_spark_together(tmp_path):
    import pyarrow as pa

    save(tmp_path / "a.docx", tbl(["9.Properties"], ["Odor:", par("none", bold=True)]))
    data = (tmp_path / "a.docx").read_bytes()
    files = pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(60)], "content": [data] * 59 + [b"no zip"]})
    found = list(docx._decode([files]))
    assert len(found) == 1  # a batch for each file took longer than their decode
    rows = found[0].to_pylist()
    assert [r["doc_id"] for r in rows if r["kind"] == "file"] == [str(k) for k in range(60)]
    assert [r["bold"] for r in rows if r["doc_id"] == "7" and r["kind"] == "paragraph"] == [False, False, True] and rows[-1]["status"] == "failed"


def test_scanned_files_deals_folders_and_decodes_once(spark, monkeypatch):
    from pathlib import Path

    from docloom import store
    from docloom.plans.queries import QUERIES

    made, new_path = [], store.new_path
    monkeypatch.setattr(store, "new_path", lambda s, name: made.append((name, new_path(s, name))) or made[-1][1])
    found = QUERIES["scanned_files"](spark, "/root/testdata/sf0.001")
    at = Path(dict(made)["package-files"].removeprefix("file:")) / "in"
    assert list(at.iterdir()) and all(p.is_dir() for p in at.iterdir())  # files of one folder by many tasks are moved one by one
    assert all("package-status" in f for f in found.inputFiles())


def test_package_rows_reads_paragraphs_written_once(spark):
    from docloom.plans.queries import QUERIES

    assert {f.split("/")[-2].split("-")[0:2] == ["row", "paragraphs"] for f in QUERIES["package_rows"](spark, "/root/testdata/sf0.001").inputFiles()} == {True}


def test_tables_that_several_steps_read_are_written_once(spark, folder):
    from docloom import store
    from docloom.plans.documents import corpus_tables

    files, names = docx.scan(spark, str(folder)), []
    corpus_tables(files, store.keep(docx.decode(files), "records"), lambda df, name: names.append(name) or store.keep(df, name))
    assert {"events", "latched", "flat-tables", "stacked-tables", "sections"} <= set(names)


def test_a_page_header_does_not_take_the_number_of_a_table_row(spark):
    schema = "doc_id string, ev string, pos long, tbl int, row int, cell int, tc string, grid_span int, para int, text string, bold boolean, num_id string, ilvl int, n_img int"
    cells = [("d", "table", 0, 0, 0, k, "t", 1, 0, "a  b", False, "1", 0, 0) for k in range(2)]  # one merged cell
    p = spark.createDataFrame([("d", "header", 0, None, None, None, None, None, 0, "head", False, "1", 0, 0), *cells, ("d", "table", 1, 0, 1, 0, "u", 1, 0, "c", False, "1", 0, 0)], schema)
    levels = spark.createDataFrame([("d", "1", 0, 1, "9.%1")], "doc_id string, num_id string, ilvl int, start int, lvl_text string")
    got = docx.clean_paragraphs(p, levels)
    assert sorted(got.columns) == sorted(p.columns)
    assert sorted((r.ev, r.pos, r.cell or 0, r.num_id, r.text) for r in got.collect()) == [("header", 0, 0, "1", "head"), ("table", 0, 0, "1", "9.1 a b"), ("table", 0, 1, "1", "a b"), ("table", 1, 0, "1", "9.2 c")]


def test_parts_are_cut_from_a_package_as_the_library_reads_them():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, how in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_LZMA)):
            z.writestr(f"p{k}", f"text {k} " * 90, how)
    for data in (out.getvalue(), b"in front" + out.getvalue()):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert [docx._part(z, data, n) for n in z.namelist()] == [z.read(n) for n in z.namelist()]
    data = out.getvalue().replace(b"text 0 text 0", b"text 0 test 0", 1)
    with zipfile.ZipFile(io.BytesIO(data)) as z, pytest.raises(zipfile.BadZipFile):
        docx._part(z, data, "p0")


def test_packages_of_two_versions_are_made_together(spark):
    from docloom.sources import packages

    one, two = [["9.Properties", "a"]], [["9.Properties", "b"]]
    schema = "doc_id string, rows array<array<string>>, box array<string>, header string, footer string, pictures array<string>, damaged boolean"
    docs = [("1", one, ["box"], "h", "f", ["PNG"], False), ("2", one, [], "h", "f", [], True)]
    alone = {r.doc_id: bytes(r.content) for r in packages.of_documents(spark.createDataFrame(docs, schema)).collect()}
    other = {r.doc_id: bytes(r.content) for r in packages.of_documents(spark.createDataFrame([(d[0], two, *d[2:]) for d in docs], schema)).collect()}
    both = packages.of_documents(spark.createDataFrame([(*d, two if d[0] == "1" else one) for d in docs], schema + ", before array<array<string>>")).collect()
    assert {r.doc_id: (bytes(r.content), bytes(r.before)) for r in both} == {"1": (alone["1"], other["1"]), "2": (alone["2"], alone["2"])}
