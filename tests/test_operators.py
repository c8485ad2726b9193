"""Rows, blocks, ingredient tables, numbering, search, pivot and checks on small tables."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, components, hierarchy, pivot, quality, rows
from docloom.sources.numbering import auto_numbers


def items_of(spark, table, section=9):
    df = spark.createDataFrame([("d", section, i, list(c), False) for i, c in enumerate(table)], "doc_id string, section int, pos long, cells array<string>, bold0 boolean")
    return [(r.kind, r.label, r.value) for r in rows.section_items(df).orderBy("pos").collect()]


def test_numbered_labels(spark):
    label = "9.19 Dynamic viscosity:\n9.20 Explosion characteristics\n9.21 Dust explosion level"
    assert items_of(spark, [(label, "<250 mPa·s\nNo data\nNot applicable")]) == [("field", "9.19 Dynamic viscosity", "<250 mPa·s"), ("field", "9.20 Explosion characteristics", "No data"), ("field", "9.21 Dust explosion level", "Not applicable")]
    got = items_of(spark, [("9.19 最低成膜温度MFFT/℃9.20 玻璃化温度Tg/℃：", "40\n45")])
    assert got == [("field", "9.19 最低成膜温度MFFT/℃", "40"), ("field", "9.20 玻璃化温度Tg/℃", "45")]
    assert len(items_of(spark, [("Combustion value:\nSaturated vapor pressure:", "Not applicable\nNo data")])) == 1


def test_continuations(spark):
    got = items_of(spark, [("物质或混合物的特殊危害：", "v1"), ("", "v2"), ("消防预防措施和保护设备：", "v3")], 5)
    assert got == [("field", "物质或混合物的特殊危害", "v1\nv2"), ("field", "消防预防措施和保护设备", "v3")]
    assert items_of(spark, [("7.1 安全操作防范：", "a"), ("", "b"), ("", "c"), ("", "d")], 7) == [("field", "7.1 安全操作防范", "a\nb\nc\nd")]
    assert items_of(spark, [("", "a"), ("", "b")], 7) == [("field", "", "a\nb")]


def test_tab_residue_and_stack(spark):
    assert items_of(spark, [("手部防护：\t内容", "v")], 8) == [("field", "手部防护", "内容 / v")]
    assert items_of(spark, [("产品名称：", "a"), ("制：", "b")], 1) == [("field", "产品名称", "a\nb")]
    got = items_of(spark, [("运输危险级别：\n包装类型：\n环境危险：\n· ADR", "9\nIII\n否\n多")], 14)
    assert got == [("field", "运输危险级别", "9"), ("field", "包装类型", "III"), ("field", "环境危险", "否\n· ADR\n多")] or got == [("field", "运输危险级别", "9"), ("field", "包装类型", "III"), ("field", "环境危险", "否\n多\n· ADR")]
    assert items_of(spark, [("8.1 暴露控制", ""), ("text",), ("x", "", "y")], 8) == [("line", "", "8.1 暴露控制"), ("line", "", "text"), ("line", "", "x / y")]


def units_of(spark, text, section=11, bold=()):
    df = spark.createDataFrame([("d", i, x, i in bold) for i, x in enumerate(text.split("\n"))], "doc_id string, pos long, line string, bold boolean")
    return [(r.kind, r.seq, r.label, r.value) for r in blocks.text_block_units(df, ["doc_id"], F.lit(section)).orderBy("ord").collect()]


def test_text_blocks(spark):
    got = units_of(spark, "急性毒性，经皮\n科学地研究，而不仅仅是合理地研究。\n急性毒性，吸入\n半数致死浓度（LC50） 大鼠: > 1.12 mg/l, 4 h\n试验环境: 粉尘/烟雾")
    assert got[:2] == [("field", "", "急性毒性，经皮", "科学地研究，而不仅仅是合理地研究。"), ("field", "", "急性毒性，吸入", "")] and [g[0] for g in got[2:]] == ["field", "field"]
    assert units_of(spark, "GHS分类：\n根据GHS不属于危险物\nGHS象形图：\n根据GHS不属于危险物") == [("field", "", "GHS分类", "根据GHS不属于危险物"), ("field", "", "GHS象形图", "根据GHS不属于危险物")]
    assert units_of(spark, "方法: OECD化学品测试指南423\n对产品的研究.") == [("field", "", "方法", "OECD化学品测试指南423\n对产品的研究.")]
    assert units_of(spark, "1.2产品使用建议和使用限\t涂料\n制：") == [("field", "1.2", "产品使用建议和使用限制", "涂料")]
    assert units_of(spark, "Heading:\n3.2\tComposition\nbody text of more than fifteen characters") == [("sub", "3.2", "Composition", ""), ("field", "", "Heading", "body text of more than fifteen characters")]
    assert units_of(spark, "· 该产品无可用的毒理学研究。") == [("note", "", "", "· 该产品无可用的毒理学研究。")]
    assert units_of(spark, "氟化橡胶 –FKM:厚度≧0.4mm；穿透时间≧480min.")[0][2] == "氟化橡胶 –FKM"


def test_section_two_blocks(spark):
    got = units_of(spark, "健康危害\n皮肤腐蚀/刺激健康危害    1B类\n标签要素\nGHS-象形图 丙二醇甲醚\n存储存储已锁定。\nH302: Harmful\nWaste Disposal Method here", 2, bold=(6,))
    assert got == [
        ("sub", "", "健康危害", ""), ("field", "", "皮肤腐蚀/刺激健康危害", "1B类"), ("sub", "", "标签要素", ""), ("field", "", "GHS-象形图", "丙二醇甲醚"),
        ("field", "", "存储", "存储已锁定。\nH302: Harmful"), ("field", "", "Waste Disposal Method here", ""),
    ]


def test_unified_rows(spark):
    data = [("d", 8, 0, "line", "", "8.1 暴露控制", False), ("d", 8, 1, "field", "8.2 手", "a", False), ("d", 8, 2, "line", "", "标题：", False), ("d", 8, 3, "line", "", "内容是长长长长长长长长长长长长长长长的。", False), ("d", 8, 4, "field", "", "sum", False)]
    df = spark.createDataFrame(data, "doc_id string, section int, pos long, kind string, label string, value string, bold boolean")
    got = [(r.ord, r.kind, r.seq, r.label, r.idx, r.span) for r in blocks.unified_rows(df).orderBy("ord").collect()]
    assert got == [(1, "sub", "8.1", "暴露控制", 2, False), (2, "field", "8.2", "手", 0, False), (3, "field", "", "标题", 3, False), (4, "field", "", "", 1, True)]


def test_unified_rows_of_long_blocks_and_bold_lines(spark):
    text = "\n".join(f"line number {i} of this block" for i in range(1500))
    data = [("d", 8, 0, 0, "line", text, [False] * 1500), ("d", 8, 1, 0, "line", "after it all, a line of its own", [False]), ("d", 9, 0, 0, "line", "Waste Disposal Method of all\nplain text, which is long enough", [True, False])]
    df = spark.createDataFrame(data, "doc_id string, section int, pos long, sub int, kind string, value string, bold array<boolean>").withColumn("label", F.lit(""))
    got = blocks.unified_rows(df).orderBy("section", "ord").collect()
    assert [r.value for r in got if r.section == 8] == [*text.split("\n"), "after it all, a line of its own"]
    assert [(r.kind, r.label, r.value) for r in got if r.section == 9] == [("field", "Waste Disposal Method of all", "plain text, which is long enough")]


def test_split_lines(spark):
    texts = ["8.1 暴露控制", "氟化橡胶 –FKM:厚度≧0.4mm；穿透时间≧480min.", "· 该产品无可用的毒理学研究。", "", None]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, pos long, line string")
    got = [(r.kind, r.label, r.value) for r in blocks.split_lines(df).orderBy("pos").collect()]
    assert got[0] == ("sub", "暴露控制", "") and got[1][:2] == ("field", "氟化橡胶 –FKM") and got[2:] == [("note", "", texts[2]), ("note", "", ""), ("note", "", "")]


def test_component_cells(spark):
    df = spark.createDataFrame([(1, "封闭型脂肪族聚异氰酸酯\n二丙二醇二甲醚\n水\nN,N-二甲基乙醇胺", "商业机密\n872-50-4\n7732-18-5\n108-01-0", "45-55\n5-10\n35-45\n0.5-2"), (2, "\n", "x", "y"), (3, "a\n\nb", None, "1")], "doc_id int, name_cell string, cas_cell string, conc_cell string")
    got = [(r.doc_id, r.idx, r.name, r.cas, r.conc) for r in components.split_cells(df).orderBy("doc_id", "idx").collect()]
    assert got == [(1, 0, "封闭型脂肪族聚异氰酸酯", "商业机密", "45-55"), (1, 1, "二丙二醇二甲醚", "872-50-4", "5-10"), (1, 2, "水", "7732-18-5", "35-45"), (1, 3, "N,N-二甲基乙醇胺", "108-01-0", "0.5-2"), (2, 0, "", "", ""), (3, 0, "a", "", "1"), (3, 1, "b", "", "")]


FLAT = [
    ("3.1 Mixtures\nDescription: Polymer\nDangerous components: Void\n3.2 Composition\nIngredient\tCAS\tNo. %(w/w)\nAcrylic polymer\t9003-01-4 40±1\nDeionized water 7732-18-5\t60±1", [("Acrylic polymer", "9003-01-4", "40±1"), ("Deionized water", "7732-18-5", "60±1")], 0),
    ("OTHER\nConcentration\t \t Components\t \t CAS-No.\n0.5 - 5%\t Dimethylethanolamine\t 108-01-0\nThis product contains no more.", [("Dimethylethanolamine", "108-01-0", "0.5-5%")], 1),
    ("3.2 Ingredients \nChemical Name CAS No. % (w/w) \nAliphatic Polycarbodiimide Proprietary 35-45\nWater 7732-18-5 55-65", [("Aliphatic Polycarbodiimide", "Proprietary", "35-45"), ("Water", "7732-18-5", "55-65")], 0),
    ("no table\nat all", [], 0),
]


@pytest.mark.parametrize(("text", "want", "post"), FLAT)
def test_flat_tables(spark, text, want, post):
    got = components.flat_tables(spark.createDataFrame([(1, 0, text)], "doc_id int, pos int, text string")).orderBy("i").collect()
    assert [(r.name, r.cas, r.conc) for r in got if r.part == "component"] == want
    assert sum(r.part == "post" for r in got) == post


def test_stacked_tables(spark):
    df = spark.createDataFrame([(1, 0, ["Chemicals\nPolyurethane dispersion\nN-ethylpyrrolidone", "CAS NO.\nTrade Secrets\n2687-91-4", "Content%（w/w）\n25.0~35.0\n0.5~1.5"]), (1, 1, ["a\nb", "c"])], "doc_id int, pos int, cells array<string>")
    got = [(r.i, r.name, r.cas, r.conc) for r in components.stacked_tables(df).orderBy("i").collect()]
    assert got == [(1, "Polyurethane dispersion", "Trade Secrets", "25.0~35.0"), (2, "N-ethylpyrrolidone", "2687-91-4", "0.5~1.5")]


def test_auto_numbers(spark):
    p = spark.createDataFrame([("d", i, "1", lvl) for i, lvl in enumerate([0, 0, 1, 1, 0, 1])] + [("d", 9, "7", 0)], "doc_id string, pos long, num_id string, ilvl int")
    levels = spark.createDataFrame([("d", "1", 0, 1, "9.%1"), ("d", "1", 1, 1, "%1.%2")], "doc_id string, num_id string, ilvl int, start int, lvl_text string")
    assert [r.number for r in auto_numbers(p, levels).orderBy("pos").collect()] == ["9.1", "9.2", "3.1", "3.2", "9.3", "4.1", ""]
    # a template of level 0 sees the deeper counter of the item before
    levels = spark.createDataFrame([("d", "1", 0, 1, "%1-%2"), ("d", "1", 1, 1, "%1.%2")], "doc_id string, num_id string, ilvl int, start int, lvl_text string")
    assert [r.number for r in auto_numbers(p, levels).orderBy("pos").collect()] == ["1-1", "2-1", "3.1", "3.2", "3-3", "4.1", ""]


def test_merged_cells(spark):
    df = spark.createDataFrame([("d", 0, 0, "t1", "a"), ("d", 0, 1, "t1", "a"), ("d", 0, 2, "t2", "b"), ("d", 0, 3, "t3", "b"), ("d", 0, 4, "t4", "a")], "doc_id string, pos long, k int, tc string, text string")
    assert rows.cells_to_rows(rows.dedupe_cells(df)).first().cells == ["a", "b", "a"]


@pytest.fixture
def entries(spark):
    data = [
        ("a", 1, 9, "9.理化", "", "intro", "x", "field"), ("a", 2, 9, "9.理化", "9.1", "外观", "乳白色液体", "field"), ("a", 3, 9, "9.理化", "", "", "a note", "note"), ("a", 4, 9, "9.理化", "9.3", "闪点（℃）", "", "field"),
        ("a", 5, 8, "8.暴露", "8.1", "暴露控制", "", "sub"), ("a", 6, 8, "8.暴露", "", "手部防护", "丁腈", "field"), ("b", 1, 9, "9.理化", "9.2", "闪点", "95 ℃", "field"), ("b", 2, 9, "9.理化", "9.2", "闪点", "96", "field"),
    ]
    return spark.createDataFrame(data, "doc_id string, pos long, section int, big_title string, seq string, label string, value string, kind string")


def test_search_and_tree(spark, entries):
    e = hierarchy.with_sub_titles(entries)
    pos = lambda df: sorted((r.doc_id, r.section, r.pos) for r in df.collect())
    assert pos(hierarchy.search_all(e, "乳白 外观")) == [("a", 9, 2)]
    assert pos(hierarchy.search_any(e, "丁腈 nothing")) == [("a", 8, 5), ("a", 8, 6)]
    assert pos(hierarchy.search_any(e, "外观")) == [("a", 9, 2), ("a", 9, 3)]
    assert len(pos(hierarchy.search_any(e, "理化"))) == 6 and len(pos(hierarchy.search_any(e, "9", "section"))) == 6
    assert len(pos(hierarchy.search_all(e, "  "))) == 8
    assert hierarchy.get_field(e, 9, "闪点：").collect()[0].value == "95 ℃"
    flat = [(r.section, r.sub_title, r.label) for r in hierarchy.flatten_tree(e).where("doc_id = 'a'").orderBy("ord").collect()]
    assert flat == [(8, "8.1 暴露控制", "暴露控制"), (8, "8.1 暴露控制", "手部防护"), (9, "9.1 外观", "外观"), (9, "9.1 外观", ""), (9, "", "intro")]
    t = {(r.doc_id, r.section): r for r in hierarchy.tree(entries).collect()}
    assert [b.title for b in t["a", 9].big_titles] == ["外观", "闪点（℃）"] and [f.label for f in t["a", 9].direct_fields] == ["intro"]
    many = hierarchy.extract_many(entries, e, "丁腈").collect()
    assert {r.doc_id: r.pos for r in many} == {"a": 6, "b": None}


def test_pivot(spark, entries):
    wide, columns = pivot.build_pivot(entries, entries)
    got = {r.doc_id: r.asDict() for r in wide.collect()}
    assert got["a"]["9_闪点"] == "无数据" and got["b"]["9_闪点"] == "95 ℃" and got["b"]["9_外观"] == "无数据" and got["a"]["9_(总结句)"] == "a note"
    c = {(r.section, r.norm_label): r for r in columns.collect()}
    assert c[9, "闪点"].seq == "9.2" and (8, "暴露控制") not in c and c[9, "intro"].col_ord == 1
    docs = spark.createDataFrame([("a", "PU-1 v2.docx"), ("b", "x.docx")], "doc_id string, file_name string")
    assert {r.doc_id: r.row_key for r in pivot.row_keys(docs, entries).collect()} == {"a": "PU-1", "b": "x"}


def test_checks(spark, entries):
    gaps = {r.doc_id: r.missing for r in quality.number_gaps(entries.select("doc_id", F.concat_ws(" ", "seq", "label").alias("label"))).collect()}
    assert gaps == {"a": "9.2"}
    assert quality.missing_sections(entries, entries).count() == 14 + 15
    r = spark.createDataFrame([("a", 1, "field", 0, True), ("a", 1, "field", 1, True)], "doc_id string, section int, kind string, idx int, editable boolean")
    o = spark.createDataFrame([("a", 1, "field", 0, False, 1), ("a", 1, "field", 0, True, 2), ("a", 1, "field", 1, False, 1)], "doc_id string, section int, kind string, idx int, editable boolean, at long")
    assert [x.editable for x in quality.apply_overrides(r, o).orderBy("idx").collect()] == [True, False]
    places = spark.createDataFrame([("a", 2, 1, "[象形图×2]"), ("a", 2, 5, "x [象形图]")], "doc_id string, section int, pos long, text string")
    images = spark.createDataFrame([("a", 2, k) for k in range(4)], "doc_id string, section int, ord int")
    assert [x.place for x in quality.allocate_images(places, images).orderBy("ord").collect()] == [1, 1, 5, None]
    odd = [("b", 2, 1, "[象形图×0]"), ("b", 2, 2, "[象形图×２] [象形图×9]"), ("b", 2, 3, "[象形图×99999999999999999999999]"), ("b", 2, 4, "[象形图]"), ("c", 2, 1, "[象形图x2]")]
    images = spark.createDataFrame([(d, 2, k) for d in "bc" for k in range(5)], "doc_id string, section int, ord int")
    got = quality.allocate_images(spark.createDataFrame(odd, places.schema), images).orderBy("doc_id", "ord").collect()
    assert [x.place for x in got] == [2, 2, 3, 3, 3] + [None] * 5


def test_pivot_of_more_columns_than_one_table_holds(spark, tmp_path):
    rows = [(d, p, 1 + p % 16, f"label {(d * 31 + p) % 700}", "" if p % 5 else "9.1", f"v{d}.{p}" if p % 4 else " ", "note" if p % 50 == 7 else "field") for d in range(12) for p in range(200)]
    e = spark.createDataFrame(rows, "doc_id long, pos long, section int, label string, seq string, value string, kind string")
    p = pivot.pivot_input(e)
    columns, cells = pivot.pivot_columns(p), pivot.pivot_cells(p)
    n = columns.count()
    assert n > 600
    whole = {(r.doc_id, r.section, r.kind, r.norm_label): r.value for r in pivot.pivot_grid(e, columns, cells).collect()}
    assert len(whole) == 12 * n and {(r.doc_id, r.section, r.kind, r.norm_label): r.value for r in pivot.pivot_grid(e, columns, cells, 100).collect()} == whole
    with pytest.raises(ValueError, match="write_slices"):
        pivot.build_pivot(e, e, most=100)
    named = pivot.write_slices(e, columns, cells, str(tmp_path / "wide"), 250).orderBy("number").collect()
    assert [r.number for r in named] == list(range(n)) and max(r.slice for r in named) == (n - 1) // 250
    got = {}
    for k in range((n - 1) // 250 + 1):
        table = spark.read.parquet(str(tmp_path / "wide" / "cells" / f"slice={k}"))
        mine = [r for r in named if r.slice == k]
        assert table.columns == ["doc_id", *[r.name for r in mine]] and table.count() == 12
        got |= {(row.doc_id, r.section, r.kind, r.norm_label): row[r.name] for row in table.collect() for r in mine}
    assert got == whole
    assert pivot.write_slices(e.limit(0), columns.limit(0), cells.limit(0), str(tmp_path / "none")).count() == 0


def test_number_gaps_of_any_numbers(spark):
    labels = {"a": ["9.2 x", "9.2000000000 y"], "b": ["9.99999999999", "9.1"], "c": ["9.１ a\n9.٣ b", "9.5"], "d": ["9." + "9" * 60, "9.7", "9.8"], "e": ["none", "8.1", " 9.1"], "f": ["9.1", "9.103"], "g": ["9.1", "9.102", "9.102"]}
    df = spark.createDataFrame([(d, x) for d, v in labels.items() for x in v], "doc_id string, label string")
    got = {r.doc_id: r.missing for r in quality.number_gaps(df).collect()}
    assert got == {"a": "9.3-9.1999999999", "b": "9.2-9.99999999998", "c": "9.2, 9.4", "f": "9.2-9.102", "g": ", ".join(f"9.{n}" for n in range(2, 102))}
    assert {(r.doc_id, int(r.first), int(r.last)) for r in quality.gap_ranges(df).collect()} >= {("a", 3, 1999999999), ("c", 2, 2), ("c", 4, 4)}


def test_flat_tables_asks_for_columns_of_lines_that_name_cas_only(spark):
    from docloom.operators import components

    x = spark.createDataFrame([(1, 0, "a\tb\nName\tcAs No.\t%\nWater\t7732-18-5\t60"), (2, 0, "Name\t%\nWater\t7732-18-5\t60")], "doc_id int, pos int, text string")
    flat = components.flat_tables(x)
    assert [(r.doc_id, r.i, r.part) for r in flat.orderBy("i").collect()] == [(1, 0, "pre"), (1, 1, "header"), (1, 2, "component")]
    assert "Contains(lower(line" in flat._jdf.queryExecution().executedPlan().toString()
