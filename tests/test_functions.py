"""Text rules on the fixed cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y"))
    return [r.y if not hasattr(r.y, "asDict") else tuple(r.y) for r in sorted(df.collect())]


def cell_values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x array<string>").select("i", f(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect())]


def test_split_seq(spark):
    got = values(spark, T.split_seq, ["8.1 暴露控制", "9.23 其他信息", "1.1产品名称", "手部防护", "3 / 5", "GB/T 16483", "9.3 pH值（1%水溶液）", None, ""])
    assert got == [("8.1", "暴露控制"), ("9.23", "其他信息"), ("1.1", "产品名称"), ("", "手部防护"), ("", "3 / 5"), ("", "GB/T 16483"), ("9.3", "pH值（1%水溶液）"), ("", ""), ("", "")]


def test_component_normalisers(spark):
    assert values(spark, T.component_conc, ["＞45", "＜1", "30.0～40.0", "> 30", "95±1", "无数据", None]) == [">45", "<1", "30.0~40.0", ">30", "95±1", "无数据", ""]
    assert values(spark, T.component_name, ["N,N－二甲基乙酰胺(DMAC)", "2-正辛基-4异噻唑啉--3酮", "N,N二甲基乙醇胺"]) == ["N,N-二甲基乙酰胺(DMAC)", "2-正辛基-4异噻唑啉-3酮", "N,N二甲基乙醇胺"]
    got = values(spark, T.component_cas, ["商业机密", "待确认", "无单一", "——", "－", " 7732-18-5 ", "55965-84-9", "Trade Secrets", "Business secret", "1-2/3-4"])
    assert got == ["商业机密", "待确认", "无单一", "", "", "7732-18-5", "55965-84-9", "Trade Secrets", "Business secret", "1-2/3-4"]


def test_section_titles(spark):
    long = "SECTION 1: Identification of the substance/mixture and of the company/undertaking"
    got = values(spark, T.section_title, ["v1.物料及供应商标识", "l1.物料及供应商标识", long, "pH值（1%水溶液）", "Version：V1.0", "8.1 暴露控制", "16、其他信息", "17.没有", None])
    assert got == [(1, "物料及供应商标识"), (1, "物料及供应商标识"), (1, long[11:]), (None, None), (None, None), (None, None), (16, "其他信息"), (None, None), (None, None)]


def test_component_header_rows(spark):
    rows = [["Chemical Name", "CAS Number", "%（w/w）"], ["Chemical name", "CAS NO.", "%（w/w）"], ["Concentration", "Components", "CAS-No."], ["Ingredient CAS %\nWater 7732-18-5 5%"], ["", "CAS", "%"]]
    assert cell_values(spark, T.is_component_header, rows) == [True, True, True, False, False]


@pytest.mark.parametrize(("text", "want"), [("42±2%", True), ("乳白色液体", True), ("乙醇", True), ("丁腈橡胶–NBR", True), ("EN 374-3", True), ("1.06g/cm3", True), ("3.1 产品类型", False), ("9.5闪点", False), ("14.1UN-Number", False), ("Odor", False), ("闪点", False)])
def test_value_shape(spark, text, want):
    assert values(spark, T.is_value_shape, [text]) == [want]


def test_labels_and_headings(spark):
    assert values(spark, T.normalize_label, [" 产品\xa0名称 ：", "a  b.", None]) == ["产品 名称", "a b", ""]
    assert values(spark, T.looks_like_label, ["Fire", "· After inhalation", "42±2%", "Odor:", ""]) == [True, False, False, True, False]
    assert values(spark, T.is_heading, ["急性毒性，经口", "无数据资料", "科学地研究，而不仅仅是合理地研究。", "RA-15000", "2B类", "[象形图]x"]) == [True, False, False, False, False, False]
    assert values(spark, lambda c: T.is_heading(c, True), ["Waste Disposal Method of all", "根据EC指令2006/121/EG,无可用的接触限值信息"]) == [True, False]
    assert values(spark, T.class_row, ["皮肤腐蚀/刺激健康危害              1B类", "物理危害  未分类。", "no class"]) == [("皮肤腐蚀/刺激健康危害", "1B类"), ("物理危害", "未分类"), (None, None)]


def test_free_components(spark):
    got = values(spark, T.component_of_text, ["Acrylic polymer 9003-01-4 40±1", "0.5 - 5% Dimethylethanolamine 108-01-0", "Aliphatic Polycarbodiimide Proprietary 35-45", "Water 55-65", "GHS 分类 3 H226"])
    assert got == [("Acrylic polymer", "9003-01-4", "40±1"), ("Dimethylethanolamine", "108-01-0", "0.5-5%"), ("Aliphatic Polycarbodiimide", "Proprietary", "35-45"), None, None]
    assert values(spark, T.mixture_row, ["· polyether urethane", "polyether urethane 20±1%（w/w） /", "Description: Polymer", "Void", ""]) == [("polyether urethane", ""), ("polyether urethane", "20±1%（w/w）"), ("Polymer", ""), None, None]


def test_page_fields(spark):
    got = values(spark, T.page_fields, ["3 / 5", "P修订日期：2020-01-01", "英德市国彩精细化工有限公司  BL-8128W-MSDS", "物料安全数据表", "PEA-4139", "批次: 7", ""])
    assert [[tuple(x) for x in g] for g in got] == [
        [("页码", "3 / 5", False)], [("修订日期", "2020-01-01", False)], [("公司名称", "英德市国彩精细化工有限公司", False), ("产品型号", "BL-8128W-MSDS", False)],
        [("物料安全数据表", "", False)], [("PEA-4139", "", True)], [("批次", "7", True)], [],
    ]


def test_hints(spark):
    assert values(spark, T.hint_section, ["急救措施", "储存条件", "nothing"]) == [4, 7, None]
    assert values(spark, T.textbox_section, ["4.1 Description", "4 x"]) == [4, None]
    assert values(spark, T.textbox_hint, ["Chemical stability: ok", "x"]) == [10, None]


def test_pivot_labels(spark):
    df = spark.createDataFrame([(9, "闪点（℃）"), (9, "PH值"), (8, "闪点（℃）"), (9, "水中溶解度")], "s int, x string")
    assert [r.y for r in df.select(T.pivot_label(F.col("s"), F.col("x")).alias("y")).collect()] == ["闪点", "pH值", "闪点（℃）", "水溶性"]
