"""Text rules as column expressions: labels, titles, values, ingredients. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

WS = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(X.WHITE))


def text(c: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def once(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(text(c), WS + "+", " "))


def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit of Unicode beyond ASCII, and the ASCII digit of each."""
    import sys
    import unicodedata

    if not _digits:
        found = [(chr(c), d) for c in range(128, sys.maxunicode + 1) if (d := unicodedata.decimal(chr(c), None)) is not None]
        _digits.extend(("".join(c for c, _ in found), "".join(str(d) for _, d in found)))
    return _digits[0], _digits[1]


_digits: list[str] = []


def whole_number(c: Column, kind: str = "decimal(37,0)") -> Column:
    """Decimal digits of any script as a number; null for no digits, or for more than the type holds."""
    return F.translate(c, *_decimal_digits()).try_cast(kind)


def any_word(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def has_colon(c: Column) -> Column:
    return c.contains("：") | c.contains(":")


# ---- labels, titles, headings ----


def normalize_label(c: Column) -> Column:
    return F.rtrim(squeeze(c), F.lit("：:。 ."))


def section_title(c: Column) -> Column:
    """struct(n, title) of a section title, both null for other text."""
    return once(squeeze(c), section_title_of)


def section_title_of(t: Column) -> Column:
    """section_title of squeezed text; a column of its own keeps the squeeze from being done for each test."""
    body = F.when(t.rlike(r"^[a-zA-Z]"), strip(F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
    # try_cast: text without a number gives null
    number = lambda x, p: group(x, p).try_cast("int")
    parts = once(body, lambda x: F.struct(number(t, X.TITLE_EN).alias("en"), number(x, X.TITLE_CN).alias("cn"), F.regexp_extract(x, X.TITLE_CN, 2).alias("title")))
    # most rows are no titles, and what a title can't have shows without a pattern
    can = (F.lower(F.substring(t, 1, 7)) == "section") | ((t != "") & (F.length(t) <= 60) & ~has_colon(t))
    none = F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("title"))
    return F.when(can, once(parts, lambda p: _title(t, p["en"], p["cn"], p["title"]))).otherwise(none)


def _title(t: Column, n_en: Column, n_cn: Column, title: Column) -> Column:
    is_en = t.rlike(X.TITLE_EN)
    ok_cn = (F.length(t) <= 60) & n_cn.between(1, 16) & ~has_colon(title) & ~title.rlike(r"\p{Nd}+\.\p{Nd}|^\p{Nd}")
    kind = F.when(is_en & (F.length(t) > 100), 0).when(is_en & n_en.between(1, 16), 1).when(ok_cn, 2).otherwise(0)
    return once(kind, lambda k: F.struct(F.when(k == 1, n_en).when(k == 2, n_cn).alias("n"), F.when(k == 1, strip(F.regexp_extract(t, X.TITLE_EN, 2))).when(k == 2, strip(title)).alias("title")))


def first_hint(c: Column, hints) -> Column:
    t = F.lower(strip(text(c)))
    return reduce(lambda a, kv: a.when(t.contains(kv[0].lower()), kv[1]), hints[1:], F.when(t.contains(hints[0][0].lower()), hints[0][1]))


def hint_section(c: Column) -> Column:
    return first_hint(c, X.SECTION_HINTS)


def textbox_hint(c: Column) -> Column:
    return first_hint(c, X.TEXTBOX_HINTS)


def textbox_section(c: Column) -> Column:
    """Section of a text-box block that begins with N.N and a space."""
    return group(text(c), r"^\s*(\p{Nd}{1,2})\.\p{Nd}+[\s\p{Z}]").try_cast("int")


def split_seq(c: Column) -> Column:
    """struct(seq, label): a leading number and the title after it."""
    t = strip(text(c))
    p = r"^(\p{Nd}+(?:\.\p{Nd}+)*)\.?[\s\p{Z}]*([一-鿿A-Za-z][\s\S]*)$"
    hit = t.rlike(p)
    return F.struct(F.when(hit, F.regexp_extract(t, p, 1)).otherwise("").alias("seq"), F.when(hit, strip(F.regexp_extract(t, p, 2))).otherwise(t).alias("label"))


def full_label(seq: Column, label: Column) -> Column:
    return F.concat_ws(" ", F.nullif(seq, F.lit("")), F.nullif(label, F.lit("")))


def is_heading(c: Column, bold: Column | bool = False) -> Column:
    t, bold = text(c), bold if isinstance(bold, Column) else F.lit(bold)
    sentence = t.rlike(r"[,，;；、/]|\p{Nd}{3,}")
    never = t.startswith(X.PICTOGRAM_MARK) | t.isin(*X.NOT_HEADINGS) | t.rlike(r"^[A-Za-z]{1,8}[-\s\p{Z}]?\p{Nd}|^\p{Nd}+[A-Za-z]|[。.！？!?]$")
    # lengths first: of long lines nothing else is looked at
    return (F.length(t) <= F.when(bold, 60).otherwise(15)) & ~never & ((F.length(t) <= 15) | ~sentence)


def class_row(c: Column) -> Column:
    """struct(name, category) of a hazard class row, both null for other text."""
    t = strip(text(c))
    return F.struct(strip(group(t, X.HAZARD_CLASS, 1)).alias("name"), strip(group(t, X.HAZARD_CLASS, 2)).alias("category"))


# ---- rows ----


def is_value_shape(c: Column) -> Column:
    t = strip(text(c))
    numbered = t.rlike(r"^\p{Nd}+\.\p{Nd}+[\s\p{Z}]+[^\s\p{Z}]") | t.rlike(r"^\p{Nd}{1,2}[\s\p{Z}]*[.、．][\s\p{Z}]*\p{Nd}{1,2}[\s\p{Z}]*[一-鿿]") | t.rlike(r"^\p{Nd}+\.\p{Nd}+[\s\p{Z}]*[A-Za-z][A-Za-z0-9\-]+[A-Za-z]$")
    never = (t == "") | (F.length(t) > 24) | has_colon(t) | any_word(t, X.FIELD_WORDS) | numbered
    shape = t.rlike(r"^[-−+±＞≥≤<>]?[\s\p{Z}]*\p{Nd}") | (t.rlike(X.UNITS) & (F.length(t) <= 12)) | t.rlike(X.COLOUR_STATE) | t.rlike(X.CHEMICAL_NAME) | t.rlike(X.GLOVE_MATERIAL) | t.rlike(r"^[A-Z]{1,6}[-\s\p{Z}]?\p{Nd}")
    return ~never & shape


def looks_like_label(c: Column) -> Column:
    t = strip(text(c))
    return (t != "") & (F.length(t) <= 30) & (has_colon(t) | any_word(t, X.FIELD_WORDS) | (~t.rlike(r"^[·•\-][\s\p{Z}]") & ~is_value_shape(t)))


def is_component_header(cells: Column) -> Column:
    """cells: array<string>."""
    at = lambda i: F.coalesce(F.get(cells, i), F.lit(""))
    joined = F.lower(F.array_join(cells, " "))
    compact = F.forall(cells, lambda c: ~c.contains("\n") & (F.length(c) <= 60))
    words = joined.rlike("化学品名称|成分名称|组分|ingredient|component|chemicals?") & joined.contains("cas") & joined.rlike("含量|浓度|concentration|%|w/w|weight")
    three = reduce(lambda a, b: a | b, [at(0).contains(a) & (at(1).contains(b) | F.lower(at(1)).contains("cas")) & (at(2).contains(c) | at(2).contains("%") | F.lower(at(2)).contains("w/w")) for a, b, c in X.COMPONENT_HEADERS])
    return F.coalesce((strip(at(0)) != "") & compact & (words | ((F.size(cells) >= 3) & three)), F.lit(False))


def is_field_row(cells: Column) -> Column:
    left = strip(F.coalesce(F.get(cells, 0), F.lit("")))
    return (F.size(cells) >= 2) & (F.coalesce(F.get(cells, 0), F.lit("")) != "") & (has_colon(left) | any_word(F.lower(left), [w.lower() for w in X.FIELD_WORDS]))


def is_sub_heading(cells: Column) -> Column:
    left, second = strip(F.coalesce(F.get(cells, 0), F.lit(""))), strip(F.coalesce(F.get(cells, 1), F.lit("")))
    return (second == "") & left.rlike(r"^\p{Nd}+\.\p{Nd}+[\s\p{Z}]*[^\s\p{Z}]+") & ~has_colon(left)


def row_class(cells: Column, bold: Column) -> Column:
    """continuation, line, sub, field or joined (a line of all cells): the order of tests is part of the rule."""
    at = lambda i: F.coalesce(F.get(cells, i), F.lit(""))
    rest = F.exists(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: strip(c) != "")
    blank = strip(at(0)) == ""
    return (
        F.when(blank & rest, "continuation").when(blank, "blank").when(F.size(cells) == 1, "line").when(is_sub_heading(cells), "sub")
        .when(is_field_row(cells) | (bold & looks_like_label(at(0))), "field").otherwise("joined")
    )


# ---- ingredients ----


def half_width(c: Column) -> Column:
    return F.translate(text(c), X.FULL_WIDTH, X.HALF_WIDTH)


def component_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(squeeze(half_width(c)), "-{2,}", "-"), F.lit(X.EDGE_PUNCTUATION))


def component_cas(c: Column) -> Column:
    return once(strip(text(c)), lambda t0: once(F.replace(half_width(t0), F.lit(" "), F.lit("")), lambda t: _placeholder_or(t0, t)))


def _placeholder_or(t0: Column, t: Column) -> Column:
    kept = t.isin(*X.CAS_PLACEHOLDERS) | F.lower(t).isin(*X.CAS_PLACEHOLDERS_EN)
    return F.when(t0.rlike(X.CAS_PLACEHOLDER_SPACED), t0).when(kept, t).when(t.rlike(r"^[\-—–－~·]+$"), "").otherwise(t)


def component_conc(c: Column) -> Column:
    return F.replace(half_width(c), F.lit(" "), F.lit(""))


def has_full_width(c: Column) -> Column:
    return text(c).rlike(f"[{X.FULL_WIDTH_MARKS}]")


def column_kind(c: Column) -> Column:
    low = F.lower(strip(text(c)))
    return F.when(low.rlike(X.CAS_COLUMN), "cas").when(low.rlike(X.NAME_COLUMN) & ~low.rlike(X.CONC_COLUMN), "name").when(low.rlike(X.CONC_COLUMN), "conc").otherwise("")


def take_out(t: Column, found: Column) -> Column:
    """t with the first `found` in it as a space; t where found is null or empty."""
    return F.when(F.coalesce(found, F.lit("")) == "", t).otherwise(F.overlay(t, F.lit(" "), F.instr(t, found), F.length(found)))


def extract_cas(c: Column) -> Column:
    """struct(cas, rest): a placeholder first, else a CAS number."""
    return once(text(c), lambda t: once(_cas_in(t), lambda found: F.struct(found.alias("cas"), take_out(t, found).alias("rest"))))


def _cas_in(t: Column) -> Column:
    return F.when(t.rlike(X.CAS_PLACEHOLDER_IN_TEXT), F.regexp_extract(t, X.CAS_PLACEHOLDER_IN_TEXT, 1)).otherwise(F.regexp_extract(t, X.CAS_IN_TEXT, 1))


def extract_conc(c: Column) -> Column:
    """struct(conc, rest): a range, a percentage, or a bare number."""
    return once(text(c), lambda t: once(F.regexp_extract(t, X.CONC_IN_TEXT, 1), lambda found: F.struct(F.replace(found, F.lit(" "), F.lit("")).alias("conc"), take_out(t, found).alias("rest"))))


def component_of_text(c: Column, with_tab: bool = False) -> Column:
    """struct(name, cas, conc) of a free ingredient row, null where it is none: a CAS is needed (with_tab: or a concentration)."""

    def named(one: Column, two: Column, name: Column) -> Column:
        found = (one["cas"] != "") | ((two["conc"] != "") if with_tab else F.lit(False))
        return F.when((name != "") & found, F.struct(name.alias("name"), one["cas"].alias("cas"), two["conc"].alias("conc")))

    name_of = lambda two: F.regexp_replace(squeeze(two["rest"]), r"[\s\p{Z}\-—–]+$", "")
    return once(extract_cas(c), lambda one: once(extract_conc(one["rest"]), lambda two: once(name_of(two), lambda name: named(one, two, name))))


def is_mixture_header(c: Column) -> Column:
    return strip(F.substring_index(text(c), "\n", 1)).rlike(r"(?i)^(?:\p{Nd}+(?:\.\p{Nd}+)?\s*)?mixtures\b")


def mixture_row(c: Column) -> Column:
    """struct(name, conc) of a row after a mixture header, null where it names no ingredient."""
    v = F.regexp_replace(F.replace(text(c), F.lit("\xa0"), F.lit(" ")), r"^[\s\p{Z}·•\-]+", "")
    return once(strip(F.regexp_replace(F.regexp_replace(v, r"(?i)^Description\s*:\s*", ""), r"\s*/\s*$", "")), _mixture_parts)


def _mixture_parts(v: Column) -> Column:
    low = F.lower(v)
    none = (v == "") | (low == "void") | low.startswith("dangerous components") | low.contains("no hazardous components") | low.startswith("composition")
    tail = X.MIXTURE_TAIL
    name = F.rtrim(F.regexp_replace(v, tail, ""), F.lit(X.WHITE))
    return F.when(~none, F.struct(F.when(v.rlike(tail), name).otherwise(v).alias("name"), F.regexp_extract(v, tail, 1).alias("conc")))


# ---- page headers and footers, search, pivot ----


def page_fields(c: Column) -> Column:
    """array<struct(label, value, editable)> of a header or footer line."""
    # a lambda has the trimmed text worked out once, and keeps the generated code small
    return once(strip(text(c)), _page_fields)


def _page_fields(t: Column) -> Column:
    number = X.PAGE_NUMBER
    pair = lambda sep: (strip(F.substring_index(t, sep, 1)), strip(F.substring(t, F.instr(t, sep) + 1, F.length(t))))
    (a1, b1), (a2, b2) = pair("："), pair(":")
    wide, narrow = t.contains("：") & (a1 != "") & (b1 != ""), t.contains(":") & (a2 != "") & (b2 != "")
    compound = X.PAGE_COMPOUND
    label, value = F.when(wide, a1).when(narrow, a2).otherwise(t), F.when(wide, b1).when(narrow, b2).otherwise("")
    label = F.when(label.rlike(X.PAGE_STRAY_LETTER), F.substring(label, F.lit(2), F.length(label))).otherwise(label)
    field = lambda a, b, e: F.struct(a.alias("label"), b.alias("value"), e.alias("editable"))
    no = F.lit(False)
    one = F.array(field(label, value, ~(label.rlike(number) | any_word(label, X.PAGE_FIXED_WORDS))))
    two = F.array(field(F.lit("公司名称"), strip(F.regexp_extract(t, compound, 1)), no), field(F.lit("产品型号"), strip(F.regexp_extract(t, compound, 2)), no))
    return F.when(t == "", F.array().cast("array<struct<label:string,value:string,editable:boolean>>")).when(t.rlike(number), F.array(field(F.lit("页码"), t, no))).when(~(wide | narrow) & t.rlike(compound), two).otherwise(one)


def search_norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(text(c), X.SEARCH_DROPPED, ""))


def pivot_label(section: Column, label: Column) -> Column:
    """Labels of section 9 without a trailing bracket, synonyms as one."""
    bare = strip(F.regexp_replace(text(label), r"[（(][^（）()]*[）)]$", ""))
    synonym = reduce(lambda a, kv: a.when(bare == kv[0], kv[1]), X.S9_SYNONYMS[1:], F.when(bare == X.S9_SYNONYMS[0][0], X.S9_SYNONYMS[0][1])).otherwise(bare)
    return F.when(section == 9, synonym).otherwise(label)


def clean_cell(c: Column) -> Column:
    return strip(F.replace(text(c), F.lit("\r\n"), F.lit("\n")))
