"""Web pages as paragraph rows, and stories (headers, footers, cells) as text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T


#: A comment, a script or style with all that is in it, a declaration, a tag with quoted attributes, text, or a lone `<`.
TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<[!?][^>]*>?|</?[a-z][^\s/>]*+(?:[^'">]++|"[^"]*+"|'[^']*+')*+>?|[^<]+|<"""
ATTRIBUTE = r"""(?s)([^\s=/>"'<]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def _entities() -> dict[str, str]:
    """Named characters, and the numbered ones that stand for Windows' own."""
    from html.entities import html5

    named = {f"&{k}": v for k, v in html5.items() if k.endswith(";")}
    return named | {f"&#{n};": c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}


def unescape(text: Column) -> Column:
    """Character references of HTML, with their semicolon, as what they stand for; unknown ones stay, impossible numbers become U+FFFD."""
    known = F.from_json(F.lit(json.dumps(_entities())), "map<string,string>")

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        number = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).when(part.rlike("^&#[0-9]"), digits).cast("long")
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        point = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        named = F.coalesce(F.try_element_at(known, F.when(number.between(128, 159), F.concat(F.lit("&#"), number.cast("string"), F.lit(";"))).otherwise(part)), F.when(digits != "", point), part)
        return F.when(part.rlike("^&.+;$"), named).otherwise(part)

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one), "")).otherwise(text)


def attributes(tag: Column) -> Column:
    """name (lower-case) to value of the attributes of a tag; of equal names the first."""
    group = lambda n: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(n))
    pairs = F.arrays_zip(F.transform(group(1), F.lower).alias("k"), group(2).alias("a"), group(3).alias("b"), group(4).alias("c"))
    first = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    value = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)
    return F.map_from_arrays(first, F.transform(first, lambda k: unescape(F.concat(value(k)["a"], value(k)["b"], value(k)["c"]))))


def page_tokens(pages: DataFrame) -> DataFrame:
    """doc_id, at, token, name (of tags, lower-case), is_end, is_block, level of pages (page_id, html): tags and text, without scripts, styles, comments and declarations.

    level: open block elements after the token, beside paragraphs, which hold no blocks and end where one begins or ends.
    """
    x = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    x = x.where(~F.col("token").rlike(r"(?is)^<(?:[!?]|(?:script|style)\b)"))
    x = x.withColumns({"name": F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1)), "is_end": F.col("token").startswith("</")})
    x = x.withColumn("is_block", F.col("name").isin(*X.HTML_BLOCKS))
    step = F.when(~F.col("is_block") | F.col("name").isin("p", *X.HTML_ENDLESS), 0).when(F.col("is_end"), -1).otherwise(1)
    return x.withColumn("level", F.sum(step).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, pos, tag, text, bold, attrs, links of pages (page_id, html): all visible text in order, a row for each run between block tags that is not blank.

    tag: the block element that the run stands in, '' before any; attrs: the attributes of the tag that the run comes
    right after, where it begins a block; bold: some of it is within b or strong, which end with their run at the latest;
    links: the addresses of its links. White space is one space, br a line break, character references are characters.
    A null or empty page has no rows.
    """
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = page_tokens(pages).withColumn("run", F.count_if("is_block").over(w))
    strong = F.when(F.col("name").isin(*X.HTML_BOLD), F.when(F.col("is_end"), -1).otherwise(1)).otherwise(0)
    x = x.withColumn("strong", F.sum(strong).over(Window.partitionBy("doc_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    is_text = F.col("name") == ""
    piece = F.when(is_text, F.col("token")).when(F.col("name") == "br", "<br>")
    opener = F.when(F.col("is_block"), F.struct("name", "is_end", "level", "token"))
    link = F.when((F.col("name") == "a") & ~F.col("is_end"), F.struct("at", attributes(F.col("token"))["href"].alias("href")))
    runs = x.groupBy("doc_id", "run").agg(
        F.max(opener).alias("o"), F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("at", piece.alias("t"))))).alias("t"),
        F.max(is_text & (F.col("strong") > 0) & F.col("token").rlike(r"[^\s]")).alias("bold"), F.array_sort(F.collect_list(link)).alias("l"),
    )
    starts = F.when(~F.col("o.is_end") & (F.col("o.name") != "p"), F.col("o.name"))
    around = F.last(starts, ignorenulls=True).over(Window.partitionBy("doc_id", "o.level").orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("tag", F.coalesce(F.when(F.col("o.is_end"), around).otherwise(F.col("o.name")), F.lit("")))
    joined = F.regexp_replace(F.array_join(F.transform("t", lambda s: s["t"]), ""), r"[ \t\n\f\r]+", " ")
    runs = runs.withColumn("text", T.strip(unescape(F.regexp_replace(joined, " ?<br> ?", "\n")))).where("text <> ''")
    attrs = F.when(~F.col("o.is_end"), attributes(F.col("o.token")))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return runs.select("doc_id", pos.alias("pos"), "tag", "text", "bold", attrs.alias("attrs"), F.array_compact(F.transform("l", lambda s: s["href"])).alias("links"))


def story(paragraphs: DataFrame) -> DataFrame:
    """doc_id, story: the paragraphs of each document (doc_id, pos, text; tc if cells) that are not blank, one per line.

    A cell that comes again under the same tc counts once.
    """
    x = paragraphs
    if "tc" in x.columns:
        x = x.groupBy("doc_id", F.coalesce("tc", F.concat(F.lit("p"), "pos")).alias("tc")).agg(F.min(F.struct("pos", "text")).alias("s")).select("doc_id", "s.*")
    t = T.strip(F.col("text"))
    parts = F.array_sort(F.collect_list(F.when(t != "", F.struct("pos", t.alias("t")))))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n").alias("story"))
