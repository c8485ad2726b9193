"""Visible text of pages against a plain parser with a stack of open elements."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed as X
from docloom.sources import pages


class Plain(HTMLParser):
    """Runs of text between block tags: tag, text, bold, links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.runs, self.tag, self.hidden = [], [], "", 0
        self.fresh("", False)

    def fresh(self, tag, _):
        self.parts, self.strong, self.bold, self.links, self.tag = [], 0, False, [], tag

    def flush(self):
        pieces = ["\n" if p is None else " ".join(p.replace("\xa0", "\x00").split(" ")) for p in self.parts]
        text = "".join(pieces)
        lines = [" ".join(x.split()).replace("\x00", "\xa0") for x in text.split("\n")] if None in self.parts else [" ".join(text.split()).replace("\x00", "\xa0")]
        text = "\n".join(lines).strip()
        if text:
            self.runs.append((self.tag, text, self.bold, self.links))

    def handle_starttag(self, name, attrs):
        if name in ("script", "style"):
            return
        if name in X.HTML_BLOCKS:
            self.flush()
            if name not in ("p", *X.HTML_ENDLESS):
                self.open.append(name)
            self.fresh(name, True)
        elif name == "br":
            self.parts.append(None)
        elif name in X.HTML_BOLD:
            self.strong += 1
        elif name == "a":
            self.links += [v for k, v in attrs if k == "href" and v is not None][:1]

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)

    def handle_endtag(self, name):
        if name in X.HTML_BLOCKS:
            self.flush()
            if name not in ("p", *X.HTML_ENDLESS) and self.open:
                self.open.pop()
            self.fresh(self.open[-1] if self.open else "", False)
        elif name in X.HTML_BOLD:
            self.strong -= 1

    def handle_data(self, data):
        if self.cdata_elem:  # a script or style
            return
        self.parts.append(data.replace("\n", " ").replace("\t", " ").replace("\r", " "))
        self.bold |= self.strong > 0 and bool(data.strip())


def plain(html):
    p = Plain()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.runs


ODD = [
    None, "", "plain text", "a < b &lt; c & d &amp;amp; &copy; &#233;&#x4e2d;&#128;&#x80; &unknown; &nbsp;x", "<p class='a>b' data-x=\"</p>\">one <i>two</i><b>three</b> four<br>five<BR/> six</P>tail",
    "<div><ul><li>1<li>2</li></ul>after<p>in <strong> </strong>p<div id=x>deep</div>out</div>end", "<!-- a <p>no</p> --><script>var t='</p>';</script><style>p{}</style>text<!doctype html><h1>Head</h1>",
    "<table><tr><td><a href=\"/x?a=1&amp;b=2\">cell</a></td><td>2 <a name=n>no link</a><a href='/y'>y</a></td></tr></table>", "<p>open <b>bold<p>next</p><B>again</B> not", "x<hr>y<title>T &middot; t</title>", "<p>\n many \t spaces\r\n here </p>  ",
    "<p " + " ".join(f'a{i}="{i}"' for i in range(800)) + ">many attributes</p>", "<p>" + "long &amp; " * 40_000 + "</p>",
]


def test_pages_match_a_plain_parser(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    rows += [(10_000 + k, h) for k, h in enumerate(ODD)]
    got = {}
    for r in pages.page_paragraphs(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, token string")).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.tag, r.text, r.bold, r.links))
    for page, html in rows:
        assert got.get(page, []) == plain(html), (html or "")[:200]


def test_unescape_matches_the_standard_library(spark):
    import html

    texts = [f"a{k} b" for k in list(html.entities.html5)[:0]] + [f"x&{k}y" for k in html.entities.html5 if k.endswith(";")] + ["&#65;", "&#x41;", "&#X41;", "&#0;", "&#xD800;", "&#x110000;", "&;", "&#;", "&#x;", "& amp;", "&#9999999;", "&#149;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == {t: html.unescape(t) for t in texts}


@pytest.mark.parametrize(("tag", "want"), [('<p a=1 B="x&amp;y" c=\'z\' a=2 d>', {"a": "1", "b": "x&y", "c": "z"}), ("<p>", {}), ('<p a = "" b=c />', {"a": "", "b": "c"})])
def test_attributes(spark, tag, want):
    assert spark.createDataFrame([(tag,)], "t string").select(pages.attributes(F.col("t")).alias("m")).first().m == want
