"""Word packages made of table rows: what the decode step reads, for tables that are no Word files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(rows: list[tuple[list[str], bool]]) -> bytes:
    """A package with one table; rows: cells, and whether the first cell's text is bold."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def cell(text: str, bold: bool) -> str:
        lines = "".join(f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
        return f"<w:tc>{lines}</w:tc>"

    body = "".join("<w:tr>" + "".join(cell(c, bold and k == 0) for k, c in enumerate(cells)) + "</w:tr>" for cells, bold in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    return out.getvalue()


def _packages(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values("pos", kind="stable")
    return pd.DataFrame({"doc_id": [str(key[0])], "content": [package([([a or "", b or ""], bool(x)) for a, b, x in zip(pdf["c0"], pdf["c1"], pdf["bold"], strict=True)])]})


def of_rows(rows: DataFrame, bold) -> DataFrame:
    """doc_id (as text) and content: a package for each document's rows (doc_id, pos, c0, c1); bold says which first cells are."""
    return rows.select("doc_id", "pos", "c0", "c1", bold.alias("bold")).groupBy("doc_id").applyInPandas(_packages, "doc_id string, content binary")


_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PICTURE = (
    '<w:r><w:drawing xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><wp:inline>'
    '<wp:extent cx="{cx}" cy="{cy}"/><a:graphic><a:blip r:embed="{id}"/></a:graphic></wp:inline></w:drawing></w:r>'
)


def whole_package(rows, box, header: str, footer: str, pictures: list[bytes]) -> bytes:
    """A package with a table of rows (lists of cells), a text box of lines, a header cell, a footer paragraph, and pictures in the last cell."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    par = lambda t, more="": f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>{more}</w:p>'
    drawn = "".join(_PICTURE.format(cx=100 + k, cy=200, id=f"rIdP{k}") for k in range(len(pictures)))
    body = "".join("<w:tr>" + "".join(f"<w:tc>{par(c, drawn if r == len(rows) - 1 and k == len(cells) - 1 else '')}</w:tc>" for k, c in enumerate(cells)) + "</w:tr>" for r, cells in enumerate(rows))
    boxed = f"<w:p><w:r><w:txbxContent>{''.join(map(par, box))}</w:txbxContent></w:r></w:p>" if len(box) else ""
    refs = '<w:sectPr><w:headerReference w:type="default" r:id="rIdH"/><w:footerReference w:type="default" r:id="rIdF"/></w:sectPr>'
    links = {"rIdH": "header1.xml", "rIdF": "footer1.xml"} | {f"rIdP{k}": f"media/image{k}.png" for k in range(len(pictures))}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, data: z.writestr(zipfile.ZipInfo(name), data)  # noqa: E731  the same bytes each time
        put("word/document.xml", f'<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body><w:tbl>{body}</w:tbl>{boxed}{refs}</w:body></w:document>')
        put("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in links.items()) + "</Relationships>")
        put("word/header1.xml", f'<w:hdr xmlns:w="{_W}"><w:tbl><w:tr><w:tc>{par(header)}</w:tc></w:tr></w:tbl></w:hdr>')
        put("word/footer1.xml", f'<w:ftr xmlns:w="{_W}">{par(footer)}</w:ftr>')
        for k, data in enumerate(pictures):
            put(f"word/media/image{k}.png", data)
    return out.getvalue()


def _whole(batches):
    import pyarrow as pa

    for batch in batches:
        docs, versions = batch.to_pylist(), [c for c in ("rows", "before") if c in batch.schema.names]
        made = []
        for d in docs:
            pictures, of = [p.encode() for p in d["pictures"]], []
            for c in versions:
                same = of and d[c] == d["rows"]  # equal rows are one package
                of.append(of[0] if same else whole_package(d[c], d["box"], d["header"], d["footer"], pictures))
            made.append([x[: len(x) // 2] if d["damaged"] else x for x in of])
        contents = [pa.array([m[k] for m in made], pa.binary()) for k in range(len(versions))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *contents], ["doc_id", *("content", "before")[: len(versions)]])


def of_documents(documents: DataFrame) -> DataFrame:
    """doc_id and content of documents (doc_id string, rows array<array<string>>, box array<string>, header, footer, pictures array<string>, damaged): half a package of a damaged one.

    With a column `before`, other rows of a document, there is `before` as well: its package with those.
    """
    more = ["before"] if "before" in documents.columns else []
    return documents.select("doc_id", "rows", "box", "header", "footer", "pictures", "damaged", *more).mapInArrow(_whole, "doc_id string, content binary" + ", before binary" * len(more))
