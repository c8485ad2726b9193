"""Word packages as rows: scan, decode, number and clean.

The decode is the one step in Python: unzip and walk the XML of a file, and emit what stands there (paragraphs, list
levels, pictures, status). Everything that gives it a meaning is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import fixed as X
from ..functions import text as T
from . import files
from .numbering import auto_numbers

SCHEMA = (
    "doc_id string, kind string, ev string, pos long, tbl int, row int, cell int, tc string, grid_span int, para int, text string, bold boolean, num_id string, ilvl int, n_img int, "
    "start int, lvl_text string, ord int, ext string, width int, height int, content binary, status string, error string, tables_count int, paragraphs_count int"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
# names asked of every element
_T, _TAB, _BR, _CR, _B, _DRAWING, _NUM, _VAL = (_W + x for x in ("t", "tab", "br", "cr", "b", "drawing", "numPr", "val"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), file_name, sha256, content of the .docx files under path, without Word's lock files (~$...)."""
    name = F.substring_index("path", "/", -1)
    found = files.listed(spark, path, "*.docx").where(~name.startswith("~$") & ~name.startswith("%7E$"))
    return files.contents(found).select(F.col("path").alias("doc_id"), name.alias("file_name"), F.sha2("content", 256).alias("sha256"), "content")


def _bold(p) -> bool:
    for r in p.iter(_W + "r"):
        b = r.find(f"{_W}rPr/{_W}b")
        if b is not None and b.get(_W + "val", "1") not in ("0", "false") and "".join(t.text or "" for t in r.iter(_W + "t")).strip():
            return True
    return False


def _paragraph(p) -> dict:
    out, tags, n_img = [], set(), 0
    for e in p.iter():
        tag = e.tag
        tags.add(tag)
        if tag == _T:
            out.append(e.text or "")
        elif tag == _TAB and e.get(_VAL) is None:
            out.append("\t")
        elif tag == _BR or tag == _CR:
            out.append("\n")
        elif tag == _DRAWING:
            n_img += 1
    num = p.find(f"{_W}pPr/{_W}numPr") if _NUM in tags else None  # most paragraphs have no number or bold run to look for
    get = lambda tag: None if num is None or num.find(_W + tag) is None else num.find(_W + tag).get(_VAL)
    return {"text": "".join(out), "bold": _B in tags and _bold(p), "num_id": get("numId"), "ilvl": int(get("ilvl") or 0), "n_img": n_img}


def _row_cells(tr, above: dict[int, object]) -> Iterator[tuple[int, object, int]]:
    """(grid column, cell, span); a cell that continues the one above it stands for that one."""
    at = 0
    for tc in tr.findall(_W + "tc"):
        pr = tc.find(_W + "tcPr")
        span = pr.find(_W + "gridSpan") if pr is not None else None
        span = int(span.get(_W + "val") or 1) if span is not None else 1
        merge = pr.find(_W + "vMerge") if pr is not None else None
        if merge is not None and merge.get(_W + "val") != "restart" and at in above:
            tc = above[at]
        else:
            above[at] = tc
        yield at, tc, span
        at += span


def _boxes(e) -> Iterator:
    """Text boxes below e, each once: of alternative contents the first."""
    if e.tag == _W + "txbxContent":
        yield e
        return
    if e.tag == _MC + "AlternateContent":
        choices = [list(_boxes(c)) for c in e]
        yield from next((c for c in choices if c), [])
        return
    for c in e:
        yield from _boxes(c)


def _part(z, data: bytes, name: str) -> bytes:
    """A part of the package `data` that z has opened, cut from it directly: a package has many small parts, and opening each costs more than to parse it."""
    import zlib

    i = z.getinfo(name)
    at = i.header_offset
    if data[at : at + 4] == b"PK\x03\x04" and not i.flag_bits & 0x61 and i.compress_type in (0, 8):
        at += 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
        raw = data[at : at + i.compress_size]
        try:
            raw = zlib.decompress(raw, -15) if i.compress_type else raw
        except zlib.error:
            raw = b""
        if len(raw) == i.file_size and zlib.crc32(raw) == i.CRC:
            return raw
    return z.read(name)  # encrypted, packed otherwise, or damaged: the library says so


def decode_bytes(data: bytes) -> Iterator[dict]:
    """The records of one package, in document order."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        read = lambda name: _part(z, data, name)
        body = ElementTree.fromstring(read("word/document.xml")).find(_W + "body")
        rels = {}
        if "word/_rels/document.xml.rels" in names:
            rels = {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target"))) for r in ElementTree.fromstring(read("word/_rels/document.xml.rels"))}
        if "word/numbering.xml" in names:
            root = ElementTree.fromstring(read("word/numbering.xml"))
            lists = {a.get(_W + "abstractNumId"): a for a in root.findall(_W + "abstractNum")}
            for n in root.findall(_W + "num"):
                ref = n.find(_W + "abstractNumId")
                for lvl in lists[ref.get(_W + "val")].findall(_W + "lvl") if ref is not None and ref.get(_W + "val") in lists else ():
                    start, text, k = lvl.find(_W + "start"), lvl.find(_W + "lvlText"), int(lvl.get(_W + "ilvl"))
                    yield {"kind": "level", "num_id": n.get(_W + "numId"), "ilvl": k, "start": int(start.get(_W + "val")) if start is not None else 1, "lvl_text": text.get(_W + "val") if text is not None else f"%{k + 1}."}
        first = body.find(f".//{_W}sectPr")
        for tag, ev in (("headerReference", "header"), ("footerReference", "footer")):
            refs = [] if first is None else first.findall(_W + tag)
            ref = next((r for r in refs if r.get(_W + "type", "default") == "default"), None)
            if ref is not None and rels.get(ref.get(_R + "id")) in names:
                yield from _story(ElementTree.fromstring(read(rels[ref.get(_R + "id")])), ev)
        pos, tbl, n_img = 0, 0, 0
        ids: dict[int, str] = {}
        for child in body:
            if child.tag == _W + "tbl":
                above: dict[int, object] = {}
                for r, tr in enumerate(child.findall(_W + "tr")):
                    seen = set()
                    for c, tc, span in _row_cells(tr, above):
                        key = ids.setdefault(id(tc), f"c{len(ids)}")
                        for k, p in enumerate(tc.findall(_W + "p")):
                            yield {"kind": "paragraph", "ev": "table", "pos": pos, "tbl": tbl, "row": r, "cell": c, "tc": key, "grid_span": span, "para": k, **_paragraph(p)}
                        for d in tc.iter(_W + "drawing") if key not in seen else ():
                            size = d.find(f".//{_WP}extent")
                            for blip in d.iter(_A + "blip"):
                                part = rels.get(blip.get(_R + "embed"))
                                if part in names:
                                    yield {"kind": "image", "pos": pos, "tbl": tbl, "row": r, "cell": c, "ord": n_img, "ext": part.rpartition(".")[2].lower(), "width": int(size.get("cx", 0)) if size is not None else 0, "height": int(size.get("cy", 0)) if size is not None else 0, "content": read(part)}
                                    n_img += 1
                        seen.add(key)
                    pos += 1
                tbl += 1
            else:
                for box in _boxes(child):
                    for k, p in enumerate(box.findall(_W + "p")):
                        yield {"kind": "paragraph", "ev": "textbox", "pos": pos, "para": k, **_paragraph(p)}
                    pos += 1
                if child.tag == _W + "p":
                    yield {"kind": "paragraph", "ev": "body", "pos": pos, "para": 0, **_paragraph(child)}
                    pos += 1
        yield {"kind": "file", "status": "ok", "tables_count": tbl, "paragraphs_count": len(body.findall(_W + "p"))}


def _story(root, ev: str) -> Iterator[dict]:
    pos = 0
    for child in root:
        if child.tag == _W + "p":
            yield {"kind": "paragraph", "ev": ev, "pos": pos, "para": 0, **_paragraph(child)}
            pos += 1
    for t, table in enumerate(root.findall(_W + "tbl")):
        above: dict[int, object] = {}
        for r, tr in enumerate(table.findall(_W + "tr")):
            for c, tc, span in _row_cells(tr, above):
                for k, p in enumerate(tc.findall(_W + "p")):
                    yield {"kind": "paragraph", "ev": ev, "pos": pos, "tbl": t, "row": r, "cell": c, "tc": f"{ev}-{id(tc)}", "grid_span": span, "para": k, **_paragraph(p)}
                pos += 1


#: Records of files that go to Spark together, by number and by bytes of pictures: a batch for each file would cost more than its decode.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def _decode(batches):
    import pyarrow as pa

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.strip().split(" ") for c in SCHEMA.split(","))])
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, schema)
    waiting, size = [], 0
    for files in batches:
        for doc_id, content in zip(files.column("doc_id"), files.column("content"), strict=True):
            doc_id = doc_id.as_py()
            try:
                rows = list(decode_bytes(content.as_py()))
            except Exception as e:  # any damaged file is recorded and skipped
                rows = [{"kind": "file", "status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}]
            for r in rows:
                waiting.append({"doc_id": doc_id, **r})
                size += len(r.get("content") or b"")
                if len(waiting) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch(waiting)
                    waiting, size = [], 0
    if waiting:
        yield batch(waiting)


def decode(files: DataFrame) -> DataFrame:
    """One row per record of every file (doc_id, content); a file that can't be read has one row of kind 'file' that says so."""
    return files.select("doc_id", "content").mapInArrow(_decode, SCHEMA)


def paragraphs(records: DataFrame) -> DataFrame:
    return records.where("kind = 'paragraph'").select("doc_id", "ev", "pos", "tbl", "row", "cell", "tc", "grid_span", "para", "text", "bold", "num_id", "ilvl", "n_img")


def file_status(records: DataFrame, files: DataFrame) -> DataFrame:
    s = records.where("kind = 'file'").select("doc_id", "status", "error", "tables_count", "paragraphs_count")
    return files.select("doc_id", "file_name", "sha256").join(s, "doc_id")


def require_any(status: DataFrame) -> DataFrame:
    """The files that were read; an error if there are none, or if all failed."""
    if status.isEmpty():
        raise FileNotFoundError("no .docx files")
    ok = status.where("status = 'ok'")
    if ok.isEmpty():
        raise ValueError("every file failed")
    return ok


def clean_paragraphs(p: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs with their cleaned `text`: number in front, runs of spaces as one (not in hazard class rows), picture marks behind.

    Symbols alone beside a picture go; paragraphs that are empty then go too, but for those of cells, which hold their places. A paragraph is numbered once, however
    often a merged cell repeats it.
    """
    from pyspark.sql import Window

    # a place of three numbers, in order: no cell has too many paragraphs for it
    flat = p.withColumn("seq", F.struct("pos", F.coalesce("cell", F.lit(0)).alias("cell"), "para"))
    # paragraphs of lists are numbered, dealt by their number; the others, most of all, stay where they are read
    listed = F.col("num_id").isNotNull() & F.col("ev").isin("table", "textbox")
    x = flat.withColumn("number", F.lit(None).cast("string"))
    if n := p.where(listed).count():
        again = F.row_number().over(Window.partitionBy("doc_id", F.coalesce("tc", F.concat(F.lit("p"), "pos")), "para").orderBy("seq")) > 1
        once = store.dealt(flat.where(listed), n, "doc_id").withColumn("_once", F.when(~again, F.col("num_id")))
        numbered = auto_numbers(once.withColumnsRenamed({"pos": "_pos", "num_id": "_num"}).withColumns({"pos": F.col("seq"), "num_id": F.col("_once")}), levels)
        x = x.where(~listed).unionByName(numbered.drop("pos", "num_id", "_once").withColumnsRenamed({"_pos": "pos", "_num": "num_id"}))
    t = F.when((F.col("n_img") > 0) & F.col("text").rlike(r"^[\\/|·•\-_ ]+$"), "").otherwise(F.col("text"))
    raw = T.strip(F.concat_ws(" ", F.nullif("number", F.lit("")), t))
    x, raw = x.withColumn("_raw", raw), F.col("_raw")
    body = F.when(~raw.contains("  "), raw).when(T.class_row(raw)["name"].isNotNull(), raw).otherwise(F.regexp_replace(raw, " {2,}", " "))
    mark = F.when(F.col("n_img") > 1, F.concat(F.lit("[象形图×"), F.col("n_img").cast("string"), F.lit("]"))).when(F.col("n_img") == 1, X.PICTOGRAM_MARK)
    return x.withColumn("text", F.concat_ws(" ", F.nullif(body, F.lit("")), mark)).where("text <> '' or ev = 'table'").drop("number", "seq", "_raw")


def cell_rows(p: DataFrame) -> DataFrame:
    """doc_id, pos, cells, bold0, bold_lines, is_box, c0 of cleaned table and text-box paragraphs; rows of blank cells only go.

    bold_lines flags the lines of the first cell that stand in a bold paragraph; bold0 says whether there is one.
    """
    from ..operators.rows import cells_to_rows, dedupe_cells

    # one exchange serves all that is grouped within a row
    t = p.where("ev = 'table'").repartition("doc_id", "pos")
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("para", "text", "bold"))))
    cells = t.groupBy("doc_id", "pos", F.col("cell").alias("k"), "tc").agg(parts.alias("p"))
    flags = F.flatten(F.transform("p", lambda s: F.array_repeat(F.coalesce(s["bold"], F.lit(False)), F.size(F.split(s["text"], "\n")))))
    cells = cells.withColumns({"text": F.array_join(F.transform("p", lambda s: s["text"]), "\n"), "flags": flags}).drop("p")
    # the first cell of a row is never dropped as a copy
    rows = cells_to_rows(dedupe_cells(cells), F.min_by("flags", "k").alias("bold_lines")).where(F.exists("cells", lambda c: c != ""))
    rows = rows.select("doc_id", "pos", "cells", F.exists("bold_lines", lambda b: b).alias("bold0"), "bold_lines", F.lit(False).alias("is_box"), F.get("cells", F.lit(0)).alias("c0"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("para", F.trim("text").alias("text")))), lambda s: s["text"])
    boxes = p.where("ev = 'textbox'").groupBy("doc_id", "pos").agg(lines.alias("cells"))
    return rows.unionByName(boxes.select("doc_id", "pos", "cells", F.lit(False).alias("bold0"), F.lit(None).cast("array<boolean>").alias("bold_lines"), F.lit(True).alias("is_box"), F.get("cells", F.lit(0)).alias("c0")))


def image_sections(images: DataFrame, titles: DataFrame) -> DataFrame:
    """images (doc_id, pos, ...) with section: that of the rows before theirs; titles: doc_id, pos, n of title and hint rows."""
    from pyspark.sql import Window

    both = images.withColumns({"n": F.lit(None).cast("int"), "_image": F.lit(True)}).unionByName(titles.select("doc_id", "pos", "n").withColumn("_image", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("section", F.coalesce(F.last("n", ignorenulls=True).over(w), F.lit(0))).where("_image").drop("n", "_image")
