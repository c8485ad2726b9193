"""WARC archives with revisit resolution.

Pages become records; of records with equal payloads one is the response and the others revisit it. Only headers (key,
digest, length) are shuffled by payload digest; each page's verdict then joins its text by page id, so a group of
equal payloads never meets in one task. Archives are written by Spark's own text writer, whose line separator is the
blank line pair that ends a WARC record, and read back as binary files, record by record by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, keep, new_path, slices, table

END = b"\r\n\r\n"
#: Bytes of pages in one archive, about.
ARCHIVE = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_FORBIDDEN = re.compile(r"[\x00-\x20\x7f]")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _uri(url: str | None, page_id) -> str:
    return _FORBIDDEN.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record_id(page_id, digest: str, nth: int = 1) -> str:
    """The id of the nth record of a page and payload: no two records of a set of archives have one id."""
    return f"<urn:page:{'-' if page_id is None else page_id}:{digest}{f':{nth}' if nth > 1 else ''}>"


def payload_headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes and digest (SHA-1 in hex) of pages; null html is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("digest"))


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The rows of headers (page_id, url, payload_bytes, digest) that revisit another, with refers_to and refers_url.

    Of equal payloads of least_bytes or more the largest page_id is the response; smaller payloads are all responses.
    The winners are a maximum per digest, combined before the shuffle, and joined back.
    """
    large = headers.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    best = large.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("best"))
    out = large.join(best, ["digest", "payload_bytes"]).where("best.page_id <> page_id")
    return out.select("page_id", "digest", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"))


def _record(page_id, url, html, nth, refers_to, refers_url, date: str) -> str:
    payload = (html or "").encode()
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page_id)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head) + "\r\n\r\n" + block.decode()


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "nth", "refers_to", "refers_url")]
            yield pa.RecordBatch.from_arrays([pa.array([_record(*row, date) for row in zip(*columns, strict=True)], pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, date: str = DATE, archive_bytes: int = ARCHIVE, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write pages (page_id, url, html) as WARC files under path, equal payloads once.

    Null html is an empty payload; a null url becomes urn:page:<id>; white space and control characters of a url are
    percent-encoded, so no header can be forged. Rows that repeat a page_id get a record each, equal ones as responses,
    and each an id of its own. A row without page_id gets a response record, of no use as an original. Spark compresses
    a file as one stream; compression "none" gives plain archives, in which a record can be read from its offset.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    headers = keep(payload_headers(pages), "warc-headers")
    revisits = resolve_revisits(headers, least_bytes).dropDuplicates(["page_id", "digest"])
    files = max(1, -(-int(headers.agg(F.sum("payload_bytes")).first()[0] or 0) // archive_bytes))
    dealt = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")))).repartition(files, "page_id", "digest")
    # the rows of a page and payload are together already
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    rows = dealt.withColumn("nth", nth).join(revisits, ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", "html", "nth", "refers_to", "refers_url").mapInArrow(_records(date), "value string")
    rows.write.option("lineSep", END.decode()).option("compression", compression).text(path)
    drop(headers)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, found by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start = end + len(END)
        stop = start + int(head["Content-Length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"record at byte {at} does not end where it says")
        yield head, data[start:stop]
        at = stop + len(END)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+):\w+(?::\d+)?>", x)) else None
    for b in batches:
        for data in b.column("content"):
            data, out = data.as_py(), []
            for head, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                http, _, payload = block.partition(END)
                size = int(re.search(rb"(?im)^Content-Length: (\d+)\r?$", http)[1])
                if head["WARC-Type"] == "response" and f"sha1:{_digest(payload)}" != head["WARC-Payload-Digest"]:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                out.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, head["WARC-Payload-Digest"][5:], head["WARC-Type"], number(head.get("WARC-Refers-To")), payload.decode() if head["WARC-Type"] == "response" else None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html (null for revisits) of all records under path.

    A task holds one archive at a time. A record that is damaged or does not end where it says raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,txt,warc}").load(path)
    return files.select("content").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def restore_payloads(records: DataFrame) -> DataFrame:
    """Records read from archives with the html of revisits taken from a response of the same digest and length; null without one."""
    payload = ["payload_digest", "payload_bytes"]
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type <> 'response'")
    originals = responses.select(*payload, "html").dropDuplicates(payload)
    return responses.unionByName(revisits.drop("html").join(originals, payload, "left").select(*records.columns))


def merge_archives(spark: SparkSession, paths: list[str], to: str, **how) -> None:
    """Read archives, resolve their revisits, and write them again as one deduplicated set with fresh headers.

    A revisit whose payload no input holds raises an error: it cannot be written with its length and digest.
    """
    records = keep(read_archives(spark, paths), "warc-records")
    pages = restore_payloads(records)
    lost = F.raise_error(F.concat(F.lit("no input has the payload sha1:"), "payload_digest"))
    write_archives(pages.withColumn("html", F.coalesce("html", F.when(F.col("record_type") == "revisit", lost))), to, **how)
    drop(records)


def op3_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url", "html")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT p.*, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (CASE WHEN k % 8 = 0 THEN b0 >> 3
                WHEN k % 8 = 1 THEN ((b0 & 7) << 2) | (b1 >> 6)
                WHEN k % 8 = 2 THEN (b1 >> 1) & 31
                WHEN k % 8 = 3 THEN ((b1 & 1) << 4) | (b2 >> 4)
                WHEN k % 8 = 4 THEN ((b2 & 15) << 1) | (b3 >> 7)
                WHEN k % 8 = 5 THEN (b3 >> 2) & 31
                WHEN k % 8 = 6 THEN ((b3 & 3) << 3) | (b4 >> 5)
                ELSE b4 & 31 END)::INT, 1), '' ORDER BY k)
    FROM (SELECT k, ('0x' || substr(hex, (k // 8) * 10 + 1, 2))::INT AS b0, ('0x' || substr(hex, (k // 8) * 10 + 3, 2))::INT AS b1,
                 ('0x' || substr(hex, (k // 8) * 10 + 5, 2))::INT AS b2, ('0x' || substr(hex, (k // 8) * 10 + 7, 2))::INT AS b3,
                 ('0x' || substr(hex, (k // 8) * 10 + 9, 2))::INT AS b4 FROM range(32) t(k))) AS payload_digest
  FROM p),
best AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS best FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM best
"""
