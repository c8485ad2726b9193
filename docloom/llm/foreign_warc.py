"""WARC archives of other writers: records of any type, binary payloads, chunked bodies, ids of any form.

Every record becomes a row. Responses and resources with equal payloads (SHA-1 and length of the body without its transfer
coding) are stored once, by the earliest capture; the others, and revisits whose original is in the input, become revisits
of that one with fresh headers. Only headers are grouped and joined by digest; each record then meets its verdict by its
own row number, so a payload that millions share, an error page say, is in no task twice. Records of other types, and
revisits whose payload no input holds, are passed through as they are.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.picture_files import PictureFiles
from .common import drop, keep
from .warc import END, _digest

SCHEMA = "record_type string, record_id string, url string, date string, refers_to string, stated_digest string, digest string, payload_bytes long, headers binary, http binary, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in one archive before compression, about.
ARCHIVE = 64 << 20


def parse(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Raw headers, headers by lower-case name (folded lines joined), and block of each record; by Content-Length alone."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + len(END)
        stop = start + int(head["content-length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut")
        yield data[at:end], head, data[start:stop]
        at = stop
        while data.startswith((b"\r", b"\n"), at):
            at += 1


def dechunked(body: bytes) -> bytes:
    """A chunked body's content; a body that is not what it says is taken as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return body


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its length and without a transfer coding, and payload; a block without HTTP is payload alone."""
    head, found, body = block.partition(END)
    if not block.startswith(b"HTTP/") or not found:
        return b"", block
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        body = dechunked(body)
    lines = [x for x in head.split(b"\r\n") if not re.match(rb"(?i)(transfer-encoding|content-length):", x)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(body)]) + END, body


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
    for b in batches:
        for data in b.column("content"):
            data = data.as_py()
            for raw, head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                kind, get = head.get("warc-type", "").lower(), head.get
                stored = kind in ("response", "resource")
                http, payload = split_block(block) if kind in ("response", "resource", "revisit") else (b"", block)
                url = (get("warc-target-uri") or "").strip("<>") or None
                row = (kind, get("warc-record-id"), url, get("warc-date"), get("warc-refers-to"), get("warc-payload-digest"), _digest(payload) if stored else None, len(payload) if stored else None, raw, http if stored or kind == "revisit" else b"", payload if kind != "revisit" else block)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each record of the archives (.warc, .warc.gz, .gz): type, ids, digests, its raw headers, HTTP head and payload.

    digest and payload_bytes are worked out anew, for responses and resources; other records have their whole block as
    payload. A task holds one archive at a time; one that is cut or no archive raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(paths)
    return files.select("content").mapInArrow(_rows, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """row, refers_to, refers_url, refers_date, digest of the records (with row) that are to be revisits of another."""
    light = records.select("row", "record_type", "record_id", "url", "date", "refers_to", "stated_digest", "digest", "payload_bytes")
    stored = light.where("digest is not null")
    first = stored.groupBy("digest", "payload_bytes").agg(F.min(F.struct(F.coalesce("date", F.lit("")).alias("at"), "url", "record_id", "row", "date")).alias("w"))
    captures = stored.select("row", "digest", "payload_bytes")
    # a revisit's original: the record it names, else one with the digest it states
    revisits = light.where("record_type = 'revisit'")
    ids = stored.where("record_id is not null").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct("digest", "payload_bytes")).alias("by_id"))
    stated = stored.where("stated_digest is not null").groupBy("stated_digest").agg(F.min(F.struct("digest", "payload_bytes")).alias("by_digest"))
    found = revisits.join(ids, "refers_to", "left").join(stated, "stated_digest", "left").select("row", F.coalesce("by_id", "by_digest").alias("o")).where("o is not null").select("row", "o.*")
    out = captures.unionByName(found).join(first, ["digest", "payload_bytes"]).where("row <> w.row")
    return out.select("row", F.col("w.record_id").alias("to_id"), F.col("w.url").alias("to_url"), F.col("w.date").alias("to_date"), F.col("digest").alias("to_digest"))


def _record(r: dict) -> bytes:
    payload, http = r["payload"], r["http"]
    if not r["revisits"] and r["digest"] is None:  # passed through
        return r["headers"] + END + payload + END
    block = http if r["revisits"] else http + payload
    digest = r["to_digest"] if r["revisits"] else r["digest"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if r['revisits'] else r['record_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}"]
    if r["revisits"]:
        head += [f"WARC-Refers-To: {r['to_id']}", f"WARC-Refers-To-Target-URI: {r['to_url']}", f"WARC-Refers-To-Date: {r['to_date']}", f"WARC-Profile: {PROFILE}"]
    head = [x for x in head if not x.endswith(": None")]
    kind = next((v for x in r["headers"].decode("utf-8", "replace").split("\r\n") for k, _, v in [x.partition(":")] if k.lower() == "content-type"), "application/http;msgtype=response").strip()
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}", f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _archives(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        folder, n, held, size = f"part-{TaskContext.get().partitionId():05d}", 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([f"{folder}-{n:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["folder", "name", "content"])

        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                record = _record(r)
                held.append(gzip.compress(record, 6, mtime=0))  # a member for each record, so one can be read from its offset
                size += len(record)
                if size >= archive_bytes:
                    yield out()
                    n, held, size = n + 1, [], 0
        if held:
            yield out()

    return run


def merge_foreign(spark: SparkSession, paths: str | list[str], to: str, archive_bytes: int = ARCHIVE, tasks: int | None = None) -> None:
    """Merge archives of any writer into deduplicated ones, under the new folder `to` (a URI that pyarrow or a mount reaches).

    Record ids, dates and addresses stay; digests, lengths and the headers of responses, resources and revisits are fresh.
    Of equal payloads, empty ones too, the capture of the least date, address and id is stored.
    """
    records = keep(read_records(spark, paths).withColumn("row", F.monotonically_increasing_id()), "warc-foreign")
    verdicts = resolve(records).withColumn("revisits", F.lit(True))
    rows = records.join(verdicts, "row", "left").withColumn("revisits", F.coalesce("revisits", F.lit(False)))
    if tasks:
        rows = rows.repartition(tasks, "row")
    spark.dataSource.register(PictureFiles)
    rows.mapInArrow(_archives(archive_bytes), "folder string, name string, content binary").write.format(PictureFiles.name()).option("path", to).mode("append").save()
    drop(records)
