"""Archives of other writers, merged, against a plain reading of them."""

import base64
import collections
import gzip
import hashlib
import random
import uuid
from pathlib import Path

import pytest

from docloom.llm import foreign_warc, warc
from docloom.llm.common import new_path

CRLF = b"\r\n"


def record(kind, block, **head):
    names = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(int=random.getrandbits(128))}>", "WARC-Date": "2020-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in head.items() if v is not None} | {"Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in names.items()) + CRLF + block + CRLF * 2, names["WARC-Record-ID"]


def http(body, *lines):
    return CRLF.join([b"HTTP/1.1 200 OK", *lines, b"", b""]) + body


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def archives(spark):
    """Two sets: what each record holds, by its id, and the records that are passed through."""
    random.seed(11)
    payloads = [b"", b"same page", bytes(range(256)) * 40, "日本".encode(), b"\r\n\r\nWARC/1.0\r\n", b"error 404", b"alone"]
    held, passed, originals = {}, {}, collections.defaultdict(list)
    root = Path(new_path(spark, "t").removeprefix("file://"))
    root.mkdir(parents=True)
    for part in range(2):
        out = []
        for kind in ("warcinfo", "request", "metadata"):
            data, i = record(kind, f"{kind} {part}\r\n\r\nfree text".encode(), WARC_Target_URI=f"http://m/{kind}")
            passed[i] = data
            out.append(data)
        for n in range(30):
            body = payloads[5] if n % 3 == 0 else payloads[(n * 5 + part) % 6]
            url, date = f"http://s{part}/{n}", f"20{20 - part}-01-{n % 9 + 1:02d}T00:00:00Z"
            if n % 4 == 0:
                chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(c), c) for c in (body[:3], body[3:]) if c) + b"0\r\n\r\n"
                block = http(chunked, b"transfer-encoding: gzip, Chunked", b"X: 1")
            elif n % 4 == 1:
                block = http(body, b"Server: no length")
            else:
                block = http(body, b"content-length: %d" % len(body))
            if n % 7 == 3:
                data, i = record("resource", body, WARC_Target_URI=url, WARC_Date=date, Content_Type="text/plain")
            else:
                data, i = record("response", block, WARC_Target_URI=f"<{url}>" if n % 5 == 0 else url, WARC_Date=date, WARC_Payload_Digest=f"sha256:{hashlib.sha256(body).hexdigest()}" if n % 2 else None, Content_Type="application/http; msgtype=response")
            held[i] = body
            originals[body].append(i)
            out.append(data)
        for n, body in enumerate((payloads[1], payloads[2])):  # by id, and by the digest it states
            how = {"WARC_Refers_To": originals[body][0]} if n == 0 else {"WARC_Payload_Digest": f"sha256:{hashlib.sha256(body).hexdigest()}"}
            data, i = record("revisit", http(b"", b"X: 2"), WARC_Target_URI=f"http://r{part}/{n}", WARC_Date=f"2021-01-0{part + 1}T00:00:00Z", **how)
            held[i] = body
            out.append(data)
        data, i = record("revisit", http(b"", b"X: 3"), WARC_Target_URI="http://lost", WARC_Refers_To="<urn:uuid:lost>", WARC_Payload_Digest="sha1:LOST")
        passed[i] = data
        out.append(data)
        if part:
            (root / "b.warc").write_bytes(b"".join(out))
        else:
            (root / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, out)))
    return f"file://{root}", held, passed


def test_foreign_archives_are_merged(spark, archives):
    path, held, passed = archives
    to = new_path(spark, "t")
    foreign_warc.merge_foreign(spark, [path], to, archive_bytes=4000, tasks=3)
    files = sorted(Path(to.removeprefix("file://")).rglob("*.warc.gz"))
    assert len(files) > 3
    got = {}
    for f in files:
        for raw, head, block in foreign_warc.parse(gzip.decompress(f.read_bytes())):
            assert head["warc-record-id"] not in got
            got[head["warc-record-id"]] = raw, head, block
    assert set(got) == set(held) | set(passed)
    for i, data in passed.items():
        raw, _, block = got[i]
        assert raw + warc.END + block + warc.END == data
    stored = {i: foreign_warc.split_block(block)[1] for i, (_, head, block) in got.items() if head["warc-type"] in ("response", "resource")}
    assert collections.Counter(stored.values()) == collections.Counter(set(held.values()))  # equal payloads once
    for i, body in held.items():
        _, head, block = got[i]
        if head["warc-type"] == "revisit":
            assert stored[head["warc-refers-to"]] == body and head["warc-payload-digest"] == f"sha1:{sha1(body)}" and not foreign_warc.split_block(block)[1]
            assert (head["warc-refers-to-date"], head["warc-refers-to"]) <= (head["warc-date"], i) or i not in stored
        else:
            assert stored[i] == body and head["warc-payload-digest"] == f"sha1:{sha1(body)}" and head["warc-block-digest"] == f"sha1:{sha1(block)}"
            assert not block.startswith(b"HTTP/") or (b"Content-Length: %d" % len(body)) in block and b"hunked" not in block
    again = new_path(spark, "t")
    foreign_warc.merge_foreign(spark, [f"{to}/*"], again)
    rows = lambda p: sorted((r.record_id, r.record_type, r.refers_to or "", bytes(r.payload or b"") if r.record_type != "revisit" else b"") for r in foreign_warc.read_records(spark, f"{p}/*").collect())
    assert rows(again) == rows(to)


def test_foreign_archives_that_are_damaged(spark, tmp_path):
    data, _ = record("response", http(b"body"), WARC_Target_URI="http://a")
    (tmp_path / "cut.warc").write_bytes(data[:-12])
    with pytest.raises(Exception, match="is cut"):
        foreign_warc.read_records(spark, f"file://{tmp_path}").count()
    (tmp_path / "cut.warc").write_bytes(b"no archive" + data)
    with pytest.raises(Exception, match="no WARC record"):
        foreign_warc.read_records(spark, f"file://{tmp_path}").count()
    assert foreign_warc.dechunked(b"zz\r\nnot chunked") == b"zz\r\nnot chunked"
