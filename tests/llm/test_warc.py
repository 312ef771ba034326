from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest

from pastward.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    out = []
    for i, x in payloads:
        tops = [j for j, y in payloads if y == x and j is not None] if len(x) >= least else []
        top = max(tops, default=i)
        digest = base64.b32encode(hashlib.sha1(x).digest()).decode()
        out.append((i, len(x), digest, *(("response", None) if top == i else ("revisit", top))))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def parsed(path):
    """The records of the written files, read byte by byte as the format says: header lines and block."""
    out = []
    for name in sorted(glob.glob(f"{path}/*.gz")):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            assert version == "WARC/1.0"
            header = dict(line.split(": ", 1) for line in lines)
            size = int(header["Content-Length"])
            out.append((header, data[end + 4 : end + 4 + size]))
            at = end + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    return out


ROWS = [
    (1, "http://a/", "<p>é日本</p>" * 20),
    (2, "http://b/", "<p>é日本</p>" * 20),
    (3, None, None),
    (4, "http://c/WARC/1.0", ""),
    (5, "http://d/\r\nX: y", "WARC/1.0\r\nWARC-Type: response\r\n\r\nWARC/1.0WARC/WARC/1.0\r\n\r\n"),
    (6, "http://e/", "WARC/1.0"),
    (None, "http://f/", "lone"),
    (None, "http://g/", "x" * 50),
    (7, "http://g/", "x" * 50),
    (7, "http://g/", "x" * 50),
    (9, "http://h/", "\r\n\r\n\x00퟿ line\n"),
    (-3, "http://i/", "\r\n\r\n\x00퟿ line\n"),
]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
@pytest.mark.parametrize("least", [0, 30])
def test_equals_plain_version(spark, chunk, least):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert found(warc.archived_pages(pages, least, chunk)) == plain(ROWS, least)


def test_files_hold_the_payloads(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path, chunk_bytes=16)
    blocks, kinds = {}, {}
    for header, block in parsed(path):
        origin = header.get("WARC-Segment-Origin-ID", header["WARC-Record-ID"])
        kinds.setdefault(header["WARC-Type"], []).append(origin)
        blocks.setdefault(origin, {})[int(header.get("WARC-Segment-Number", 1))] = block
        assert len(block) <= 16 + (len(block.split(b"\r\n\r\n")[0]) + 4 if header["WARC-Type"] != "continuation" else 0)
    whole = {k: b"".join(x for _, x in sorted(v.items())).split(b"\r\n\r\n", 1)[1] for k, v in blocks.items()}
    texts = {(html or "").encode() for _, _, html in ROWS}
    assert {whole[k] for k in kinds["response"]} == texts
    assert all(whole[k] == b"" for k in kinds["revisit"])
    assert kinds["continuation"]


def test_records_of_other_archives(spark, tmp_path):
    """Records that this library did not write: other headers, header names in lower case, no HTTP head, other record types."""
    body = "héllo\r\n\r\nthere".encode()
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 3\r\n\r\na=b\r\n\r\n"
    text += b"WARC/1.0\r\nwarc-type: resource\r\nwarc-record-id: <urn:x>\r\nwarc-target-uri: http://x/\r\ncontent-length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(text[:90]) + gzip.compress(text[90:]))
    got = warc.records(warc.read_chunks(spark, str(tmp_path))).collect()
    assert [(r["record_id"], r["type"], r["uri"], r["payload_bytes"], r["payload_digest"]) for r in got] == [
        ("<urn:x>", "resource", "http://x/", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    ]


def test_damaged_archives_are_errors(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame([(1, "u", "abcdef" * 9)], SCHEMA), path, chunk_bytes=10)
    chunks = warc.read_chunks(spark, path)
    with pytest.raises(Exception, match="segment 3 is missing"):
        warc.records(chunks.where("chunk != 3")).collect()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 90\r\n\r\nshort")
    with pytest.raises(Exception, match="shorter than its length"):
        warc.read_chunks(spark, str(cut)).collect()


def test_empty_table_long_texts_and_other_columns(spark):
    assert found(warc.archived_pages(spark.createDataFrame([], SCHEMA))) == []
    rows = [(i, "u", "long é" * 60_000 + ("WARC/1.0\r\n" if i % 2 else "")) for i in range(4)]
    pages = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], SCHEMA + ", digest string, top int, payload binary")
    assert found(warc.archived_pages(pages)) == plain(rows)


def test_payloads_are_hashed_once(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "w"))
    read = warc.records(warc.read_chunks(spark, str(tmp_path / "w")))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
