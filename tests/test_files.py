"""Digests and trees of files, and lines that cannot be parsed."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pastward.catalog import sources
from pastward.session import delete
from pastward.sources import fingerprint
from pastward.sources.fingerprint import file_hashes, file_trees
from pastward.sources.series import accepted_and_rejected, judged_lines
from pastward.sources.sha256 import Sha256
from pastward.sources.sinks import packed_lines

HEADER = "Date,Time,Consumption,Temperature,Rain,Sun"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain_tree(data: bytes, chunk: int, fan_in: int) -> str:
    lines = data.split(b"\n")
    lines = [line + b"\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    chunks, at = {}, 0
    for line in lines:
        chunks[at // chunk] = chunks.get(at // chunk, b"") + line
        at += len(line)
    level = [sha(chunks[k]) for k in sorted(chunks)]
    while level:
        level = [sha("".join(level[k : k + fan_in]).encode()) for k in range(0, len(level), fan_in)]
        if len(level) == 1:
            break
    return sha(f"{len(data)}:{level[0] if level else ''}".encode())


FILES = {
    "plain.txt": b"".join(b"line %d\n" % i for i in range(3000)),
    "open_end.txt": b"a\nb\nc",
    "marked.txt": b"\xef\xbb\xbfDate,Time\n1,2\n",
    "marked_open.txt": b"\xef\xbb\xbfx",
    "binary.bin": bytes(range(256)) * 400 + b"\r\n\n\n\x00",
    "empty.txt": b"",
    "newline.txt": b"\n",
    "one_line.txt": b"x" * 50_000 + b"\n" + b"y\n" * 10,
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


@pytest.fixture(params=["whole", "split"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m" if request.param == "whole" else "4k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_digests_are_those_of_the_files(spark, folder, splits):
    got = {r["name"]: r["sha256"] for r in file_hashes(spark, f"{folder}/*").collect()}
    assert got == {name: sha(data) for name, data in FILES.items() if data}


def test_lines_are_packed_before_one_task_sorts_them(spark, tmp_path):
    """One row for each line would cost that task several times the file."""
    lines = b"".join(b"line %d\n" % i for i in range(20_000))
    (tmp_path / "a.txt").write_bytes(lines)
    seen = fingerprint._pieces(spark, str(tmp_path / "a.txt"))[1].mapInArrow(fingerprint.packed, "file string, at long, data binary").orderBy("at").collect()
    assert b"".join(bytes(r["data"]) for r in seen) == lines
    assert len(seen) <= 2 * len(lines) / fingerprint.PACK + 2
    plan = file_hashes(spark, str(tmp_path / "a.txt"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_rows_out_of_order_are_not_joined():
    rows = [("f", 0, b"ab"), ("f", 2, b"c"), ("f", 9, b"x"), ("g", 10, b"y"), ("g", 4, b"z"), ("g", 5, b"w")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "at", "data"])
    got = [tuple(r.values()) for out in fingerprint.packed(iter([batch.slice(0, 2), batch.slice(2)])) for r in out.to_pylist()]
    assert got == [("f", 0, b"abc"), ("f", 9, b"x"), ("g", 10, b"y"), ("g", 4, b"zw")]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_lines_of_splits_are_packed_across_batches(size, monkeypatch):
    monkeypatch.setattr(fingerprint, "PACK", 12)
    rows = [("f", 0, b"abc\n")] * 7 + [("f", 99, b"\n")] * 20 + [("g", 99, b"x" * 40 + b"\n")] + [("g", 0, b"yz\n")] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["file", "block", "data"])
    batches = [batch.slice(k, size) for k in range(0, len(rows) + size, size)]
    got = [tuple(r.values()) for out in fingerprint._packs_of_splits(iter(batches)) for r in out.to_pylist()]
    assert got == [
        ("f", 0, 0, b"abc\n" * 3), ("f", 0, 12, b"abc\n" * 3), ("f", 0, 24, b"abc\n"), ("f", 99, 0, b"\n" * 12), ("f", 99, 12, b"\n" * 8),
        ("g", 99, 0, b"x" * 40 + b"\n"), ("g", 0, 0, b"yz\n" * 4), ("g", 0, 12, b"yz\n" * 4), ("g", 0, 24, b"yz\n"),
    ]
    lines = [r["at"] for out in fingerprint._lines_of_splits(iter(batches)) for r in out.to_pylist()]
    assert lines == [*range(0, 28, 4), *range(20), 0, *range(0, 27, 3)]


def test_the_event_file_is_written_from_packs(spark, tmp_path):
    """The writing task sorts a row for each few hundred lines, not for each line."""
    rows = [(i, i % 7, "view", None if i % 3 else "é") for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    path = sources._event_file(spark, str(tmp_path))
    wanted = "".join("|".join(str(v) for v in r if v is not None) + "\n" for r in rows)
    parts = spark.read.text(path, wholetext=True).collect()
    assert [r["value"] for r in parts] == [wanted]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([str(i) for i in range(1000)])], ["at", "value"])
    out = [r for b in packed_lines(iter([batch])) for r in b.to_pylist()]
    assert len(out) == 4 and "\n".join(r["value"] for r in out) == "\n".join(str(i) for i in range(1000)) and [r["at"] for r in out] == [0, 256, 512, 768]


@pytest.mark.parametrize("chunk, fan_in", [(1000, 2), (1 << 20, 1024)])
def test_trees_equal_plain_version(spark, folder, splits, chunk, fan_in):
    got = {r["name"]: r["sha256"] for r in file_trees(spark, f"{folder}/*", chunk, fan_in).collect()}
    assert got == {name: plain_tree(data, chunk, fan_in) for name, data in FILES.items() if data}


def test_lines_that_cannot_be_parsed(spark, tmp_path):
    lines = [
        HEADER + ",Note",
        "2020-01-01,0:00 - 1:00,5.5,1,0,2,fine",
        "2020-13-01,0:00,5.5,1,0,2,",
        ",1:00,5.5,1,0,2,",
        "2020-01-01,noon,5.5,1,0,2,",
        "2020-01-01,25:00,5.5,1,0,2,",
        "2020-01-01,2:00,much,1,0,2,",
        "2020-01-01,3:00,5,1,x,2,",
        "2020-01-01,4:00,5,1",
        "2020-01-01,5:00,5,1,0,2,a,b",
        '2020-01-02,6:00,,,,,"a ""quoted"" note"',
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(HEADER + ",Note\n2020-01-03,7:00,1,2,3,4,\n")
    good, bad = accepted_and_rejected(judged_lines(spark, str(tmp_path)))
    rows = sorted((str(r["timestamp"]), r["Consumption"]) for r in good.collect())
    assert rows == [("2020-01-01 00:00:00", 5.5), ("2020-01-02 06:00:00", None), ("2020-01-03 07:00:00", 1.0)]
    assert good.columns == ["Date", "Time", "Consumption", "Temperature", "Rain", "Sun", "timestamp", "file_order"]
    found = [(r["reason"], r["line"]) for r in bad.orderBy("file_order").collect()]
    assert [r for r, _ in found] == ["date", "date", "time", "time", "Consumption", "Rain", "columns", "columns"]
    assert found[0][1].startswith("2020-13-01,0:00,5.5") and found[-1][1] == "2020-01-01,5:00,5,1,0,2,a,b"
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv"}
    with pytest.raises(ValueError, match="Sun"):
        (tmp_path / "c").mkdir()
        (tmp_path / "c" / "d.csv").write_text("Date,Time,Consumption,Temperature,Rain\n")
        judged_lines(spark, str(tmp_path / "c"))


@pytest.mark.parametrize("cuts", [[0], [1, 2, 64, 65], [63, 128, 4000], list(range(0, 5000, 7))])
def test_a_digest_goes_on_from_its_state(cuts):
    data = bytes(i * i % 251 for i in range(5000))
    done = Sha256()
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        done = Sha256(done.state())
        done.update(data[a:b])
    assert done.hexdigest() == done.hexdigest() == sha(data)
    with pytest.raises(ValueError, match="bytes"):
        Sha256(b"short")


def test_large_files_are_hashed_in_segments(spark, folder, splits, monkeypatch):
    """Each job reads one segment of a file, not the file."""
    seen = []

    def spy(spark, path):
        rows = spark.read.parquet(path).groupBy("file", "segment").agg(F.sum(F.octet_length("data")).alias("held"), F.min("at").alias("first"))
        seen.extend(rows.collect())
        delete(spark, path)

    monkeypatch.setattr(fingerprint, "delete", spy)
    monkeypatch.setattr(fingerprint, "SEGMENT", 20_000)
    got = {r["name"]: r["sha256"] for r in file_hashes(spark, f"{folder}/*").collect()}
    assert got == {name: sha(data) for name, data in FILES.items() if data}
    large = {name: data for name, data in FILES.items() if len(data) > 20_000}
    assert set(large) == {"plain.txt", "binary.bin", "one_line.txt"} == {r["file"].rsplit("/", 1)[1] for r in seen}
    for name, data in large.items():
        rows = [r for r in seen if r["file"].endswith(name)]
        longest = max(map(len, data.split(b"\n"))) + 1
        assert sum(r["held"] for r in rows) == len(data)
        assert all(r["first"] // 20_000 == r["segment"] and r["held"] <= 20_000 + fingerprint.PACK + longest for r in rows)
    assert len([r for r in seen if r["file"].endswith("binary.bin")]) > 3


def test_without_openssl_a_file_streams_through_one_task(spark, folder, monkeypatch):
    monkeypatch.setattr(fingerprint, "SEGMENT", 5000)
    monkeypatch.setattr(fingerprint, "resumable", lambda: False)
    got = {r["name"]: r["sha256"] for r in file_hashes(spark, f"{folder}/*").collect()}
    assert got == {name: sha(data) for name, data in FILES.items() if data}
