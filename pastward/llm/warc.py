"""WARC archives written from pages and read back as a table of chunks.

Every payload becomes rows of record id, chunk number and at most ``chunk_bytes`` bytes, and each row is one WARC record: a
payload of one chunk is a ``response``, a longer one is a ``response`` that is segment 1 and ``continuation`` records after it, as the
format has them. Neither the writer nor the reader ever builds a whole record: the archive lines are rendered chunk by chunk, and
the digest of a segmented payload is carried from chunk to chunk while a sorted partition streams by.

Archives are written by Spark's text writer, whose committed tasks survive lost executors, and read by its text reader with the
record's first line as separator. So that no payload holds that line, a payload is also cut inside every ``WARC/1.0`` it contains; the
segments put together are the payload again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.llm.work import Work
from pastward.operators.skew import joined_to_groups

CHUNK_BYTES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
# fixed values of the format
VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest whose length is a multiple of five digits."""

    def letters(five: Column) -> Column:
        number = F.conv(five, 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[letters(F.substring(digest, k, 5)) for k in range(1, 41, 5)])


def _pieces(payload: Column, chunk_bytes: int) -> Column:
    """Offset and length of each chunk of a payload; an empty payload is one empty chunk."""
    text = payload.cast("string")
    cuts = F.when(F.contains(payload, F.lit(b"WARC/1.0")), F.transform(F.split(text, r"(?<=WARC/)(?=1\.0)", -1), lambda x: F.octet_length(x))).otherwise(F.array(F.octet_length(payload)))

    def chunks_of(at: Column, length: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(chunk_bytes))
        return F.transform(starts, lambda s: F.struct((at + s).alias("at"), F.least(length - s, F.lit(chunk_bytes)).alias("size")))

    empty = F.array().cast("array<struct<at:int,size:int>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.aggregate(cuts, first, lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["found"], chunks_of(done["at"], n)).alias("found")))["found"]


def _decided(work: Work, pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with payload, digest, and in ``top`` the largest id of those with the same payload; null where a payload is alone or too small."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= min_bytes, F.concat("digest", F.sha2("payload", 256))))
    counted = rows.groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    groups = work.put(counted.where("n > 1 AND same IS NOT NULL"))
    return joined_to_groups(rows, groups, ["same"], "n")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def rendered(decided: DataFrame, chunk_bytes: int, date: str) -> DataFrame:
    """One row ``value`` for each archive record: its version line, header lines and block, as bytes in a string."""
    revisit = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    label = F.concat(F.lit(":"), F.col("digest32"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size")))
    rows = (
        decided.withColumn("digest32", base32_of_hex(F.col("digest")))
        .withColumn("revisit", revisit)
        .withColumn("record_id", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), label))
        .withColumn("refers_to", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), label)))
        .withColumn("http", http)
        .withColumn("pieces", F.when(F.col("revisit"), none).otherwise(_pieces(F.col("payload"), chunk_bytes)))
        .withColumn("segments", F.size("pieces"))
    )
    cut = rows.select("*", F.posexplode("pieces").alias("chunk", "piece"))
    first, last, many = F.col("chunk") == 0, F.col("chunk") == F.col("segments") - 1, F.col("segments") > 1
    number = (F.col("chunk") + 1).cast("string")
    head = F.when(first, F.col("http")).otherwise("")
    uri = F.concat(F.lit("<"), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(">"))
    lines = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(F.concat(F.rtrim(F.col("record_id"), F.lit(">")), F.lit(":"), number, F.lit(">")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.when(first, uri)),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest32")))),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _line("WARC-Segment-Number", F.when(many, number)),
        _line("WARC-Segment-Total-Length", F.when(many & last, (F.octet_length("payload") + F.octet_length("http")).cast("string"))),
        _line("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _line("Content-Length", (F.octet_length(head) + F.col("piece.size")).cast("string")),
        F.lit("\r\n"),
        head,
    )
    data = F.substring(F.col("payload"), F.col("piece.at") + 1, F.col("piece.size"))
    return cut.select(F.concat(lines.cast("binary"), data).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> None:
    """Write one WARC record (or one set of segments) for each page (page_id, url, html) below ``path``, compressed by gzip.

    The payload is the html in UTF-8; null is an empty payload. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the
    largest id is a ``response`` and the others are ``revisit`` records that refer to it; rows that share this id and the payload are
    responses all. A null id counts as smaller than any. Line ends in an address are percent-encoded. Other columns are not read. The
    payload of a page is compared by SHA-1 and SHA-256 together. An empty table gives an archive without records.
    """
    work = Work(pages.sparkSession)
    rows = rendered(_decided(work, pages, min_bytes), chunk_bytes, date)
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)
    work.close()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives as rows: record_id (of the first segment), chunk (from 1), type, uri, refers_to, declared digest and
    payload_bytes (both null after the first chunk), segmented, and the payload's ``data``.

    Header names are read in any case. A record whose block is shorter than its length says is an error.
    """
    value = spark.read.option("lineSep", VERSION).text(path).where("value != ''")
    parts = value.select(F.substring_index("value", END, 1).alias("head"), F.col("value").cast("binary").alias("raw"))

    def header(name: str, source: str = "head") -> Column:
        return F.nullif(F.regexp_extract(source, rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1), F.lit(""))

    length = header("Content-Length").cast("int")
    parts = parts.withColumn("length", length).withColumn("block", F.substring(F.col("raw"), F.octet_length("head") + len(END) + 1, F.col("length")))
    short = F.octet_length("block") < F.col("length")
    parts = parts.withColumn("block", F.when(short, F.raise_error(F.lit("a record is shorter than its length"))).otherwise(F.col("block")))
    parts = parts.withColumn("type", header("WARC-Type")).where("type IN ('response', 'revisit', 'continuation', 'resource')")
    first, has_http = F.col("type") != "continuation", header("Content-Type").startswith("application/http")
    parts = parts.withColumn("http", F.when(first & has_http, F.substring_index(F.col("block").cast("string"), END, 1)))
    data = F.when(F.col("http").isNull(), F.col("block")).otherwise(F.substring(F.col("block"), F.octet_length("http") + len(END) + 1, F.octet_length("block")))
    number = header("WARC-Segment-Number").cast("int")
    return parts.select(
        F.coalesce(header("WARC-Segment-Origin-ID"), header("WARC-Record-ID")).alias("record_id"),
        F.coalesce(number, F.lit(1)).alias("chunk"),
        "type",
        F.regexp_replace(header("WARC-Target-URI"), "^<(.*)>$", "$1").alias("uri"),
        header("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(header("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        header("Content-Length", "http").cast("long").alias("payload_bytes"),
        number.isNotNull().alias("segmented"),
        data.alias("data"),
    )


RECORD = "record_id string, type string, uri string, refers_to string, declared string, payload_bytes bigint, payload_digest string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by record and number to one row per record; the digest of the record at hand is all that is kept."""
    names = [part.split()[0] for part in RECORD.split(", ")]
    now, facts, sha, size, last = None, [], hashlib.sha1(), 0, 0
    done: list[tuple] = []

    def close() -> None:
        done.extend((*fact, size, base64.b32encode(sha.digest()).decode()) for fact in facts)

    def taken() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, columns)], names)

    for rows in batches:
        columns = [rows.column(c) for c in ("record_id", "type", "uri", "refers_to", "digest", "chunk", "data")]
        for k in range(len(rows)):
            *fact, chunk = (c[k].as_py() for c in columns[:6])
            if fact[0] != now:
                close()
                now, facts, sha, size, last = fact[0], [], hashlib.sha1(), 0, 0
            if chunk == 1:
                facts.append(tuple(fact))
            if chunk != last:  # the same chunk again belongs to a copy of the record
                if chunk != last + 1:
                    raise ValueError(f"{now}: segment {last + 1} is missing")
                data = columns[6][k].as_buffer()
                sha.update(data)
                size, last = size + len(data), chunk
        if done:
            yield taken()
            done.clear()
    close()
    if done:
        yield taken()


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: record_id, type, uri, refers_to, declared digest, payload_bytes and payload_digest (bare base32 SHA-1).

    Size and digest come from the data read, those of a ``revisit``, which has none, from its header lines. Only segmented
    records are shuffled; each streams through one task in order, chunk by chunk, and a missing segment is an error.
    """
    revisit = F.col("type") == "revisit"
    # a column of its own: named in a branch, the hash would be made anew for each of its letters
    held = chunks.where("NOT segmented").withColumn("sha1", F.when(~revisit, F.sha1("data")))
    whole = held.select(
        "record_id",
        "type",
        "uri",
        "refers_to",
        F.col("digest").alias("declared"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("data")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(base32_of_hex(F.col("sha1"))).alias("payload_digest"),
    )
    cut = chunks.where("segmented").select("record_id", "type", "uri", "refers_to", "digest", "chunk", "data")
    cut = cut.repartition(F.col("record_id")).sortWithinPartitions("record_id", "chunk")
    return whole.unionByName(cut.mapInArrow(_folded, RECORD))


def archived_pages(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """What archives of ``pages`` say when they are read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{Work(pages.sparkSession).root}/archives"
    write_archives(pages, path, min_bytes, chunk_bytes)

    def page(record_id: str) -> Column:
        return F.nullif(F.regexp_extract(record_id, "^<urn:page:([^:]*):", 1), F.lit("")).cast("long")

    return records(read_chunks(pages.sparkSession, path)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to")
    )


SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
fives AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(sha1(x), 5 * k + 1, 5))::BIGINT) AS five FROM payloads)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes,
       array_to_string(flatten(list_transform(five, lambda v: list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)))), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM fives
"""
