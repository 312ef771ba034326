"""Identity of inputs: required files, content hashes and the provenance record."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pastward.operators.audits import missing_names
from pastward.session import delete, staged, work_folder
from pastward.sources.sha256 import Sha256, resumable

DIGITS = 15
MARK = b"\xef\xbb\xbf"  # the byte order mark of UTF-8
CHUNK = 1 << 20
FAN_IN = 1024
SEGMENT = 1 << 27  # bytes of a file that one task hashes
PACK = 1 << 14  # bytes of a packed row: enough that a row's own cost is small, and few enough for a batch of thousands of rows


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, path, bytes`` of the files in a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.col("length").alias("bytes")
    )


def require_files(spark: SparkSession, folder: str, required: Sequence[str]) -> DataFrame:
    """The listing, or an error that names every required file that is absent or empty."""
    present = list_files(spark, folder).where("bytes > 0")
    wanted = spark.createDataFrame([(name,) for name in required], "name string")
    absent = sorted(row["name"] for row in missing_names(wanted, present, "name").collect())  # at most the required names
    if absent:
        raise FileNotFoundError(f"missing input files: {', '.join(absent)}")
    return present


def _pieces(spark: SparkSession, path: str | list[str], packs: bool = True, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The files with their sizes, and their content as pieces that end where a line does, with the place of each in its file.

    Files are read in splits, and lines are counted and packed in the task that reads them; ``packs=False`` leaves one row for each line.
    The splits' lengths give each split's place, and tell what the line reader left out: a byte order mark at the start, or the line end
    that the last line lacks. ``where`` chooses files.
    """
    where = F.lit(True) if where is None else where
    files = spark.read.format("binaryFile").load(path).where(where).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    lines = spark.read.option("lineSep", "\n").text(path).where(where).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data")
    )
    length = F.octet_length("data").cast("long")
    splits = lines.groupBy("file", "block").agg(F.sum(length).alias("held"))
    whole = W.partitionBy("file")
    before = F.coalesce(F.sum("held").over(whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", before.alias("before"), F.sum("held").over(whole).alias("all_held"))
    facts = staged(splits.join(files, "file").withColumn("left_out", F.col("size") - F.col("all_held")))  # one row per split
    mark = F.when(F.col("left_out") >= 2, F.lit(len(MARK))).otherwise(0)
    found = lines.mapInArrow(_packs_of_splits if packs else _lines_of_splits, "file string, block long, at long, data binary")
    placed = found.join(facts, ["file", "block"]).withColumn("at", F.col("before") + F.col("at"))
    first, last = F.col("at") == 0, F.col("at") + length == F.col("all_held")
    open_end = last & F.col("left_out").isin(-1, 2)
    closed = F.when(open_end, F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data"))
    data = F.concat(F.when(first & (mark > 0), F.lit(MARK)).otherwise(F.lit(b"")), closed)
    at = F.when(first, 0).otherwise(F.col("at") + mark)
    return files, placed.select("file", at.cast("long").alias("at"), data.alias("data"))


def _runs(breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last-but-one row of the runs that ``breaks`` between neighbours leave."""
    return pairwise([0, *(np.flatnonzero(breaks) + 1).tolist(), len(breaks) + 1])


def _unlike(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row and the next differ in a column."""
    last = len(columns[0]) - 1
    return np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, last)).to_numpy(zero_copy_only=False) for c in columns])


def _lines_of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``file, block, data`` in the order in which a scan reads them, with the place ``at`` of each in its split."""
    now, end = None, 0
    for rows in batches:
        if not rows.num_rows:
            continue
        file, block, data = (rows.column(name) for name in ("file", "block", "data"))
        upto = np.cumsum(pc.binary_length(data).to_numpy(), dtype=np.int64)
        at = np.concatenate([[0], upto[:-1]])
        for a, b in _runs(_unlike([file, block])):
            of = file[a].as_py(), block[a].as_py()
            if of != now:
                now, end = of, 0
            shift = end - at[a]
            at[a:b] += shift
            end = int(upto[b - 1] + shift)
        yield pa.RecordBatch.from_arrays([file, block, pa.array(at, pa.int64()), data], ["file", "block", "at", "data"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys, ``at, data`` with those put together that follow each other under their keys, to about ``PACK`` bytes.

    Rows that come in another order are right too, only less is put together.
    """
    key, first, end, held = None, 0, 0, []
    schema, done = None, []
    for rows in batches:
        if not rows.num_rows:
            continue
        schema = schema or rows.schema
        keys, data, at = rows.columns[:-2], rows.column("data"), rows.column("at").to_numpy()
        upto = at + pc.binary_length(data).to_numpy()
        for a, b in _runs(_unlike(keys) | (at[1:] != upto[:-1])):
            of = tuple(c[a].as_py() for c in keys)
            while a < b:
                if held and (of != key or at[a] != end or end - first >= PACK):
                    done.append((*key, first, b"".join(held)))
                    held = []
                if not held:
                    key, first = of, int(at[a])
                upper = a + int(np.searchsorted(at[a:b], first + PACK))
                held.extend(data.slice(a, upper - a).to_pylist())
                a, end = upper, int(upto[upper - 1])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, first, b"".join(held)), schema)], schema=schema)


def _packs_of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return packed(_lines_of_splits(batches))


def _digests(keys: int):
    """SHA-256 of the pieces of each key, which come in order; one digest is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, hashlib.sha256(), []
        schema = None
        for rows in batches:
            schema = schema or pa.schema([*(rows.schema.field(k) for k in range(keys)), ("sha256", pa.string())])
            key, data = list(zip(*(rows.column(k).to_pylist() for k in range(keys)))), rows.column("data")
            for k, of in enumerate(key):
                if of != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = of, hashlib.sha256()
                sha.update(data[k].as_buffer())
        if now is not None:
            done.append((*now, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema.names)

    return run


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "sha256")


def _resumed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of SHA-256 after the pieces of each file, which come in order. A row with ``at`` below 0 has the state to go on from."""
    now, sha, done, schema = None, None, [], None
    for rows in batches:
        schema, data = rows.schema, rows.column("data")
        for k, (of, at) in enumerate(zip(rows.column("file").to_pylist(), rows.column("at").to_pylist())):
            if of != now:
                if now is not None:
                    done.append((now, -1, sha.state()))
                now, sha = of, Sha256(data[k].as_py() if at < 0 else None)
            if at >= 0:
                sha.update(data[k].as_buffer())
    if now is not None:
        done.append((now, -1, sha.state()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        digests = pa.array([Sha256(state).hexdigest() for state in rows.column("data").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([rows.column("file"), digests], ["file", "sha256"])


def _chained(spark: SparkSession, pieces: DataFrame, most: int) -> DataFrame:
    """SHA-256 of files of up to ``most`` bytes, a job for each ``SEGMENT`` bytes: its tasks go on from the states that the job before wrote."""
    folder = work_folder(spark)
    try:
        cut = pieces.withColumn("segment", F.expr(f"at div {int(SEGMENT)}"))
        cut.write.partitionBy("segment").parquet(folder)
        cut = spark.read.schema(cut.schema).parquet(folder)
        states = None
        for k in range(-(-most // SEGMENT)):
            rows = cut.where(F.col("segment") == k).select("file", "at", "data")
            rows = rows if states is None else rows.unionByName(states)
            ordered = rows.repartition("file").sortWithinPartitions("file", "at")
            states = staged(ordered.mapInArrow(_resumed, "file string, at long, data binary"))  # one row per file
    finally:
        delete(spark, folder)
    return states.mapInArrow(_finished, "file string, sha256 string")


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256 of the content of each file that the paths name.

    A file of up to ``SEGMENT`` bytes streams through one task. The digest of a larger one is handed on from task to task, each of which reads
    one segment, so a task's share does not grow with the file; they run one after the other, as this digest asks for. For large files
    :func:`file_trees` works on all parts at once. A line must fit into memory. Without OpenSSL's functions (``resumable``) a file of any
    size streams through one task. Spark's scans leave out files of no bytes, so these have no row.
    """
    size = F.col("_metadata.file_size")
    most = spark.read.format("binaryFile").load(path).agg(F.max(size)).first()[0] or 0
    chained = most > SEGMENT and resumable()
    _, pieces = _pieces(spark, path, where=size <= SEGMENT if chained else None)
    ordered = pieces.repartition("file").sortWithinPartitions("file", "at").select("file", "data")
    found = ordered.mapInArrow(_digests(1), "file string, sha256 string")
    if chained:
        found = found.unionByName(_chained(spark, _pieces(spark, path, where=size > SEGMENT)[1], most))
    return _named(found)


def file_trees(spark: SparkSession, path: str | list[str], chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """A hash tree over each file: a fingerprint of files of any size, made by all tasks at once.

    A chunk is the lines that begin in the same ``chunk`` bytes; its leaf is the SHA-256 of these lines. Each level hashes ``fan_in`` neighbours'
    hexadecimal digests put together; the fingerprint is the SHA-256 of the size, a colon and the last digest. Files of no bytes have no row.
    """
    files, pieces = _pieces(spark, path, packs=False)
    dealt = pieces.withColumn("part", F.expr(f"at div {int(chunk)}")).repartition("file", "part").sortWithinPartitions("file", "part", "at")
    level = staged(dealt.select("file", "part", "data").mapInArrow(_digests(2), "file string, part long, sha256 string"))
    level = level.withColumn("part", F.row_number().over(W.partitionBy("file").orderBy("part")) - 1)  # chunks inside a long line have no leaf
    finished = F.lit(False)  # a file is left as it is from the level on at which one digest stands for it
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: x["sha256"]), "")
        digest = F.when(F.bool_and("finished"), F.min("sha256")).otherwise(F.sha2(joined.cast("binary"), 256))
        grouped = level.withColumn("finished", finished).groupBy("file", F.expr(f"part div {int(fan_in)}").alias("part"))
        level = staged(grouped.agg(digest.alias("sha256")))
        if not level.agg(F.max("part")).first()[0]:
            break
        finished = F.max("part").over(W.partitionBy("file")) == 0
    text = F.concat_ws(":", F.col("size").cast("string"), F.col("sha256"))
    return _named(files.join(level, "file").select("file", F.sha2(text.cast("binary"), 256).alias("sha256")))


def row_hash(*columns: Column) -> Column:
    """SHA-256 of a row. Each value follows its length, and a missing one is a dash, so no two rows give one text."""

    def part(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """``rows, low, high``: the same for the same rows in any order and layout.

    ``low`` and ``high`` add up two runs of 15 digits of each row's hash, as whole numbers that hold 10**19 rows.
    """
    marked = df.select(row_hash(*(F.col(f"`{c}`") for c in df.columns)).alias("mark"))

    def total(first: int) -> Column:
        digits = F.conv(F.substring("mark", first, DIGITS), 16, 10).cast("decimal(19,0)")
        return F.coalesce(F.sum(digits.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)")

    return marked.agg(F.count("*").alias("rows"), total(1).alias("low"), total(1 + DIGITS).alias("high"))


def provenance(hashes: DataFrame, source: str, synthetic: bool, roles: dict[str, str]) -> DataFrame:
    """One row: where the data comes from, whether it is synthetic, and name and hash of the file in each role."""
    known = hashes.where(F.col("name").isin(*roles.values()))
    facts = [
        column
        for role, name in roles.items()
        for column in (
            F.lit(name).alias(f"{role}_file"),
            F.max(F.when(F.col("name") == name, F.col("sha256"))).alias(f"{role}_sha256"),
        )
    ]
    return known.agg(F.lit(source).alias("source"), F.lit(synthetic).alias("synthetic_data"), *facts)
