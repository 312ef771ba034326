"""Shuffled shards by a two-pass external shuffle.

A row's shard follows from its id and the number of shards alone: every shard draws a hash with the id, and the largest
takes the row. A further shard takes the rows whose largest draw is its own, and no row moves between the others.

In the first pass rows are scattered by seeded hashes into buckets of a shard that fit into memory. In the second each
bucket is put into a random order by a Fisher-Yates shuffle; its rows follow those of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pastward.llm.work import Work, fresh
from pastward.operators.skew import joined_to_groups

SHARDS = 16
BUCKET_ROWS = 1024
BUCKET_BYTES = 32 << 20
MOST_SHARDS = 100_000
TASK_BUCKETS = 4  # buckets of a task, on average


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard with the largest draw; rows without an id share one."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(i, F.lit(seed), doc_id).alias("draw"), i.alias("shard")))
    return F.array_max(draws)["shard"]


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more for the row; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _numbered(work: Work, docs: DataFrame, seed: int) -> DataFrame:
    """(row, key): every row with a seeded hash of its values and of its number among equal rows.

    Equal rows are told from others by 128 bits. They are counted, one of them is kept, and the count makes rows of it again.
    """

    def value(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return F.to_json(F.struct(column)) if "map<" in kind else column

    values = [value(*c) for c in docs.dtypes]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(F.xxhash64(F.lit(seed + 1), *values).alias("h"), F.xxhash64(F.lit(seed + 2), *values).alias("g"), row)
    counts = work.put(hashed.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"))
    key = lambda number: F.xxhash64("h", number).alias("key")
    if counts.isEmpty():
        return hashed.select("row", key(F.lit(0).cast("long")))
    known = joined_to_groups(hashed, counts, ["h", "g"], "n")
    alone = known.where("n IS NULL").select("row", key(F.lit(0).cast("long")))
    kept = known.where("n IS NOT NULL").groupBy("h", "g").agg(F.any_value("row").alias("row"), F.any_value("n").alias("n"))
    again = kept.select("row", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number"))
    return alone.union(again.select("row", key(F.col("number"))))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 0, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, size: str | None = None) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to shards - 1), ``slot`` (gapless from 0 in a shard) and ``grown_shard``.

    ``grown_shard`` is where the row goes with one more shard: its own or the new one. ``size`` names a column of row sizes; with
    it, buckets stay near ``bucket_bytes`` too. Repeated rows are rows of their own; their number among equal rows spreads them over
    buckets. The same rows and seed give the same slots, however the input is split. If columns of the three names exist, the new ones
    have underscores in front. An empty table gives an empty table; a null id counts as an id.
    """
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"there are 1 to {MOST_SHARDS} shards")
    work = Work(docs.sparkSession)
    rows = _numbered(work, docs, seed).select(
        "row",
        "key",
        shard_of(F.col("row.doc_id"), shards, seed).alias("shard"),
        shard_of(F.col("row.doc_id"), shards + 1, seed).alias("grown_shard"),
    )
    weight = F.col(f"row.`{size}`") if size else F.lit(0)
    held = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum(weight.cast("double")).alias("bytes"))
    buckets = F.greatest(F.ceil(F.col("n") / bucket_rows), F.ceil(F.coalesce("bytes", F.lit(0.0)) / bucket_bytes)).cast("int")
    per_shard = work.put(held.select(F.col("shard").alias("of_shard"), buckets.alias("buckets")))
    parts = -(-(per_shard.agg(F.sum("buckets")).first()[0] or 1) // TASK_BUCKETS)

    scattered = rows.join(F.broadcast(per_shard), F.col("shard") == F.col("of_shard"))  # one row per shard, MOST_SHARDS at most
    scattered = scattered.select(F.pmod("key", "buckets").alias("bucket"), "shard", F.struct("key", "grown_shard", "row").alias("x"))
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    filled = scattered.repartition(parts, "shard", "bucket").groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("x"), by_key).alias("xs"))
    # a task's draws go on from bucket to bucket, so tasks and the order of their buckets are fixed
    first = work.put(filled.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("xs", seed).alias("xs")))

    sizes = first.select("shard", "bucket", F.size("xs.key").cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = work.put(sizes.select("shard", "bucket", before.alias("before")))
    second = first.join(offsets, ["shard", "bucket"])
    out = second.select("shard", "before", F.posexplode("xs").alias("at", "x"))
    shard, slot, grown = fresh(docs.columns, "shard", "slot", "grown_shard")
    return out.select("x.row.*", F.col("shard").alias(shard), (F.col("before") + F.col("at")).alias(slot), F.col("x.grown_shard").alias(grown))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """Write each shard to a folder of its own below ``path``; slots are ascending in every file."""
    name = fresh(docs.columns, "size")[0]
    sized = docs.withColumn(name, text_size(F.col("text")))
    shard, slot, grown = fresh(sized.columns, "shard", "slot", "grown_shard")
    out = shuffled(sized, shards, seed, size=name).drop(name, grown)
    parts = F.floor(F.col(slot) / (64 * BUCKET_ROWS))
    out.repartition(F.col(shard), parts).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def placed(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all rows. A null text has size 1 and the checksum of no bytes.

    Whole documents are shuffled, in buckets bounded by bytes too; size and checksum are those of the texts that come out.
    """
    whole = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), text_size(F.col("text")).alias("size"))
    out = shuffled(whole, shards, seed, size="size")
    text = F.col("document.text")
    return out.select("doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
