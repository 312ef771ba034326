"""Series tables from hourly CSV files and from transaction and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastward.functions.calendar import CLOCK_HOUR, parse_timestamp
from pastward.schema import HOURLY_CSV
from pastward.session import staged
from pastward.sources.sinks import read_csv

CORRUPT = "_corrupt_line"


def read_hourly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan an hourly CSV, its columns by name, under a declared schema; a malformed line stops the job.

    ``file_order`` is the place of a line in its file, for rules that speak of first and last lines.
    """
    lines = read_csv(spark, path, HOURLY_CSV)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select("*", place.alias("file_order"))


def judged_lines(spark: SparkSession, path: str, schema: T.StructType = HOURLY_CSV, date: str = "Date", time: str = "Time") -> DataFrame:
    """All lines of an hourly CSV, good or not: the schema's columns by name, ``timestamp``, ``reason``, the ``line`` as it was, ``file`` and ``file_order``.

    ``reason`` is null for a good line, else the first of: ``columns`` (more or fewer than the header has), ``date`` and ``time`` (missing or not to be
    parsed), and ``<column>`` for a number that is none. Nothing is dropped and nothing stops the job but an absent column or unequal headers.
    """
    header = spark.read.csv(path, header=True, mode="PERMISSIVE", enforceSchema=False, inferSchema=False)
    absent = [f.name for f in schema if f.name not in header.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    texts = T.StructType([*(T.StructField(c, T.StringType()) for c in header.columns), T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.schema(texts).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
    day = F.to_date(F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")))
    hour = F.regexp_extract(F.trim(F.col(time)), CLOCK_HOUR, 1)
    hour = F.when(F.coalesce(hour, F.lit("")) != "", hour.cast("int"))
    numbers = [f for f in schema if f.name not in (date, time)]
    reason = F.when(F.col(CORRUPT).isNotNull(), "columns").when(day.isNull(), "date").when(hour.isNull() | (hour > 23), "time")
    for f in numbers:
        reason = reason.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f.name)
    good = reason.isNull()
    typed = [F.when(good, F.col(f.name).try_cast(f.dataType)).alias(f.name) if f in numbers else F.col(f.name) for f in schema]
    ts = F.when(good, day.cast("timestamp_ntz") + F.make_interval(hours=hour))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    kept = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in header.columns)))
    return lines.select(*typed, ts.alias("timestamp"), reason.alias("reason"), F.when(~good, kept).alias("line"), F.col("_metadata.file_path").alias("file"), place.alias("file_order"))


def accepted_and_rejected(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good lines with their time, and the others with reason, text, file and place; the files are read once."""
    held = staged(judged)
    good = held.where("reason IS NULL").drop("reason", "line", "file")
    return good, held.where("reason IS NOT NULL").select("reason", "line", "file", "file_order")


def with_timestamp(lines: DataFrame) -> DataFrame:
    return lines.withColumn("timestamp", parse_timestamp(F.col("Date"), F.col("Time")))


def tail_rows(df: DataFrame, rows: int, order: str) -> DataFrame:
    """The last rows in file order, before any sorting by time: the sample of a smoke run."""
    return df.orderBy(F.desc(order)).limit(rows)


def hourly_events(events: DataFrame, key: Column) -> DataFrame:
    """An hourly series with a target and three side columns from an events table."""
    first_value = F.min_by("value", "event_id")
    rain = (
        F.when(F.min_by("user_id", "event_id") % 37 == 0, F.lit(None).cast("double"))
        .when(first_value <= 10, 0.0)
        .otherwise(F.round((first_value - 10) / 20, 4))
    )
    return events.groupBy(key.alias("series_id"), F.window("ts", "1 hour")["start"].alias("timestamp")).agg(
        F.round(F.sum("value"), 2).alias("Consumption"),
        F.max("value").alias("Temperature"),
        rain.alias("Rain"),
        F.sum(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)).alias("Sun"),
    )


def daily_totals(df: DataFrame, key: Column, date: str, value: str) -> DataFrame:
    """A daily series of summed amounts."""
    return df.groupBy(key.alias("series_id"), F.col(date).cast("date").alias("Date")).agg(
        F.round(F.sum(value), 2).alias("Consumption")
    )
