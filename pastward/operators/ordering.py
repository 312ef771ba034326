"""Row positions, look-back windows and position cut-offs for series of any length.

A window over a whole series would put that series into one task. Here no window over rows is wider than one block:
rows are numbered inside time buckets and shifted by the counts of the earlier buckets, and look-back windows run
over blocks of consecutive rows that carry a copy of the rows just before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pastward.functions.calendar import epoch_seconds
from pastward.session import staged
from pastward.spec import SeriesSpec

ROW = "_row"  # position in the series, from 0
ROWS = "_rows"  # length of the series
BLOCK = "_block"
BUCKET = "_bucket"
START = "_start"


def checked(spec: SeriesSpec, column: Column) -> Column:
    """The column, or an error in rows without key or time: they have no place in any series."""
    missing = F.col(spec.key).isNull() | F.col(spec.time).isNull()
    return F.when(missing, F.raise_error(F.lit(f"{spec.key} or {spec.time} is missing"))).otherwise(column)


def time_bucket(spec: SeriesSpec) -> Column:
    """The span of time a row falls into, ``block_rows`` grid steps wide."""
    return checked(spec, F.floor(epoch_seconds(F.col(spec.time)) / F.lit(spec.step_seconds * spec.block_rows)))


def keep_last(df: DataFrame, spec: SeriesSpec, ordinal: str) -> DataFrame:
    """One row per key and time: the one with the highest ``ordinal``, of equal ones the highest by the other columns.

    The maximum is taken before the shuffle too, so many copies of one row cost one row per task.
    """
    identity = [spec.key, spec.time]
    rest = [name for name in df.columns if name not in (*identity, ordinal)]
    latest = F.max(F.struct(ordinal, *rest)).alias("latest")
    return df.groupBy(*identity).agg(latest).select(*identity, "latest.*").select(*df.columns)


def bucket_starts(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per bucket: its number of rows, the rows of the series before it, and those of the whole series.

    Counting combines before its shuffle; the running sum sees one row per bucket.
    """
    counts = df.groupBy(spec.key, time_bucket(spec).alias(BUCKET)).agg(F.count("*").alias("bucket_rows"))
    series = W.partitionBy(spec.key)
    earlier = series.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        spec.key,
        BUCKET,
        "bucket_rows",
        F.coalesce(F.sum("bucket_rows").over(earlier), F.lit(0)).alias(START),
        F.sum("bucket_rows").over(series).alias(ROWS),
    )


def number_rows(df: DataFrame, spec: SeriesSpec, *tie_break: str) -> DataFrame:
    """Add the position of every row in its series and the length of the series."""
    starts = bucket_starts(df, spec).drop("bucket_rows")
    inside = W.partitionBy(spec.key, BUCKET).orderBy(spec.time, *tie_break)
    return (
        df.withColumn(BUCKET, time_bucket(spec))
        .withColumn(ROW, F.row_number().over(inside).cast("long") - 1)
        .join(starts, [spec.key, BUCKET], "left")  # an inner join would quietly drop rows without a key
        .select(*df.columns, (F.col(ROW) + F.col(START)).alias(ROW), ROWS)
    )


def with_history(numbered: DataFrame, spec: SeriesSpec, depth: int) -> DataFrame:
    """Give every block of rows a copy of the ``depth`` rows before it."""
    last_block = F.floor((F.col(ROWS) - 1) / spec.block_rows)
    reach = F.least(F.floor((F.col(ROW) + depth) / spec.block_rows), last_block)
    return numbered.withColumn(BLOCK, F.explode(F.sequence(own_block(spec), reach)))


def own_block(spec: SeriesSpec) -> Column:
    return F.floor(F.col(ROW) / spec.block_rows)


def history_window(spec: SeriesSpec, *before_row: str) -> WindowSpec:
    return W.partitionBy(spec.key, BLOCK).orderBy(*before_row, ROW)


Build = Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]]


def over_history(df: DataFrame, spec: SeriesSpec, depth: int, build: Build, *tie_break: str) -> DataFrame:
    """Add window columns that look back at most ``depth`` rows, on a frame that is not numbered yet.

    ``build`` makes the columns from the window; a list of them is added step by step, each step reading the ones
    before. Columns whose name starts with ``_`` are helpers and do not stay.
    """
    return over_numbered(number_rows(df, spec, *tie_break), spec, depth, build).drop(ROW, ROWS)


def over_numbered(numbered: DataFrame, spec: SeriesSpec, depth: int, build: Build) -> DataFrame:
    """The same for a numbered frame; positions are kept."""
    steps = build(history_window(spec))
    wide = with_history(numbered, spec, depth)
    helpers = [BLOCK]
    for columns in [steps] if isinstance(steps, dict) else steps:
        wide = wide.select("*", *(column.alias(name) for name, column in columns.items()))
        helpers += [name for name in columns if name.startswith("_")]
    return wide.where(F.col(BLOCK) == own_block(spec)).drop(*helpers)


def cutoff_times(
    df: DataFrame, spec: SeriesSpec, positions: Callable[[Column], dict[str, Column]], last: bool = False
) -> DataFrame:
    """Per series, the times found at given positions: one row per series with a column for each.

    ``positions`` gets the length of the series. Only the buckets that hold a wanted position are numbered, and
    only key and time are read for it. A position past the end has no time and gives null.

    Rows are then compared with these times, so a time must not be shared with the row on the other side of the cut: the one
    before it, or the one behind it if the times are ``last`` ones. That is an error, as the parts would have wrong sizes.
    """
    labels = list(positions(F.col(ROWS)))
    wanted = F.array(
        *(F.struct(F.lit(label).alias("label"), at.cast("long").alias("at")) for label, at in positions(F.col(ROWS)).items())
    )
    inside_bucket = lambda t: (t["at"] >= F.col(START)) & (t["at"] < F.col(START) + F.col("bucket_rows"))
    targets = (
        bucket_starts(df, spec)
        .select(spec.key, BUCKET, START, F.filter(wanted, inside_bucket).alias("wanted"))
        .where(F.size("wanted") > 0)
    )
    inside = W.partitionBy(spec.key, BUCKET).orderBy(spec.time)
    shared = F.raise_error(F.concat(F.lit(f"a cut lies between rows of equal {spec.time}: "), F.col(spec.time).cast("string")))
    found = (
        df.select(spec.key, spec.time, time_bucket(spec).alias(BUCKET))
        .join(targets, [spec.key, BUCKET])
        .withColumn(ROW, F.row_number().over(inside) - 1 + F.col(START))
        .withColumn("beside", F.lead(spec.time).over(inside) if last else F.lag(spec.time).over(inside))
        .withColumn("hits", F.filter("wanted", lambda t: t["at"] == F.col(ROW)))
        .where(F.size("hits") > 0)
        .select(spec.key, F.when(F.col("beside") == F.col(spec.time), shared).otherwise(F.col(spec.time)).alias(spec.time), F.explode("hits.label").alias("label"))
    )
    return found.groupBy(spec.key).agg(
        *(F.max(F.when(F.col("label") == label, F.col(spec.time))).alias(label) for label in labels)
    )


def with_cutoffs(
    df: DataFrame, spec: SeriesSpec, positions: Callable[[Column], dict[str, Column]], last: bool = False
) -> DataFrame:
    """Add the times of :func:`cutoff_times` to every row.

    The times are spread to the time buckets of their series and joined by series and bucket, so the rows of one long series
    never meet in one task. The bucket table is staged: its real size decides whether it is broadcast, and then no row moves.
    """
    return beside_series(df, spec, cutoff_times(df, spec, positions, last))


def beside_series(df: DataFrame, spec: SeriesSpec, facts: DataFrame) -> DataFrame:
    """Add the columns of ``facts``, which has one row per series, to every row, by way of the series' time buckets."""
    buckets = df.select(spec.key, time_bucket(spec).alias(BUCKET)).distinct()
    spread = staged(buckets.join(facts, spec.key, "left"))
    return df.withColumn(BUCKET, time_bucket(spec)).join(spread, [spec.key, BUCKET], "left").drop(BUCKET)


def last_rows(df: DataFrame, spec: SeriesSpec, rows: int) -> DataFrame:
    """The last ``rows`` rows of every series."""
    marked = with_cutoffs(df, spec, lambda n: {"_from": F.greatest(n - rows, F.lit(0))})
    return marked.where(F.col(spec.time) >= F.col("_from")).select(*df.columns)


def first_rows(df: DataFrame, spec: SeriesSpec, rows: int) -> DataFrame:
    """The first ``rows`` rows of every series."""
    marked = with_cutoffs(df, spec, lambda n: {"_last": F.least(n, F.lit(rows)) - 1}, last=True)
    return marked.where(F.col(spec.time) <= F.col("_last")).select(*df.columns)
