"""Chronological splits and expanding folds, per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.calendar import iso_text
from pastward.operators.ordering import checked, with_cutoffs
from pastward.spec import HOURLY, SeriesSpec

# First part, first and second part, of the rows of a series.
TRAIN_SHARE = 0.70
DEVELOPMENT_SHARE = 0.85
PARTS = ("train", "validation", "test")


def chronological_split(
    df: DataFrame,
    spec: SeriesSpec = HOURLY,
    shares: tuple[float, ...] = (TRAIN_SHARE, DEVELOPMENT_SHARE),
    names: tuple[str, ...] = PARTS,
) -> DataFrame:
    """Add ``split``: the first ``floor(n * share)`` rows of a series are the first part, and so on.

    Rows are compared with the time at which a part starts; the rows on either side of a cut must differ in time.
    """
    starts = names[1:]

    def positions(rows: Column) -> dict[str, Column]:
        return {f"_{name}_from": F.floor(rows * F.lit(share)) for name, share in zip(starts, shares, strict=True)}

    marked = with_cutoffs(df, spec, positions)
    split = F.lit(names[0])
    for name in starts:
        split = F.when(F.col(spec.time) >= F.col(f"_{name}_from"), name).otherwise(split)
    return marked.select(*df.columns, checked(spec, split).alias("split"))


def holdout(df: DataFrame, spec: SeriesSpec = HOURLY, share: float = 0.80) -> DataFrame:
    """Two parts: the first ``share`` of a series is ``train``, the rest ``test``."""
    return chronological_split(df, spec, (share,), ("train", "test"))


def development(split: DataFrame) -> DataFrame:
    """Train and validation together; the locked test stays out."""
    return split.where(F.col("split").isin("train", "validation"))


def split_summary(split: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Rows and first and last time of each part, one row per series."""
    ts = F.col(spec.time)

    def part(name: str) -> Column:
        return F.col("split") == name

    def edge(function, name: str) -> Column:
        return iso_text(function(F.when(part(name), ts)))

    return split.groupBy(spec.key).agg(
        F.count("*").alias("rows"),
        *(F.count_if(part(name)).alias(f"{name}_rows") for name in PARTS),
        edge(F.max, "train").alias("train_end"),
        edge(F.min, "validation").alias("validation_start"),
        edge(F.max, "validation").alias("validation_end"),
        edge(F.min, "test").alias("test_start"),
        edge(F.max, "test").alias("test_end"),
    )


def part_summary(split: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """The same facts, one row per part."""
    ts = F.col(spec.time)
    return split.groupBy(spec.key, "split").agg(
        F.count("*").alias("rows"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )


def expanding_folds(df: DataFrame, spec: SeriesSpec = HOURLY, folds: int = 5) -> DataFrame:
    """Add ``fold``: 0 for rows that are only ever trained on, else the fold that scores the row.

    Fold *i* trains on every row with a lower fold number, so no row is copied. The scored parts are the last
    ``folds`` stretches of ``n // (folds + 1)`` rows.
    """

    def positions(rows: Column) -> dict[str, Column]:
        size = F.floor(rows / (folds + 1))
        return {f"_fold_{i}": rows - (folds - i + 1) * size for i in range(1, folds + 1)}

    starts = [f"_fold_{i}" for i in range(1, folds + 1)]
    marked = with_cutoffs(df, spec, positions)
    reached = [F.coalesce((F.col(spec.time) >= F.col(start)).cast("int"), F.lit(0)) for start in starts]
    return marked.select(*df.columns, checked(spec, sum(reached[1:], reached[0])).alias("fold"))


def fold_bounds(folded: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Per series and fold: rows trained on, rows scored, and the times at the borders."""
    ts = F.col(spec.time)
    per_fold = folded.groupBy(spec.key, "fold").agg(
        F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    earlier = per_fold.select(spec.key, F.col("fold").alias("before"), F.col("rows").alias("rows_before"), F.col("last").alias("last_before"))
    scored = per_fold.where(F.col("fold") > 0)
    return (
        scored.join(earlier, spec.key)
        .where(F.col("before") < F.col("fold"))
        .groupBy(spec.key, "fold")
        .agg(
            F.sum("rows_before").alias("train_rows"),
            F.first("rows").alias("test_rows"),
            F.max("last_before").alias("train_end"),
            F.first("first").alias("test_start"),
            F.first("last").alias("test_end"),
        )
    )
