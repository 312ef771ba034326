"""Audits of a series table before any modelling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.ordering import over_history
from pastward.operators.skew import joined_to_groups
from pastward.operators.quantiles import exact_quantiles
from pastward.session import staged
from pastward.spec import DAILY, HOURLY, SeriesSpec

# The fence factor and the least number of daily observations to model on.
FENCE = 1.5
MINIMUM_OBSERVATIONS = 523


def is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    kind = dict(df.dtypes)[name]
    return column.isNull() | F.isnan(column) if kind in ("double", "float") else column.isNull()


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, missing`` for every column, from one pass; NaN counts as missing."""
    names = list(columns or df.columns)
    counts = df.agg(*(F.count_if(is_missing(df, c)).alias(c) for c in names))
    return counts.unpivot([], names, "column_name", "missing")


def align_missing(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """Missing counts of two tables side by side; a column that one of them lacks has 0 there."""
    left = raw.select("column_name", F.col("missing").alias("raw_missing"))
    right = canonical.select("column_name", F.col("missing").alias("canonical_missing"))
    return left.join(right, "column_name", "full_outer").fillna(0, ["raw_missing", "canonical_missing"])


def duplicate_times(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Rows beyond the first of each time, counted before any row is dropped."""
    copies = df.groupBy(spec.key, spec.time).agg(F.count("*").alias("copies"))
    return copies.groupBy(spec.key).agg((F.sum("copies") - F.count("*")).alias("duplicates"))


def extent(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    return df.groupBy(spec.key).agg(
        F.count("*").alias("rows"), F.min(spec.time).alias("start"), F.max(spec.time).alias("end")
    )


def audit(raw: DataFrame, canonical: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """One row: counts, extent and duplicates over all series of the table."""
    times = canonical.groupBy(spec.key, spec.time).agg(F.count("*").alias("copies"))
    counted = raw.agg(F.count("*").alias("raw_rows"))
    both = times.select(spec.time, "copies").unionByName(counted, allowMissingColumns=True)
    return both.agg(
        F.sum("raw_rows").alias("raw_rows"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("canonical_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("timestamp_duplicates"),
        F.min(spec.time).alias("start"),
        F.max(spec.time).alias("end"),
    )


def profile(lines: DataFrame, date: str, value: str) -> DataFrame:
    """Counts of text rows by defect: missing, unreadable dates, values that are no positive finite number."""
    number = F.col(value).try_cast("double")
    day = F.col(date).try_cast("date")
    readable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return lines.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(date).isNull()).alias("missing_dates"),
        F.count_if(F.col(value).isNull()).alias("missing_values"),
        F.count_if(F.col(date).isNotNull() & day.isNull()).alias("invalid_dates"),
        F.count_if(F.col(value).isNotNull() & number.isNull()).alias("non_numeric"),
        F.count_if(number.isNotNull() & ~readable).alias("non_finite"),
        F.count_if(readable & (number <= 0)).alias("non_positive"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )


def duplicated_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their number."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicated_dates(df: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    return df.groupBy(spec.key, spec.time).agg(F.count("*").alias("copies")).where("copies > 1")


def calendar_gaps(df: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """Stretches of missing days: the observed days around them and how many are missing."""
    days = df.select(spec.key, spec.time).distinct()
    before = over_history(days, spec, 1, lambda w: {"gap_from": F.lag(spec.time, 1).over(w)})
    missing = F.date_diff(F.col(spec.time), F.col("gap_from")) - 1
    return before.select(spec.key, "gap_from", F.col(spec.time).alias("gap_to"), missing.alias("missing_days")).where(
        "missing_days > 0"
    )


def missing_days(df: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """Every missing day as a row, from the gaps alone."""
    return calendar_gaps(df, spec).select(
        spec.key, F.explode(F.sequence(F.date_add("gap_from", 1), F.date_sub("gap_to", 1))).alias(spec.time)
    )


def tukey_fences(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per group the quartiles and the fences beyond which values are looked at."""
    found = exact_quantiles(df, [value], [0.25, 0.75], by)
    quartiles = found.groupBy(*by).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
    )
    reach = FENCE * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({"lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach})


def flag_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """All rows with a flag; nothing is removed."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    fences = staged(tukey_fences(df, value, by).drop("q1", "q3").join(sizes, list(by)))  # one row per group
    outside = ~F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))
    return joined_to_groups(df, fences, by, "_rows").select(*df.columns, outside.alias("outside_fences"))


def repeated_values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Values that occur more than once in a group, and how often."""
    return df.groupBy(*by, value).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def rows_with_repeated_value(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The rows that share their value with another row of the group, for inspection. A value may be that of most rows."""
    repeated = staged(repeated_values(df, value, by).withColumnRenamed("occurrences", "_rows"))
    return joined_to_groups(df, repeated, [*by, value], "_rows").where("_rows IS NOT NULL").select(*df.columns)


def describe_value(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each group."""
    x = F.col(value)
    basics = df.groupBy(*by).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    found = exact_quantiles(df, [value], [0.25, 0.5, 0.75], by)
    quartiles = found.groupBy(*by).agg(
        *(
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
        )
    )
    return basics.join(quartiles, list(by))


def calendar_summary(df: DataFrame, value: str, by: Sequence[str], part: Column, name: str) -> DataFrame:
    """Count, mean and sample deviation of a value per calendar part."""
    x = F.col(value)
    return df.groupBy(*by, part.alias(name)).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every two columns, from one aggregate; nothing for a single column."""
    pairs = list(combinations(columns, 2))
    schema = [*by, "first", "second", "correlation"]
    if not pairs:
        empty = df.select(*by).where("false")
        return empty.select(
            *by, *(F.lit(None).cast(t).alias(n) for n, t in zip(schema[-3:], ("string", "string", "double")))
        )
    wide = df.groupBy(*by).agg(
        F.array(
            *(
                F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.corr(a, b).alias("correlation"))
                for a, b in pairs
            )
        ).alias("pairs")
    )
    return wide.select(*by, F.explode("pairs").alias("pair")).select(*by, "pair.*")


def fitness(df: DataFrame, spec: SeriesSpec = DAILY, minimum: int = MINIMUM_OBSERVATIONS) -> DataFrame:
    """Whether each series is fit for modelling, with reasons when it is not."""
    gaps = calendar_gaps(df, spec).groupBy(spec.key).agg(F.count("*").alias("gap_count"))
    facts = df.groupBy(spec.key).agg(
        F.count("*").alias("rows"), F.min(spec.time).alias("date_start"), F.max(spec.time).alias("date_end")
    )
    gap_count = F.coalesce("gap_count", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rows") < minimum, f"fewer than {minimum} observations"),
            F.when(gap_count > 0, F.lit("calendar gaps")),
        )
    )
    return facts.join(gaps, spec.key, "left").select(
        spec.key,
        "rows",
        "date_start",
        "date_end",
        gap_count.alias("gap_count"),
        F.array_join(reasons, "; ").alias("reasons"),
        F.when(F.size(reasons) == 0, "READY").otherwise("NOT_READY").alias("status"),
    )
