"""Features of daily series. Row-based ones count rows, date-based ones ask for the exact date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pastward.functions.calendar import fourier_columns
from pastward.operators.features import full_window, lag_columns, rolling_columns
from pastward.operators.ordering import ROW
from pastward.spec import DAILY, SeriesSpec

# Lags, windows and periods of the daily feature families.
DAILY_LAGS = (1, 7, 14, 30, 365)
DAILY_WINDOWS = (7, 30)
WEEK, YEAR = 7.0, 365.25


def daily_lag_columns(value: str, w: WindowSpec) -> dict[str, Column]:
    return lag_columns(value, DAILY_LAGS, w, "demand")


def daily_rolling_columns(value: str, w: WindowSpec) -> dict[str, Column]:
    return rolling_columns(value, DAILY_WINDOWS, w, "demand", ("mean", "median", "std", "min", "max"))


def change_columns(value: str, w: WindowSpec) -> dict[str, Column]:
    """Change since the day before and growth over seven rows, both ending with the row before the current one."""
    before = F.lag(value, 1).over(w)
    return {
        "day_change": before - F.lag(value, 2).over(w),
        "growth_7": F.try_divide(before - F.lag(value, 8).over(w), F.lag(value, 8).over(w)),
    }


def slope_columns(value: str, w: WindowSpec) -> dict[str, Column]:
    """Least-squares slope of the value on the row position, over the full window before the row."""
    slope = F.regr_slope(F.col(value), F.col(ROW).cast("double"))
    return {f"demand_slope_{n}": full_window(slope, F.col(value), n, w) for n in DAILY_WINDOWS}


def fourier_terms(date: Column, order: int = 2) -> dict[str, Column]:
    """Weekly and yearly waves of the day number."""
    day = F.unix_date(date)
    return {**fourier_columns(day, WEEK, order, "week"), **fourier_columns(day, YEAR, order, "year")}


def same_date_columns(df: DataFrame, value: str, spec: SeriesSpec = DAILY) -> DataFrame:
    """Add the values of the same weekday last week and of the same date last year, null unless those days exist."""
    day = F.col(spec.time)

    def shifted(later: Column, name: str) -> DataFrame:
        return df.select(spec.key, later.alias(spec.time), F.col(value).alias(name))

    # 29 February looks back to 28 February, which several days may be moved to: so the earlier date is the join key
    week = shifted(F.date_add(day, 7), "same_weekday_last_week")
    year = df.select(spec.key, day.alias("_year_ago"), F.col(value).alias("same_date_last_year"))
    return (
        df.join(week, [spec.key, spec.time], "left")
        .withColumn("_year_ago", F.add_months(day, -12))
        .join(year, [spec.key, "_year_ago"], "left")
        .drop("_year_ago")
        .select(*df.columns, "same_weekday_last_week", "same_date_last_year")
    )


def holiday_flag(df: DataFrame, holidays: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """Add ``is_holiday`` from a calendar table of ``month`` and ``day``; there are at most 12 x 31 of those."""
    day = F.col(spec.time)
    possible = F.col("month").between(1, 12) & F.col("day").between(1, 31)
    known = holidays.select("month", "day").where(possible).distinct().withColumn("_known", F.lit(1))
    dated = df.withColumns({"month": F.month(day), "day": F.dayofmonth(day)})
    marked = dated.join(F.broadcast(known), ["month", "day"], "left")
    return marked.select(*df.columns, F.coalesce("_known", F.lit(0)).alias("is_holiday"))
