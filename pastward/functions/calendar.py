"""Timestamp parsing and calendar columns (all known when the forecast is made)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The leading hour of a clock text, and the ISO form used in reports.
CLOCK_HOUR = r"^(\d{1,2}):"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def parse_timestamp(date: Column, time: Column) -> Column:
    """Date text plus the start hour of the clock text; text that does not parse raises."""
    hour = F.regexp_extract(F.trim(time), CLOCK_HOUR, 1).cast("int")
    return F.to_timestamp_ntz(date) + F.make_interval(hours=hour)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a naive timestamp or date, whatever the session time zone."""
    ntz = ts.cast("timestamp_ntz")
    seconds = F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)
    return F.unix_date(ntz.cast("date")).cast("long") * 86400 + seconds


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def hour_period(hour: Column) -> Column:
    return (
        F.when(hour.between(0, 5), "night")
        .when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .otherwise("evening")
    )


def cycle(position: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle, so that its two ends are neighbours."""
    angle = position * (2.0 * F.pi() / F.lit(float(period)))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "dow": day_of_week(ts),
        "day_of_week_name": F.date_format(ts, "EEEE"),
        "month": F.month(ts),
        "day_of_year": F.dayofyear(ts),
        "is_weekend": is_weekend(ts),
        "season": season(F.month(ts)),
        "hour_period": hour_period(F.hour(ts)),
    }


def cyclical_columns(ts: Column) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for name, position, period in (
        ("hour", F.hour(ts), 24),
        ("dow", day_of_week(ts), 7),
        ("month", F.month(ts) - 1, 12),
    ):
        columns[f"{name}_sin"], columns[f"{name}_cos"] = cycle(position, period)
    return columns


def fourier_columns(position: Column, period: float, order: int, prefix: str) -> dict[str, Column]:
    """Sine and cosine terms of the first ``order`` harmonics of a period."""
    columns: dict[str, Column] = {}
    for k in range(1, order + 1):
        columns[f"{prefix}_sin_{k}"], columns[f"{prefix}_cos_{k}"] = cycle(position * k, period)
    return columns


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)
