"""Forecasts of several steps from one fixed origin, from values at or before the origin alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.operators.ordering import beside_series
from pastward.schema import TARGET
from pastward.spec import DAILY, SeriesSpec

# The season length, the longest horizon and the method names.
SEASON = 7
LONGEST = 365
LAST_VALUE, SEASONAL = "last_value", "seasonal_7"


def fixed_origin_forecast(df: DataFrame, origin: DataFrame, horizon: int, spec: SeriesSpec = DAILY, value: str = TARGET) -> DataFrame:
    """``key, Date, forecast, method`` for the days after each series' origin.

    ``origin`` holds one row per series: its key and the last known day as ``origin``. The seasonal forecast repeats
    the last seven days before the origin, which is what applying it to its own forecasts amounts to.
    """
    if not 1 <= horizon <= LONGEST:
        raise ValueError(f"horizon must be from 1 to {LONGEST}")
    day = F.col(spec.time)
    known = beside_series(df, spec, origin).where(day <= F.col("origin"))
    age = F.date_diff("origin", day)
    # at most one week of days is kept per series
    recent = known.groupBy(spec.key, "origin").agg(
        F.max_by(value, spec.time).alias("last"),
        *(F.max(F.when(age == back, F.col(value))).alias(f"back_{back}") for back in range(SEASON)),
    )
    week = F.array(*(F.col(f"back_{back}") for back in reversed(range(SEASON))))
    steps = recent.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    wide = steps.select(
        spec.key,
        F.date_add("origin", F.col("step")).alias(spec.time),
        F.col("last").alias(LAST_VALUE),
        F.get(week, (F.col("step") - 1) % SEASON).alias(SEASONAL),
    )
    return wide.unpivot([spec.key, spec.time], [LAST_VALUE, SEASONAL], "method", "forecast")
