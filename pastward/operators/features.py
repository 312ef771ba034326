"""The past-only feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.functions.bands import rain_band
from pastward.functions.calendar import calendar_columns, cyclical_columns
from pastward.operators.ewm import CHUNK, ewm_columns, join_carries
from pastward.operators.ordering import (
    BLOCK,
    ROW,
    history_window,
    number_rows,
    over_history,
    own_block,
    with_history,
)
from pastward.spec import HOURLY, SeriesSpec


def lag_columns(value: str, lags: tuple[int, ...], w: WindowSpec, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_lag_{k}": F.lag(F.col(value), k).over(w) for k in lags}


def full_window(aggregate: Column, value: Column, rows: int, w: WindowSpec) -> Column:
    """An aggregate over the ``rows`` rows before the current one; null unless all of them have a value."""
    frame = w.rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) == rows, aggregate.over(frame))


def rolling_columns(
    value: str, windows: tuple[int, ...], w: WindowSpec, prefix: str, stats: tuple[str, ...] = ("mean", "std", "min", "max")
) -> dict[str, Column]:
    x = F.col(value)
    aggregate = {
        "mean": F.avg(x),
        "median": F.percentile(x, F.lit(0.5)),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        "max": F.max(x),
    }
    return {f"{prefix}_roll_{stat}_{n}": full_window(aggregate[stat], x, n, w) for n in windows for stat in stats}


LONGEST_FRAME = 32  # Spark aggregates a sliding frame anew for every row, so longer windows are put together from shorter ones


def part_rows(rows: int, windows: tuple[int, ...]) -> int | None:
    """A short window that fits into a long one several times, one that is asked for anyway if there is such."""
    if rows <= LONGEST_FRAME:
        return None
    fitting = [n for n in range(4, LONGEST_FRAME + 1) if rows % n == 0]
    return max([n for n in fitting if n in windows] or fitting, default=None)


def rolling_levels(
    value: str, windows: tuple[int, ...], w: WindowSpec, prefix: str, stats: tuple[str, ...] = ("mean", "std", "min", "max")
) -> list[dict[str, Column]]:
    """The columns of :func:`rolling_columns` in two steps: short windows, then long ones from the lags of short ones."""
    parts = {n: part_rows(n, windows) for n in windows}
    direct = tuple(n for n in windows if parts[n] is None)
    first, second = rolling_columns(value, direct, w, prefix, stats), {}
    for n, part in parts.items():
        if part is None:
            continue

        def shorter(stat: str) -> str:
            name = f"{prefix}_roll_{stat}_{part}"
            if name in first:
                return name
            # not asked for: a helper column
            first[f"_{name}"] = rolling_columns(value, (part,), w, prefix, (stat,))[name]
            return f"_{name}"

        second |= pooled_columns({stat: shorter(stat) for stat in {"mean", *stats}}, part, n // part, w, prefix, stats)
    return [first, second]


def pooled_columns(
    source: dict[str, str], part: int, parts: int, w: WindowSpec, prefix: str, stats: tuple[str, ...]
) -> dict[str, Column]:
    """Statistics of ``parts`` adjoining windows of ``part`` rows each, null unless all of them are full."""
    rows = part * parts

    def lagged(stat: str) -> list[Column]:
        column = F.col(source[stat])
        return [column, *(F.lag(column, part * i).over(w) for i in range(1, parts))]

    means = lagged("mean")
    # relative to one part, so that equal parts give exactly their mean and no spread
    offsets = [mean - means[0] for mean in means]
    offset = sum(offsets[1:], offsets[0]) / parts
    complete = offset.isNotNull()
    columns: dict[str, Column] = {}
    for stat in stats:
        if stat == "mean":
            pooled = means[0] + offset
        elif stat == "std":
            inside = [std * std * F.lit(float(part - 1)) for std in lagged("std")]
            between = [(o - offset) * (o - offset) * F.lit(float(part)) for o in offsets]
            pooled = F.sqrt(sum(inside[1:] + between, inside[0]) / F.lit(float(rows - 1)))
        else:
            pooled = F.when(complete, (F.least if stat == "min" else F.greatest)(*lagged(stat)))
        columns[f"{prefix}_roll_{stat}_{rows}"] = pooled
    return columns


def previous_change(value: str, w: WindowSpec) -> Column:
    x = F.col(value)
    return F.lag(x, 1).over(w) - F.lag(x, 2).over(w)


def demand_levels(w: WindowSpec) -> list[dict[str, Column]]:
    first, second = rolling_levels(S.TARGET, S.DEMAND_WINDOWS, w, "consumption")
    lags = lag_columns(S.TARGET, S.DEMAND_LAGS, w, "consumption")
    return [{**lags, **first, "consumption_prev_change": previous_change(S.TARGET, w)}, second]


def weather_columns(w: WindowSpec) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for name in S.WEATHER:
        prefix = name.lower()
        columns |= lag_columns(name, S.WEATHER_LAGS, w, prefix)
        columns |= rolling_columns(name, (S.WEATHER_WINDOW,), w, prefix, ("mean",))
    return columns


def named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing: turn it into null in every floating-point column."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*(F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floating else F.col(c) for c in df.columns))


def past_features(series: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """All feature columns for every row of a series table that is unique on key and time.

    Two shuffles of the rows: one to number them, one to lay out the blocks that every window shares.
    """
    numbered = number_rows(series.withColumn(S.TARGET, F.col(S.TARGET).cast("double")), spec)
    blocks = with_history(numbered, spec, max(S.DEMAND_LAGS + S.DEMAND_WINDOWS))
    blocks = join_carries(blocks, spec, S.TARGET, S.EWM_SPANS)
    w = history_window(spec, CHUNK)
    first, second = demand_levels(w)
    past = (
        blocks.select(
            *series.columns,
            ROW,
            BLOCK,
            CHUNK,
            *named(first),
            *named(weather_columns(w)),
            *named(ewm_columns(spec, S.TARGET, S.EWM_SPANS, "consumption_ewm")),
        )
        .select("*", *named(second))
        .where(F.col(BLOCK) == own_block(spec))
    )
    past = past.drop(ROW, BLOCK, CHUNK, *(name for name in first if name.startswith("_")))
    ts = F.col(spec.time)
    return past.select(
        "*",
        rain_band(F.col("rain_lag_1")).alias("rain_intensity"),
        *named(calendar_columns(ts)),
        *named(cyclical_columns(ts)),
    )


def drop_warm_up(features: DataFrame) -> DataFrame:
    """Leave out rows without a target or without a full week of history; gaps in the weather stay for imputation."""
    return features.dropna(subset=list(S.WARM_UP))


def persistence_table(series: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """The rows of the feature table with only the target's own lags: all that the persistence models read."""

    def build(w: WindowSpec) -> list[dict[str, Column]]:
        first, second = rolling_levels(S.TARGET, (max(S.PERSISTENCE_LAGS),), w, "consumption", ("mean", "std"))
        return [{**lag_columns(S.TARGET, S.PERSISTENCE_LAGS, w, "consumption"), **first}, second]

    target = series.select(spec.key, spec.time, F.col(S.TARGET).cast("double").alias(S.TARGET))
    lags = [f"consumption_lag_{k}" for k in S.PERSISTENCE_LAGS]
    past = drop_warm_up(over_history(target, spec, max(S.PERSISTENCE_LAGS), build))
    return past.select(spec.key, spec.time, S.TARGET, *lags)


def feature_table(series: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    return drop_warm_up(past_features(series, spec))
