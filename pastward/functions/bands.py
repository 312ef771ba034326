"""Rain bands and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pastward.schema import RAIN_LEVELS

# Upper edges of the bands, each edge belonging to the band below it.
RAIN_EDGES = (0.0, 0.5, 2.0)


def rain_band(rain: Column) -> Column:
    """Right-closed bands: up to 0 none, up to 0.5 light, up to 2 moderate, more is heavy; null stays null."""
    present = rain.isNotNull() & ~F.isnan(rain)
    band = F.when(~present, F.lit(None).cast("string"))
    for edge, level in zip(RAIN_EDGES, RAIN_LEVELS):
        band = band.when(rain <= edge, level)
    return band.otherwise(RAIN_LEVELS[-1])


def ordinal_rank(level: Column, levels: tuple[str, ...] = RAIN_LEVELS) -> Column:
    """0, 1, 2 … in the order of ``levels``; an unknown level is -1 and null stays null."""
    rank = F.when(level.isNull(), F.lit(None).cast("double"))
    for position, name in enumerate(levels):
        rank = rank.when(level == name, float(position))
    return rank.otherwise(-1.0)
