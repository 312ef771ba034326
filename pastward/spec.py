"""How a table is keyed, ordered and cut into blocks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeriesSpec:
    """Key, order column and grid of a time-series table.

    ``step_seconds`` is the grid the series is declared on (at most one row per step). It sizes the time buckets
    that rows are counted in, so that even one series holding most of the table is spread over many tasks.
    ``block_rows`` is the number of consecutive rows one window partition handles. With the week of rows copied in front
    of it, the default stays below the 4096 rows that Spark's window buffer holds without spilling.
    """

    key: str = "series_id"
    time: str = "timestamp"
    step_seconds: int = 3600
    block_rows: int = 2048

    def __post_init__(self) -> None:
        if self.step_seconds < 1:
            raise ValueError("step_seconds must be at least 1")
        if self.block_rows < 1 or self.block_rows & (self.block_rows - 1):
            raise ValueError("block_rows must be a power of two")


HOURLY = SeriesSpec()
DAILY = SeriesSpec(time="Date", step_seconds=86400)
