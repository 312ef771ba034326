"""Past-only features, chronological evaluation and audits for keyed time series, on Spark DataFrames."""

from pastward.spec import DAILY, HOURLY, SeriesSpec

__all__ = ["DAILY", "HOURLY", "SeriesSpec"]
