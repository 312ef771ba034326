"""The audit that checks every row finds exactly the rows that look ahead."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastward.operators.audits import causality_by_row
from pastward.operators.ewm import ewm_columns, join_carries
from pastward.operators.features import named, rolling_columns
from pastward.operators.ordering import number_rows, over_history, with_history
from pastward.schema import TARGET
from pastward.spec import SeriesSpec

SMALL = SeriesSpec(block_rows=16)


def test_rows_that_look_ahead_are_named(hourly):
    rng = np.random.default_rng(0)
    df = hourly({"a": rng.normal(size=40).tolist(), "b|c": rng.normal(size=7).tolist()}, _at=lambda p: 1.0)

    def build(frame):
        odd = (F.col("series_id").endswith("|a")) & (F.hour("timestamp") == 5) & (F.dayofmonth("timestamp") == 1)

        def columns(w):
            past = F.lag(TARGET, 1).over(w)
            return {
                **rolling_columns(TARGET, (3,), w, "y"),
                "peek": F.when(odd, F.lead(TARGET, 2).over(w)).otherwise(past),
                "kind": F.when(odd, F.col(TARGET) > 0).otherwise(past > 0),
            }

        return over_history(frame, SMALL, 3, columns)

    names = ["y_roll_mean_3", "y_roll_std_3", "y_roll_max_3", "peek", "kind"]
    got = {(r["feature"], r["series_id"], r["timestamp"].hour): r["turns"] for r in causality_by_row(df, build, names, 3, SMALL, ahead=2).collect()}
    # the flag changes where the changed value has another sign
    value = df.where("series_id = 'a' and hour(timestamp) = 5 and dayofmonth(timestamp) = 1").first()["Consumption"]
    expected = {("peek", "a", 5): 3} | ({("kind", "a", 5): 1} if (value > 0) != (value * 3 + 1000 > 0) else {})
    assert got == expected
    assert causality_by_row(df.limit(0), build, names, 3, SMALL).count() == 0
    with pytest.raises(ValueError):
        causality_by_row(df, build, names, 0, SMALL)


def test_unbounded_memory_is_no_fault(hourly):
    df = hourly({"a": [float(v) for v in np.random.default_rng(1).normal(size=60)]})

    def build(frame):
        blocks = join_carries(with_history(number_rows(frame, SMALL), SMALL, 0), SMALL, TARGET, (6,))
        return blocks.select("series_id", "timestamp", *named(ewm_columns(SMALL, TARGET, (6,), "y")))

    assert causality_by_row(df, build, ["y_6"], 8, SMALL).count() == 0
