"""Positions, look-back windows and exponential means against pandas, over many small blocks."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.operators.audits import causality_violations
from pastward.operators.ewm import ewm_columns, join_carries
from pastward.operators.features import (
    feature_table,
    named,
    past_features,
    persistence_table,
    previous_change,
    rolling_columns,
    rolling_levels,
)
from pastward.operators.ordering import ROW, ROWS, first_rows, keep_last, last_rows, number_rows, over_history, with_history
from pastward.operators.splits import chronological_split, expanding_folds
from pastward.spec import HOURLY, SeriesSpec

SMALL = SeriesSpec(block_rows=64)


def gappy(seed: int, rows: int):
    rng = np.random.default_rng(seed)
    hours = np.sort(rng.choice(rows * 3, rows, replace=False))
    return hours, rng.normal(100, 25, rows).round(2)


@pytest.fixture
def three_series(hourly):
    rng = np.random.default_rng(3)
    return hourly(
        {"long": gappy(1, 900), "short": gappy(2, 40), "one": ([5], [7.0])},
        Temperature=lambda p: rng.normal(10, 4, len(p)).round(2),
        Rain=lambda p: np.where(rng.random(len(p)) < 0.05, np.nan, (rng.random(len(p)) * 3).round(2)),
        Sun=lambda p: rng.integers(0, 5, len(p)).astype(float),
    )


def per_series(df):
    pdf = df.toPandas().sort_values(["series_id", "timestamp"]).reset_index(drop=True)
    return {key: part.reset_index(drop=True) for key, part in pdf.groupby("series_id")}


@pytest.mark.parametrize("spec", [HOURLY, SMALL, SeriesSpec(block_rows=1)])
def test_positions_are_dense(three_series, spec):
    for part in per_series(number_rows(three_series, spec)).values():
        assert list(part[ROW]) == list(range(len(part)))
        assert set(part[ROWS]) == {len(part)}


@pytest.mark.parametrize("key, time", [("a", None), (None, datetime(2020, 1, 1))])
def test_missing_key_or_time_is_an_error(spark, key, time):
    rows = [("a", datetime(2020, 1, 1, hour)) for hour in range(24)] + [(key, time)]
    bad = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz")
    for use in (lambda d: number_rows(d, HOURLY), chronological_split, expanding_folds):
        # two stages may fail at once, and Spark then reports only that
        with pytest.raises(PySparkException, match="is missing|Multiple failures"):
            use(bad).collect()


@pytest.mark.parametrize("spec", [SMALL, HOURLY])
def test_feature_columns_equal_pandas(three_series, spec):
    for part in per_series(past_features(three_series, spec)).values():
        y = part["Consumption"]
        before = y.shift(1)
        expected = {f"consumption_lag_{k}": y.shift(k) for k in S.DEMAND_LAGS}
        for n in S.DEMAND_WINDOWS:
            roll = before.rolling(n, min_periods=n)
            for stat in ("mean", "std", "min", "max"):
                expected[f"consumption_roll_{stat}_{n}"] = getattr(roll, stat)()
        for span in S.EWM_SPANS:
            expected[f"consumption_ewm_{span}"] = before.ewm(span=span, adjust=False).mean()
        expected["consumption_prev_change"] = y.shift(1) - y.shift(2)
        for name in S.WEATHER:
            for k in S.WEATHER_LAGS:
                expected[f"{name.lower()}_lag_{k}"] = part[name].shift(k)
            expected[f"{name.lower()}_roll_mean_24"] = part[name].shift(1).rolling(24, min_periods=24).mean()
        for name, values in expected.items():
            np.testing.assert_allclose(
                part[name].to_numpy(dtype=float), values.to_numpy(dtype=float), rtol=1e-9, atol=1e-7, err_msg=name
            )
        assert set(S.FEATURES) <= set(part.columns)


def test_warm_up_rows_leave(three_series):
    rows = {key: len(part) for key, part in per_series(feature_table(three_series, SMALL)).items()}
    assert rows == {"long": 900 - 168}
    assert persistence_table(three_series, SMALL).count() == 900 - 168


def test_window_with_a_missing_value_is_null(hourly):
    series = hourly({"a": [1, 2, 3, None, 5, 6, 7, 8, 9, 10]})
    part = per_series(over_history(series, SMALL, 3, lambda w: rolling_columns("Consumption", (3,), w, "y", ("mean",))))["a"]
    assert part["y_roll_mean_3"].isna().tolist() == [True, True, True, False, True, True, True, False, False, False]


@pytest.mark.parametrize("spans", [(6, 24), (2, 1000), (3,)])
def test_exponential_mean_over_chunks(hourly, spans):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.normal(0, 1, 300), rng.normal(1e6, 1e3, 300), [0.0] * 200])
    numbered = number_rows(hourly({"a": values, "b": [4.0, 2.0]}), SMALL)
    blocks = join_carries(with_history(numbered, SMALL, 0), SMALL, "Consumption", spans)
    columns = named(ewm_columns(SMALL, "Consumption", spans, "e"))
    for part in per_series(blocks.select("series_id", "timestamp", "Consumption", *columns)).values():
        for span in spans:
            expected = part["Consumption"].shift(1).ewm(span=span, adjust=False).mean()
            np.testing.assert_allclose(part[f"e_{span}"].astype(float), expected, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("windows", [(168,), (24, 168), (37, 50), (3, 96)])
def test_long_windows_are_put_together_from_short_ones(hourly, windows):
    rng = np.random.default_rng(8)
    values = [5.1] * 200 + list(rng.normal(1e5, 3, 300)) + [None] + list(rng.normal(0, 1e-3, 200))
    build = lambda w: rolling_levels("Consumption", windows, w, "y")
    wide = over_history(hourly({"a": values, "b": values[:60]}), SMALL, 168, build)
    assert not [c for c in wide.columns if c.startswith("_")]
    for part in per_series(wide).values():
        before = part["Consumption"].shift(1)
        for n in windows:
            exact = before.rolling(n, min_periods=n)
            for stat, fn in (("mean", np.mean), ("min", np.min), ("max", np.max), ("std", lambda x: np.std(x, ddof=1))):
                expected = exact.apply(fn, raw=True)
                np.testing.assert_allclose(part[f"y_roll_{stat}_{n}"].astype(float), expected, rtol=1e-9, atol=1e-12)
        if len(part) > 200 and 168 in windows:
            assert (part["y_roll_std_168"][168:200] == 0).all()


def test_span_of_one_is_refused(hourly):
    numbered = number_rows(hourly({"a": [1, 2]}), SMALL)
    with pytest.raises(ValueError, match="above 1"):
        join_carries(with_history(numbered, SMALL, 0), SMALL, "Consumption", (1,))


@pytest.mark.parametrize("spans", [(6, 24), (2, 400)])
@pytest.mark.parametrize("share", [0.05, 0.6, 0.97])
def test_exponential_mean_over_gaps(hourly, spans, share):
    rng = np.random.default_rng(int(share * 100))
    values = rng.normal(100, 30, 900)
    values[rng.random(900) < share] = np.nan
    values[300:520] = np.nan  # a gap over several blocks
    numbered = number_rows(hourly({"a": list(values), "none": [None, None], "late": [None] * 130 + [3.0, 4.0]}), SMALL)
    blocks = join_carries(with_history(numbered, SMALL, 40), SMALL, "Consumption", spans).where("_block = floor(_row / 64)")
    columns = named(ewm_columns(SMALL, "Consumption", spans, "e"))
    for part in per_series(blocks.select("series_id", "timestamp", "Consumption", *columns)).values():
        for span in spans:
            expected = part["Consumption"].astype(float).shift(1).ewm(span=span, adjust=False).mean()
            np.testing.assert_allclose(part[f"e_{span}"].astype(float), expected, rtol=1e-9, atol=1e-9)


def test_features_of_a_series_with_missing_targets(hourly):
    rng = np.random.default_rng(6)
    values = [None if i % 97 == 3 else float(v) for i, v in enumerate(rng.normal(100, 9, 800))]
    series = hourly({"a": values}, Temperature=lambda p: 0.0, Rain=lambda p: 0.0, Sun=lambda p: 0.0)
    kept = feature_table(series, SMALL)
    assert kept.where("Consumption IS NULL").count() == 0
    assert kept.count() == kept.where("consumption_ewm_6 IS NOT NULL").count()


def test_no_feature_looks_ahead(three_series):
    found = causality_violations(three_series, lambda f: past_features(f, SMALL), S.FEATURES, SMALL)
    rows = found.collect()
    assert {row["feature"] for row in rows} == set(S.FEATURES)
    assert all(row["mismatches"] == 0 and row["rows"] > 400 for row in rows)


def test_audit_finds_a_leak(three_series):
    leak = lambda f: over_history(f, SMALL, 2, lambda w: {"now": F.col("Consumption") + 0, "past": previous_change("Consumption", w)})
    found = {row["feature"]: row["mismatches"] for row in causality_violations(three_series, leak, ["now", "past"], SMALL).collect()}
    assert found["past"] == 0 and found["now"] == 3


def test_keep_last(spark):
    rows = [("a", "2020-01-01 00:00:00", 1, 5.0, None), ("a", "2020-01-01 00:00:00", 3, 7.0, "x"), ("a", "2020-01-01 00:00:00", 2, None, "y")]
    df = spark.createDataFrame(rows, "series_id string, t string, ordinal int, Consumption double, note string")
    df = df.withColumn("timestamp", F.to_timestamp_ntz("t")).drop("t")
    kept = keep_last(df, HOURLY, "ordinal").collect()
    assert len(kept) == 1 and kept[0]["Consumption"] == 7.0 and kept[0]["note"] == "x"


def test_first_and_last_rows(three_series):
    parts = per_series(three_series)
    first, last = per_series(first_rows(three_series, SMALL, 50)), per_series(last_rows(three_series, SMALL, 50))
    for key, part in parts.items():
        pd.testing.assert_series_equal(first[key]["timestamp"], part["timestamp"].head(50).reset_index(drop=True))
        pd.testing.assert_series_equal(last[key]["timestamp"], part["timestamp"].tail(50).reset_index(drop=True))


def test_windows_over_rows_are_never_wider_than_a_block(three_series):
    """No plan puts a series into one partition: every window over rows is partitioned by bucket or block too."""
    plan = past_features(three_series, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        per_chunk = any(name in line for name in ("bucket_rows", "last_row", "step_", "after_"))  # one row per bucket or chunk
        if "Window [" in line and not per_chunk:
            assert "_block" in line or "_bucket" in line, line
