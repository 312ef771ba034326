"""Rolling statistics of any width against pandas."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from pastward.operators.features import rolling_columns
from pastward.operators.long_windows import RankTable, rolling_quantiles, rolling_statistics, sliding_quantile
from pastward.operators.ordering import over_history
from pastward.spec import SeriesSpec

SMALL = SeriesSpec(block_rows=16)


def series(seed, n, gaps=0.1):
    rng = np.random.default_rng(seed)
    values = rng.normal(1e6, 3, n).round(1)
    return [None if rng.random() < gaps else float(v) for v in values]


def expected(values, n, stat):
    past = pd.Series(values, dtype=float).shift(1).rolling(n)
    return (past.median() if stat == "median" else getattr(past, stat)()).to_numpy()


def by_time(df, key, column):
    rows = df.where(f"series_id = '{key}'").orderBy("timestamp").select(column).collect()
    return np.array([np.nan if r[0] is None else r[0] for r in rows])


@pytest.mark.parametrize("windows", [(1, 2, 5), (13, 16, 17), (40,)])
def test_statistics_equal_pandas(hourly, windows):
    data = {"a": series(1, 150), "b": series(2, 37, 0.0), "c": series(3, 3)}
    out = rolling_statistics(hourly(data), "Consumption", windows, "y", SMALL).persist()
    assert out.columns[:3] == ["series_id", "Consumption", "timestamp"] and not [c for c in out.columns if c.startswith("_")]
    for key, values in data.items():
        for n in windows:
            for stat in ("mean", "std", "min", "max"):
                want = expected(values, n, stat)
                assert np.allclose(by_time(out, key, f"y_roll_{stat}_{n}"), want, atol=1e-5, equal_nan=True), (key, n, stat)
    out.unpersist()


def test_equal_values_have_no_spread(hourly):
    out = rolling_statistics(hourly({"a": [0.1] * 60}), "Consumption", (7, 23), "y", SMALL).dropna()
    assert {(r["y_roll_mean_7"], r["y_roll_std_7"], r["y_roll_std_23"]) for r in out.collect()} == {(0.1, 0.0, 0.0)}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 25])
def test_rank_table(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 9, 60).astype(float)
    table = RankTable(values)
    low = np.arange(0, 60 - n)
    for k in {0, n // 2, n - 1}:
        found = table.order_statistic(low, low + n, np.full(len(low), k))
        assert (found == [np.sort(values[i : i + n])[k] for i in low]).all()
    for p in (0.0, 0.3, 0.5, 1.0):
        got = sliding_quantile(values, n, p)
        assert np.isnan(got[:n]).all() and np.allclose(got[n:], [np.quantile(values[i - n : i], p) for i in range(n, 60)])


def test_medians_equal_pandas(hourly):
    data = {"a": series(4, 130), "b": series(5, 30, 0.0)}
    out = rolling_quantiles(hourly(data), "Consumption", (4, 21), "y", SMALL)
    assert out.columns == ["series_id", "Consumption", "timestamp", "y_roll_median_4", "y_roll_median_21"]
    for key, values in data.items():
        for n in (4, 21):
            assert np.allclose(by_time(out, key, f"y_roll_median_{n}"), expected(values, n, "median"), equal_nan=True)
    assert rolling_quantiles(hourly({"a": [1.0]}).limit(0), "Consumption", (4,), "y", SMALL).count() == 0


def test_cost_does_not_follow_the_width(hourly):
    """A window of 1009 rows, put together from two scans, is no dearer than twice one of 24 (the direct form would be 40 times)."""
    rng = np.random.default_rng(6)
    df = hourly({"a": rng.normal(size=40_000).tolist()}).persist()
    df.count()

    def seconds(make):
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    spec = SeriesSpec()
    narrow = seconds(lambda: over_history(df, spec, 24, lambda w: rolling_columns("Consumption", (24,), w, "y")))
    wide = seconds(lambda: rolling_statistics(df, "Consumption", (1009,), "y", spec))
    median = seconds(lambda: rolling_quantiles(df, "Consumption", (365,), "y", spec))
    df.unpersist()
    print(f"24 rows {narrow:.2f} s, 1009 rows {wide:.2f} s, median of 365 rows {median:.2f} s")
    assert wide < 4 * narrow and median < 4 * max(wide, narrow)
