from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pastward.operators.forecast import fixed_origin_forecast
from pastward.operators.daily import same_date_columns
from pastward.operators.quality import calendar_gaps, fitness, missing_days
from pastward.operators.selection import (
    correlation_matrix,
    drop_redundant,
    permutation_importance,
    permuted_rows,
    stability_ranking,
)
from pastward.spec import SeriesSpec

DAYS = SeriesSpec(time="Date", step_seconds=86400, block_rows=16)


def daily(spark, dates, values=None, key="a"):
    values = values if values is not None else range(len(dates))
    return spark.createDataFrame([(key, d.date(), float(v)) for d, v in zip(dates, values)], "series_id string, Date date, Consumption double")


def test_permutation_uses_every_vector_once(spark, hourly):
    base = hourly({"a": range(500), "b": range(300)}).withColumn("features", array_to_vector(F.array("Consumption")))
    rows = permuted_rows(base, 3).select("features", "partner").collect()
    own, partner = [[float(row[i][0]) for row in rows] for i in (0, 1)]
    assert len(rows) == 800 and sorted(own) == sorted(partner) and own != partner


def test_permutation_importance_finds_the_used_column(spark, hourly):
    rng = np.random.default_rng(0)
    base = hourly({"a": rng.normal(0, 1, 400)}).withColumn("noise", F.hash("timestamp") / F.lit(2.0**31))
    base = base.withColumn("x", F.col("Consumption") * 2).withColumn("features", array_to_vector(F.array("x", "noise")))
    model = LinearRegression(labelCol="Consumption").fit(base)
    found = {row["feature"]: row["importance"] for row in permutation_importance(model, base, ["x", "noise"], 2).collect()}
    assert found["x"] > 0.5 and abs(found["noise"]) < 0.01


def test_redundancy_keeps_the_better_one(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    data = {"a": a, "copy": a * 3 + 1, "other": rng.normal(size=300)}
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(*data.values())], "a double, copy double, other double")
    matrix = correlation_matrix(df, list(data))
    assert matrix["a", "other"] == pytest.approx(np.corrcoef(data["a"], data["other"])[0, 1])
    assert drop_redundant({"a": 0.5, "copy": 0.6, "other": 0.1}, matrix) == ["copy", "other"]
    # a dropped feature makes nothing else redundant
    chain = {("a", "b"): 0.99, ("b", "c"): 0.99, ("a", "c"): 0.5}
    assert drop_redundant({"a": 3, "b": 2, "c": 1}, chain) == ["a", "c"]


def test_stability_counts_top_places(spark):
    rows = [(f, name, s) for f in (1, 2) for name, s in (("x", 3.0), ("y", 2.0 if f == 1 else 0.5), ("z", 1.0))]
    ranking = {r["feature"]: r for r in stability_ranking(spark.createDataFrame(rows, "fold int, feature string, score double"), top=2).collect()}
    assert ranking["x"]["stability"] == 1.0 and ranking["y"]["stability"] == 0.5 and ranking["z"]["stability"] == 0.5
    assert ranking["x"]["combined"] == pytest.approx(1.0)


def test_gaps_and_missing_days(spark):
    dates = pd.date_range("2014-02-20", "2014-02-28").append(pd.date_range("2014-10-01", "2014-10-30"))
    df = daily(spark, dates)
    gap = calendar_gaps(df, DAYS).collect()
    assert len(gap) == 1 and gap[0]["missing_days"] == 214
    assert missing_days(df, DAYS).count() == 214
    row = fitness(df, DAYS).first()
    assert row["status"] == "NOT_READY" and row["reasons"] == "fewer than 523 observations; calendar gaps"
    assert fitness(daily(spark, pd.date_range("2014-01-01", periods=523)), DAYS).first()["status"] == "READY"


def test_same_date_values_need_the_date(spark):
    dates = pd.DatetimeIndex(["2019-02-28", "2019-03-01", "2020-02-22", "2020-02-28", "2020-02-29", "2020-03-01"])
    rows = {r["Date"].isoformat(): r for r in same_date_columns(daily(spark, dates), "Consumption", DAYS).collect()}
    assert rows["2020-02-28"]["same_date_last_year"] == 0.0 and rows["2020-02-29"]["same_date_last_year"] == 0.0
    assert rows["2020-02-29"]["same_weekday_last_week"] == 2.0 and rows["2020-03-01"]["same_weekday_last_week"] is None
    assert len(rows) == 6


def test_seasonal_forecast_is_the_recursion(spark):
    rng = np.random.default_rng(4)
    dates = pd.date_range("2020-01-01", periods=60)
    values = rng.normal(100, 10, 60).round(2)
    df = daily(spark, dates, values)
    origin = df.agg(F.lit("a").alias("series_id"), F.lit(dates[39].date()).alias("origin"))
    got = {(r["method"], r["Date"]): r["forecast"] for r in fixed_origin_forecast(df, origin, 20, DAYS).collect()}
    known = list(values[:40])
    for step in range(1, 21):
        known.append(known[-7])
        day = (dates[39] + pd.Timedelta(days=step)).date()
        assert got["seasonal_7", day] == known[-1] and got["last_value", day] == values[39]
    # values after the origin change nothing
    changed = df.withColumn("Consumption", F.when(F.col("Date") > F.lit(dates[39].date()), -1.0).otherwise(F.col("Consumption")))
    again = {(r["method"], r["Date"]): r["forecast"] for r in fixed_origin_forecast(changed, origin, 20, DAYS).collect()}
    assert again == got
    with pytest.raises(ValueError):
        fixed_origin_forecast(df, origin, 366, DAYS)
