from __future__ import annotations

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pastward.functions.bands import ordinal_rank, rain_band
from pastward.functions.calendar import calendar_columns, cyclical_columns, epoch_seconds, parse_timestamp
from pastward.functions.errors import adjusted_r2
from pastward.operators.scoring import (
    append_metrics,
    best_per_group,
    choose_final,
    final_table,
    fold_summary,
    lag_of_model,
    score,
    worst_rows,
)
from pastward.operators.audits import non_finite_metrics, replay_metrics, require_finite


def test_parse_hours(spark):
    df = spark.createDataFrame([("2020-02-28", t) for t in ("0:00", "9:00", "23:00", " 7:00", "07:00 - 08:00")], "d string, t string")
    hours = [row[0].hour for row in df.select(parse_timestamp(F.col("d"), F.col("t"))).collect()]
    assert hours == [0, 9, 23, 7, 7]


@pytest.mark.parametrize("date, time", [("2020-01-01", "x"), ("2020-13-01", "1:00"), ("2020-01-01", "123:00")])
def test_unreadable_time_raises(spark, date, time):
    df = spark.createDataFrame([(date, time)], "d string, t string")
    with pytest.raises(PySparkException):
        df.select(parse_timestamp(F.col("d"), F.col("t"))).collect()


def test_rain_bands_are_right_closed(spark):
    values = [-1.0, 0.0, 0.5, 0.51, 2.0, 2.01, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    band = rain_band(F.col("r"))
    rows = df.select(band, ordinal_rank(band)).collect()
    assert [row[0] for row in rows] == ["none", "none", "light", "moderate", "moderate", "heavy", None, None]
    assert [row[1] for row in rows] == [0.0, 0.0, 1.0, 2.0, 2.0, 3.0, None, None]


def test_calendar_columns_equal_pandas(spark):
    times = pd.date_range("2019-12-25", "2021-01-05", freq="7h")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in times], "ts timestamp_ntz")
    columns = {**calendar_columns(F.col("ts")), **cyclical_columns(F.col("ts")), "epoch": epoch_seconds(F.col("ts"))}
    got = df.select("ts", *(c.alias(n) for n, c in columns.items())).toPandas().sort_values("ts").reset_index(drop=True)
    assert (got["hour"] == times.hour).all() and (got["dow"] == times.dayofweek).all()
    assert (got["day_of_week_name"] == times.day_name()).all() and (got["day_of_year"] == times.dayofyear).all()
    assert (got["is_weekend"] == (times.dayofweek >= 5).astype(int)).all()
    assert (got["epoch"] == (times - pd.Timestamp("1970-01-01")) // pd.Timedelta(seconds=1)).all()
    assert got["hour_sin"].between(-1, 1).all()


def predictions(spark, rows):
    return spark.createDataFrame(rows, "model string, actual double, prediction double")


def test_metrics_by_hand(spark):
    row = score(predictions(spark, [("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 5.0, 1.0), ("m", 0.0, 0.0)])).first()
    assert row["mae"] == pytest.approx(5 / 4) and row["rmse"] == pytest.approx((17 / 4) ** 0.5)
    assert row["r2"] == pytest.approx(1 - 17 / 14.75)
    assert row["smape_pct"] == pytest.approx((200 / 3 + 800 / 6) / 4)


def test_constant_target_has_no_r2(spark):
    table = score(predictions(spark, [("m", 5.0, 4.0), ("m", 5.0, 6.0)]))
    assert table.first()["r2"] is None and non_finite_metrics(table).count() == 1
    with pytest.raises(PySparkException, match="not finite"):
        require_finite(table).collect()


@pytest.mark.parametrize("pair", [(1.0, None), (None, 1.0), (1.0, float("nan"))])
def test_missing_prediction_is_an_error(spark, pair):
    with pytest.raises(PySparkException, match="missing"):
        score(predictions(spark, [("m", 1.0, 1.0), ("m", *pair)])).collect()


def test_fold_summary_gives_published_numbers(spark):
    folds = [
        (1, 130.58545358, 191.95235385, 0.96607313, 9.65025514),
        (2, 162.94099945, 220.35984325, 0.94897644, 11.66923712),
        (3, 170.04091691, 239.58028197, 0.94730688, 9.96144398),
        (4, 157.60009771, 219.31398823, 0.94576326, 8.70299089),
        (5, 151.96410507, 211.53892477, 0.95766132, 8.98752473),
    ]
    table = spark.createDataFrame([("boosted", *f) for f in folds], "model string, fold int, mae double, rmse double, r2 double, smape_pct double")
    row = fold_summary(table).first()
    assert row["mae_mean"] == pytest.approx(154.62631454) and row["mae_std"] == pytest.approx(15.00531316)
    assert row["rmse_mean"] == pytest.approx(216.54907841) and row["rmse_std"] == pytest.approx(17.1952282)
    assert row["r2_mean"] == pytest.approx(0.9531562) and row["smape_mean"] == pytest.approx(9.79429037)
    assert best_per_group(table, "model").first()["fold"] == 1


def metrics(spark, rows):
    return spark.createDataFrame([(m, e, e, 0.5, 1.0) for m, e in rows], "model string, mae double, rmse double, r2 double, smape_pct double")


def test_choice_and_final_table(spark):
    first = metrics(spark, [("naive_lag_1", 3.0), ("b", 2.0)]).withColumn("fit_seconds", F.lit(0.1))
    second = metrics(spark, [("a", 2.0)]).withColumn("saw_validation", F.lit(True))
    assert "fit_seconds" not in append_metrics(first, second).columns
    assert choose_final(first, second).first()["model"] == "a"
    table = final_table(metrics(spark, [("naive_lag_1", 3.0), ("naive_lag_24", 1.0), ("a", 2.0)]), "a").collect()
    assert [(row["model"], row["role"]) for row in table] == [("naive_lag_24", "baseline"), ("naive_lag_1", "baseline"), ("a", "selected_final_model")]
    chosen = final_table(metrics(spark, [("naive_lag_1", 3.0)]), "naive_lag_1").collect()
    assert [row["role"] for row in chosen] == ["baseline", "selected_final_model"]


def test_lag_of_model(spark):
    df = spark.createDataFrame([("naive_lag_168",), ("ridge",)], "m string")
    assert [row[0] for row in df.select(lag_of_model(F.col("m"))).collect()] == [168, None]


def test_worst_rows_descend_and_residuals_add_up(spark):
    df = predictions(spark, [("m", float(i), float(i * i % 7)) for i in range(50)]).withColumn("t", F.col("actual").cast("int"))
    rows = worst_rows(df, "t", 10, key="model").collect()
    assert len(rows) == 10 and [r["absolute_error"] for r in rows] == sorted((r["absolute_error"] for r in rows), reverse=True)
    assert all(r["residual"] == r["actual"] - r["prediction"] for r in rows)


def test_replay_finds_tampering(spark):
    df = predictions(spark, [("m", 1.0, 2.0), ("m", 3.0, 3.0), ("n", 1.0, 1.5), ("n", 2.0, 2.0)])
    stored = score(df).withColumn("rmse", F.when(F.col("model") == "n", F.col("rmse") + 1e-6).otherwise(F.col("rmse")))
    assert {row["model"]: row["agrees"] for row in replay_metrics(df, stored).collect()} == {"m": True, "n": False}
    only = stored.where("model = 'm'")
    assert {row["model"]: row["agrees"] for row in replay_metrics(df, only).collect()} == {"m": True, "n": False}


def test_adjusted_r2_needs_rows(spark):
    df = spark.createDataFrame([(0.5, 10, 2), (0.5, 3, 2)], "r2 double, n int, p int")
    values = [row[0] for row in df.select(adjusted_r2(F.col("r2"), F.col("n"), F.col("p"))).collect()]
    assert values[0] == pytest.approx(1 - 0.5 * 9 / 7) and values[1] is None
