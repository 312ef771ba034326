"""Predictions in long form, metric tables, leaderboards and the choice of a winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.errors import extended_metric_columns, metric_columns
from pastward.schema import METRICS, PERSISTENCE_LAGS, TARGET

# How a persistence model is named, and the role names of the final table.
PERSISTENCE = "naive_lag_"
SELECTED_ROLE = "selected_final_model"
BASELINE_ROLE = "baseline"


def with_persistence(features: DataFrame, lags: Sequence[int] = PERSISTENCE_LAGS) -> DataFrame:
    """Add one forecast column per lag: the value observed that many rows earlier."""
    return features.withColumns({f"{PERSISTENCE}{k}": F.col(f"consumption_lag_{k}") for k in lags})


def persistence_names(lags: Sequence[int] = PERSISTENCE_LAGS) -> list[str]:
    return [f"{PERSISTENCE}{k}" for k in lags]


def lag_of_model(model: Column) -> Column:
    """The lag in a persistence model's name, null for other names."""
    digits = F.regexp_extract(model, r"^naive_lag_(\d+)$", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def long_predictions(wide: DataFrame, keys: Sequence[str], models: Sequence[str], actual: str = TARGET) -> DataFrame:
    """One row per key and model: ``actual`` and ``prediction``."""
    return wide.select(*keys, F.col(actual).alias("actual"), *models).unpivot(
        [*keys, "actual"], list(models), "model", "prediction"
    )


def score(predictions: DataFrame, *by: str) -> DataFrame:
    """MAE, RMSE, R² and sMAPE per model (and further columns), from long predictions."""
    metrics = metric_columns(F.col("actual"), F.col("prediction"))
    return predictions.groupBy(*by, "model").agg(*(metrics[name].alias(name) for name in METRICS))


def score_extended(predictions: DataFrame, *by: str) -> DataFrame:
    metrics = extended_metric_columns(F.col("actual"), F.col("prediction"))
    return predictions.groupBy(*by, "model").agg(
        F.count("*").alias("rows"), *(column.alias(name) for name, column in metrics.items())
    )


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Lowest MAE first; equal errors in order of model name."""
    return metrics.orderBy("mae", "model")


def fold_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of MAE and RMSE over folds, mean of the others, lowest mean MAE first."""
    return (
        fold_metrics.groupBy("model")
        .agg(
            F.avg("mae").alias("mae_mean"),
            F.stddev_samp("mae").alias("mae_std"),
            F.avg("rmse").alias("rmse_mean"),
            F.stddev_samp("rmse").alias("rmse_std"),
            F.avg("r2").alias("r2_mean"),
            F.avg("smape_pct").alias("smape_mean"),
        )
        .orderBy("mae_mean", "model")
    )


def best_row(metrics: DataFrame, by: str = "mae", tie: str = "model") -> DataFrame:
    """The row with the lowest value; equal values are decided by name."""
    return metrics.orderBy(by, tie).limit(1)


def best_per_group(metrics: DataFrame, group: str, by: str = "mae", tie: str = "model") -> DataFrame:
    """The best row of each group, by an aggregate that combines before the shuffle."""
    return metrics.groupBy(group).agg(F.min_by(F.struct("*"), F.struct(by, tie)).alias("best")).select("best.*")


def append_metrics(*tables: DataFrame) -> DataFrame:
    """Stack metric tables with unequal columns; fit times are left out, they are no basis for a choice."""
    first, *others = (table.drop("fit_seconds") for table in tables)
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def choose_final(*tables: DataFrame) -> DataFrame:
    """The candidate with the lowest validation MAE over all tables."""
    return best_row(append_metrics(*tables))


def final_table(metrics: DataFrame, selected: str) -> DataFrame:
    """Locked-test metrics with roles: the persistence baselines, and the selected model again as the final one."""
    baselines = metrics.where(F.col("model").startswith(PERSISTENCE)).withColumn("role", F.lit(BASELINE_ROLE))
    winner = metrics.where(F.col("model") == selected).withColumn("role", F.lit(SELECTED_ROLE))
    return baselines.unionByName(winner).select("model", "role", *METRICS).orderBy("role", "mae", "model")


def worst_rows(predictions: DataFrame, time: str, top: int = 20, key: str = "series_id") -> DataFrame:
    """The largest absolute errors with their residuals; equal errors in order of time, series and model."""
    residual = F.col("actual") - F.col("prediction")
    return (
        predictions.withColumn("residual", residual)
        .withColumn("absolute_error", F.abs(residual))
        .orderBy(F.desc("absolute_error"), time, key, "model")
        .limit(top)
    )
