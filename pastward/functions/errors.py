"""Error columns and regression metrics as plain aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def smape_term(actual: Column, predicted: Column) -> Column:
    """Symmetric percentage error of one row; 0 where both values are 0."""
    size = F.abs(actual) + F.abs(predicted)
    return F.when(size == 0, 0.0).otherwise(200.0 * F.abs(actual - predicted) / size)


def mape_term(actual: Column, predicted: Column) -> Column:
    """Absolute error relative to the actual value; null where that is 0."""
    return F.try_divide(F.abs(actual - predicted), F.abs(actual))


def complete_pair(actual: Column, predicted: Column) -> Column:
    """The prediction, or an error where either value is missing: averages would skip such rows silently."""
    missing = actual.isNull() | predicted.isNull() | F.isnan(actual) | F.isnan(predicted)
    return F.when(missing, F.raise_error(F.lit("actual or prediction is missing"))).otherwise(predicted)


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE, R² and sMAPE in one pass. A constant target has no R²: it is null, never infinite."""
    predicted = complete_pair(actual, predicted)
    error = actual - predicted
    spread = F.var_pop(actual)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(spread > 0, 1.0 - F.avg(error * error) / spread),
        "smape_pct": F.avg(smape_term(actual, predicted)),
    }


def extended_metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """The metrics above plus MSE and MAPE."""
    checked = complete_pair(actual, predicted)
    return {
        **metric_columns(actual, predicted),
        "mse": F.avg((actual - checked) * (actual - checked)),
        "mape": F.avg(mape_term(actual, checked)),
    }


def adjusted_r2(r2: Column, rows: Column, predictors: Column) -> Column:
    """R² adjusted for the number of predictors; null where there are too few rows for it to mean anything."""
    freedom = rows - predictors - 1
    return F.when(freedom > 0, 1.0 - (1.0 - r2) * (rows - 1) / freedom)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
