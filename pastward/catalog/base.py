"""Registry, and the series that Spark and SQL both derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.sources.series import daily_totals, hourly_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 7  # floating-point results are rounded on both sides before they are compared


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hourly_all(spark: SparkSession, folder: str) -> DataFrame:
    return hourly_events(table(spark, folder, "events"), F.lit("all"))


def hourly_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return hourly_events(table(spark, folder, "events"), F.col("event_type"))


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    return daily_totals(table(spark, folder, "orders"), F.lit("all"), "o_orderdate", "o_totalprice")


def daily_orders_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    return daily_totals(table(spark, folder, "orders"), F.col("o_orderpriority"), "o_orderdate", "o_totalprice")


def daily_shipments(spark: SparkSession, folder: str) -> DataFrame:
    return daily_totals(table(spark, folder, "lineitem"), F.col("l_returnflag"), "l_shipdate", "l_quantity")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, keeping names and order."""
    return df.select(
        *(F.round(F.col(name), digits).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes)
    )


def r(expression: str, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits})"


def rs(*names: str, digits: int = DIGITS) -> str:
    return ", ".join(f"round({name}, {digits}) AS {name}" for name in names)


def _hourly_sql(key: str) -> str:
    return f"""
        SELECT {key} AS series_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp,
               round(sum(value), 2) AS Consumption, max(value) AS Temperature,
               CASE WHEN min_by(user_id, event_id) % 37 = 0 THEN NULL
                    WHEN min_by(value, event_id) <= 10 THEN 0::DOUBLE
                    ELSE round((min_by(value, event_id) - 10) / 20, 4) END AS Rain,
               sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::DOUBLE AS Sun
        FROM events GROUP BY 1, 2"""


def _daily_sql(source: str, key: str, date: str, value: str) -> str:
    return f"""
        SELECT {key} AS series_id, {date}::DATE AS Date, round(sum({value}), 2) AS Consumption
        FROM {source} GROUP BY 1, 2"""


SERIES_SQL = {
    "hourly_all": _hourly_sql("'all'"),
    "hourly_by_type": _hourly_sql("event_type"),
    "daily_orders": _daily_sql("orders", "'all'", "o_orderdate", "o_totalprice"),
    "daily_orders_by_priority": _daily_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice"),
    "daily_shipments": _daily_sql("lineitem", "l_returnflag", "l_shipdate", "l_quantity"),
}


def with_series(*names: str, then: str = "") -> str:
    """The head of a statement that defines the named series."""
    parts = [f"{name} AS ({SERIES_SQL[name]})" for name in names]
    return "WITH " + ",\n".join(parts) + (f",\n{then}" if then else "") + "\n"


# the same window for every look-back column
W_SQL = "(PARTITION BY series_id ORDER BY timestamp)"


def frame_sql(rows: int, order: str = "timestamp") -> str:
    return f"(PARTITION BY series_id ORDER BY {order} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def full_window_sql(aggregate: str, value: str, rows: int, order: str = "timestamp") -> str:
    over = frame_sql(rows, order)
    return f"CASE WHEN count({value}) OVER {over} = {rows} THEN {aggregate} OVER {over} END"


def ewm_sql(value: str, span: int, order: str = "timestamp") -> str:
    return (
        f"list_reduce(list({value}) OVER (PARTITION BY series_id ORDER BY {order}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),"
        f" lambda a, x: a * (1 - 2.0::DOUBLE / {span + 1}) + x * 2.0::DOUBLE / {span + 1})"
    )


def feature_sql(source: str) -> str:
    """Target history and its warm-up filter, as far as the evaluation statements need it."""
    return f"""
        feature_rows AS (
            SELECT * FROM (
                SELECT *, {", ".join(f"lag(Consumption, {k}) OVER {W_SQL} AS consumption_lag_{k}" for k in (1, 24, 168))},
                       {full_window_sql("avg(Consumption)", "Consumption", 168)} AS consumption_roll_mean_168,
                       {full_window_sql("stddev_samp(Consumption)", "Consumption", 168)} AS consumption_roll_std_168
                FROM {source})
            WHERE Consumption IS NOT NULL AND consumption_lag_168 IS NOT NULL
              AND consumption_roll_mean_168 IS NOT NULL AND consumption_roll_std_168 IS NOT NULL)"""


def split_sql(source: str, order: str = "timestamp", shares: tuple[float, float] = (0.70, 0.85)) -> str:
    first, second = shares
    return f"""
        split_rows AS (
            SELECT *, CASE WHEN position < floor(n * {first}::DOUBLE) THEN 'train'
                           WHEN position < floor(n * {second}::DOUBLE) THEN 'validation' ELSE 'test' END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {order}) - 1 AS position,
                         count(*) OVER (PARTITION BY series_id) AS n
                  FROM {source}))"""


def fold_sql(source: str, folds: int, order: str = "timestamp", name: str = "fold_rows") -> str:
    return f"""
        {name} AS (
            SELECT * EXCLUDE (fold_position, fold_n),
                   CASE WHEN fold_position < fold_n - {folds} * (fold_n // {folds + 1}) THEN 0
                        ELSE 1 + (fold_position - (fold_n - {folds} * (fold_n // {folds + 1}))) // (fold_n // {folds + 1})
                   END::INTEGER AS fold
            FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {order}) - 1 AS fold_position,
                         count(*) OVER (PARTITION BY series_id) AS fold_n
                  FROM {source}))"""


def long_sql(source: str, keys: str, models: tuple[str, ...], where: str = "true") -> str:
    selects = [
        f"SELECT {keys}, Consumption AS actual, '{model}' AS model, {column} AS prediction FROM {source} WHERE {where}"
        for model, column in ((m, "consumption_lag_" + m.rsplit("_", 1)[1]) for m in models)
    ]
    return "predictions AS (" + "\nUNION ALL\n".join(selects) + ")"


NAIVE = ("naive_lag_1", "naive_lag_24", "naive_lag_168")

METRICS_SQL = """avg(abs(actual - prediction)) AS mae,
       sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse,
       1 - avg((actual - prediction) * (actual - prediction)) / nullif(var_pop(actual), 0) AS r2,
       avg(CASE WHEN abs(actual) + abs(prediction) = 0 THEN 0
                ELSE 200 * abs(actual - prediction) / (abs(actual) + abs(prediction)) END) AS smape_pct"""

