"""Series whose rows grow with the tables: one per supplier, and a single long one (F, W, B at scale)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastward.catalog.base import fold_sql, frame_sql, query, rounded, split_sql, table
from pastward.operators.ewm import ewm_columns, join_carries
from pastward.operators.features import lag_columns, named, rolling_columns
from pastward.operators.long_windows import rolling_quantiles, rolling_statistics
from pastward.operators.ordering import number_rows, over_history, with_history
from pastward.operators.quality import tukey_fences
from pastward.operators.splits import chronological_split, expanding_folds
from pastward.sources.series import daily_totals
from pastward.spec import DAILY, HOURLY

SUPPLIERS_SQL = """WITH supplier_days AS (
    SELECT l_suppkey AS series_id, l_shipdate::DATE AS Date, round(sum(l_quantity), 2) AS Consumption FROM lineitem GROUP BY 1, 2)"""
LONG_SQL = """WITH long_series AS (
    SELECT 'all' AS series_id, TIMESTAMP '1970-01-01' + o_orderkey * INTERVAL 1 HOUR AS timestamp, o_totalprice AS Consumption FROM orders)"""
STATS = (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))


def supplier_days(spark, folder):
    return daily_totals(table(spark, folder, "lineitem"), F.col("l_suppkey"), "l_shipdate", "l_quantity")


def long_series(spark, folder):
    orders = table(spark, folder, "orders")
    hour = F.timestamp_seconds(F.col("o_orderkey") * 3600).cast("timestamp_ntz")
    return orders.select(F.lit("all").alias("series_id"), hour.alias("timestamp"), F.col("o_totalprice").alias("Consumption"))


def _windows_sql(source: str, order: str, rows: int) -> str:
    w = f"(PARTITION BY series_id ORDER BY {order})"
    stats = ", ".join(
        f"CASE WHEN count(Consumption) OVER {frame_sql(rows, order)} = {rows} THEN round({f}(Consumption) OVER {frame_sql(rows, order)}, 5) END AS y_roll_{name}_{rows}"
        for name, f in STATS
    )
    return f" SELECT series_id, {order}, lag(Consumption, 1) OVER {w} AS y_lag_1, lag(Consumption, {rows}) OVER {w} AS y_lag_{rows}, {stats} FROM {source}"


def _windows(series, spec, rows):
    def build(w):
        return {**lag_columns("Consumption", (1, rows), w, "y"), **rolling_columns("Consumption", (rows,), w, "y", tuple(n for n, _ in STATS))}

    return rounded(over_history(series, spec, rows, build).drop("Consumption"), 5)


@query("w1_w5_by_supplier", SUPPLIERS_SQL + _windows_sql("supplier_days", "Date", 30))
def by_supplier(spark, folder):
    return _windows(supplier_days(spark, folder), DAILY, 30)


@query("w1_w5_long_series", LONG_SQL + _windows_sql("long_series", "timestamp", 24))
def one_long(spark, folder):
    return _windows(long_series(spark, folder), HOURLY, 24)


@query(
    "w6_by_supplier",
    SUPPLIERS_SQL
    + """ SELECT series_id, Date, round(list_reduce(list(Consumption) OVER (PARTITION BY series_id ORDER BY Date
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda a, x: a * (5.0::DOUBLE / 7) + x * (2.0::DOUBLE / 7)), 5) AS y_6 FROM supplier_days""",
)
def ewm_by_supplier(spark, folder):
    numbered = number_rows(supplier_days(spark, folder), DAILY)
    blocks = join_carries(with_history(numbered, DAILY, 0), DAILY, "Consumption", (6,))
    return rounded(blocks.select("series_id", "Date", *named(ewm_columns(DAILY, "Consumption", (6,), "y"))), 5)


@query(
    "w10_w12_by_supplier",
    SUPPLIERS_SQL + "," + split_sql("supplier_days", "Date") + "," + fold_sql("split_rows", 5, "Date") + " SELECT series_id, Date, split, fold FROM fold_rows",
)
def cuts_by_supplier(spark, folder):
    rows = chronological_split(supplier_days(spark, folder).select("series_id", "Date"), DAILY)
    return expanding_folds(rows, DAILY)


@query("w10_long_series", LONG_SQL + "," + split_sql("long_series") + " SELECT series_id, timestamp, split FROM split_rows")
def cuts_of_long(spark, folder):
    return chronological_split(long_series(spark, folder).select("series_id", "timestamp"), HOURLY)


@query(
    "b4_by_supplier",
    SUPPLIERS_SQL
    + """ SELECT series_id, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence
          FROM (SELECT series_id, quantile_cont(Consumption, 0.25::DOUBLE) AS q1, quantile_cont(Consumption, 0.75::DOUBLE) AS q3 FROM supplier_days GROUP BY 1)""",
)
def fences_by_supplier(spark, folder):
    return rounded(tukey_fences(supplier_days(spark, folder), "Consumption", ["series_id"]), 6)


WIDTHS = (167, 1009)


def _wide_sql(source: str, aggregates: str) -> str:
    return f" SELECT series_id, timestamp, {aggregates} FROM {source}"


def _frames_sql(name: str, function: str, rows: int) -> str:
    over = frame_sql(rows)
    return f"CASE WHEN count(Consumption) OVER {over} = {rows} THEN round({function}(Consumption) OVER {over}, 4) END AS y_roll_{name}_{rows}"


@query("w2_w5_any_width", LONG_SQL + _wide_sql("long_series", ", ".join(_frames_sql(name, f, n) for n in WIDTHS for name, f in STATS)))
def any_width(spark, folder):
    """Widths that are no multiple of a shorter window."""
    return rounded(rolling_statistics(long_series(spark, folder), "Consumption", WIDTHS, "y").drop("Consumption"), 4)


@query("b10_long_rolling_median", LONG_SQL + _wide_sql("long_series", ", ".join(_frames_sql("median", "median", n) for n in (30, 365))))
def long_median(spark, folder):
    return rounded(rolling_quantiles(long_series(spark, folder), "Consumption", (30, 365), "y").drop("Consumption"), 4)


@query(
    "b10_rolling_quartiles_by_supplier",
    SUPPLIERS_SQL
    + " SELECT series_id, Date, "
    + ", ".join(
        f"CASE WHEN count(Consumption) OVER {frame_sql(61, 'Date')} = 61 THEN round(quantile_cont(Consumption, {p}::DOUBLE) OVER {frame_sql(61, 'Date')}, 4) END AS y_roll_{name}_61"
        for name, p in (("q1", 0.25), ("q3", 0.75))
    )
    + " FROM supplier_days",
)
def quartiles_by_supplier(spark, folder):
    found = rolling_quantiles(supplier_days(spark, folder), "Consumption", (61,), "y", DAILY, {"q1": 0.25, "q3": 0.75})
    return rounded(found.drop("Consumption"), 4)
