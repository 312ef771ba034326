"""Audits and descriptive tables (A1-A4, J, B1-B8, B31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastward.catalog.base import (
    daily_orders_by_priority,
    daily_shipments,
    hourly_all,
    hourly_by_type,
    query,
    r,
    rounded,
    rs,
    table,
    with_series,
)
from pastward.functions.calendar import season
from pastward.operators import quality as Q
from pastward.operators.audits import missing_names
from pastward.operators.ordering import keep_last
from pastward.spec import DAILY, HOURLY

SERIES_COLUMNS = ("series_id", "timestamp", "Consumption", "Temperature", "Rain", "Sun")


def _raw_hours(spark, folder):
    """Hours as recorded: gaps in the target, one side column less and one more than in the cleaned table."""
    gaps = F.when(F.col("Sun") > 0, F.col("Consumption")).alias("Consumption")
    note = F.when(F.col("Rain") > 0, "rain").alias("Note")
    return hourly_by_type(spark, folder).select("series_id", "timestamp", gaps, "Temperature", "Rain", note)


RAW_HOURS = """raw_hours AS (SELECT series_id, timestamp, CASE WHEN Sun > 0 THEN Consumption END AS Consumption, Temperature,
                             Rain, CASE WHEN Rain > 0 THEN 'rain' END AS Note FROM hourly_by_type)"""


def _doubled_hours(spark, folder):
    series = hourly_all(spark, folder)
    later = series.where(F.hour("timestamp") == 12).withColumn("Consumption", F.round(F.col("Consumption") + 1, 2))
    return series.withColumn("ordinal", F.lit(0)).unionByName(later.withColumn("ordinal", F.lit(1)))


DOUBLED_HOURS = """doubled_hours AS (SELECT * FROM hourly_all UNION ALL
                   SELECT * REPLACE (Consumption + 1 AS Consumption) FROM hourly_all WHERE hour(timestamp) = 12)"""


@query(
    "a1_row_counts",
    with_series("hourly_all", then=DOUBLED_HOURS)
    + """SELECT (SELECT count(*) FROM doubled_hours) AS raw_rows,
                (SELECT count(DISTINCT timestamp) FROM doubled_hours) AS canonical_rows""",
)
def a1(spark, folder):
    doubled = _doubled_hours(spark, folder)
    return Q.audit(doubled, keep_last(doubled, HOURLY, "ordinal"), HOURLY).select("raw_rows", "canonical_rows")


def _missing_sql(source: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM {source}" for c in columns)


@query("a2_missing_counts", with_series("hourly_by_type") + _missing_sql("hourly_by_type", SERIES_COLUMNS))
def a2(spark, folder):
    return Q.missing_counts(hourly_by_type(spark, folder), SERIES_COLUMNS)


@query(
    "a3_duplicate_times",
    with_series("hourly_all", then=DOUBLED_HOURS)
    + """SELECT series_id, count(*) - count(DISTINCT timestamp) AS duplicates FROM doubled_hours GROUP BY 1""",
)
def a3(spark, folder):
    return Q.duplicate_times(_doubled_hours(spark, folder))


@query(
    "a3_duplicate_event_times",
    """SELECT event_type AS series_id, count(*) - count(DISTINCT date_trunc('minute', ts)) AS duplicates
       FROM events GROUP BY 1""",
)
def a3_events(spark, folder):
    events = table(spark, folder, "events")
    minutes = events.select(F.col("event_type").alias("series_id"), F.window("ts", "1 minute")["start"].alias("timestamp"))
    return Q.duplicate_times(minutes)


@query(
    "a4_extent",
    """SELECT event_type AS series_id, count(*) AS rows, min(ts) AS start, max(ts) AS "end" FROM events GROUP BY 1""",
)
def a4(spark, folder):
    events = table(spark, folder, "events")
    return Q.extent(events.select(F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp")))


@query(
    "j1_align_missing_counts",
    with_series("hourly_by_type", then=RAW_HOURS)
    + f"""SELECT coalesce(a.column_name, b.column_name) AS column_name, coalesce(a.missing, 0) AS raw_missing,
                 coalesce(b.missing, 0) AS canonical_missing
          FROM ({_missing_sql("raw_hours", ("timestamp", "Consumption", "Temperature", "Rain", "Note"))}) a
          FULL JOIN ({_missing_sql("hourly_by_type", SERIES_COLUMNS)}) b ON a.column_name = b.column_name""",
)
def j1(spark, folder):
    raw = Q.missing_counts(_raw_hours(spark, folder).drop("series_id"))
    return Q.align_missing(raw, Q.missing_counts(hourly_by_type(spark, folder), SERIES_COLUMNS))


@query(
    "j3_missing_set",
    """SELECT DISTINCT l_shipdate::DATE AS Date FROM lineitem
       WHERE l_shipdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)""",
)
def j3(spark, folder):
    shipped = table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("Date"))
    ordered = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("Date"))
    return missing_names(shipped, ordered, "Date")


# --- daily series ----------------------------------------------------------------------------------------------


@query(
    "b1_quality_profile",
    """SELECT count(*) AS rows, count(*) - count(day) AS missing_dates, count(*) - count(amount) AS missing_values,
              count(*) FILTER (day IS NOT NULL AND TRY_CAST(day AS DATE) IS NULL) AS invalid_dates,
              count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS non_numeric,
              count(*) FILTER (isnan(TRY_CAST(amount AS DOUBLE)) OR isinf(TRY_CAST(amount AS DOUBLE))) AS non_finite,
              count(*) FILTER (isfinite(TRY_CAST(amount AS DOUBLE)) AND TRY_CAST(amount AS DOUBLE) <= 0) AS non_positive,
              min(TRY_CAST(day AS DATE)) AS first_date, max(TRY_CAST(day AS DATE)) AS last_date
       FROM (SELECT CASE WHEN o_orderkey % 50 = 1 THEN NULL WHEN o_orderkey % 50 = 2 THEN 'unknown'
                         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
                    CASE WHEN o_orderkey % 40 = 1 THEN NULL WHEN o_orderkey % 40 = 2 THEN 'n/a' WHEN o_orderkey % 40 = 3 THEN 'NaN'
                         WHEN o_orderkey % 40 = 4 THEN '-1.5' WHEN o_orderkey % 40 = 5 THEN '0'
                         ELSE '12.5' END AS amount
             FROM orders)""",
)
def b1(spark, folder):
    key = F.col("o_orderkey")
    day = (
        F.when(key % 50 == 1, F.lit(None))
        .when(key % 50 == 2, "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    amount = F.when(key % 40 == 1, F.lit(None))
    for rest, text in ((2, "n/a"), (3, "NaN"), (4, "-1.5"), (5, "0")):
        amount = amount.when(key % 40 == rest, text)
    lines = table(spark, folder, "orders").select(day.alias("day"), amount.otherwise("12.5").alias("amount"))
    return Q.profile(lines, "day", "amount")


@query(
    "b2_duplicated_rows",
    """SELECT user_id, event_type, hour, count(*) AS copies
       FROM (SELECT user_id, event_type, hour(ts)::INTEGER AS hour FROM events) GROUP BY ALL HAVING count(*) > 1""",
)
def b2(spark, folder):
    return Q.duplicated_rows(table(spark, folder, "events").select("user_id", "event_type", F.hour("ts").alias("hour")))


@query(
    "b2_duplicated_dates",
    """SELECT o_orderpriority AS series_id, o_orderdate::DATE AS Date, count(*) AS copies
       FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
)
def b2_dates(spark, folder):
    orders = table(spark, folder, "orders")
    return Q.duplicated_dates(
        orders.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("Date"))
    )


GAPS_SQL = """gaps AS (SELECT * FROM (
                 SELECT series_id, lag(Date) OVER (PARTITION BY series_id ORDER BY Date) AS gap_from, Date AS gap_to,
                        (Date - lag(Date) OVER (PARTITION BY series_id ORDER BY Date) - 1)::INTEGER AS missing_days
                 FROM daily_orders_by_priority) WHERE missing_days > 0)"""


@query("b3_calendar_gaps", with_series("daily_orders_by_priority", then=GAPS_SQL) + "SELECT * FROM gaps")
def b3(spark, folder):
    return Q.calendar_gaps(daily_orders_by_priority(spark, folder))


@query(
    "b3_missing_days",
    with_series("daily_orders_by_priority", then=GAPS_SQL)
    + """SELECT series_id, unnest(generate_series(gap_from + 1, gap_to - 1, INTERVAL 1 DAY))::DATE AS Date FROM gaps""",
)
def b3_days(spark, folder):
    return Q.missing_days(daily_orders_by_priority(spark, folder))


FENCES_SQL = """fences AS (SELECT series_id, q1, q3, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
                  FROM (SELECT series_id, quantile_cont(Consumption, 0.25) AS q1, quantile_cont(Consumption, 0.75) AS q3
                        FROM daily_orders_by_priority GROUP BY 1))"""


@query(
    "b4_tukey_fences",
    with_series("daily_orders_by_priority", then=FENCES_SQL)
    + f"SELECT series_id, {rs('q1', 'q3', 'lower_fence', 'upper_fence', digits=5)} FROM fences",
)
def b4(spark, folder):
    return rounded(Q.tukey_fences(daily_orders_by_priority(spark, folder), "Consumption", ["series_id"]), 5)


@query(
    "b4_flagged_outliers",
    with_series("daily_orders_by_priority", then=FENCES_SQL)
    + """SELECT series_id, Date, Consumption, NOT (Consumption BETWEEN lower_fence AND upper_fence) AS outside_fences
         FROM daily_orders_by_priority JOIN fences USING (series_id)""",
)
def b4_flags(spark, folder):
    return Q.flag_outliers(daily_orders_by_priority(spark, folder), "Consumption", ["series_id"])


@query(
    "b4_lineitem_fences",
    f"""SELECT l_returnflag, {rs('q1', 'q3', digits=5)}, {r('q1 - 1.5 * (q3 - q1)', 5)} AS lower_fence,
               {r('q3 + 1.5 * (q3 - q1)', 5)} AS upper_fence
        FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
              FROM lineitem GROUP BY 1)""",
)
def b4_lines(spark, folder):
    return rounded(Q.tukey_fences(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"]), 5)


@query(
    "b5_repeated_values",
    with_series("daily_shipments")
    + """SELECT series_id, Date, Consumption FROM (
             SELECT *, count(*) OVER (PARTITION BY series_id, Consumption) AS n FROM daily_shipments) WHERE n > 1""",
)
def b5(spark, folder):
    shipments = daily_shipments(spark, folder)
    return Q.rows_with_repeated_value(shipments, "Consumption", ["series_id"]).select("series_id", "Date", "Consumption")


@query(
    "b6_descriptive_statistics",
    with_series("daily_shipments")
    + f"""SELECT series_id, count(Consumption) AS count, {r('avg(Consumption)', 5)} AS mean,
                 {r('stddev_samp(Consumption)', 5)} AS std, min(Consumption) AS min, max(Consumption) AS max,
                 {r('quantile_cont(Consumption, 0.25)', 5)} AS q25, {r('median(Consumption)', 5)} AS median,
                 {r('quantile_cont(Consumption, 0.75)', 5)} AS q75
          FROM daily_shipments GROUP BY 1""",
)
def b6(spark, folder):
    return rounded(Q.describe_value(daily_shipments(spark, folder), "Consumption", ["series_id"]), 5)


CALENDAR_PARTS = {
    "month": ("month(Date)::INTEGER", lambda d: F.month(d)),
    "weekday": ("(isodow(Date) - 1)::INTEGER", lambda d: F.weekday(d)),
    "season": (
        """CASE WHEN month(Date) IN (12, 1, 2) THEN 'winter' WHEN month(Date) IN (3, 4, 5) THEN 'spring'
                WHEN month(Date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END""",
        lambda d: season(F.month(d)),
    ),
}


def _calendar_summary(part: str, text: str, column):
    @query(
        f"b7_summary_by_{part}",
        with_series("daily_shipments")
        + f"""SELECT series_id, {text} AS {part}, count(Consumption) AS count, {r('avg(Consumption)', 5)} AS mean,
                     {r('stddev_samp(Consumption)', 5)} AS std FROM daily_shipments GROUP BY 1, 2""",
    )
    def run(spark, folder):
        shipments = daily_shipments(spark, folder)
        return rounded(Q.calendar_summary(shipments, "Consumption", ["series_id"], column(F.col("Date")), part), 5)


for _part, (_text, _column) in CALENDAR_PARTS.items():
    _calendar_summary(_part, _text, _column)

NUMERIC_LINES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "b8_correlation_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, {r(f'corr({a}, {b})', 9)} AS correlation FROM lineitem"
        for i, a in enumerate(NUMERIC_LINES)
        for b in NUMERIC_LINES[i + 1 :]
    ),
)
def b8(spark, folder):
    return rounded(Q.correlation_pairs(table(spark, folder, "lineitem"), NUMERIC_LINES), 9)


@query(
    "b31_fitness_check",
    with_series("daily_orders_by_priority", then="short AS (SELECT * FROM daily_orders_by_priority WHERE series_id <> '5-LOW' OR Date < '1993-01-01')," + GAPS_SQL.replace("daily_orders_by_priority", "short"))
    + """SELECT series_id, rows, date_start, date_end, gap_count, array_to_string(reasons, '; ') AS reasons,
                CASE WHEN len(reasons) = 0 THEN 'READY' ELSE 'NOT_READY' END AS status
         FROM (SELECT f.*, coalesce(g.gap_count, 0) AS gap_count,
                      list_filter([CASE WHEN rows < 523 THEN 'fewer than 523 observations' END,
                                   CASE WHEN coalesce(g.gap_count, 0) > 0 THEN 'calendar gaps' END], lambda x: x IS NOT NULL) AS reasons
               FROM (SELECT series_id, count(*) AS rows, min(Date) AS date_start, max(Date) AS date_end
                     FROM short GROUP BY 1) f
               LEFT JOIN (SELECT series_id, count(*) AS gap_count FROM gaps GROUP BY 1) g USING (series_id))""",
)
def b31(spark, folder):
    orders = daily_orders_by_priority(spark, folder)
    return Q.fitness(orders.where("series_id <> '5-LOW' OR Date < '1993-01-01'"), DAILY)  # one series is too short
