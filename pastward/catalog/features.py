"""Projections, filters and windows of the feature table (P, F, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastward import schema as S
from pastward.catalog.base import (
    W_SQL,
    ewm_sql,
    daily_shipments,
    feature_sql,
    fold_sql,
    full_window_sql,
    hourly_all,
    hourly_by_type,
    query,
    r,
    rounded,
    split_sql,
    with_series,
)
from pastward.functions.bands import rain_band
from pastward.functions.calendar import (
    calendar_columns,
    cyclical_columns,
    hour_period,
    is_weekend,
    iso_text,
    parse_timestamp,
    season,
)
from pastward.functions.errors import absolute_error, smape_term
from pastward.operators.ewm import ewm_columns, join_carries
from pastward.operators.features import (
    feature_table,
    lag_columns,
    named,
    persistence_table,
    previous_change,
    rolling_columns,
    rolling_levels,
)
from pastward.operators.ordering import (
    first_rows,
    keep_last,
    last_rows,
    number_rows,
    over_history,
    with_history,
)
from pastward.operators.scoring import lag_of_model, long_predictions, persistence_names
from pastward.operators.splits import chronological_split, expanding_folds, fold_bounds, holdout, part_summary, split_summary
from pastward.session import staged
from pastward.spec import DAILY, HOURLY, SeriesSpec

KEYS = ["series_id", "timestamp"]


# --- projections -----------------------------------------------------------------------------------------------


@query(
    "p1_parse_timestamp",
    with_series("hourly_by_type")
    + """SELECT series_id, strftime(timestamp, '%Y-%m-%d') AS Date, concat(hour(timestamp), ':00') AS Time, timestamp
         FROM hourly_by_type""",
)
def p1(spark, folder):
    text = hourly_by_type(spark, folder).select(
        "series_id",
        F.date_format("timestamp", "yyyy-MM-dd").alias("Date"),
        F.concat(F.hour("timestamp").cast("string"), F.lit(":00")).alias("Time"),
    )
    return text.withColumn("timestamp", parse_timestamp(F.col("Date"), F.col("Time")))


@query(
    "p2_calendar_parts",
    """SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dow, dayname(ts) AS day_of_week_name,
              month(ts)::INTEGER AS month, dayofyear(ts)::INTEGER AS day_of_year
       FROM events""",
)
def p2(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    wanted = ("hour", "dow", "day_of_week_name", "month", "day_of_year")
    columns = calendar_columns(F.col("ts"))
    return events.select("event_id", *named({name: columns[name] for name in wanted}))


@query(
    "p3_is_weekend",
    "SELECT event_id, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END::INTEGER AS is_weekend FROM events",
)
def p3(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select("event_id", is_weekend(F.col("ts")).alias("is_weekend"))


@query(
    "p4_season",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter'
                               WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
                               WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season
       FROM orders""",
)
def p4(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select("o_orderkey", season(F.month("o_orderdate")).alias("season"))


@query(
    "p5_hour_period",
    """SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
                             WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS hour_period
       FROM events""",
)
def p5(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select("event_id", hour_period(F.hour("ts")).alias("hour_period"))


@query(
    "p6_cyclical_pairs",
    "SELECT event_id, "
    + ", ".join(
        f"round({wave}(2 * pi() * {position} / {period}), 7) + 0 AS {name}_{wave}"
        for name, position, period in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "(month(ts) - 1)", 12))
        for wave in ("sin", "cos")
    )
    + " FROM events",
)
def p6(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    # adding 0 turns a rounded -0.0 into 0.0
    return events.select(
        "event_id", *((F.round(c, 7) + 0).alias(name) for name, c in cyclical_columns(F.col("ts")).items())
    )


@query(
    "p7_rain_band",
    with_series("hourly_by_type")
    + f"""SELECT series_id, timestamp, rain, CASE WHEN rain IS NULL THEN NULL WHEN rain <= 0 THEN 'none'
                 WHEN rain <= 0.5 THEN 'light' WHEN rain <= 2 THEN 'moderate' ELSE 'heavy' END AS rain_intensity
          FROM (SELECT series_id, timestamp, lag(Rain) OVER {W_SQL} AS rain FROM hourly_by_type)""",
)
def p7(spark, folder):
    series = hourly_by_type(spark, folder).select(*KEYS, "Rain")
    lagged = over_history(series, HOURLY, 1, lambda w: {"rain_lag_1": F.lag("Rain", 1).over(w)})
    return lagged.select(*KEYS, F.col("rain_lag_1").alias("rain"), rain_band(F.col("rain_lag_1")).alias("rain_intensity"))


@query("p8_cast_target", "SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE AS Consumption FROM lineitem")
def p8(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias(S.TARGET))


def all_features_sql() -> str:
    y = "Consumption"
    columns = [f"lag({y}, {k}) OVER {W_SQL} AS consumption_lag_{k}" for k in (1, 2, 3, 24, 48, 72, 168)]
    for n in (3, 24, 168):
        for stat, aggregate in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            columns.append(f"{full_window_sql(f'{aggregate}({y})', y, n)} AS consumption_roll_{stat}_{n}")
    columns += [f"{ewm_sql(y, span)} AS consumption_ewm_{span}" for span in (6, 24)]
    columns.append(f"lag({y}, 1) OVER {W_SQL} - lag({y}, 2) OVER {W_SQL} AS consumption_prev_change")
    for name in ("Temperature", "Rain", "Sun"):
        columns += [f"lag({name}, {k}) OVER {W_SQL} AS {name.lower()}_lag_{k}" for k in (1, 24)]
        columns.append(f"{full_window_sql(f'avg({name})', name, 24)} AS {name.lower()}_roll_mean_24")
    calendar = """(isodow(timestamp) - 1) AS dow, month(timestamp) AS month, hour(timestamp) AS hour"""
    numbers = [name for name in S.CONTINUOUS]
    return (
        with_series("hourly_by_type")
        + f"""SELECT series_id, timestamp, {", ".join(f"{r(n)} AS {n}" for n in numbers)},
              round(sin(2 * pi() * hour / 24), 7) + 0 AS hour_sin, round(cos(2 * pi() * hour / 24), 7) + 0 AS hour_cos,
              round(sin(2 * pi() * dow / 7), 7) + 0 AS dow_sin, round(cos(2 * pi() * dow / 7), 7) + 0 AS dow_cos,
              round(sin(2 * pi() * (month - 1) / 12), 7) + 0 AS month_sin,
              round(cos(2 * pi() * (month - 1) / 12), 7) + 0 AS month_cos,
              CASE WHEN dow >= 5 THEN 1 ELSE 0 END::INTEGER AS is_weekend, dayname(timestamp) AS day_of_week_name,
              CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
                   WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
              CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning'
                   WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS hour_period,
              CASE WHEN rain_lag_1 IS NULL THEN NULL WHEN rain_lag_1 <= 0 THEN 'none' WHEN rain_lag_1 <= 0.5 THEN 'light'
                   WHEN rain_lag_1 <= 2 THEN 'moderate' ELSE 'heavy' END AS rain_intensity
       FROM (SELECT *, {calendar}, {", ".join(columns)} FROM hourly_by_type)
       WHERE Consumption IS NOT NULL AND consumption_lag_168 IS NOT NULL
         AND consumption_roll_mean_168 IS NOT NULL AND consumption_roll_std_168 IS NOT NULL"""
    )


@query("p9_feature_projection", all_features_sql())
def p9(spark, folder):
    chosen = feature_table(hourly_by_type(spark, folder)).select(*KEYS, *S.FEATURES)
    waves = set(S.CYCLICAL)
    return rounded(chosen).select(*(F.col(c) + 0 if c in waves else F.col(c) for c in chosen.columns)).toDF(*chosen.columns)


@query(
    "p10_drop_if_present",
    """SELECT event_type AS model, round(avg(value), 6) AS mae, turn FROM events, (VALUES ('with'), ('without')) AS v(turn) GROUP BY ALL""",
)
def p10(spark, folder):
    stats = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.col("event_type").alias("model"))
    timed = stats.agg(F.round(F.avg("value"), 6).alias("mae"), F.max("value").alias("fit_seconds"))
    dropped = [frame.drop("fit_seconds").withColumn("turn", F.lit(turn)) for frame, turn in ((timed, "with"), (timed.drop("fit_seconds"), "without"))]
    return dropped[0].union(dropped[1])


@query(
    "p11_lag_of_model",
    with_series("hourly_by_type")
    + """SELECT model, regexp_extract(model, '_(\\d+)$', 1)::INTEGER AS lag, count(*) AS rows
         FROM (SELECT 'naive_lag_' || k AS model FROM hourly_by_type, (VALUES (1), (24), (168)) AS lags(k))
         GROUP BY 1""",
)
def p11(spark, folder):
    wide = hourly_by_type(spark, folder).select(*KEYS, S.TARGET, *(F.col(S.TARGET).alias(m) for m in persistence_names()))
    named_rows = long_predictions(wide, KEYS, persistence_names())
    return named_rows.groupBy("model").agg(F.count("*").alias("rows")).withColumn("lag", lag_of_model(F.col("model")))


@query("p12_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def p12(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select("event_id", iso_text(F.col("ts")).alias("iso"))


@query(
    "p13_error_columns",
    with_series("hourly_by_type")
    + f"""SELECT series_id, timestamp, {r("abs(y - p)")} AS absolute_error,
                 {r("CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 200 * abs(y - p) / (abs(y) + abs(p)) END")} AS smape
          FROM (SELECT series_id, timestamp, Sun AS y, lag(Sun) OVER {W_SQL} AS p FROM hourly_by_type)
          WHERE p IS NOT NULL""",
)
def p13(spark, folder):
    series = hourly_by_type(spark, folder).select(*KEYS, "Sun")
    pairs = over_history(series, HOURLY, 1, lambda w: {"p": F.lag("Sun", 1).over(w)}).where("p IS NOT NULL")
    y, p = F.col("Sun"), F.col("p")
    return rounded(pairs.select(*KEYS, absolute_error(y, p).alias("absolute_error"), smape_term(y, p).alias("smape")))


# --- filters and deduplication ---------------------------------------------------------------------------------


@query(
    "f1_warm_up_filter",
    with_series("hourly_by_type", then=feature_sql("hourly_by_type"))
    + f"""SELECT series_id, timestamp, Consumption, {r("consumption_lag_168")} AS consumption_lag_168,
                 {r("consumption_roll_mean_168")} AS consumption_roll_mean_168,
                 {r("consumption_roll_std_168")} AS consumption_roll_std_168
          FROM feature_rows""",
)
def f1(spark, folder):
    return rounded(feature_table(hourly_by_type(spark, folder)).select(*KEYS, *S.WARM_UP))


@query(
    "f2_keep_last",
    with_series("hourly_all")
    + """SELECT series_id, timestamp, round(CASE WHEN hour(timestamp) = 12 THEN Consumption + 1 ELSE Consumption END, 2) AS Consumption,
                CASE WHEN hour(timestamp) = 12 THEN 1 ELSE 0 END::INTEGER AS ordinal
         FROM hourly_all""",
)
def f2(spark, folder):
    series = hourly_all(spark, folder).select(*KEYS, S.TARGET)
    later = series.where(F.hour("timestamp") == 12).withColumn(S.TARGET, F.round(F.col(S.TARGET) + 1, 2))
    doubled = series.withColumn("ordinal", F.lit(0)).unionByName(later.withColumn("ordinal", F.lit(1)))
    return keep_last(doubled, HOURLY, "ordinal")


@query(
    "f2_keep_last_event",
    """SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp, max(event_id) AS event_id,
              max_by(value, event_id) AS value
       FROM events GROUP BY 1, 2""",
)
def f2_event(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    hours = events.select(
        F.col("event_type").alias("series_id"), F.window("ts", "1 hour")["start"].alias("timestamp"), "event_id", "value"
    )
    return keep_last(hours, HOURLY, "event_id")


# --- windows ---------------------------------------------------------------------------------------------------


def _history(spark, folder, value, depth, build):
    series = hourly_by_type(spark, folder).select(*KEYS, *value)
    return rounded(over_history(series, HOURLY, depth, build).drop(*value))


def _window_sql(columns: dict[str, str]) -> str:
    outer = ", ".join(f"{r(name)} AS {name}" for name in columns)
    inner = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return with_series("hourly_by_type") + f"SELECT series_id, timestamp, {outer} FROM (SELECT *, {inner} FROM hourly_by_type)"


@query(
    "w1_demand_lags",
    _window_sql({f"consumption_lag_{k}": f"lag(Consumption, {k}) OVER {W_SQL}" for k in (1, 2, 3, 24, 48, 72, 168)}),
)
def w1(spark, folder):
    return _history(
        spark, folder, [S.TARGET], 168, lambda w: lag_columns(S.TARGET, S.DEMAND_LAGS, w, "consumption")
    )


def _rolling(name: str, stat: str, aggregate: str):
    sql = _window_sql(
        {
            f"consumption_roll_{stat}_{n}": full_window_sql(f"{aggregate}(Consumption)", "Consumption", n)
            for n in (3, 24, 168)
        }
    )

    @query(name, sql)
    def run(spark, folder):
        return _history(
            spark,
            folder,
            [S.TARGET],
            168,
            lambda w: rolling_levels(S.TARGET, S.DEMAND_WINDOWS, w, "consumption", (stat,)),
        )


_rolling("w2_rolling_mean", "mean", "avg")
_rolling("w3_rolling_std", "std", "stddev_samp")
_rolling("w4_rolling_min", "min", "min")
_rolling("w5_rolling_max", "max", "max")


@query("w6_ewm_mean", _window_sql({f"consumption_ewm_{span}": ewm_sql("Consumption", span) for span in (6, 24)}))
def w6(spark, folder):
    numbered = number_rows(hourly_by_type(spark, folder).select(*KEYS, S.TARGET), HOURLY)
    blocks = join_carries(with_history(numbered, HOURLY, 0), HOURLY, S.TARGET, S.EWM_SPANS)
    return rounded(blocks.select(*KEYS, *named(ewm_columns(HOURLY, S.TARGET, S.EWM_SPANS, "consumption_ewm"))))


# stretches of 2, 30 and 101 hours without a value, and blocks of 64 rows, so that gaps cross the borders of blocks
SMALL = SeriesSpec(block_rows=64)
GAPPED = "CASE WHEN hour(timestamp) IN (4, 5) OR day(timestamp) = 9 OR day(timestamp) BETWEEN 14 AND 17 THEN NULL ELSE Consumption END"
GAPS_SQL = with_series("hourly_by_type", then=f"gapped AS (SELECT * REPLACE ({GAPPED} AS Consumption) FROM hourly_by_type)")


def _gapped(spark, folder):
    return hourly_by_type(spark, folder).withColumn(S.TARGET, F.expr(GAPPED))


@query(
    "w6_ewm_over_gaps",
    GAPS_SQL
    + "SELECT series_id, timestamp, "
    + ", ".join(
        f"""round(list_reduce(list(struct_pack(e := Consumption, w := 1.0::DOUBLE)) OVER (PARTITION BY series_id ORDER BY timestamp
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              lambda s, x: CASE WHEN x.e IS NULL THEN struct_pack(e := s.e, w := s.w * {1 - 2 / (span + 1)!r}::DOUBLE)
                                WHEN s.e IS NULL THEN struct_pack(e := x.e, w := 1.0::DOUBLE)
                                ELSE struct_pack(e := (s.w * {1 - 2 / (span + 1)!r}::DOUBLE * s.e + {2 / (span + 1)!r}::DOUBLE * x.e)
                                                      / (s.w * {1 - 2 / (span + 1)!r}::DOUBLE + {2 / (span + 1)!r}::DOUBLE), w := 1.0::DOUBLE) END).e, 6)
            AS consumption_ewm_{span}"""
        for span in (6, 24)
    )
    + " FROM gapped",
)
def w6_gaps(spark, folder):
    numbered = number_rows(_gapped(spark, folder).select(*KEYS, S.TARGET), SMALL)
    blocks = join_carries(with_history(numbered, SMALL, 0), SMALL, S.TARGET, S.EWM_SPANS)
    return rounded(blocks.select(*KEYS, *named(ewm_columns(SMALL, S.TARGET, S.EWM_SPANS, "consumption_ewm"))), 6)


# a stretch of 18 hours and one of 2 hours without a value, with complete weeks between and behind them
SHORT_GAPS = "CASE WHEN day(timestamp) IN (2, 3) AND hour(timestamp) < 9 OR day(timestamp) = 14 AND hour(timestamp) IN (4, 5) THEN NULL ELSE Consumption END"
SHORT_GAPS_SQL = with_series("hourly_by_type", then=f"gapped AS (SELECT * REPLACE ({SHORT_GAPS} AS Consumption) FROM hourly_by_type)")


@query(
    "f1_warm_up_over_gaps",
    SHORT_GAPS_SQL + "," + feature_sql("gapped") + """ SELECT series_id, timestamp, Consumption, round(consumption_roll_mean_168, 6) AS consumption_roll_mean_168
         FROM feature_rows""",
)
def f1_gaps(spark, folder):
    gapped = hourly_by_type(spark, folder).withColumn(S.TARGET, F.expr(SHORT_GAPS))
    features = feature_table(gapped, SMALL)
    return rounded(features.select(*KEYS, S.TARGET, "consumption_roll_mean_168"), 6)


@query(
    "w1_w5_small_blocks",
    _window_sql(
        {"consumption_lag_168": f"lag(Consumption, 168) OVER {W_SQL}"}
        | {
            f"consumption_roll_{name}_{n}": full_window_sql(f"{function}(Consumption)", "Consumption", n)
            for n in (24, 168)
            for name, function in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
        }
    ),
)
def small_blocks(spark, folder):
    def build(w):
        first, second = rolling_levels(S.TARGET, (24, 168), w, "consumption")
        return [{**lag_columns(S.TARGET, (168,), w, "consumption"), **first}, second]

    rows = over_history(hourly_by_type(spark, folder).select(*KEYS, S.TARGET), SMALL, 168, build)
    return rounded(rows.drop(S.TARGET))


@query(
    "w10_w12_small_blocks",
    with_series("hourly_by_type", then=split_sql("hourly_by_type") + "," + fold_sql("split_rows", 5))
    + "SELECT series_id, timestamp, split, fold FROM fold_rows",
)
def small_cuts(spark, folder):
    rows = chronological_split(hourly_by_type(spark, folder).select(*KEYS), SMALL)
    return expanding_folds(rows, SMALL)


@query(
    "w7_previous_change",
    _window_sql({"consumption_prev_change": f"lag(Consumption, 1) OVER {W_SQL} - lag(Consumption, 2) OVER {W_SQL}"}),
)
def w7(spark, folder):
    return _history(
        spark, folder, [S.TARGET], 2, lambda w: {"consumption_prev_change": previous_change(S.TARGET, w)}
    )


@query(
    "w8_weather_lags",
    _window_sql({f"{n.lower()}_lag_{k}": f"lag({n}, {k}) OVER {W_SQL}" for n in S.WEATHER for k in (1, 24)}),
)
def w8(spark, folder):
    def build(w):
        return {k: c for n in S.WEATHER for k, c in lag_columns(n, S.WEATHER_LAGS, w, n.lower()).items()}

    return _history(spark, folder, S.WEATHER, 24, build)


@query(
    "w9_weather_rolling_mean",
    _window_sql({f"{n.lower()}_roll_mean_24": full_window_sql(f"avg({n})", n, 24) for n in S.WEATHER}),
)
def w9(spark, folder):
    def build(w):
        return {k: c for n in S.WEATHER for k, c in rolling_columns(n, (24,), w, n.lower(), ("mean",)).items()}

    return _history(spark, folder, S.WEATHER, 24, build)


@query(
    "w10_chronological_split",
    with_series("hourly_by_type", then=feature_sql("hourly_by_type") + "," + split_sql("feature_rows"))
    + "SELECT series_id, timestamp, split FROM split_rows",
)
def w10(spark, folder):
    return chronological_split(staged(persistence_table(hourly_by_type(spark, folder)).select(*KEYS)))


@query(
    "w11_split_summary",
    with_series("hourly_all", then=feature_sql("hourly_all") + "," + split_sql("feature_rows"))
    + """SELECT series_id, count(*) AS rows, """
    + ", ".join(f"count(*) FILTER (split = '{p}') AS {p}_rows" for p in ("train", "validation", "test"))
    + ", "
    + ", ".join(
        f"strftime({f}(timestamp) FILTER (split = '{p}'), '%Y-%m-%dT%H:%M:%S') AS {p}_{e}"
        for p, f, e in (
            ("train", "max", "end"),
            ("validation", "min", "start"),
            ("validation", "max", "end"),
            ("test", "min", "start"),
            ("test", "max", "end"),
        )
    )
    + " FROM split_rows GROUP BY 1",
)
def w11(spark, folder):
    return split_summary(chronological_split(staged(persistence_table(hourly_all(spark, folder)).select(*KEYS))))


@query(
    "w11_part_summary",
    with_series("hourly_by_type", then=split_sql("hourly_by_type"))
    + """SELECT series_id, split, count(*) AS rows, min(timestamp) AS first_time, max(timestamp) AS last_time
         FROM split_rows GROUP BY 1, 2""",
)
def w11_parts(spark, folder):
    return part_summary(chronological_split(hourly_by_type(spark, folder).select(*KEYS)))


def _folds(name: str, folds: int):
    @query(
        name,
        with_series("hourly_by_type", then=fold_sql("hourly_by_type", folds))
        + "SELECT series_id, timestamp, fold FROM fold_rows",
    )
    def run(spark, folder):
        return expanding_folds(hourly_by_type(spark, folder).select(*KEYS), folds=folds)


for _k in (5, 3, 2):
    _folds(f"w12_expanding_folds_{_k}", _k)


@query(
    "w12_fold_bounds",
    with_series("hourly_by_type", then=fold_sql("hourly_by_type", 5))
    + """SELECT f.series_id, f.fold, count(*) FILTER (t.fold < f.fold) AS train_rows,
                count(*) FILTER (t.fold = f.fold) AS test_rows, max(t.timestamp) FILTER (t.fold < f.fold) AS train_end,
                min(t.timestamp) FILTER (t.fold = f.fold) AS test_start, max(t.timestamp) FILTER (t.fold = f.fold) AS test_end
         FROM (SELECT DISTINCT series_id, fold FROM fold_rows WHERE fold > 0) f JOIN fold_rows t USING (series_id)
         GROUP BY 1, 2""",
)
def w12_bounds(spark, folder):
    return fold_bounds(expanding_folds(hourly_by_type(spark, folder).select(*KEYS)))


# --- sorts and limits of rows ----------------------------------------------------------------------------------


@query(
    "o1_sorted_series",
    with_series("hourly_by_type") + "SELECT series_id, timestamp, Consumption FROM hourly_by_type ORDER BY 1, 2",
)
def o1(spark, folder):
    return hourly_by_type(spark, folder).select(*KEYS, S.TARGET).orderBy(*KEYS)


def _ordinal_sql(where: str, order: str) -> str:
    return (
        with_series("hourly_by_type")
        + f"""SELECT series_id, timestamp, Consumption FROM (
                  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp {order}) AS position
                  FROM hourly_by_type) WHERE {where}"""
    )


@query("o5_last_two_weeks", _ordinal_sql("position <= 336", "DESC"))
def o5(spark, folder):
    return last_rows(hourly_by_type(spark, folder).select(*KEYS, S.TARGET), HOURLY, 14 * 24)


@query(
    "o6_first_training_rows",
    with_series("daily_shipments", then=split_sql("daily_shipments", "Date", (0.95, 1.0)))
    + "SELECT series_id, Date, Consumption FROM split_rows WHERE split = 'train' AND position < 2000",
)
def o6(spark, folder):
    train = holdout(daily_shipments(spark, folder), DAILY, 0.95).where("split = 'train'")  # more than 2000 days
    return first_rows(train.drop("split"), DAILY, 2000)

