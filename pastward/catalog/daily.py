"""Features of daily series and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastward import schema as S
from pastward.catalog.base import (
    daily_orders_by_priority,
    ewm_sql,
    full_window_sql,
    hourly_by_type,
    query,
    r,
    rounded,
    split_sql,
    with_series,
)
from pastward.operators import daily as D
from pastward.operators.ewm import ewm_columns, join_carries
from pastward.operators.features import feature_table, named
from pastward.operators.ordering import number_rows, over_history, with_history
from pastward.operators.selection import (
    correlation_matrix,
    drop_redundant,
    select_top,
    stability_ranking,
    target_copies,
    target_correlation,
)
from pastward.operators.splits import chronological_split, expanding_folds
from pastward.session import staged
from pastward.spec import DAILY

SOURCE = "daily_orders_by_priority"
W = "(PARTITION BY series_id ORDER BY Date)"
DIGITS = 4  # sums of prices are large
DAILY_SPANS = (14, 30)  # a span of 7 halves and quarters cents: values that end in 5 right where they are rounded


def _window_sql(columns: dict[str, str], digits: int = DIGITS) -> str:
    outer = ", ".join(f"{r(name, digits)} AS {name}" for name in columns)
    inner = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return (
        with_series(SOURCE)
        + f"""SELECT series_id, Date, {outer} FROM (SELECT *, {inner} FROM (
                  SELECT *, row_number() OVER {W} - 1 AS position FROM {SOURCE}))"""
    )


def _history(spark, folder, depth, build, digits=DIGITS):
    return rounded(over_history(daily_orders_by_priority(spark, folder), DAILY, depth, build).drop("Consumption"), digits)


@query("b9_daily_lags", _window_sql({f"demand_lag_{k}": f"lag(Consumption, {k}) OVER {W}" for k in D.DAILY_LAGS}))
def b9(spark, folder):
    return _history(spark, folder, 365, lambda w: D.daily_lag_columns("Consumption", w))


_STATS = {"mean": "avg", "median": "median", "std": "stddev_samp", "min": "min", "max": "max"}


@query(
    "b10_daily_rolling",
    _window_sql(
        {
            f"demand_roll_{stat}_{n}": full_window_sql(f"{f}(Consumption)", "Consumption", n, "Date")
            for n in (7, 30)
            for stat, f in _STATS.items()
        },
        3,
    ),
)
def b10(spark, folder):
    return _history(spark, folder, 30, lambda w: D.daily_rolling_columns("Consumption", w), 3)


@query(
    "b11_daily_ewm",
    _window_sql({f"demand_ewm_{span}": ewm_sql("Consumption", span, "Date") for span in DAILY_SPANS}),
)
def b11(spark, folder):
    numbered = number_rows(daily_orders_by_priority(spark, folder), DAILY)
    blocks = join_carries(with_history(numbered, DAILY, 0), DAILY, "Consumption", DAILY_SPANS)
    columns = ewm_columns(DAILY, "Consumption", DAILY_SPANS, "demand_ewm")
    return rounded(blocks.select("series_id", "Date", *named(columns)), DIGITS)


@query(
    "b12_daily_change",
    _window_sql(
        {
            "day_change": f"lag(Consumption) OVER {W} - lag(Consumption, 2) OVER {W}",
            "growth_7": f"""(lag(Consumption) OVER {W} - lag(Consumption, 8) OVER {W})
                            / nullif(lag(Consumption, 8) OVER {W}, 0)""",
        }
    ),
)
def b12(spark, folder):
    return _history(spark, folder, 8, lambda w: D.change_columns("Consumption", w))


@query(
    "b13_daily_slope",
    _window_sql(
        {
            f"demand_slope_{n}": full_window_sql("regr_slope(Consumption, position)", "Consumption", n, "Date")
            for n in (7, 30)
        },
        5,
    ),
)
def b13(spark, folder):
    return _history(spark, folder, 30, lambda w: D.slope_columns("Consumption", w), 5)


@query(
    "b14_fourier_terms",
    "SELECT DISTINCT o_orderdate::DATE AS Date, "
    + ", ".join(
        f"round({wave}({k} * (o_orderdate::DATE - DATE '1970-01-01') * (2 * pi() / {period})), 6) + 0 AS {name}_{wave}_{k}"
        for name, period in (("week", "7"), ("year", "365.25::DOUBLE"))
        for k in (1, 2)
        for wave in ("sin", "cos")
    )
    + " FROM orders",
)
def b14(spark, folder):
    days = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("Date")).distinct()
    return days.select("Date", *((F.round(c, 6) + 0).alias(n) for n, c in D.fourier_terms(F.col("Date")).items()))


@query(
    "b15_same_date_values",
    with_series(SOURCE)
    + f"""SELECT d.series_id, d.Date, d.Consumption, w.Consumption AS same_weekday_last_week,
                 y.Consumption AS same_date_last_year
          FROM {SOURCE} d
          LEFT JOIN {SOURCE} w ON w.series_id = d.series_id AND w.Date = d.Date - 7
          LEFT JOIN {SOURCE} y ON y.series_id = d.series_id AND y.Date = (d.Date - INTERVAL 1 YEAR)::DATE""",
)
def b15(spark, folder):
    return D.same_date_columns(daily_orders_by_priority(spark, folder), "Consumption")


HOLIDAYS = ((1, 1), (7, 1), (12, 25), (12, 26))


@query(
    "b16_holiday_flag",
    with_series(SOURCE)
    + f"""SELECT series_id, Date, CASE WHEN (month(Date), day(Date)) IN ({", ".join(str(h) for h in HOLIDAYS)}) THEN 1 ELSE 0 END::INTEGER
                 AS is_holiday FROM {SOURCE}""",
)
def b16(spark, folder):
    holidays = spark.createDataFrame(HOLIDAYS, "month int, day int")
    return D.holiday_flag(daily_orders_by_priority(spark, folder), holidays).drop("Consumption")


# --- selection -------------------------------------------------------------------------------------------------

SCREENED = {"as_is": "Consumption", "plus_zero": "Consumption + 0", "doubled": "Consumption * 2", "sun": "Sun"}


@query(
    "b18_target_copies",
    with_series("hourly_by_type")
    + " UNION ALL ".join(
        f"SELECT '{name}' AS feature, bool_and({text} IS NOT DISTINCT FROM Consumption) AS is_copy FROM hourly_by_type"
        for name, text in SCREENED.items()
    ),
)
def b18(spark, folder):
    series = hourly_by_type(spark, folder)
    candidates = series.select("Consumption", *(F.expr(text).alias(name) for name, text in SCREENED.items()))
    return target_copies(candidates, list(SCREENED))


CANDIDATES = {
    **{f"consumption_lag_{k}": f"lag(Consumption, {k}) OVER w" for k in (1, 2, 3, 24, 48, 72, 168)},
    **{
        f"consumption_roll_{s}_{n}": full_window_sql(f"{f}(Consumption)", "Consumption", n)
        for n in (3, 24, 168)
        for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    },
    "consumption_prev_change": "lag(Consumption, 1) OVER w - lag(Consumption, 2) OVER w",
}
CANDIDATES_SQL = f"""candidate_rows AS (
    SELECT * FROM (SELECT *, {", ".join(f"{text} AS {name}" for name, text in CANDIDATES.items())} FROM hourly_by_type
                   WINDOW w AS (PARTITION BY series_id ORDER BY timestamp))
    WHERE Consumption IS NOT NULL AND consumption_lag_168 IS NOT NULL
      AND consumption_roll_mean_168 IS NOT NULL AND consumption_roll_std_168 IS NOT NULL)"""


def _candidates(spark, folder):
    rows = feature_table(hourly_by_type(spark, folder)).select("series_id", "timestamp", S.TARGET, *CANDIDATES)
    return staged(rows)


def _pairs_sql() -> str:
    names = list(CANDIDATES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    columns = ", ".join(f"corr({a}, {b}) AS p{i}" for i, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, {r(f'p{i}')} AS correlation FROM wide" for i, (a, b) in enumerate(pairs)
    )
    return (
        with_series("hourly_by_type", then=CANDIDATES_SQL + "," + split_sql("candidate_rows"))
        + f", wide AS (SELECT {columns} FROM split_rows WHERE split = 'train') {rows}"
    )


@query("b19_correlation_matrix", _pairs_sql())
def b19_matrix(spark, folder):
    train = chronological_split(_candidates(spark, folder)).where("split = 'train'")
    matrix = correlation_matrix(train, list(CANDIDATES))
    rows = [(a, b, value) for (a, b), value in matrix.items()]
    return rounded(spark.createDataFrame(rows, "first string, second string, correlation double"))


def _greedy_sql() -> str:
    """A walk over the features by falling score; one stays if no kept one is too close to it."""
    names = list(CANDIDATES)
    close = ", ".join(
        f"list_filter([{', '.join(f'CASE WHEN abs(corr({a}, {b})) >= 0.98 THEN {b!r} END' for b in names if b != a)}], lambda x: x IS NOT NULL) AS c{i}"
        for i, a in enumerate(names)
    )
    scores = ", ".join(f"abs(corr({a}, Consumption)) AS s{i}" for i, a in enumerate(names))
    rows = " UNION ALL ".join(f"SELECT {a!r} AS feature, s{i} AS score, c{i} AS close FROM wide" for i, a in enumerate(names))
    return (
        with_series("hourly_by_type", then=CANDIDATES_SQL + "," + split_sql("candidate_rows")).replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", wide AS (SELECT {scores}, {close} FROM split_rows WHERE split = 'train'),
            scored AS ({rows}),
            placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS place FROM scored),
            walk AS (
                SELECT 0::BIGINT AS place, []::VARCHAR[] AS kept
                UNION ALL SELECT p.place, CASE WHEN list_has_any(kept, close) THEN kept ELSE list_append(kept, feature) END
                FROM walk JOIN placed p ON p.place = walk.place + 1)
            SELECT feature, round(score, 7) AS score FROM placed
            WHERE list_contains((SELECT kept FROM walk ORDER BY place DESC LIMIT 1), feature)"""
    )


@query("b19_redundancy_filter", _greedy_sql())
def b19(spark, folder):
    train = staged(chronological_split(_candidates(spark, folder)).where("split = 'train'"))
    scores = {row["feature"]: row["score"] for row in target_correlation(train, list(CANDIDATES)).collect()}
    kept = drop_redundant(scores, correlation_matrix(train, list(CANDIDATES)))
    return rounded(spark.createDataFrame([(name, scores[name]) for name in kept], "feature string, score double"))


def _stability_sql() -> str:
    folds = f"""(SELECT *, CASE WHEN position < n - 3 * (n // 4) THEN 0
                             ELSE 1 + (position - (n - 3 * (n // 4))) // (n // 4) END AS fold
                 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS position,
                              count(*) OVER (PARTITION BY series_id) AS n FROM candidate_rows))"""
    scores = " UNION ALL ".join(
        f"SELECT fold, '{c}' AS feature, abs(corr({c}, Consumption)) AS score FROM folded GROUP BY 1" for c in CANDIDATES
    )
    return (
        with_series("hourly_by_type", then=CANDIDATES_SQL)
        + f""", folded AS (SELECT * FROM {folds} WHERE fold > 0), scores AS ({scores}),
            ranked AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score DESC, feature) AS place FROM scores),
            per_feature AS (SELECT feature, avg(score) AS mean_score, avg(CASE WHEN place <= 15 THEN 1.0::DOUBLE ELSE 0.0 END) AS stability
                            FROM ranked GROUP BY 1),
            combined AS (SELECT *, (coalesce(mean_score / nullif(max(mean_score) OVER (), 0), 0) + stability) / 2 AS combined
                         FROM per_feature)
            SELECT feature, {r('mean_score')} AS mean_score, {r('stability')} AS stability, {r('combined')} AS combined
            FROM combined ORDER BY combined DESC, feature LIMIT 20"""
    )


@query("b22_stability_selection", _stability_sql())
def b22(spark, folder):
    folded = expanding_folds(_candidates(spark, folder), folds=3).where("fold > 0")
    scores = target_correlation(folded, list(CANDIDATES), ["fold"])
    return rounded(select_top(stability_ranking(scores)))
