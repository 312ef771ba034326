"""Train-only preprocessing (M)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pastward import schema as S
from pastward.catalog.base import hourly_by_type, query, r, rounded, split_sql, with_series
from pastward.catalog.daily import CANDIDATES
from pastward.functions.bands import ordinal_rank, rain_band
from pastward.functions.calendar import hour_period
from pastward.functions.yeo_johnson import yeo_johnson
from pastward.operators import preprocess as P
from pastward.operators.features import feature_table, previous_change, named
from pastward.operators.ordering import over_history
from pastward.operators.quantiles import exact_quantiles
from pastward.operators.splits import chronological_split
from pastward.session import staged
from pastward.spec import HOURLY

KEYS = ["series_id", "timestamp"]
WEATHER = ["Temperature", "Rain", "Sun"]


def _split(spark, folder):
    return staged(chronological_split(staged(hourly_by_type(spark, folder))))


def _train(rows):
    return rows.where("split = 'train'")


SPLIT = with_series("hourly_by_type", then=split_sql("hourly_by_type"))


@query(
    "m1_median_impute",
    SPLIT
    + """, fill AS (SELECT median(Temperature) AS Temperature, median(Rain) AS Rain, median(Sun) AS Sun FROM split_rows WHERE split = 'train')
       SELECT series_id, timestamp, """
    + ", ".join(f"{r(f'coalesce(s.{c}, f.{c})')} AS {c}" for c in WEATHER)
    + " FROM split_rows s, fill f",
)
def m1(spark, folder):
    rows = _split(spark, folder)
    fill = P.medians(_train(rows), WEATHER)
    return rounded(rows.select(*KEYS, *(P.impute(c, fill[c]).alias(c) for c in WEATHER)))


@query(
    "m1_exact_quantiles",
    SPLIT
    + " UNION ALL ".join(
        f"""SELECT series_id, '{c}' AS "column", {p}::DOUBLE AS p, {r(f"quantile_cont({c}, {p}::DOUBLE)")} AS value
            FROM split_rows WHERE split = 'train' GROUP BY 1"""
        for c in WEATHER
        for p in (0.25, 0.5, 0.75)
    ),
)
def m1_quantiles(spark, folder):
    found = exact_quantiles(_train(_split(spark, folder)), WEATHER, [0.25, 0.5, 0.75], ["series_id"])
    return found.withColumn("value", F.round("value", 7))


BAND_SQL = "CASE WHEN Rain <= 0 THEN 'none' WHEN Rain <= 0.5 THEN 'light' WHEN Rain <= 2 THEN 'moderate' WHEN Rain > 2 THEN 'heavy' END"


@query(
    "m2_mode_impute",
    SPLIT
    + f""", banded AS (SELECT *, {BAND_SQL} AS band FROM split_rows),
         fill AS (SELECT band FROM banded WHERE split = 'train' AND band IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, band LIMIT 1)
       SELECT series_id, timestamp, coalesce(b.band, f.band) AS rain_intensity FROM banded b, fill f""",
)
def m2(spark, folder):
    rows = _split(spark, folder).withColumn("rain_intensity", rain_band(F.col("Rain")))
    counts = P.category_counts(_train(rows), ["rain_intensity"])
    return rows.select(*KEYS, P.impute("rain_intensity", P.most_frequent(counts["rain_intensity"])).alias("rain_intensity"))


@query(
    "m3_one_hot",
    SPLIT
    + """, seen AS (SELECT DISTINCT 'day ' || day(timestamp) AS level FROM split_rows WHERE split = 'train')
       SELECT series_id, timestamp, level, CASE WHEN level = 'day ' || day(timestamp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM split_rows, seen""",
)
def m3(spark, folder):
    # the days of the later parts are unseen in training and must become all zeros
    rows = _split(spark, folder).withColumn("day", F.concat(F.lit("day "), F.day("timestamp").cast("string")))
    levels = sorted(P.category_counts(_train(rows), ["day"])["day"])
    hot = P.one_hot(F.col("day"), levels)
    return rows.select(*KEYS, F.inline(F.array(*(F.struct(F.lit(level).alias("level"), h.alias("hot")) for level, h in zip(levels, hot)))))


@query(
    "m4_ordinal_encode",
    SPLIT
    + f"""SELECT series_id, timestamp, CASE {BAND_SQL} WHEN 'none' THEN 0.0::DOUBLE WHEN 'light' THEN 1.0::DOUBLE
                 WHEN 'moderate' THEN 2.0::DOUBLE WHEN 'heavy' THEN 3.0::DOUBLE END AS rain_rank,
                 -1.0::DOUBLE AS unknown_rank FROM split_rows""",
)
def m4(spark, folder):
    rows = _split(spark, folder)
    return rows.select(
        *KEYS,
        ordinal_rank(rain_band(F.col("Rain"))).alias("rain_rank"),
        ordinal_rank(F.lit("drizzle")).alias("unknown_rank"),
    )


POWERS = (-0.5, 0.0, 0.5, 2.0, 2.5)


def _yj_sql(x: str, power: float) -> str:
    mirrored = 2 - power
    positive = f"ln(1 + {x})" if power == 0 else f"(pow({x} + 1, {power}) - 1) / {power}"
    negative = f"-ln(1 - {x})" if mirrored == 0 else f"-(pow(1 - {x}, {mirrored}) - 1) / {mirrored}"
    return f"CASE WHEN {x} >= 0 THEN {positive} ELSE {negative} END"


@query(
    "m5_yeo_johnson",
    with_series("hourly_by_type")
    + "SELECT series_id, timestamp, "
    + ", ".join(f"{r(_yj_sql('x', p), 5)} AS power_{i}" for i, p in enumerate(POWERS))
    + """ FROM (SELECT series_id, timestamp, (lag(Consumption) OVER w - lag(Consumption, 2) OVER w) / 100 AS x FROM hourly_by_type
                WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)) WHERE x IS NOT NULL""",
)
def m5(spark, folder):
    series = hourly_by_type(spark, folder).select(*KEYS, S.TARGET)
    change = over_history(series, HOURLY, 2, lambda w: {"x": previous_change(S.TARGET, w) / 100}).where("x IS NOT NULL")
    return rounded(change.select(*KEYS, *(yeo_johnson(F.col("x"), p).alias(f"power_{i}") for i, p in enumerate(POWERS))), 5)


# a grid of powers, and a finer one around its best; powers are compared to one digit
FITTED_SQL = (
    SPLIT
    + """, long AS (
        SELECT 'Consumption' AS feature, Consumption AS x FROM split_rows WHERE split = 'train'
        UNION ALL SELECT 'Temperature', Temperature FROM split_rows WHERE split = 'train'),
    coarse AS (SELECT unnest(range(-80, 81)) / 8.0::DOUBLE AS p),
    first AS (
        SELECT feature, p, -count(*) / 2.0::DOUBLE * ln(var_pop(y)) + (p - 1) * sum(sign(x) * ln(1 + abs(x))) AS fit
        FROM (SELECT feature, x, p, YJ AS y FROM long, coarse) GROUP BY feature, p),
    fine AS (SELECT feature, p + k / 200.0::DOUBLE AS p FROM (SELECT feature, arg_max(p, fit) AS p FROM first GROUP BY feature), (SELECT unnest(range(-25, 26)) AS k)),
    second AS (
        SELECT feature, p, -count(*) / 2.0::DOUBLE * ln(var_pop(y)) + (p - 1) * sum(sign(x) * ln(1 + abs(x))) AS fit
        FROM (SELECT feature, x, p, YJ AS y FROM long JOIN fine USING (feature)) GROUP BY feature, p)
    SELECT feature, round(arg_max(p, fit), 1) AS power FROM second GROUP BY feature"""
).replace(
    "YJ",
    """CASE WHEN x >= 0 THEN CASE WHEN abs(p) < 1e-9 THEN ln(1 + x) ELSE (pow(1 + x, p) - 1) / p END
            WHEN abs(2 - p) < 1e-9 THEN -ln(1 - x) ELSE (1 - pow(1 - x, 2 - p)) / (2 - p) END""",
)


@query("m5_fitted_powers", FITTED_SQL)
def m5_fit(spark, folder):
    train = _train(_split(spark, folder))
    powers = P.fit_powers(train.select(S.TARGET, "Temperature"), [S.TARGET, "Temperature"])
    return spark.createDataFrame(sorted((name, round(power, 1)) for name, power in powers.items()), "feature string, power double")


@query(
    "m6_robust_scale",
    SPLIT
    + """, stats AS (SELECT """
    + ", ".join(
        f"quantile_cont({c}, 0.5::DOUBLE) AS {c}_mid, quantile_cont({c}, 0.75::DOUBLE) - quantile_cont({c}, 0.25::DOUBLE) AS {c}_range"
        for c in WEATHER
    )
    + " FROM split_rows WHERE split = 'train') SELECT series_id, timestamp, "
    + ", ".join(f"{r(f'({c} - {c}_mid) / CASE WHEN {c}_range = 0 THEN 1 ELSE {c}_range END')} AS {c}" for c in WEATHER)
    + " FROM split_rows, stats",
)
def m6(spark, folder):
    rows = _split(spark, folder)
    stats = P.robust_statistics(_train(rows), WEATHER)
    return rounded(rows.select(*KEYS, *(P.robust_scale(F.col(c), *stats[c]).alias(c) for c in WEATHER)))


FEATURES_SQL = (
    {name: text for name, text in CANDIDATES.items()}
    | {f"{n.lower()}_lag_{k}": f"lag({n}, {k}) OVER w" for n in WEATHER for k in (1, 24)}
)

# the two branches are checked on the columns that short SQL can state; the rest are checked in the tests
CHECKED = ("consumption_lag_1", "consumption_prev_change", "rain_lag_1", "sun_lag_24")


def _branch_sql(scaled: bool) -> str:
    inner = f"""feature_rows AS (
        SELECT * FROM (SELECT *, {", ".join(f"{text} AS {name}" for name, text in FEATURES_SQL.items())},
                              CASE WHEN isodow(timestamp) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend, hour(timestamp) AS hour,
                              sin(2 * pi() * hour(timestamp) / 24) AS hour_sin
                       FROM hourly_by_type WINDOW w AS (PARTITION BY series_id ORDER BY timestamp))
        WHERE Consumption IS NOT NULL AND consumption_lag_168 IS NOT NULL
          AND consumption_roll_mean_168 IS NOT NULL AND consumption_roll_std_168 IS NOT NULL)"""
    numbers = (*CHECKED, "hour_sin")
    band = BAND_SQL.replace("Rain", "rain_lag_1")
    head = with_series("hourly_by_type", then=inner + "," + split_sql("feature_rows"))
    medians = ", ".join(f"median({c}) FILTER (split = 'train') AS {c}_fill" for c in numbers)
    head += f""", fill AS (SELECT {medians} FROM split_rows),
        banded AS (SELECT *, {band} AS band FROM split_rows),
        mode AS (SELECT band AS band_fill FROM banded WHERE split = 'train' AND band IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, band LIMIT 1)"""
    imputed = {c: f"coalesce({c}, {c}_fill)" for c in numbers}
    if scaled:
        imputed = {c: _yj_sql(x, 0.5) if c != "hour_sin" else x for c, x in imputed.items()}
    head += f""", filled AS (SELECT series_id, timestamp, split, is_weekend, hour, coalesce(band, band_fill) AS band,
                                    {", ".join(f"{x} AS {c}" for c, x in imputed.items())} FROM banded, fill, mode)"""
    out = {c: c for c in numbers}
    if scaled:
        stats = ", ".join(
            f"quantile_cont({c}, 0.5::DOUBLE) AS {c}_mid, quantile_cont({c}, 0.75::DOUBLE) - quantile_cont({c}, 0.25::DOUBLE) AS {c}_range"
            for c in numbers
        )
        head += f", stats AS (SELECT {stats} FROM filled WHERE split = 'train')"
        out = {c: f"({c} - {c}_mid) / CASE WHEN {c}_range = 0 THEN 1 ELSE {c}_range END" for c in numbers}
    source = "filled, stats" if scaled else "filled"
    hot = """CASE WHEN hour < 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hour_period_night,
             CASE WHEN hour >= 18 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hour_period_evening"""
    return (
        head
        + f"""SELECT series_id, timestamp, {", ".join(f"{r(x, 6)} AS {c}" for c, x in out.items())}, is_weekend, {hot},
                     CASE band WHEN 'none' THEN 0.0::DOUBLE WHEN 'light' THEN 1.0::DOUBLE WHEN 'moderate' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS rain_intensity
              FROM {source}"""
    )


def _branch(spark, folder, estimator):
    rows = staged(chronological_split(staged(feature_table(hourly_by_type(spark, folder)))))
    model = estimator.fit(_train(rows))
    wanted = (*CHECKED, "hour_sin", "is_weekend", "hour_period_night", "hour_period_evening", "rain_intensity")
    columns = model.encoded()
    return rounded(rows.select(*KEYS, *named({c: columns[c] for c in wanted})), 6)


@query("m7_scaled_branch", _branch_sql(True))
def m7(spark, folder):
    frozen = json.dumps(dict.fromkeys(S.CONTINUOUS, 0.5))
    return _branch(spark, folder, P.FeaturePreprocessor(scale=True, powers=frozen))


@query("m8_tree_branch", _branch_sql(False))
def m8(spark, folder):
    return _branch(spark, folder, P.FeaturePreprocessor(scale=False))


@query(
    "m9_standardized_target",
    SPLIT
    + f""", stats AS (SELECT avg(Consumption) AS m, stddev_pop(Consumption) AS s FROM split_rows WHERE split = 'train')
        SELECT series_id, timestamp, {r('(Consumption - m) / s')} AS scaled, {r('(Consumption - m) / s * s + m')} AS restored
        FROM split_rows, stats""",
)
def m9(spark, folder):
    rows = _split(spark, folder)
    mean, std = P.target_statistics(_train(rows))
    scaled = rows.select(*KEYS, P.standardize(F.col(S.TARGET), mean, std).alias("scaled"))
    return rounded(scaled.withColumn("restored", P.restore(F.col("scaled"), mean, std)))
