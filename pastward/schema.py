"""Table schemas and the column lists of the feature table."""

from __future__ import annotations

from pyspark.sql import types as T

HOURLY_CSV = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Time", T.StringType()),
        T.StructField("Consumption", T.DoubleType()),
        T.StructField("Temperature", T.DoubleType()),
        T.StructField("Rain", T.DoubleType()),
        T.StructField("Sun", T.DoubleType()),
    ]
)

# Lags, window lengths, spans, weather columns and category levels of the feature table.
TARGET = "Consumption"
DEMAND_LAGS = (1, 2, 3, 24, 48, 72, 168)
DEMAND_WINDOWS = (3, 24, 168)
EWM_SPANS = (6, 24)
WEATHER = ("Temperature", "Rain", "Sun")
WEATHER_LAGS = (1, 24)
WEATHER_WINDOW = 24
PERSISTENCE_LAGS = (1, 24, 168)
RAIN_LEVELS = ("none", "light", "moderate", "heavy")

NOMINAL = ("day_of_week_name", "season", "hour_period")
ORDINAL = ("rain_intensity",)
BINARY = ("is_weekend",)
CYCLICAL = tuple(f"{part}_{wave}" for part in ("hour", "dow", "month") for wave in ("sin", "cos"))
CONTINUOUS = (
    *(f"consumption_lag_{k}" for k in DEMAND_LAGS),
    *(f"consumption_roll_{stat}_{n}" for n in DEMAND_WINDOWS for stat in ("mean", "std", "min", "max")),
    *(f"consumption_ewm_{span}" for span in EWM_SPANS),
    "consumption_prev_change",
    *(
        f"{name}_{suffix}"
        for name in ("temperature", "rain", "sun")
        for suffix in ("lag_1", "lag_24", "roll_mean_24")
    ),
)
FEATURES = CONTINUOUS + CYCLICAL + BINARY + NOMINAL + ORDINAL

# Rows without these are warm-up rows and leave the feature table.
WARM_UP = (TARGET, "consumption_lag_168", "consumption_roll_mean_168", "consumption_roll_std_168")

METRICS = ("mae", "rmse", "r2", "smape_pct")
