"""Schemas, feature sets and the fixed values that define results.

The constants in the "fixed values" block must stay exactly as written: they
decide levels, colours, risks, bins, flags and messages, so results depend on
them literally.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Observation schema (one row per hour of traffic)
# --------------------------------------------------------------------------
OBSERVATION_SCHEMA = T.StructType([
    T.StructField("holiday", T.StringType(), True),
    T.StructField("temp", T.DoubleType(), True),
    T.StructField("rain_1h", T.DoubleType(), True),
    T.StructField("snow_1h", T.DoubleType(), True),
    T.StructField("clouds_all", T.IntegerType(), True),
    T.StructField("weather_main", T.StringType(), True),
    T.StructField("weather_description", T.StringType(), True),
    T.StructField("date_time", T.TimestampNTZType(), True),
    T.StructField("traffic_volume", T.LongType(), True),
])

# Adapted driver tables carry an extra unique id used as a sort tie-break.
OBS_COLUMNS = ["obs_id"] + [f.name for f in OBSERVATION_SCHEMA.fields]

LEADERBOARD_SCHEMA = T.StructType([
    T.StructField("Model", T.StringType(), False),
    T.StructField("Category", T.StringType(), True),
    T.StructField("MAE", T.DoubleType(), True),
    T.StructField("RMSE", T.DoubleType(), True),
    T.StructField("R2", T.DoubleType(), True),
    T.StructField("MAPE", T.DoubleType(), True),
    T.StructField("Time", T.DoubleType(), True),
])

# --------------------------------------------------------------------------
# Feature sets
# --------------------------------------------------------------------------
FS11 = ["hour", "dow", "month", "is_weekend", "is_holiday", "temp_c", "rain_1h",
        "snow_1h", "clouds_all", "weather_enc", "rush_hour"]
FS18 = ["hour", "dow", "month", "quarter", "is_weekend", "temp_c", "rain_1h",
        "snow_1h", "clouds_all", "weather_enc", "rush_hour", "night",
        "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
FS19 = FS18 + ["is_holiday"]
FS7_RAW = ["temp", "rain_1h", "snow_1h", "clouds_all", "weather_enc", "hour", "dow"]

FEATURE_SETS = {"FS11": FS11, "FS18": FS18, "FS19": FS19, "FS7": FS7_RAW}
TARGET = "traffic_volume"

# --------------------------------------------------------------------------
# Fixed values (must equal the published behaviour exactly)
# --------------------------------------------------------------------------
# Congestion levels: volume < 1000 LOW, < 3000 MEDIUM, < 5000 HIGH, else SEVERE.
LEVEL_CUTS = (1000, 3000, 5000)
LEVEL_NAMES = ("LOW", "MEDIUM", "HIGH", "SEVERE")
LEVEL_COLORS = ("#22c55e", "#eab308", "#f97316", "#ef4444")
LEVEL_EMOJI_LONG = ("🟢 LOW", "🟡 MEDIUM", "🟠 HIGH", "🔴 SEVERE")
LEVEL_EMOJI_SHORT = ("🟢 LOW", "🟡 MED", "🟠 HIGH", "🔴 SEV")
RISK_CAP = 100

RUSH_HOURS = (7, 8, 9, 16, 17, 18)
MORNING_RUSH = (7, 8, 9)
EVENING_RUSH = (16, 17, 18)
NIGHT_HOURS = (0, 5)        # inclusive range used by the `night` feature
LATE_NIGHT_HOURS = (0, 4)   # inclusive range used by the late-night message
WEEKEND_FROM_DOW = 5        # Monday = 0

KELVIN_OFFSET = 273.15

TEMP_BIN_EDGES = (-40, -10, 0, 10, 20, 30, 50)
TEMP_BIN_LABELS = ("-40to-10", "-10to0", "0to10", "10to20", "20to30", "30+")

WEATHER_LABELS = ("Clear", "Clouds", "Drizzle", "Fog", "Mist", "Rain", "Snow",
                  "Thunderstorm")

FACTOR_MORNING = "Morning rush hour — high commuter traffic"
FACTOR_EVENING = "Evening rush hour — peak congestion window"
FACTOR_LATE_NIGHT = "Late night — minimal traffic expected"
FACTOR_WEEKEND = "Weekend — lower commuter volume"
FACTOR_RAIN = "Rain {}mm/h — speeds reduced"
FACTOR_SNOW = "Snow {}mm/h — road capacity reduced"
FACTOR_DEFAULT = "Normal weekday conditions"

REQUEST_DEFAULTS = {"hour": 8, "dow": 0, "month": 6, "temp_c": 15.0, "rain": 0.0,
                    "snow": 0.0, "clouds": 40.0, "weather": "Clear",
                    "weather_severity": 0.0, "special_event": 0.0,
                    "incident": 0.0, "remote_work": 0.0}

# What-if multipliers at 100 % severity.
SCENARIO_WEATHER = 0.3
SCENARIO_EVENT = 0.4
SCENARIO_INCIDENT = 0.2
SCENARIO_REMOTE = 0.25

PREDICTION_CLIP = (0.0, 10000.0)
MAPE_EPS = 1e-6
TARGET_SCALE_EPS = 1e-8

DISPLAY_NAMES = {
    "hour": "Hour of Day", "dow": "Day of Week", "month": "Month",
    "quarter": "Quarter", "is_weekend": "Is Weekend", "temp_c": "Temperature",
    "rain_1h": "Rainfall", "snow_1h": "Snowfall", "clouds_all": "Cloud Cover",
    "weather_enc": "Weather Type", "rush_hour": "Rush Hour", "night": "Night Flag",
    "hour_sin": "Hour (sin)", "hour_cos": "Hour (cos)", "dow_sin": "Day (sin)",
    "dow_cos": "Day (cos)", "month_sin": "Month (sin)", "month_cos": "Month (cos)",
}

# Model categories of the leaderboards, in report order.
MODEL_CATEGORIES = {
    "ML Models": ["Linear Regression", "Ridge Regression", "Lasso Regression",
                  "Decision Tree", "KNN (k=10)", "Random Forest", "Extra Trees",
                  "AdaBoost", "Gradient Boosting", "XGBoost", "LightGBM"],
}
# Our SQL-expressible baseline predictors (train means), reported as a category.
BASELINE_MODELS = ["Global Mean", "Hourly Mean", "Weather Mean", "Day-Hour Mean"]
REPORT_CATEGORIES = {**MODEL_CATEGORIES, "Baselines": BASELINE_MODELS}

# --------------------------------------------------------------------------
# Our own definitions for published-only breakdowns (no code to follow)
# --------------------------------------------------------------------------
# Time-of-day periods, non-overlapping: label, first hour, last hour.
PERIODS = (("night", 0, 5), ("morning", 6, 9), ("midday", 10, 13),
           ("afternoon", 14, 16), ("evening", 17, 19), ("late", 20, 23))
# Named windows of the hourly profile.
WINDOWS = (("morning_rush", 6, 9), ("evening_rush", 15, 18), ("night_valley", 0, 4))
HISTOGRAM_WIDTH = 500
HISTOGRAM_TOP_BIN = 11          # 5,500 and above

# Residual (predicted - actual) histogram edges, left-closed,
# the last bin open-ended, residuals below the first edge dropped.
RESIDUAL_EDGES = (-1000, -800, -600, -400, -200, -100, 0, 100, 200, 400, 600, 800, 1000)
