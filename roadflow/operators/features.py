"""Feature derivation (F2-F11, F18 hooks, F25) and simple projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions import calendar as C
from roadflow.operators.broadcast import bounded_broadcast


# -- projections / filters ---------------------------------------------------

def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P1."""
    return df.drop(*cols)


def select_features(df: DataFrame, feature_set="FS18", keep=()) -> DataFrame:
    """The feature columns of a named set, plus ``keep`` columns."""
    cols = S.FEATURE_SETS[feature_set] if isinstance(feature_set, str) else list(feature_set)
    return df.select(*keep, *cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P3."""
    return df.withColumnsRenamed(mapping)


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows with a null in any (or the given) column."""
    return df.na.drop(how="any", subset=subset)


def filter_valid(df: DataFrame, min_temp: float = 0.0, max_rain: float = 500.0,
                 max_snow: float = 5.0) -> DataFrame:
    """Reject impossible readings (0 K, rain > 500 mm/h, snow > 5 mm/h);
    a missing reading is not impossible."""
    bad = [F.col("temp") <= min_temp, F.col("rain_1h") > max_rain, F.col("snow_1h") > max_snow]
    for b in bad:
        df = df.filter(~F.coalesce(b, F.lit(False)))
    return df


def only_weekend(df: DataFrame, weekend: bool = True) -> DataFrame:
    """Keep weekend (or weekday) rows."""
    return df.filter(F.col("is_weekend") == (1.0 if weekend else 0.0))


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """P8."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def display_name(col) -> Column:
    """Human name of a feature column; unknown names map to themselves."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in S.DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(m[c], c)


# -- label encoding (F11) -----------------------------------------------------

def fit_labels(df: DataFrame, col: str = "weather_main") -> DataFrame:
    """Vocabulary ``(label, code)``: codes follow sorted label order.

    The distinct step is a partial + final aggregate; the numbering window then
    runs over the vocabulary only (a handful of labels), never over rows.
    """
    labels = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    w = Window.orderBy("label")
    return labels.select("label", (F.row_number().over(w) - 1).cast("double").alias("code"))


def encode_labels(df: DataFrame, vocab: DataFrame, col: str = "weather_main",
                  out: str = "weather_enc", flag: str | None = None) -> DataFrame:
    """Apply a vocabulary; unseen or null labels → 0.0 (optionally flagged).

    The vocabulary has one row per distinct label.  It is counted first: up to
    the broadcast bound it is sent to every task, beyond it the join shuffles.
    """
    codes = bounded_broadcast(vocab.select(F.col("label").alias("_label"), F.col("code").alias("_code")))
    joined = df.join(codes, F.col(col) == F.col("_label"), "left")
    cols = {out: F.coalesce("_code", F.lit(0.0))}
    if flag:
        cols[flag] = F.col("_code").isNotNull()
    return joined.withColumns(cols).drop("_label", "_code")


# -- derived features -----------------------------------------------------------

def flags_and_cycles(hour: Column, dow: Column, month: Column) -> dict[str, Column]:
    """Flags and cyclic encodings of the calendar fields, the same in training and serving."""
    cycles = {}
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        cycles[f"{name}_sin"], cycles[f"{name}_cos"] = C.cyclic(value, period)
    return {"is_weekend": C.is_weekend(dow), "rush_hour": C.rush_hour(hour), "night": C.night(hour), **cycles}


def add_features(df: DataFrame, vocab: DataFrame | None = None, ts: str = "date_time",
                 encode: bool = True) -> DataFrame:
    """Calendar, flags, Celsius, cyclic encodings and the weather code.

    All columns are built in one projection (one codegen stage) except the
    weather code, which needs the (broadcast) vocabulary.
    """
    t = F.col(ts)
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)
    out = df.withColumns({
        "hour": hour, "dow": dow, "month": month, "quarter": F.quarter(t),
        "year": F.year(t),
        "is_holiday": C.is_holiday("holiday") if "holiday" in df.columns else F.lit(0.0),
        "temp_c": C.kelvin_to_c("temp"),
        **flags_and_cycles(hour, dow, month),
    })
    if encode:
        if vocab is None:
            vocab = fit_labels(df)
        out = encode_labels(out, vocab)
    return out


def canonical_features(obs: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """The canonical preparation: drop ``holiday``, derive, drop incomplete rows."""
    return drop_incomplete(add_features(drop_columns(obs, ["holiday"]), vocab))


def scenario_features(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """one feature row per request (hour, dow, month, temp_c, rain, snow,
    clouds, weather) without a timestamp."""
    hour, dow, month = F.col("hour"), F.col("dow"), F.col("month")
    out = df.withColumns({
        "quarter": C.quarter_of_month(month),
        "rain_1h": F.col("rain"), "snow_1h": F.col("snow"),
        "clouds_all": F.col("clouds"),
        **flags_and_cycles(hour, dow, month),
    })
    return encode_labels(out, vocab, col="weather", out="weather_enc", flag="weather_known")
