"""The full feature table: one plan, one chunked window pass, columns in the published order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions import temporal, weather
from tidegrid.functions.holidays import calendar_features
from tidegrid.operators.chunks import HOURLY, Grid, over_chunks
from tidegrid.operators.guards import require_columns
from tidegrid.operators.series import (
    LAGS,
    WEATHER_LAGS,
    WINDOWS,
    lag_columns,
    range_column,
    rolling_columns,
)

# Weather inputs and calendar outputs in table order.
WEATHER = ["temperature", "humidity", "precipitation", "wind_speed", "wind_direction", "pressure", "cloud_cover"]
CALENDAR = [
    "is_holiday",
    "days_to_holiday",
    "is_before_holiday",
    "is_after_holiday",
    "is_special_event",
    "holiday_type",
    "is_friday_before_weekend_holiday",
    "is_monday_after_weekend_holiday",
]
DERIVED = ["hdd", "cdd", "heat_index", "discomfort_index"]
INTERACTIONS = ["temp_x_hour", "temp_x_weekend", "humidity_x_temp"]

# A feature belongs to the first category one of whose words its name contains.
CATEGORY_WORDS = {
    "temporal": ["hour", "day", "week", "month", "quarter", "season"],
    "calendar": ["holiday", "weekend", "business"],
    "lag": ["lag"],
    "rolling": ["rolling"],
    "weather": ["temp", "humidity", "wind", "precip", "pressure", "hdd", "cdd", "heat_index"],
    "interaction": ["_x_"],
}


def feature_names(
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    weather_columns: Sequence[str] = WEATHER,
    weather_lag_steps: Sequence[int] = WEATHER_LAGS,
) -> list[str]:
    temporal_names = temporal.TEMPORAL_NAMES + temporal.CYCLICAL_NAMES
    load_names = [f"load_lag_{k}h" for k in lags] + [
        f"rolling_{n}h_{s}" for n in windows for s in ("mean", "std", "min", "max")
    ]
    lagged = [f"{c}_lag_{k}h" for c in weather_columns for k in weather_lag_steps]
    return temporal_names + CALENDAR + load_names + [*weather_columns, *DERIVED, "temp_range_24h", *lagged, *INTERACTIONS]


def feature_table(
    load: DataFrame,
    weather_table: DataFrame,
    holidays: DataFrame,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    weather_columns: Sequence[str] = WEATHER,
    weather_lag_steps: Sequence[int] = WEATHER_LAGS,
    toggles: Mapping[str, bool] | None = None,
    base: float = weather.DEGREE_DAY_BASE,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Features of every series plus the target ``load``; ``toggles`` switches single columns off by name."""
    require_columns(load, ["series_id", "timestamp", "load"], "load table")
    require_columns(weather_table, ["timestamp", *weather_columns], "weather table")
    merged = load.select("series_id", "timestamp", "load").join(
        weather_table.select("timestamp", *weather_columns), "timestamp", "left"
    )

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {**lag_columns(w, "load", lags), **rolling_columns(w, "load", windows)}
        out["temp_range_24h"] = range_column(w)
        for c in weather_columns:
            out.update(lag_columns(w, c, weather_lag_steps))
        return out

    reach = max([24, *lags, *windows, *weather_lag_steps])
    wide = over_chunks(merged, build, back=reach, grid=grid, carry=["load", *weather_columns])
    wide = calendar_features(wide, holidays, days_of=load)
    scalars = {
        **temporal.temporal_expressions(),
        **temporal.cyclical_expressions(),
        **weather.degree_day_expressions(base=base),
        "heat_index": weather.heat_index(),
        "discomfort_index": weather.discomfort_index(),
        **weather.interaction_expressions(),
    }
    names = feature_names(lags, windows, weather_columns, weather_lag_steps)
    kept = [n for n in names if (toggles or {}).get(n, True)]
    return wide.withColumns(scalars).select("series_id", "timestamp", *kept, "load")


def category_of(name: Column) -> Column:
    chain = None
    for category, words in CATEGORY_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise("other")


def feature_catalog(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    table = spark.createDataFrame([(n,) for n in names], "feature string")
    return table.groupBy(category_of(F.col("feature")).alias("category")).agg(F.count(F.lit(1)).alias("n_features"))
