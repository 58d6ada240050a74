"""Readers for landed files: load series, covariates, grid events, wide meter files and API payloads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.guards import clean_double, require_columns
from tidegrid.session import prepare

OFFSET = r"([zZ]|[+-]\d{2}:?\d{2})$"

# Names of the API variables and the columns they become.
SOLAR_NAMES = {
    "shortwave_radiation": "ghi",
    "direct_radiation": "dni",
    "diffuse_radiation": "dhi",
    "direct_normal_irradiance": "dni_normal",
    "terrestrial_radiation": "toa_radiation",
    "sunshine_duration": "sunshine_seconds",
}
WEATHER_NAMES = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "surface_pressure": "pressure",
    "cloud_cover": "cloud_cover",
}
EVENT_SCHEMA = "timestamp timestamp, event_type string, duration_hours double, affected_load double"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there anything under ``path``?  Works for every file system Spark can read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _scan(spark: SparkSession, path: str, file_format: str | None, sep: str = ",") -> DataFrame:
    prepare(spark)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    kind = file_format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if kind == "csv":
        # header only, no inference pass: every column is text until it is cast
        return spark.read.option("header", True).option("sep", sep).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {kind}")


def utc_timestamp(df: DataFrame, column: str, timezone: str) -> Column:
    """Text or naive times are local to ``timezone``; times with an offset are instants already."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, T.StringType):
        parsed = F.try_to_timestamp(c)
        return F.when(F.rlike(c, F.lit(OFFSET)), parsed).otherwise(F.to_utc_timestamp(parsed, timezone))
    return F.to_utc_timestamp(c.cast("timestamp"), timezone)


def read_series(
    spark: SparkSession,
    path: str,
    date_column: str = "timestamp",
    load_column: str = "load",
    timezone: str = "UTC",
    series_column: str | None = None,
    file_format: str | None = None,
) -> DataFrame:
    """(series_id, timestamp, load) from CSV or Parquet; text that is no number becomes NULL."""
    raw = _scan(spark, path, file_format)
    require_columns(raw, [date_column, load_column, *([series_column] if series_column else [])], path)
    series = F.col(series_column).cast("string") if series_column else F.lit("series")
    return raw.select(
        series.alias("series_id"), utc_timestamp(raw, date_column, timezone).alias("timestamp"), clean_double(F.col(load_column)).alias("load")
    )


def read_covariates(
    spark: SparkSession, path: str, date_column: str = "timestamp", timezone: str = "UTC", file_format: str | None = None
) -> DataFrame:
    raw = _scan(spark, path, file_format)
    require_columns(raw, [date_column], path)
    values = [clean_double(F.col(c)).alias(c) for c in raw.columns if c != date_column]
    return raw.select(utc_timestamp(raw, date_column, timezone).alias("timestamp"), *values)


def read_grid_events(spark: SparkSession, path: str, timezone: str = "UTC") -> DataFrame:
    """Event table; a missing file gives an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], EVENT_SCHEMA)
    raw = require_columns(_scan(spark, path, "csv"), ["timestamp", "event_type", "duration_hours", "affected_load"], path)
    return raw.select(
        utc_timestamp(raw, "timestamp", timezone).alias("timestamp"),
        "event_type",
        clean_double(F.col("duration_hours")).alias("duration_hours"),
        clean_double(F.col("affected_load")).alias("affected_load"),
    )


def read_wide_meter(
    spark: SparkSession, path: str, timezone: str = "UTC", clients: Sequence[str] | None = None, sep: str = ";"
) -> DataFrame:
    """Wide meter file (time in the first column, one column per client, decimal comma) as (series_id, timestamp, kw)."""
    raw = _scan(spark, path, "csv", sep)
    time, *columns = raw.columns
    wanted = list(clients) if clients else columns
    require_columns(raw, wanted, path)
    number = {c: clean_double(F.regexp_replace(F.col(f"`{c}`"), ",", ".")).alias(c) for c in wanted}
    parsed = raw.select(utc_timestamp(raw, time, timezone).alias("timestamp"), *number.values())
    return parsed.where("timestamp IS NOT NULL").unpivot("timestamp", wanted, "series_id", "kw")


def parse_hourly_json(df: DataFrame, names: Mapping[str, str], column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Documents with parallel arrays under ``hourly`` as one row per hour; fails on a document without ``hourly``."""
    fields = ", ".join(f"{n}: array<double>" for n in names)
    parsed = df.withColumn("_doc", F.from_json(column, f"struct<hourly: struct<time: array<string>, {fields}>>"))
    hourly = F.when(F.col("_doc.hourly").isNull(), F.raise_error(F.lit("payload has no hourly section"))).otherwise(F.col("_doc.hourly"))
    arrays = parsed.select(*keep, hourly.alias("_h"))
    # an absent variable is padded with NULL
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(F.col("_h.time").alias("time"), *[F.coalesce(f"_h.{n}", none).alias(n) for n in names])
    rows = arrays.select(*keep, F.inline(zipped))
    return rows.select(*keep, F.try_to_timestamp("time").alias("timestamp"), *[F.col(n).alias(new) for n, new in names.items()])


def read_hourly_json(spark: SparkSession, path: str, names: Mapping[str, str] = SOLAR_NAMES) -> DataFrame:
    """One payload per line."""
    prepare(spark)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return parse_hourly_json(spark.read.text(path), names)


def read_features(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    return _scan(spark, path, file_format)


def read_through_cache(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if it was completely written before, else build the table, write it and read it back."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
