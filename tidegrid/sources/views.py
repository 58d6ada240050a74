"""Time-series views over the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, over_chunks
from tidegrid.session import prepare

HOUR = "hour"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _hour() -> F.Column:
    return F.date_trunc(HOUR, F.col("ts").cast("timestamp"))


def load_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("series_id"), _hour().alias("timestamp")).agg(
        F.round(F.sum("value"), 2).alias("load")
    )


def load_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    quarter = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900) * 900)
    return events.groupBy(F.col("event_type").alias("series_id"), quarter.alias("timestamp")).agg(
        F.round(F.sum("value"), 2).alias("kw")
    )


def load_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("timestamp")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("load")
    )


def load_supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped value per supplier and day: as many series as suppliers, rows in proportion to the line items."""
    items = table(spark, sf_dir, "lineitem")
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    return items.groupBy(F.col("l_suppkey").alias("series_id"), day.alias("timestamp")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("load")
    )


def load_user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values per user and hour."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("series_id"), _hour().alias("timestamp")).agg(
        F.round(F.sum("value"), 2).alias("load")
    )


def _hour_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    return table(spark, sf_dir, "events").groupBy(_hour().alias("timestamp")).agg(
        F.sum(number).alias("sk"), F.sum("event_id").alias("se")
    )


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = F.col("sk")
    return (
        _hour_keys(spark, sf_dir)
        .select(
            "timestamp",
            ((sk % 450).cast("double") / 10 - 5).alias("temperature"),
            (20 + (sk * 7) % 81).cast("double").alias("humidity"),
            (((sk * 3) % 50).cast("double") / 10).alias("precipitation"),
            (((sk * 13) % 200).cast("double") / 10).alias("wind_speed"),
            ((sk * 17) % 360).cast("double").alias("wind_direction"),
            (980 + sk % 50).cast("double").alias("pressure"),
            ((sk * 11) % 101).cast("double").alias("cloud_cover"),
        )
    )


def solar_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = F.col("sk")
    return _hour_keys(spark, sf_dir).select(
        "timestamp",
        (sk * 5 % 1000).cast("double").alias("ghi"),
        (sk * 3 % 800).cast("double").alias("dni"),
        (sk % 300).cast("double").alias("dhi"),
        (1000 + sk % 361).cast("double").alias("toa_radiation"),
        (sk * 17 % 3601).cast("double").alias("sunshine_seconds"),
    )


def grid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    return events.select(
        _hour().alias("timestamp"),
        "event_type",
        (1 + F.col("user_id") % 5).cast("double").alias("duration_hours"),
        F.col("value").alias("affected_load"),
    )


def holidays(spark: SparkSession) -> DataFrame:
    """Small calendar around the test period: the dimension side of the calendar joins."""
    rows = [
        ("2024-01-01", "New Year's Day", "standard", 1),
        ("2024-01-15", "Martin Luther King Jr. Day", "standard", 2),
        ("2024-01-20", "Local Saturday", "custom", 0),
        ("2024-01-28", "Big Game", "event", 0),
    ]
    df = spark.createDataFrame(rows, "d string, name string, kind string, category int")
    return df.select(F.to_date("d").alias("holiday_date"), "name", "kind", "category")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lag models on the hourly load: champion = last hour, challenger = same hour one day (24 rows) ago."""
    lagged = over_chunks(
        load_hourly(spark, sf_dir),
        lambda w: {"champion": F.lag("load", 1).over(w), "challenger": F.lag("load", 24).over(w)},
        back=24,
        grid=HOURLY,
    )
    long = lagged.withColumnRenamed("load", "y_true").unpivot(
        ["series_id", "timestamp", "y_true"], ["champion", "challenger"], "model", "y_pred"
    )
    return long.where("y_pred IS NOT NULL")


MODEL_TERMS = {"load_lag_1h": 0.6, "load_lag_24h": 0.2, "temperature": 1.5, "humidity": -0.3}
MODEL_BASE = 50.0


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows for the linear formula model, with ``load`` kept as the target."""
    lagged = over_chunks(
        load_hourly(spark, sf_dir),
        lambda w: {"load_lag_1h": F.lag("load", 1).over(w), "load_lag_24h": F.lag("load", 24).over(w)},
        back=24,
    )
    weather = weather_hourly(spark, sf_dir).select("timestamp", "temperature", "humidity")
    return lagged.join(weather, "timestamp").dropna(subset=list(MODEL_TERMS)).select(
        "series_id", "timestamp", "load", *MODEL_TERMS
    )
