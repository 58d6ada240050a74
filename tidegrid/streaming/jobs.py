"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.temporal import cyclical_expressions, temporal_expressions
from tidegrid.functions.weather import degree_day_expressions, discomfort_index, heat_index, interaction_expressions
from tidegrid.operators.metrics import SERIES_MODEL, with_degradation
from tidegrid.session import prepare, scratch_path


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = prepare(spark).readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything that is available into a Parquet table, however long it takes, and return that table."""
    spark = df.sparkSession
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_resample_hourly(df: DataFrame, column: str = "value", key: str = "series_id", ts: str = "timestamp", delay: str = "2 hours") -> DataFrame:
    """Hourly sums; an hour comes out once the watermark has passed its end, later rows are dropped."""
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), key).agg(F.sum(column).alias("load"))
    return grouped.select(key, F.col("window.start").alias("timestamp"), "load")


def stream_sliding_mean(
    df: DataFrame, column: str = "value", key: str = "series_id", ts: str = "timestamp", size: str = "24 hours", slide: str = "1 hour", delay: str = "2 hours"
) -> DataFrame:
    """Mean and count of every sliding window, from panes of one slide: each event counts in one pane, each pane in its windows.

    ``size`` must be a multiple of ``slide``.  A window comes out once the watermark has passed its end; later rows are dropped.
    """
    panes = df.withWatermark(ts, delay).groupBy(F.window(ts, slide).alias("_pane"), key).agg(
        F.sum(column).alias("_sum"), F.count(column).alias("_n"), F.count(F.lit(1)).alias("_rows")
    )
    windows = panes.groupBy(F.window(F.window_time("_pane"), size, slide).alias("window"), key).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean"), F.sum("_rows").alias("n")
    )
    return windows.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "mean", "n")


def stream_dedupe(df: DataFrame, keys: Sequence[str] = ("series_id", "timestamp"), ts: str = "timestamp", delay: str = "2 hours") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_enrich(df: DataFrame, weather: DataFrame, dates: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Stream-static joins with the weather of the hour and the calendar of the day, then the scalar features."""
    keyed = df.withColumns({"_hour": F.date_trunc("hour", ts), "date": F.to_date(ts)})
    joined = keyed.join(weather.withColumnRenamed("timestamp", "_hour"), "_hour", "left").join(dates, "date", "left")
    scalars = {
        **temporal_expressions(ts),
        **cyclical_expressions(ts),
        **degree_day_expressions(),
        "heat_index": heat_index(),
        "discomfort_index": discomfort_index(),
        **interaction_expressions(ts),
    }
    return joined.drop("_hour", "date").withColumns(scalars)


def stream_performance_alert(df: DataFrame, baseline: DataFrame, path: str, delay: str = "1 day", **kw) -> DataFrame:
    """One performance record per key and day, whatever the micro-batches: sums per day are kept in the stream's state.

    Rows more than ``delay`` behind the newest one are dropped, and so is the state of such days.  Every batch writes the days
    that it changed to a folder of its own, so a repeated batch replaces itself; the last version of a day counts.
    """
    keys, ts = list(kw.get("keys", SERIES_MODEL)), kw.get("ts", "timestamp")
    e = F.col(kw.get("y", "y_true")) - F.col(kw.get("yhat", "y_pred"))
    daily = df.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 day")).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n_samples")
    )
    days = daily.select(*keys, F.to_date("window.start").alias("date"), "rmse", "mae", "n_samples")

    def record(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = days.writeStream.outputMode("update").foreachBatch(record).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    measured = F.max_by(F.struct("rmse", "mae", "n_samples"), "batch").alias("m")
    latest = df.sparkSession.read.parquet(path).groupBy(*keys, "date").agg(measured).select(*keys, "date", "m.*")
    return with_degradation(latest, baseline, keys, kw.get("limit", 0.3))


def hybrid_forecast(batch: DataFrame, online: DataFrame, weight: float = 0.3, keys: Sequence[str] = ("series_id", "timestamp")) -> DataFrame:
    """Batch prediction plus the weighted correction an online model learned on its residuals."""
    correction = online.select(*keys, F.col("y_pred").alias("correction"))
    joined = batch.join(correction, list(keys), "left").fillna(0.0, ["correction"])
    return joined.withColumn("hybrid_pred", F.col("y_pred") + weight * F.col("correction"))


def resampled_table(spark: SparkSession, df: DataFrame, name: str = "hourly") -> DataFrame:
    """Run the hourly resampling of a raw stream into a table, for a second stream to read."""
    return run_to_table(stream_resample_hourly(df), scratch_path(spark, name))
