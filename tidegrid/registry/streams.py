"""Streaming queries: a file stream over the event table, run until all available data is processed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions.holidays import date_dimension
from tidegrid.functions.temporal import cyclical_features
from tidegrid.operators.guards import flag, r6
from tidegrid.operators.metrics import forecast_metrics
from tidegrid.registry.common import q6, query
from tidegrid.registry.features import CALENDAR_SQL, DISCOMFORT_SQL
from tidegrid.registry.forecasting import PERF
from tidegrid.session import scratch_path
from tidegrid.sources import views as v
from tidegrid.sources.writers import write_table
from tidegrid.streaming import jobs
from tidegrid.streaming.learner import online_learner

WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)"
X = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]


def event_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    raw = jobs.stream_parquet(spark, sf, schema, "events.parquet")
    return raw.select(
        "event_id", F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("timestamp"), "value"
    )


@query(
    "stream_resample_hourly",
    "",
    f"""SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp, {q6('sum(value)')} AS load FROM events
    GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {WATERMARK}""",
)
def _(spark, sf):
    out = jobs.resampled_table(spark, event_stream(spark, sf))
    return out.withColumn("load", r6(F.col("load")))


@query(
    "stream_sliding_mean",
    "",
    f""", s AS (SELECT event_type AS series_id, date_trunc('hour', ts) - to_hours(k::INT) AS window_start, value
        FROM events, range(0, 24) t(k))
    SELECT series_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, {q6('avg(value)')} AS mean, count(*) AS n FROM s
    WHERE window_start + INTERVAL 24 HOUR <= {WATERMARK} GROUP BY 1, 2""".replace(", s AS", "WITH s AS", 1),
)
def _(spark, sf):
    out = jobs.run_to_table(jobs.stream_sliding_mean(event_stream(spark, sf)), scratch_path(spark, "sliding"))
    return out.withColumn("mean", r6(F.col("mean")))


@query("stream_dedupe", "", "SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS timestamp FROM events")
def _(spark, sf):
    hourly = event_stream(spark, sf).select("series_id", F.date_trunc("hour", "timestamp").alias("timestamp"))
    return jobs.run_to_table(jobs.stream_dedupe(hourly), scratch_path(spark, "dedupe"))


@query(
    "stream_enrich",
    "load_hourly weather holidays",
    f""", {CALENDAR_SQL}
    SELECT e.event_id, event_type AS series_id, e.ts::TIMESTAMP AS timestamp, value, temperature, is_holiday, days_to_holiday,
        hour(e.ts)::INT AS hour, (isodow(e.ts) >= 6)::INT AS is_weekend, {q6('greatest(18.3 - temperature, 0.0)')} AS hdd,
        {q6(DISCOMFORT_SQL)} AS discomfort_index, {q6('temperature * hour(e.ts)')} AS temp_x_hour
    FROM events e LEFT JOIN weather w ON w.timestamp = date_trunc('hour', e.ts) LEFT JOIN calendar c ON c.date = e.ts::DATE""".replace(
        "greatest(18.3 - temperature, 0.0)", "CASE WHEN temperature IS NOT NULL THEN greatest(18.3 - temperature, 0.0) END"
    ),
)
def _(spark, sf):
    days = v.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    dates = date_dimension(days, v.holidays(spark))
    enriched = jobs.stream_enrich(event_stream(spark, sf), v.weather_hourly(spark, sf), dates)
    out = jobs.run_to_table(enriched, scratch_path(spark, "enriched"))
    rounded = {n: r6(F.col(n)) for n in ("hdd", "discomfort_index", "temp_x_hour")}
    return out.withColumns(rounded).select(
        "event_id", "series_id", "timestamp", "value", "temperature", "is_holiday", "days_to_holiday", "hour", "is_weekend", *rounded
    )


def _learned(spark, sf, detector="adwin", threshold=None, delay=None):
    jobs_path = scratch_path(spark, "hourly")
    table = jobs.run_to_table(jobs.stream_resample_hourly(event_stream(spark, sf)), jobs_path)
    second = cyclical_features(jobs.stream_parquet(spark, jobs_path, table.schema))
    learned = online_learner(second, X, detector=detector, threshold=threshold, delay=delay)
    return jobs.run_to_table(learned, scratch_path(spark, "learned"))


@query("stream_online_learner")
def _(spark, sf):
    return _learned(spark, sf)


CLOSED = f"""SELECT event_type AS series_id, count(DISTINCT date_trunc('hour', ts)) FILTER (date_trunc('hour', ts) + INTERVAL 1 HOUR <= {WATERMARK}) AS n FROM events GROUP BY 1"""


# Every closed hour is learned once, in order, and errors are ordered.
@query("stream_online_learner_check", "", f"SELECT series_id, n AS n_samples, n AS last_number, 1 AS in_order, 0::BIGINT AS n_late FROM ({CLOSED})")
def _(spark, sf):
    return _steps(_learned(spark, sf))


# With a delay of a day: the hours of days that ended a day before the newest closed hour.
@query(
    "stream_delayed_learner_check",
    "",
    f""", h AS (SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS t FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {WATERMARK})
    SELECT series_id, count(*) AS n_samples, count(*) AS last_number, 1 AS in_order, 0::BIGINT AS n_late FROM h
    WHERE date_trunc('day', t) + INTERVAL 1 DAY <= (SELECT max(t) FROM h) - INTERVAL 1 DAY GROUP BY 1""".replace(", h AS", "WITH h AS", 1),
)
def _(spark, sf):
    return _steps(_learned(spark, sf, delay="1 day"))


def _steps(learned):
    turn = Window.partitionBy("series_id").orderBy("sample_number")
    steps = learned.withColumn("_after", flag(F.coalesce(F.col("timestamp") > F.lag("timestamp").over(turn), F.lit(True)) & (F.col("mae") <= F.col("rmse") + 1e-9)))
    return steps.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("sample_number").alias("last_number"), F.min("_after").alias("in_order"), F.max("late_rows").alias("n_late")
    )


@query("stream_drift_events")
def _(spark, sf):
    learned = _learned(spark, sf, "page_hinkley", 25.0)
    return learned.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("drift").alias("n_drift_events"), F.max_by("rmse", "sample_number").alias("rmse")
    )


@query(
    "stream_performance_alert",
    "predictions",
    PERF
    + f""" SELECT series_id, model, date, {q6('rmse')} AS rmse, {q6('mae')} AS mae, n_samples, {q6('degradation')} AS degradation,
        alert FROM perf""",
)
def _(spark, sf):
    predicted = v.predictions(spark, sf)
    path = write_table(predicted, scratch_path(spark, "predictions"))
    first_week = predicted.where(F.col("timestamp") < F.lit("2024-01-08").cast("timestamp"))
    baseline = forecast_metrics(first_week).select("series_id", "model", F.col("rmse").alias("baseline_rmse"))
    # several micro-batches; files come in any order, so nothing is late within the month
    stream = jobs.stream_parquet(spark, path, predicted.schema, files_per_batch=2)
    out = jobs.stream_performance_alert(stream, baseline, scratch_path(spark, "performance"), delay="60 days")
    return out.withColumns({n: r6(F.col(n)) for n in ("rmse", "mae", "degradation")})


def _hybrid(spark, sf):
    champion = v.predictions(spark, sf).where("model = 'champion'").drop("model")
    residual = cyclical_features(champion.withColumn("residual", F.col("y_true") - F.col("y_pred")))
    path = write_table(residual, scratch_path(spark, "residuals"))
    stream = jobs.stream_parquet(spark, path, residual.schema)
    online = jobs.run_to_table(online_learner(stream, X, "residual"), scratch_path(spark, "corrections"))
    return jobs.hybrid_forecast(champion, online)


@query("hybrid_forecast")
def _(spark, sf):
    return _hybrid(spark, sf)


# Every batch prediction, moved by three tenths of what was learned on the residuals before it.
@query("hybrid_forecast_check", "predictions", f"SELECT series_id, timestamp, {q6('y_pred')} AS y_pred, 1 AS is_moved FROM predictions WHERE model = 'champion'")
def _(spark, sf):
    moved = flag(F.abs(F.col("hybrid_pred") - F.col("y_pred") - 0.3 * F.col("correction")) < 1e-9)
    return _hybrid(spark, sf).select("series_id", "timestamp", r6(F.col("y_pred")).alias("y_pred"), moved.alias("is_moved"))
