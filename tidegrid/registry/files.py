"""File round trips: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tidegrid.operators.guards import r6, rounded
from tidegrid.plans import importance as im
from tidegrid.registry.common import q6, query
from tidegrid.registry.explaining import IMPORTANCE, phi
from tidegrid.registry.forecasting import METRIC, metric_sql
from tidegrid.operators.metrics import forecast_metrics
from tidegrid.session import scratch_path
from tidegrid.sources import readers, views as v, writers

STAMP = "yyyy-MM-dd HH:mm:ss"


@query("read_series", "load_hourly", "SELECT series_id, timestamp - INTERVAL 1 HOUR AS timestamp, load FROM load_hourly")
def _(spark, sf):
    table = v.load_hourly(spark, sf).withColumn("timestamp", F.date_format("timestamp", STAMP))
    path = writers.write_table(table, scratch_path(spark, "load") + ".csv", "csv")
    return readers.read_series(spark, path, timezone="Europe/Berlin", series_column="series_id")


@query("read_series_parquet", "load_hourly", "SELECT series_id, timestamp, load FROM load_hourly")
def _(spark, sf):
    path = writers.write_table(v.load_hourly(spark, sf), scratch_path(spark, "load"), partition_by=["series_id"])
    return readers.read_series(spark, path, series_column="series_id")


@query("read_covariates", "weather", "SELECT * FROM weather")
def _(spark, sf):
    table = v.weather_hourly(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    path = writers.write_table(table, scratch_path(spark, "weather") + ".csv", "csv")
    return readers.read_covariates(spark, path, timezone="Europe/Berlin")


@query("read_grid_events", "grid_events", "SELECT * FROM grid_events")
def _(spark, sf):
    table = v.grid_events(spark, sf).withColumn("timestamp", F.date_format("timestamp", STAMP))
    path = writers.write_table(table, scratch_path(spark, "events") + ".csv", "csv")
    return readers.read_grid_events(spark, path)


@query(
    "read_wide_meter",
    "load_15min",
    """SELECT t.timestamp, s.series_id, l.kw FROM (SELECT DISTINCT timestamp FROM load_15min) t
    JOIN (SELECT DISTINCT series_id FROM load_15min) s ON true
    LEFT JOIN load_15min l ON l.timestamp = t.timestamp AND l.series_id = s.series_id""",
)
def _(spark, sf):
    wide = v.load_15min(spark, sf).groupBy("timestamp").pivot("series_id").agg(F.max("kw"))
    text = wide.select(
        F.date_format("timestamp", STAMP).alias("time"),
        *[F.regexp_replace(F.col(s).cast("string"), r"\.", ",").alias(s) for s in wide.columns[1:]],
    )
    path = scratch_path(spark, "meter")
    text.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_wide_meter(spark, path)


@query("parse_hourly_json", "solar", "SELECT timestamp, ghi, dni, dhi, toa_radiation, sunshine_seconds FROM solar")
def _(spark, sf):
    names = {api: c for api, c in readers.SOLAR_NAMES.items() if c != "dni_normal"}
    solar = v.solar_hourly(spark, sf)
    entry = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"), *[F.col(c).alias(api) for api, c in names.items()])
    days = solar.groupBy(F.to_date("timestamp").alias("date")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    arrays = F.struct(*[F.col("e")[n].alias(n) for n in ("time", *names)])
    path = scratch_path(spark, "payload")
    days.select(F.to_json(F.struct(arrays.alias("hourly"))).alias("value")).write.text(path)
    return readers.read_hourly_json(spark, path, names)


@query("write_table", "load_daily", "SELECT series_id, timestamp, load FROM load_daily")
def _(spark, sf):
    path = writers.write_table(v.load_daily(spark, sf), scratch_path(spark, "table"), partition_by=["series_id"])
    return spark.read.parquet(path).select("series_id", "timestamp", "load")


@query("read_features", "model_rows", "SELECT * FROM model_rows")
def _(spark, sf):
    path = writers.write_table(v.model_rows(spark, sf), scratch_path(spark, "features"))
    return readers.read_features(spark, path)


@query("read_through_cache", "solar", "SELECT * FROM solar")
def _(spark, sf):
    path = scratch_path(spark, "cache")
    readers.read_through_cache(spark, path, lambda: v.solar_hourly(spark, sf))
    return readers.read_through_cache(spark, path, lambda: spark.range(0).toDF("timestamp"))


@query("score_batch", "scored", f"SELECT series_id, timestamp, {q6('prediction')} AS prediction FROM scored")
def _(spark, sf):
    formula = " ".join([repr(v.MODEL_BASE), *[f"+ ({w}) * {c}" for c, w in v.MODEL_TERMS.items()]])
    model = SQLTransformer(statement=f"SELECT *, {formula} AS prediction FROM __THIS__")
    out = writers.score_batch(v.model_rows(spark, sf), model, list(v.MODEL_TERMS), path=scratch_path(spark, "scores"))
    return out.withColumn("prediction", r6(F.col("prediction")))


@query("write_importance", "phi", IMPORTANCE + f" SELECT feature, {q6('importance')} AS importance FROM importance")
def _(spark, sf):
    path = writers.write_importance(im.global_importance(phi(spark, sf)), scratch_path(spark, "importance"))
    out = spark.read.schema("feature string, importance double").option("header", True).csv(path)
    return out.withColumn("importance", r6(F.col("importance")))


@query("write_results", "predictions", f"SELECT series_id, model, {metric_sql()} FROM predictions GROUP BY 1, 2")
def _(spark, sf):
    scores = rounded(forecast_metrics(v.predictions(spark, sf)), METRIC)
    path = writers.write_results(scores, scratch_path(spark, "results"))
    return spark.read.schema(scores.schema).json(path)
