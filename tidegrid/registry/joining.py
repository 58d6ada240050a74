"""Join queries."""

from __future__ import annotations

from tidegrid.operators import joins
from tidegrid.registry.common import query
from tidegrid.sources import views as v


@query(
    "merge_load_weather",
    "load_hourly weather",
    "SELECT l.*, w.* EXCLUDE (timestamp) FROM load_hourly l LEFT JOIN weather w USING (timestamp)",
)
def _(spark, sf):
    return joins.merge_load_weather(v.load_hourly(spark, sf), v.weather_hourly(spark, sf))


@query(
    "merge_solar",
    "weather solar",
    "SELECT w.timestamp, w.temperature, w.humidity, s.* EXCLUDE (timestamp) FROM weather w JOIN solar s USING (timestamp)",
)
def _(spark, sf):
    weather = v.weather_hourly(spark, sf).select("timestamp", "temperature", "humidity")
    return joins.merge_solar(weather, v.solar_hourly(spark, sf))


@query(
    "grid_event_flag",
    "load_hourly grid_events",
    "SELECT *, (timestamp IN (SELECT timestamp FROM grid_events))::INT AS has_grid_event FROM load_hourly",
)
def _(spark, sf):
    return joins.grid_event_flag(v.load_hourly(spark, sf), v.grid_events(spark, sf))


@query(
    "grid_event_interval_flag",
    "load_hourly grid_events",
    """SELECT l.*, (EXISTS (SELECT 1 FROM grid_events g WHERE g.timestamp <= l.timestamp
        AND l.timestamp < g.timestamp + to_hours(g.duration_hours::INT)))::INT AS has_grid_event FROM load_hourly l""",
)
def _(spark, sf):
    return joins.grid_event_interval_flag(v.load_hourly(spark, sf), v.grid_events(spark, sf))


@query(
    "sample_join",
    "load_hourly weather",
    """SELECT l.*, w.temperature FROM load_hourly l JOIN weather w USING (timestamp)
    WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-13'""",
)
def _(spark, sf):
    weather = v.weather_hourly(spark, sf).select("timestamp", "temperature")
    return joins.sample_join(v.load_hourly(spark, sf), weather, "2024-01-05", "2024-01-12")


@query(
    "align_predictions",
    "load_hourly predictions",
    "SELECT l.series_id, l.timestamp, l.load, p.model, p.y_pred FROM load_hourly l JOIN predictions p USING (series_id, timestamp)",
)
def _(spark, sf):
    predicted = v.predictions(spark, sf).select("series_id", "timestamp", "model", "y_pred")
    return joins.align_predictions(v.load_hourly(spark, sf), predicted)


@query(
    "merge_all_sources",
    "load_hourly weather solar grid_events",
    """SELECT l.series_id, l.timestamp, l.load, w.* EXCLUDE (timestamp), s.* EXCLUDE (timestamp),
        (l.timestamp IN (SELECT timestamp FROM grid_events))::INT AS has_grid_event
    FROM load_hourly l LEFT JOIN weather w USING (timestamp) JOIN solar s ON s.timestamp = l.timestamp""",
)
def _(spark, sf):
    return joins.merge_all_sources(
        v.load_hourly(spark, sf), v.weather_hourly(spark, sf), v.solar_hourly(spark, sf), v.grid_events(spark, sf)
    )
