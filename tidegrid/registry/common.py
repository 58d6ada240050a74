"""Registry plumbing: each query has a Spark function and, where SQL can say it, a DuckDB text for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

def hash32_sql(*parts: str) -> str:
    """DuckDB text of ``guards.hash32``."""
    joined = ", ".join(f"coalesce({p}::VARCHAR, '')" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {joined})), 1, 8) AS BIGINT)"


QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "load_hourly": """SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp, round(sum(value), 2) AS load
        FROM events GROUP BY 1, 2""",
    "load_15min": """SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp,
        round(sum(value), 2) AS kw FROM events GROUP BY 1, 2""",
    "load_daily": """SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp,
        round(sum(o_totalprice), 2) AS load FROM orders GROUP BY 1, 2""",
    "load_supplier_daily": """SELECT l_suppkey AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp,
        round(sum(l_extendedprice), 2) AS load FROM lineitem GROUP BY 1, 2""",
    "load_user_hourly": """SELECT user_id AS series_id, date_trunc('hour', ts) AS timestamp, round(sum(value), 2) AS load
        FROM events GROUP BY 1, 2""",
    "hour_keys": """SELECT date_trunc('hour', ts) AS timestamp,
        sum(cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT)) AS sk, sum(event_id) AS se FROM events GROUP BY 1""",
    "weather": """SELECT timestamp, cast(sk % 450 AS DOUBLE) / 10 - 5 AS temperature,
        cast(20 + (sk * 7) % 81 AS DOUBLE) AS humidity, cast((sk * 3) % 50 AS DOUBLE) / 10 AS precipitation,
        cast((sk * 13) % 200 AS DOUBLE) / 10 AS wind_speed, cast((sk * 17) % 360 AS DOUBLE) AS wind_direction,
        cast(980 + sk % 50 AS DOUBLE) AS pressure, cast((sk * 11) % 101 AS DOUBLE) AS cloud_cover
        FROM hour_keys""",
    "solar": """SELECT timestamp, cast(sk * 5 % 1000 AS DOUBLE) AS ghi, cast(sk * 3 % 800 AS DOUBLE) AS dni,
        cast(sk % 300 AS DOUBLE) AS dhi, cast(1000 + sk % 361 AS DOUBLE) AS toa_radiation,
        cast(sk * 17 % 3601 AS DOUBLE) AS sunshine_seconds FROM hour_keys""",
    "grid_events": """SELECT date_trunc('hour', ts) AS timestamp, event_type,
        cast(1 + user_id % 5 AS DOUBLE) AS duration_hours, value AS affected_load
        FROM events WHERE event_type = 'error'""",
    "holidays": """SELECT * FROM (VALUES (DATE '2024-01-01', 'New Year''s Day', 'standard', 1),
        (DATE '2024-01-15', 'Martin Luther King Jr. Day', 'standard', 2),
        (DATE '2024-01-20', 'Local Saturday', 'custom', 0), (DATE '2024-01-28', 'Big Game', 'event', 0))
        h(holiday_date, name, kind, category)""",
    "lagged": """SELECT *, lag(load, 1) OVER w AS champion, lag(load, 24) OVER w AS challenger FROM load_hourly
        WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)""",
    "predictions": """SELECT series_id, timestamp, load AS y_true, 'champion' AS model, champion AS y_pred FROM lagged
        WHERE champion IS NOT NULL UNION ALL
        SELECT series_id, timestamp, load, 'challenger', challenger FROM lagged WHERE challenger IS NOT NULL""",
    "model_rows": """SELECT l.series_id, l.timestamp, l.load, l.champion AS load_lag_1h, l.challenger AS load_lag_24h,
        w.temperature, w.humidity FROM lagged l JOIN weather w USING (timestamp)
        WHERE l.champion IS NOT NULL AND l.challenger IS NOT NULL""",
    "scored": """SELECT *, 50 + 0.6 * load_lag_1h + 0.2 * load_lag_24h + 1.5 * temperature - 0.3 * humidity AS prediction
        FROM model_rows""",
    "model_means": """SELECT avg(load_lag_1h) AS m1, avg(load_lag_24h) AS m24, avg(temperature) AS mt,
        avg(humidity) AS mh FROM model_rows""",
    "phi": """SELECT series_id, timestamp, 'load_lag_1h' AS feature, load_lag_1h AS value, 0.6 * (load_lag_1h - m1) AS phi
        FROM model_rows, model_means UNION ALL
        SELECT series_id, timestamp, 'load_lag_24h', load_lag_24h, 0.2 * (load_lag_24h - m24) FROM model_rows, model_means
        UNION ALL SELECT series_id, timestamp, 'temperature', temperature, 1.5 * (temperature - mt)
        FROM model_rows, model_means UNION ALL
        SELECT series_id, timestamp, 'humidity', humidity, -0.3 * (humidity - mh) FROM model_rows, model_means""",
}
NEEDS = {
    "weather": ["hour_keys"],
    "solar": ["hour_keys"],
    "lagged": ["load_hourly"],
    "predictions": ["lagged"],
    "model_rows": ["lagged", "weather"],
    "scored": ["model_rows"],
    "model_means": ["model_rows"],
    "phi": ["model_rows", "model_means"],
}


def with_views(body: str, views: str) -> str:
    """Prefix ``body`` with the view definitions it needs; ``body`` may start its own ``WITH`` list after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = body.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head}{body}" if body.startswith(",") else f"WITH {head}\n{body}"


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def keep(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return keep


def q6(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``guards.r6``."""
    value = f"cast({expr} AS DOUBLE)"
    return f"round({value} + sign({value}) * 1e-{digits + 3}, {digits}) + 0.0"
