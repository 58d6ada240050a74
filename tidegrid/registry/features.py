"""Scalar features, series windows and the full feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import temporal, weather
from tidegrid.functions.holidays import calendar_features
from tidegrid.operators import guards, series
from tidegrid.operators.chunks import DAILY
from tidegrid.operators.guards import r6
from tidegrid.plans import feature_table as ft
from tidegrid.registry.common import q6, query
from tidegrid.sources import views as v

KEY = ["series_id", "timestamp"]
INT_TEMPORAL = temporal.TEMPORAL_NAMES

TEMPORAL_SQL = {
    "hour": "hour(timestamp)::INT",
    "day_of_week": "(isodow(timestamp) - 1)::INT",
    "day_of_month": "day(timestamp)::INT",
    "day_of_year": "dayofyear(timestamp)::INT",
    "week_of_year": "weekofyear(timestamp)::INT",
    "month": "month(timestamp)::INT",
    "quarter": "quarter(timestamp)::INT",
    "is_weekend": "(isodow(timestamp) >= 6)::INT",
    "is_business_hour": "(hour(timestamp) >= 9 AND hour(timestamp) < 17 AND isodow(timestamp) <= 5)::INT",
    "season": "((month(timestamp) % 12) // 3)::INT",
}
CYCLE_SQL = {}
for _name, _value, _period in (
    ("hour", "hour(timestamp)", 24), ("day_of_week", "(isodow(timestamp) - 1)", 7), ("month", "month(timestamp)", 12)
):
    CYCLE_SQL[f"{_name}_sin"] = f"sin({_value} * (2 * pi() / {_period}))"
    CYCLE_SQL[f"{_name}_cos"] = f"cos({_value} * (2 * pi() / {_period}))"


def cols(exprs: dict[str, str], rounded: int | None = None) -> str:
    return ", ".join(f"{q6(e, rounded) if rounded else e} AS {n}" for n, e in exprs.items())


def rounded(df, keep, names, digits=6):
    return guards.rounded(df.select(*keep, *names), names, digits)


@query("temporal_features", "load_daily", f"SELECT series_id, timestamp, {cols(TEMPORAL_SQL)} FROM load_daily")
def _(spark, sf):
    return temporal.temporal_features(v.load_daily(spark, sf)).drop("load")


@query("temporal_features_hourly", "load_hourly", f"SELECT series_id, timestamp, {cols(TEMPORAL_SQL)} FROM load_hourly")
def _(spark, sf):
    return temporal.temporal_features(v.load_hourly(spark, sf)).drop("load")


@query("cyclical_features", "load_hourly", f"SELECT series_id, timestamp, {cols(CYCLE_SQL, 9)} FROM load_hourly")
def _(spark, sf):
    return rounded(temporal.cyclical_features(v.load_hourly(spark, sf)), KEY, CYCLE_SQL, 9)


@query(
    "feature_toggles",
    "load_hourly",
    "SELECT series_id, timestamp, load, hour(timestamp)::INT AS hour, (isodow(timestamp) - 1)::INT AS day_of_week FROM load_hourly",
)
def _(spark, sf):
    off = {n: False for n in INT_TEMPORAL if n not in ("hour", "day_of_week")}
    return temporal.temporal_features(v.load_hourly(spark, sf), toggles=off)


DEGREE_SQL = {"hdd": "greatest(18.3 - temperature, 0.0)", "cdd": "greatest(temperature - 18.3, 0.0)"}
F_SQL = "(temperature * 9 / 5 + 32)"
HEAT_SQL = (
    "CASE WHEN temperature < 27 THEN temperature ELSE ((-42.379::DOUBLE + 2.04901523::DOUBLE * f + 10.14333127::DOUBLE * h"
    " - 0.22475541::DOUBLE * f * h - 0.00683783::DOUBLE * f * f - 0.05481717::DOUBLE * h * h"
    " + 0.00122874::DOUBLE * f * f * h + 0.00085282::DOUBLE * f * h * h - 0.00000199::DOUBLE * f * f * h * h)"
    " - 32) * 5 / 9 END"
).replace("f", F_SQL).replace(" h", " humidity")
DISCOMFORT_SQL = "temperature - 0.55 * (1 - humidity / 100) * (temperature - 14.5)"


@query("degree_days", "weather", f"SELECT timestamp, {cols(DEGREE_SQL, 6)} FROM weather")
def _(spark, sf):
    w = v.weather_hourly(spark, sf).withColumns(weather.degree_day_expressions())
    return rounded(w, ["timestamp"], ["hdd", "cdd"])


@query("heat_index", "weather", f"SELECT timestamp, {q6(HEAT_SQL, 5)} AS heat_index FROM weather")
def _(spark, sf):
    return v.weather_hourly(spark, sf).select("timestamp", r6(weather.heat_index(), 5).alias("heat_index"))


@query("discomfort_index", "weather", f"SELECT timestamp, {q6(DISCOMFORT_SQL)} AS discomfort_index FROM weather")
def _(spark, sf):
    return v.weather_hourly(spark, sf).select("timestamp", r6(weather.discomfort_index()).alias("discomfort_index"))


@query(
    "wind_chill",
    "weather",
    f"""SELECT timestamp, {q6('''CASE WHEN temperature <= 10 AND wind_speed * 3.6 > 4.8 THEN 13.12 + 0.6215 * temperature
        - 11.37 * pow(wind_speed * 3.6, 0.16) + 0.3965 * temperature * pow(wind_speed * 3.6, 0.16)
        ELSE temperature END''')} AS wind_chill FROM weather""",
)
def _(spark, sf):
    return v.weather_hourly(spark, sf).select("timestamp", r6(weather.wind_chill()).alias("wind_chill"))


INTERACTION_SQL = {
    "temp_x_hour": "temperature * hour(timestamp)",
    "temp_x_weekend": "temperature * (isodow(timestamp) >= 6)::INT",
    "humidity_x_temp": "humidity * temperature",
}


@query("interaction_features", "weather", f"SELECT timestamp, {cols(INTERACTION_SQL, 6)} FROM weather")
def _(spark, sf):
    w = v.weather_hourly(spark, sf).withColumns(weather.interaction_expressions())
    return rounded(w, ["timestamp"], INTERACTION_SQL)


SOLAR_SQL = {
    "solar_direct_ratio": "dni / (dni + dhi + 1e-6)",
    "clearness_index": "least(greatest(ghi / (toa_radiation + 1e-6), 0.0), 1.0)",
    "ghi_normalized": "ghi / 1000",
    "sunshine_fraction": "sunshine_seconds / 3600",
}


@query("solar_features", "solar", f"SELECT timestamp, {cols(SOLAR_SQL, 6)}, (ghi > 50)::INT AS solar_available FROM solar")
def _(spark, sf):
    s = v.solar_hourly(spark, sf).withColumns(weather.solar_expressions())
    return rounded(s, ["timestamp", "solar_available"], SOLAR_SQL)


@query(
    "range_validation",
    "weather",
    """, limits AS (SELECT * FROM (VALUES ('temperature', -50.0::DOUBLE, 60.0::DOUBLE), ('humidity', 0.0, 100.0),
        ('wind_speed', 0.0, 50.0), ('precipitation', 0.0, 500.0), ('pressure', 900.0, 1100.0)) l(variable, lo, hi)),
    long AS (UNPIVOT (SELECT temperature, humidity, wind_speed, precipitation, pressure FROM weather)
        ON temperature, humidity, wind_speed, precipitation, pressure INTO NAME variable VALUE x)
    SELECT variable, count(x) AS n_values, count(*) FILTER (x < lo OR x > hi) AS n_violations, lo AS min_allowed,
        hi AS max_allowed, round(count(*) FILTER (x < lo OR x > hi) / count(x), 6) + 0.0 AS violation_ratio
    FROM long JOIN limits USING (variable) GROUP BY variable, lo, hi""",
)
def _(spark, sf):
    out = weather.range_violations(v.weather_hourly(spark, sf))
    return out.withColumn("violation_ratio", r6(F.col("violation_ratio")))


@query(
    "column_aliases",
    "weather",
    "SELECT timestamp, temperature, humidity, wind_speed, pressure FROM weather",
)
def _(spark, sf):
    raw = v.weather_hourly(spark, sf).select(
        "timestamp",
        F.when(F.hour("timestamp") < 12, F.col("temperature")).alias("temp"),
        F.col("temperature").alias("temperature_2m"),
        F.col("humidity").alias("relative_humidity"),
        F.col("wind_speed").alias("wind_speed_10m"),
        F.col("pressure").alias("surface_pressure"),
    )
    return weather.standard_names(raw)


@query(
    "gap_limited_interpolate",
    "load_hourly",
    f""", span AS (SELECT series_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
        FROM load_hourly GROUP BY 1),
    whole AS (SELECT s.series_id, s.timestamp, l.load FROM span s LEFT JOIN load_hourly l USING (series_id, timestamp)),
    near AS (SELECT *, last_value(load IGNORE NULLS) OVER b AS p,
        last_value(CASE WHEN load IS NOT NULL THEN epoch(timestamp) END IGNORE NULLS) OVER b AS pt,
        first_value(load IGNORE NULLS) OVER a AS n,
        first_value(CASE WHEN load IS NOT NULL THEN epoch(timestamp) END IGNORE NULLS) OVER a AS nt FROM whole
        WINDOW b AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               a AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT series_id, timestamp, {q6('''coalesce(load, CASE WHEN nt - pt <= 4 * 3600
        THEN p + (n - p) * ((epoch(timestamp) - pt) / (nt - pt)) END)''')} AS load FROM near""",
)
def _(spark, sf):
    return rounded(series.fill_short_gaps(v.load_hourly(spark, sf), ["load"]), KEY, ["load"])


LAG_SQL = ", ".join(f"lag(load, {k}) OVER w AS load_lag_{k}h" for k in series.LAGS)
W_SQL = "WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)"


@query("lag_features", "load_hourly", f"SELECT series_id, timestamp, load, {LAG_SQL} FROM load_hourly {W_SQL}")
def _(spark, sf):
    return series.lag_features(v.load_hourly(spark, sf))


# Series whose number and length grow with the tables.
SUPPLIER_LAGS = (1, 7, 28)


@query(
    "lag_features_supplier",
    "load_supplier_daily",
    f"""SELECT series_id, timestamp, load, {', '.join(f'lag(load, {k}) OVER w AS load_lag_{k}h' for k in SUPPLIER_LAGS)}
    FROM load_supplier_daily {W_SQL}""",
)
def _(spark, sf):
    return series.lag_features(v.load_supplier_daily(spark, sf), lags=SUPPLIER_LAGS, grid=DAILY)


@query(
    "rolling_features_supplier",
    "load_supplier_daily",
    "SELECT series_id, timestamp, "
    + ", ".join(
        f"{q6(f'{e} OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', 3)} AS rolling_{n}h_{s}"
        for n in (7, 28)
        for s, e in (("mean", "avg(load)"), ("max", "max(load)"))
    )
    + " FROM load_supplier_daily",
)
def _(spark, sf):
    out = series.rolling_features(v.load_supplier_daily(spark, sf), windows=(7, 28), stats=("mean", "max"), grid=DAILY)
    return guards.rounded(out.drop("load"), [f"rolling_{n}h_{s}" for n in (7, 28) for s in ("mean", "max")], 3)


@query("lag_features_user", "load_user_hourly", f"SELECT series_id, timestamp, load, lag(load, 1) OVER w AS load_lag_1h FROM load_user_hourly {W_SQL}")
def _(spark, sf):
    return series.lag_features(v.load_user_hourly(spark, sf), lags=(1,))


@query(
    "lag_features_aligned",
    "load_hourly",
    """, span AS (SELECT series_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
        FROM load_hourly GROUP BY 1)
    SELECT series_id, timestamp, l.load, lag(l.load, 1) OVER w AS load_lag_1h, lag(l.load, 24) OVER w AS load_lag_24h
    FROM span LEFT JOIN load_hourly l USING (series_id, timestamp)
    WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)""",
)
def _(spark, sf):
    return series.lag_features(v.load_hourly(spark, sf), lags=(1, 24), aligned=True)


def rolling_sql(n: int) -> dict[str, str]:
    over = f"OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return {
        f"rolling_{n}h_mean": f"avg(load) {over}",
        f"rolling_{n}h_std": f"stddev_samp(load) {over}",
        f"rolling_{n}h_min": f"min(load) {over}",
        f"rolling_{n}h_max": f"max(load) {over}",
    }


ROLL_SQL = {k: e for n in series.WINDOWS for k, e in rolling_sql(n).items()}


@query("rolling_features", "load_hourly", f"SELECT series_id, timestamp, {cols(ROLL_SQL, 6)} FROM load_hourly")
def _(spark, sf):
    return rounded(series.rolling_features(v.load_hourly(spark, sf)), KEY, ROLL_SQL)


DIFF_SQL = {f"diff_{p}h": f"load - lag(load, {p}) OVER w" for p in series.DIFFS}


@query("diff_features", "load_hourly", f"SELECT series_id, timestamp, {cols(DIFF_SQL, 6)} FROM load_hourly {W_SQL}")
def _(spark, sf):
    return rounded(series.diff_features(v.load_hourly(spark, sf)), KEY, DIFF_SQL)


# The weather table is one site: the whole country shares it.
def _site_weather(spark, sf):
    return v.weather_hourly(spark, sf).withColumn("series_id", F.lit("site"))


WEATHER_LAG_SQL = {f"{c}_lag_{k}h": f"lag({c}, {k}) OVER w" for c in ft.WEATHER for k in series.WEATHER_LAGS}


@query(
    "weather_lags",
    "weather",
    f"SELECT timestamp, {cols(WEATHER_LAG_SQL, 6)} FROM weather WINDOW w AS (ORDER BY timestamp)",
)
def _(spark, sf):
    return rounded(series.weather_lags(_site_weather(spark, sf), ft.WEATHER), ["timestamp"], WEATHER_LAG_SQL)


RANGE_SQL = (
    "max(temperature) OVER (ORDER BY timestamp ROWS 23 PRECEDING) - min(temperature) OVER (ORDER BY timestamp ROWS 23 PRECEDING)"
)


@query("temp_range_24h", "weather", f"SELECT timestamp, {q6(RANGE_SQL)} AS temp_range_24h FROM weather")
def _(spark, sf):
    return rounded(series.temp_range(_site_weather(spark, sf)), ["timestamp"], ["temp_range_24h"])


GHI_SQL = {
    "ghi_rolling_3h": "avg(ghi) OVER (ORDER BY timestamp ROWS 2 PRECEDING)",
    "ghi_rolling_6h": "avg(ghi) OVER (ORDER BY timestamp ROWS 5 PRECEDING)",
    "ghi_change_1h": "ghi - lag(ghi) OVER (ORDER BY timestamp)",
}


@query("solar_rolling", "solar", f"SELECT timestamp, {cols(GHI_SQL, 6)} FROM solar")
def _(spark, sf):
    site = v.solar_hourly(spark, sf).withColumn("series_id", F.lit("site"))
    return rounded(series.solar_rolling(site), ["timestamp"], GHI_SQL)


TARGET_SQL = ", ".join(f"lead(load, {h}) OVER w AS target_{h}h" for h in series.HORIZONS)


@query("horizon_targets", "load_hourly", f"SELECT series_id, timestamp, load, {TARGET_SQL} FROM load_hourly {W_SQL}")
def _(spark, sf):
    return series.horizon_targets(v.load_hourly(spark, sf))


@query(
    "safe_lags",
    "load_hourly",
    """SELECT series_id, timestamp, load, """
    + ", ".join(
        f"CASE WHEN timestamp <= TIMESTAMP '2024-01-20 00:00:00' THEN lag(load, {k}) OVER w END AS load_lag_{k}h"
        for k in (1, 24, 168)
    )
    + f" FROM load_hourly {W_SQL}",
)
def _(spark, sf):
    return series.safe_lags(v.load_hourly(spark, sf), "2024-01-20 00:00:00")


FREE_SQL = "(SELECT holiday_date FROM holidays WHERE kind IN ('standard', 'custom'))"
CALENDAR_SQL = f"""
    days AS (SELECT DISTINCT timestamp::DATE AS date FROM load_hourly),
    free AS {FREE_SQL},
    near AS (SELECT date, arg_min(holiday_date - date, abs(holiday_date - date) * 2
        - (CASE WHEN holiday_date > date THEN 1 ELSE 0 END)) AS days_to_holiday FROM days, free GROUP BY date),
    kinds AS (SELECT holiday_date AS date, max((kind IN ('standard', 'custom'))::INT) AS is_holiday,
        max((kind = 'event')::INT) AS is_special_event,
        coalesce(min(CASE WHEN kind <> 'event' AND category > 0 THEN category END), 0) AS holiday_type
        FROM holidays GROUP BY 1),
    calendar AS (SELECT d.date, coalesce(k.is_holiday, 0)::INT AS is_holiday,
        coalesce(k.is_special_event, 0)::INT AS is_special_event, coalesce(k.holiday_type, 0)::INT AS holiday_type,
        n.days_to_holiday::INT AS days_to_holiday,
        (n.days_to_holiday > 0 AND n.days_to_holiday <= 2)::INT AS is_before_holiday,
        (n.days_to_holiday < 0 AND n.days_to_holiday >= -1)::INT AS is_after_holiday,
        (isodow(d.date) = 5 AND (d.date + 1 IN (FROM free) OR d.date + 2 IN (FROM free)))::INT
            AS is_friday_before_weekend_holiday,
        (isodow(d.date) = 1 AND (d.date - 1 IN (FROM free) OR d.date - 2 IN (FROM free)))::INT
            AS is_monday_after_weekend_holiday
        FROM days d LEFT JOIN near n USING (date) LEFT JOIN kinds k USING (date))"""


def _calendar(spark, sf):
    return calendar_features(v.load_hourly(spark, sf), v.holidays(spark))


def _calendar_query(name: str, columns: list[str]) -> None:
    sql = f", {CALENDAR_SQL} SELECT series_id, timestamp, {', '.join(columns)} FROM load_hourly JOIN calendar ON date = timestamp::DATE"
    query(name, "load_hourly holidays", sql)(lambda spark, sf: _calendar(spark, sf).select(*KEY, *columns))


_calendar_query("holiday_flags", ["is_holiday", "is_special_event", "holiday_type"])
_calendar_query("days_to_holiday", ["days_to_holiday", "is_before_holiday", "is_after_holiday"])
_calendar_query("weekend_adjacent", ["is_friday_before_weekend_holiday", "is_monday_after_weekend_holiday"])


def _catalog_sql() -> str:
    names = ", ".join(f"('{n}')" for n in [*ft.feature_names(), "load"])
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(feature, '{w}')" for w in words) + f" THEN '{category}'"
        for category, words in ft.CATEGORY_WORDS.items()
    )
    case = f"CASE {whens} ELSE 'other' END"
    return f"""SELECT {case} AS category, count(*) AS n_features, max((SELECT count(*) FROM load_hourly)) AS n_rows
        FROM (VALUES {names}) f(feature) GROUP BY 1"""


@query("feature_catalog", "load_hourly", _catalog_sql())
def _(spark, sf):
    table = _features(spark, sf)
    catalog = ft.feature_catalog(spark, table.drop("series_id", "timestamp").columns)
    return catalog.withColumn("n_rows", table.agg(F.count(F.lit(1))).scalar())


def _features(spark, sf):
    return ft.feature_table(v.load_hourly(spark, sf), v.weather_hourly(spark, sf), v.holidays(spark))


ALL_SQL = {
    **TEMPORAL_SQL,
    **CYCLE_SQL,
    **{c: c for c in ft.CALENDAR},
    **{f"load_lag_{k}h": f"lag(load, {k}) OVER w" for k in series.LAGS},
    **ROLL_SQL,
    **{c: c for c in ft.WEATHER},
    "hdd": "CASE WHEN temperature IS NOT NULL THEN greatest(18.3 - temperature, 0.0) END",
    "cdd": "CASE WHEN temperature IS NOT NULL THEN greatest(temperature - 18.3, 0.0) END",
    "heat_index": HEAT_SQL,
    "discomfort_index": DISCOMFORT_SQL,
    "temp_range_24h": "max(temperature) OVER r24 - min(temperature) OVER r24",
    **WEATHER_LAG_SQL,
    **INTERACTION_SQL,
}
INT_FEATURES = [*INT_TEMPORAL, *ft.CALENDAR]
FEATURE_SELECT_SQL = ", ".join(
    f"{e if n in INT_FEATURES else q6(e, 5)} AS {n}" for n, e in ALL_SQL.items()
)


@query(
    "feature_table",
    "load_hourly weather holidays",
    f""", {CALENDAR_SQL}, merged AS (SELECT l.*, w.* EXCLUDE (timestamp), c.* FROM load_hourly l
        LEFT JOIN weather w USING (timestamp) LEFT JOIN calendar c ON c.date = l.timestamp::DATE)
    SELECT series_id, timestamp, {FEATURE_SELECT_SQL}, load FROM merged
    WINDOW w AS (PARTITION BY series_id ORDER BY timestamp),
        r24 AS (PARTITION BY series_id ORDER BY timestamp ROWS 23 PRECEDING)""",
)
def _(spark, sf):
    out = _features(spark, sf)
    doubles = [n for n in out.columns if n not in INT_FEATURES and n not in (*KEY, "load")]
    return out.withColumns({n: r6(F.col(n), 5) for n in doubles})


@query(
    "drop_incomplete",
    "load_hourly",
    f"""SELECT series_id, timestamp, load, load_lag_1h, load_lag_24h FROM (SELECT *, lag(load, 1) OVER w AS load_lag_1h,
        lag(load, 24) OVER w AS load_lag_24h FROM load_hourly {W_SQL})
    WHERE load IS NOT NULL AND load_lag_1h IS NOT NULL AND load_lag_24h IS NOT NULL""",
)
def _(spark, sf):
    lagged = series.lag_features(v.load_hourly(spark, sf), lags=(1, 24))
    return lagged.dropna(subset=["load"]).dropna(subset=["load_lag_1h", "load_lag_24h"])


@query("filter_positive", "", "SELECT event_id, ts::TIMESTAMP AS timestamp, value AS load FROM events WHERE value > 0")
def _(spark, sf):
    events = v.table(spark, sf, "events")
    return events.where("value > 0").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("load"))


@query(
    "period_slice",
    "load_daily",
    "SELECT * FROM load_daily WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1998-01-01'",
)
def _(spark, sf):
    from tidegrid.operators.joins import period_slice

    return period_slice(v.load_daily(spark, sf), "1996-01-01", "1997-12-31")
