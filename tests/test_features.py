import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import temporal
from tidegrid.functions import weather as w
from tidegrid.functions.holidays import calendar_features, date_dimension, us_holidays
from tidegrid.operators import joins, series
from tidegrid.plans import feature_table as ft
from tidegrid.plans import hooks


def test_temporal_ranges(load):
    out = temporal.cyclical_features(temporal.temporal_features(load)).agg(
        F.min("hour"), F.max("hour"), F.min("hour_sin"), F.max("hour_cos"), F.max("day_of_week"), F.max("season")
    ).first()
    assert (out[0], out[1], out[4], out[5]) == (0, 23, 6, 0)
    assert out[2] >= -1 and out[3] <= 1


def test_names_match_expressions(spark):
    assert list(temporal.temporal_expressions()) == temporal.TEMPORAL_NAMES
    assert list(temporal.cyclical_expressions()) == temporal.CYCLICAL_NAMES


def test_toggles(load):
    out = temporal.temporal_features(load, toggles={"hour": False})
    assert "hour" not in out.columns and "month" in out.columns
    with pytest.raises(ValueError):
        temporal.temporal_features(load, toggles={"nonsense": False})


def test_lags_and_rolling(load):
    rows = series.rolling_features(series.lag_features(load)).orderBy("timestamp").collect()
    assert rows[0].load_lag_1h is None and rows[24].load_lag_24h == rows[0].load
    assert rows[0].rolling_24h_mean is None and rows[1].rolling_24h_mean == rows[0].load
    assert rows[1].rolling_3h_std is None and rows[5].rolling_3h_max == max(r.load for r in rows[2:5])


def test_rolling_by_aggregate_name(load):
    out = series.rolling_features(load, windows=(3,), stats=("mean", "median")).orderBy("timestamp").collect()
    assert out[3].rolling_3h_median == sorted(r.load for r in out[:3])[1]


def test_weather_formulas(spark, weather):
    out = w.weather_features(weather, with_wind_chill=True)
    low = out.agg(F.min("hdd"), F.min("cdd"), F.min(F.col("hdd") * F.col("cdd"))).first()
    assert low[0] >= 0 and low[1] >= 0 and low[2] == 0
    one = spark.createDataFrame([(35.0, 60.0, 5.0), (-10.0, 50.0, 10.0), (None, 50.0, 10.0)], "temperature double, humidity double, wind_speed double")
    rows = w.weather_features(one, with_wind_chill=True).collect()
    assert rows[0].heat_index == pytest.approx(45.05, abs=0.1) and rows[0].wind_chill == 35.0
    assert rows[1].wind_chill == pytest.approx(-20.27, abs=0.05)
    assert rows[2].hdd is None and rows[2].heat_index is None


def test_solar_columns(spark):
    rows = [(100.0, 50.0, 50.0, 200.0, 1800.0), (500.0, 400.0, 100.0, 1000.0, 3600.0), (800.0, 700.0, 100.0, 1200.0, 3600.0), (200.0, 100.0, 100.0, 400.0, 900.0)]
    df = spark.createDataFrame(rows, "ghi double, dni double, dhi double, toa_radiation double, sunshine_seconds double")
    out = df.withColumns(w.solar_expressions()).collect()
    assert [round(r.clearness_index, 3) for r in out] == [0.5, 0.5, 0.667, 0.5]
    assert [r.solar_available for r in out] == [1, 1, 1, 1] and out[0].sunshine_fraction == 0.5


def test_us_holidays_and_nearest_rule(spark):
    days = {(r.holiday_date, r.name) for r in us_holidays(spark, [2023, 2024]).collect()}
    assert (dt.date(2024, 5, 27), "Memorial Day") in days and (dt.date(2024, 11, 28), "Thanksgiving") in days
    assert (dt.date(2023, 1, 2), "New Year's Day (observed)") in days
    two = spark.createDataFrame([(dt.date(2024, 1, 1), "a", "standard", 1), (dt.date(2024, 1, 5), "b", "custom", 0)], "holiday_date date, name string, kind string, category int")
    dates = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 4, 5, 8)], "date date")
    got = {r.date.day: r.days_to_holiday for r in date_dimension(dates, two).collect()}
    assert got == {1: 0, 2: -1, 3: 2, 4: 1, 5: 0, 8: -3}


def test_empty_calendar(spark, load):
    none = spark.createDataFrame([], "holiday_date date, name string, kind string, category int")
    row = calendar_features(load, none).agg(F.count("days_to_holiday"), F.max("is_holiday"), F.count("*")).first()
    assert tuple(row) == (0, 0, 720)


def test_feature_table_shape(spark, load, weather):
    table = ft.feature_table(load, weather, us_holidays(spark, [2023]))
    assert table.columns == ["series_id", "timestamp", *ft.feature_names(), "load"]
    assert len(ft.feature_names()) == 88 and table.count() == 720
    off = ft.feature_table(load, weather, us_holidays(spark, [2023]), toggles={"hdd": False})
    assert "hdd" not in off.columns


def test_merge_keeps_rows_and_checks_overlap(load, weather):
    assert joins.merge_load_weather(load, weather.limit(500)).count() == 720
    late = weather.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 5 YEARS"))
    merged = joins.merge_load_weather(load, late)
    with pytest.raises(Exception, match="No overlap"):
        merged.collect()
    assert joins.merge_load_weather(load, late, check=False).count() == 720


def test_aliases_and_ranges(spark):
    df = spark.createDataFrame([(1.0, None, 50.0), (None, 2.0, 150.0)], "temp double, temperature_2m double, humidity double")
    std = w.standard_names(df)
    assert sorted(std.columns) == ["humidity", "temperature"] and {r.temperature for r in std.collect()} == {1.0, 2.0}
    assert [r.humidity for r in w.null_out_of_range(std).collect()] == [50.0, None]


def test_user_hooks(load):
    doubled = load.withColumn("p", hooks.score_udf(lambda x: x["load"] * 2, ["load"]))
    assert doubled.where("abs(p - 2 * load) > 1e-12").count() == 0
    sizes = hooks.apply_per_chunk(load, lambda rows: rows.tail(1)[["series_id", "load"]], "series_id string, load double")
    assert sizes.count() >= 1
