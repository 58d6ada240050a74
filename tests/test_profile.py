import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import joins
from tidegrid.plans import profile as p


def hours(spark, numbers):
    rows = [("s", 3600 * h, float(i)) for i, h in enumerate(numbers)]
    return spark.createDataFrame(rows, "series_id string, t long, load double").selectExpr("series_id", "timestamp_seconds(t) AS timestamp", "load")


def test_consistency_counts(spark):
    row = p.temporal_consistency(hours(spark, [0, 1, 1, 2, 5, 6])).first()
    assert (row.n_rows, row.n_duplicates, row.n_gaps, row.usual_step_seconds, row.n_irregular) == (6, 1, 2, 3600, 2)
    assert row.first_gaps == "1970-01-01 03:00:00,1970-01-01 04:00:00"


def test_consistency_single_row(spark):
    row = p.temporal_consistency(hours(spark, [7])).first()
    assert (row.n_rows, row.n_gaps, row.n_irregular, row.first_gaps) == (1, 0, 0, "")


def test_coverage_ignores_duplicates(spark):
    row = p.temporal_coverage(hours(spark, [0, 1, 1, 3])).first()
    assert (row.n_expected, row.n_missing) == (4, 1)


def test_quality_of_empty_column(spark, load):
    df = load.withColumn("gone", F.lit(None).cast("double"))
    checks = {(r.check, r.column): r for r in p.data_quality(df, ["load", "gone"]).collect()}
    assert checks["row_count", None].passed == 0 and checks["missing_ratio", "gone"].value == 1.0
    assert checks["missing_ratio", "load"].passed == 1
    summary = p.quality_summary(p.data_quality(df, ["load", "gone"])).first()
    assert summary.passed == 0 and summary.issues == "missing_ratio gone; row_count"


def test_all_null_statistics(spark, load):
    row = p.distribution_stats(load.withColumn("load", F.lit(None).cast("double"))).first()
    assert row["mean"] is None and row["median"] is None and row["skewness"] is None


def test_pacf_of_an_autoregression(spark):
    rng, x, rows = random.Random(1), 0.0, []
    for i in range(3000):
        x = 0.7 * x + rng.gauss(0, 1)
        rows.append(("s", 3600 * i, x))
    df = spark.createDataFrame(rows, "series_id string, t long, load double").selectExpr("series_id", "timestamp_seconds(t) AS timestamp", "load")
    got = {r.lag: r.pacf for r in p.pacf(df, max_lag=4).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(0.7, abs=0.05) and abs(got[2]) < 0.06 and abs(got[3]) < 0.06
    acf = {r.lag: r.acf for r in p.acf(df, max_lag=2).collect()}
    assert acf[1] == pytest.approx(got[1])


def test_constant_series_has_no_autocorrelation(spark):
    df = hours(spark, range(30)).withColumn("load", F.lit(2.0))
    assert p.autocorr_lags(df, lags=(1, 2)).count() == 0


def test_missing_hours(spark):
    got = [r.timestamp.hour for r in joins.missing_timestamps(hours(spark, [0, 3])).orderBy("timestamp").collect()]
    assert got == [1, 2]


def test_interval_events_match_brute_force(spark, load):
    events = spark.createDataFrame(
        [("2023-01-02 10:30:00", 2.0), ("2023-01-02 11:00:00", 0.5), ("2023-01-03 00:00:00", 1.0), ("2023-01-04 05:00:00", 0.0)], "t string, duration_hours double"
    ).selectExpr("to_timestamp(t) AS timestamp", "duration_hours")
    hit = joins.grid_event_interval_flag(load, events).where("has_grid_event = 1").orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in hit] == ["2023-01-02 11:00:00", "2023-01-02 12:00:00", "2023-01-03 00:00:00"]
