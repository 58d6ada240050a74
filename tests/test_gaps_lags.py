"""Gaps without a grid, autocorrelation by FFT, merged event spans and window panes: results and plans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rowsets import as_set

from tidegrid.operators import joins
from tidegrid.operators.chunks import Grid, full_grid, gap_islands
from tidegrid.plans import profile
from tidegrid.streaming import jobs

SHORT = Grid(3600, 7)


def by_grid(df, grid):
    return full_grid(df, grid=grid).join(df.select("series_id", "timestamp"), ["series_id", "timestamp"], "left_anti")


def test_gaps_equal_the_grid_minus_the_rows(spark, gappy):
    off = spark.sql("SELECT 'off' AS series_id, timestamp_seconds(1700000000 + s) AS timestamp, 1D AS load FROM VALUES (0), (0), (5000), (7200), (40000), (43200 * 40) t(s)")
    one = spark.sql("SELECT 'one' AS series_id, timestamp_seconds(1700000000) AS timestamp, 1D AS load")
    rows = gappy.unionByName(off).unionByName(one).cache()
    for grid in (SHORT, Grid()):
        assert as_set(joins.missing_timestamps(rows, grid=grid)) == as_set(by_grid(rows, grid))
    assert joins.missing_timestamps(rows.where("load < -5")).count() == 0
    islands = gap_islands(rows, grid=SHORT)
    assert islands.agg(F.sum("_missing")).first()[0] == by_grid(rows, SHORT).count()
    plan = joins.missing_timestamps(rows)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan


def test_consistency_counts_gaps_of_any_length(spark):
    rows = spark.sql("SELECT 'a' AS series_id, timestamp_seconds(3600 * s) AS timestamp FROM VALUES (0), (1), (4), (30), (100000) t(s)")
    r = profile.temporal_consistency(rows, grid=SHORT).first()
    assert r.n_gaps == 100001 - 5
    want = [2, 3, *range(5, 13)]
    assert r.first_gaps == ",".join(str(np.datetime64(3600 * h, "s")).replace("T", " ") for h in want)


@pytest.mark.parametrize("max_lag", [0, 3, 20])
def test_lagged_products(max_lag):
    rng = np.random.default_rng(max_lag)
    known = rng.normal(0, 1, 17)
    own = known[5:]
    found = profile.lagged_products(own, known, max_lag)
    want = [sum(known[i] * known[i - k] for i in range(5, 17) if i >= k) for k in range(min(max_lag, 16) + 1)]
    assert found == pytest.approx(want)


def test_acf_over_bucket_borders(gappy):
    found = {(r.series_id, r.lag): r.acf for r in profile.acf(gappy, max_lag=9, grid=SHORT).collect()}
    for name in ("x", "y", "z"):
        x = np.array([r.load for r in gappy.where(F.col("series_id") == name).orderBy("timestamp").collect()])
        d = x - x.mean()
        for k in range(min(10, len(d))):
            assert found.pop((name, k)) == pytest.approx((d[k:] * d[: len(d) - k]).sum() / (d * d).sum(), abs=1e-9)
    assert not found


def test_acf_shuffles_buckets_times_lags(spark):
    rows = spark.range(3000).selectExpr("'a' AS series_id", "timestamp_seconds(id * 3600) AS timestamp", "cast(id % 11 AS double) AS load")
    plan = profile.acf(rows, max_lag=24)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("FlatMapGroupsInArrow")[0] and "FlatMapGroupsInArrow" in plan


def test_many_events_in_a_cell(spark):
    """A cell with 100,000 overlapping events keeps a few disjoint spans."""
    base = 1700000000 // 3600 * 3600
    events = spark.range(100_000).selectExpr(f"timestamp_seconds({base} + id % 1800) AS timestamp", "(1 + id % 7) / 3600D AS duration_hours")
    more = spark.sql(f"SELECT timestamp_seconds({base} + s) AS timestamp, d / 3600D AS duration_hours FROM VALUES (3000, 60), (3100, 7200), (-100, 50), (20000, -5) t(s, d)")
    spans = [(s, s + d) for s, d in ((0, 1806), (3000, 60), (3100, 7200), (-100, 50))]
    df = spark.range(-200, 12000, 37).selectExpr(f"timestamp_seconds({base} + id) AS timestamp", "id")
    out = joins.grid_event_interval_flag(df, events.unionByName(more))
    assert all(r.has_grid_event == any(a <= r.id < b for a, b in spans) for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_panes_equal_windows(spark):
    rng = random.Random(3)
    rows = [("ab"[i % 2], 1700006400 + rng.randrange(5 * 86400), rng.random() if i % 9 else None) for i in range(600)]
    events = spark.createDataFrame(rows, "series_id string, t long, value double").selectExpr("series_id", "timestamp_seconds(t) AS timestamp", "value")
    batch = events.groupBy(F.window("timestamp", "24 hours", "1 hour"), "series_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    want = batch.select("series_id", F.col("window.start").alias("window_start"), F.round("m", 9).alias("mean"), "n")
    found = jobs.stream_sliding_mean(events).select("series_id", "window_start", F.round("mean", 9).alias("mean"), "n")
    assert as_set(found) == as_set(want)
    plan = jobs.stream_sliding_mean(events)._jdf.queryExecution().optimizedPlan().toString()
    # the 24 copies are made of panes, above the aggregate of the events
    assert plan.index("Expand" if "Expand" in plan else "Aggregate") < plan.rindex("Aggregate")
