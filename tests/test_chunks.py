import random

import numpy as np
import pytest
from rowsets import as_set
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.operators import chunks as c
from tidegrid.operators import ranks, series
from tidegrid.operators.chunks import Grid


@pytest.mark.parametrize("steps", [3, 7, 50, 6000])
def test_chunked_windows_equal_plain_windows(gappy, steps):
    def build(w):
        return {
            "lag": F.lag("load", 12).over(w),
            "lead": F.lead("load", 5).over(w),
            "mean": F.avg("load").over(w.rowsBetween(-9, -1)),
            "peak": F.max("load").over(w.rowsBetween(-4, 4)),
        }

    plain = gappy.withColumns(build(Window.partitionBy("series_id").orderBy("timestamp")))
    cut = c.over_chunks(gappy, build, back=12, ahead=5, grid=c.Grid(3600, steps))
    assert as_set(cut) == as_set(plain)


@pytest.mark.parametrize("steps", [4, 6000])
def test_ordinal_edges_and_running_sums(gappy, steps):
    grid = c.Grid(3600, steps)
    w = Window.partitionBy("series_id").orderBy("timestamp")
    want = gappy.withColumns({"ordinal": F.row_number().over(w) - 1, "ordinal_n": F.count("*").over(Window.partitionBy("series_id"))})
    assert as_set(c.with_ordinal(gappy, grid=grid)) == as_set(want)
    tail = gappy.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("timestamp")))).where("rank <= 6")
    assert as_set(c.edge_rows(gappy, 6, grid=grid)) == as_set(tail)
    total = gappy.withColumn("t", F.sum("load").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert as_set(c.running_sums(gappy, {"t": F.col("load")}, grid=grid)) == as_set(total)


def test_full_grid_is_independent_of_the_bucket_size(gappy):
    a = as_set(c.full_grid(gappy, grid=c.Grid(3600, 5)))
    b = as_set(c.full_grid(gappy))
    assert a == b and len(a) == len(set(a))


def test_empty_input(spark, gappy):
    empty = gappy.where("false")
    assert series.lag_features(empty).count() == 0
    assert c.with_ordinal(empty).count() == 0
    assert ranks.exact_percentiles(empty, ["series_id"], "load", {"m": 0.5}).count() == 0


def test_percentiles_match_numpy(spark):
    rng = random.Random(5)
    pools = {
        "normal": [rng.gauss(0, 100) for _ in range(500)],
        "ties": [float(rng.randint(-3, 3)) for _ in range(400)],
        "powers": [s * 2.0**k * f for k in range(-20, 20) for s in (-1, 1) for f in (0.999999999999, 1.0, 1.000000000001)],
        "one": [4.5],
        "close": [1e6 + rng.random() for _ in range(700)],
    }
    df = spark.createDataFrame([(k, x) for k, xs in pools.items() for x in xs], "k string, x double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    rows = ranks.exact_percentiles(df, ["k"], "x", probs).collect()
    assert len(rows) == len(pools)
    for row in rows:
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(pools[row.k], p), rel=1e-12, abs=1e-12), (row.k, name)


def test_percentiles_of_null_keys_and_of_the_whole_table(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "k string, x double")
    assert sorted(map(str, map(tuple, ranks.exact_percentiles(df, ["k"], "x", {"m": 0.5}).collect()))) == ["('a', 5.0)", "(None, 2.0)"]
    assert [tuple(r) for r in ranks.exact_percentiles(df, [], "x", {"m": 0.5}).collect()] == [(3.0,)]


def test_time_frames_do_not_depend_on_the_grid(spark):
    """15-minute rows and copies of a timestamp over buckets of an hourly grid equal a plain window."""
    rng = random.Random(8)
    rows = [("a", 1700000000 + 900 * (i - i % 7 // 6), rng.random(), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "series_id string, s long, y_true double, y_pred double").selectExpr("series_id", "timestamp_seconds(s) AS timestamp", "y_true", "y_pred")
    got = series.rolling_time_rmse(df, days=2, grid=Grid(3600, 30)).collect()
    assert len(got) == len(rows)
    for r in rng.sample(got, 150):
        at = r.timestamp.timestamp()
        errors = [(y - p) ** 2 for _, s, y, p in rows if at - 2 * 86400 < s <= at]
        assert r.rolling_rmse == pytest.approx((sum(errors) / len(errors)) ** 0.5)


def test_value_buckets_keep_the_order(spark):
    rng = random.Random(9)
    xs = sorted([rng.choice((-1, 1)) * 10 ** rng.uniform(-9, 9) for _ in range(3000)] + [0.0] + [2.0**k for k in range(-30, 30)])
    cells = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").selectExpr("i", ranks.value_bucket("x") + " AS b").orderBy("i").select("b").collect()]
    assert cells == sorted(cells)


def test_gap_filling_rules(spark):
    rows = [(0, 1.0), (1, 2.0), (4, 8.0), (9, 18.0)]
    df = spark.createDataFrame([("s", 3600 * i, v) for i, v in rows], "series_id string, t long, load double").selectExpr(
        "series_id", "timestamp_seconds(t) AS timestamp", "load"
    )
    filled = [r.load for r in series.fill_short_gaps(df, ["load"]).orderBy("timestamp").collect()]
    assert filled == [1.0, 2.0, 4.0, 6.0, 8.0, None, None, None, None, 18.0]
    forward = [r.load for r in series.fill_short_gaps(df, ["load"], method="forward_fill").orderBy("timestamp").collect()]
    assert forward == [1.0, 2.0, 2.0, 2.0, 8.0, 8.0, 8.0, 8.0, None, 18.0]
    with pytest.raises(ValueError):
        series.fill_short_gaps(df, ["load"], method="guess")
