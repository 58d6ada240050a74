import pytest
from pyspark.sql import functions as F

from tidegrid.operators import metrics as m
from tidegrid.plans import forecast as f


def test_naive_forecasts(load):
    values = [r.load for r in load.orderBy("timestamp").collect()]
    got = f.naive_forecasts(load, 30).orderBy("method", "step").collect()
    by = {k: [r.y_pred for r in got if r.method == k] for k in f.METHODS}
    assert by["persistence"] == [values[-1]] * 30
    assert by["seasonal_naive"] == [values[-24 + i % 24] for i in range(30)]
    assert by["moving_average"] == pytest.approx([sum(values[-168:]) / 168] * 30)
    assert got[0].timestamp.hour == 0 and len(got) == 90
    with pytest.raises(ValueError):
        f.naive_forecasts(load, 3, ["magic"])


def test_short_series_falls_back_to_its_last_value(load):
    short = load.orderBy("timestamp").limit(5)
    last = short.orderBy(F.desc("timestamp")).first().load
    values = [r.load for r in short.orderBy("timestamp").collect()]
    got = [r.y_pred for r in f.seasonal_naive_forecast(short, 24).orderBy("step").collect()]
    assert got[:19] == [last] * 19 and got[19:] == values


def test_baseline_metrics(load):
    split = f.holdout_split(load, 48)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 538, "validation": 134, "test": 48}
    out = f.compare_baselines(split.where("split <> 'test'"), split.where("split = 'test'"), 24).collect()
    assert {r.method for r in out} == set(f.METHODS) and all(r.rmse >= r.mae > 0 and r.n == 24 for r in out)


def test_splits(load):
    splits = f.rolling_origin_splits(load, 3, 5, 10).orderBy("split").collect()
    assert len(splits) == 3 and all(s.train_end <= s.test_start < s.test_end for s in splits)
    assert [(s.train_end - s.train_start).days for s in splits] == [10, 17, 24]
    with pytest.raises(Exception, match="Insufficient data"):
        f.rolling_origin_splits(load).collect()
    one = f.rolling_origin_splits(load, 1, 5, 10).collect()
    assert len(one) == 1


def test_border_row_of_a_zero_gap(load):
    splits = f.rolling_origin_splits(load, 1, 5, 10)
    both = f.tag_splits(load, splits).groupBy("timestamp").count().where("count > 1").count()
    strict = f.tag_splits(load, splits, strict=True).groupBy("timestamp").count().where("count > 1").count()
    assert (both, strict) == (1, 0)


def test_leakage(load):
    f.assert_no_leakage(load, "2024-01-01 00:00:00")
    with pytest.raises(ValueError, match="Data leakage: 719 rows"):
        f.assert_no_leakage(load, "2023-01-01 00:00:00")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "m", 2.0, 1.0), ("a", "m", 0.0, 2.0), ("a", "m", 4.0, 4.0)], "series_id string, model string, y_true double, y_pred double")
    r = m.forecast_metrics(df).first()
    assert r.rmse == pytest.approx((5 / 3) ** 0.5) and r.mae == 1.0 and r.max_error == 2.0
    assert r.r2 == pytest.approx(1 - 5 / 8) and r.mape_raw == pytest.approx(25.0)


def test_constant_target_has_no_r2(spark):
    df = spark.createDataFrame([("a", "m", 2.0, 1.0), ("a", "m", 2.0, 2.0)], "series_id string, model string, y_true double, y_pred double")
    assert m.forecast_metrics(df).first().r2 is None


def test_zero_baseline_counts_as_unset(spark, load):
    df = load.selectExpr("series_id", "'m' AS model", "timestamp", "load AS y_true", "load + 1 AS y_pred")
    base = spark.createDataFrame([("a", "m", 0.0)], "series_id string, model string, baseline_rmse double")
    r = m.performance_log(df, base).first()
    assert r.degradation is None and r.alert == 0


def test_recursion_by_hand(load):
    values = [r.load for r in load.orderBy("timestamp").collect()]
    state = values[-3:]
    for _ in range(5):
        state.append(1.0 + 0.5 * state[-1] + 0.25 * state[-3])
    got = [r.y_pred for r in f.recursive_forecast(load, {1: 0.5, 3: 0.25}, 1.0, 5).orderBy("step").collect()]
    assert got == pytest.approx(state[3:])


def test_quantile_names():
    assert [f.quantile_name(q) for q in (0.1, 0.5, 0.9)] == ["q10", "q50", "q90"]
