import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators.metrics import winkler_score
from tidegrid.operators.series import lag_features
from tidegrid.plans import conformal as cf
from tidegrid.plans import forecast as f
from tidegrid.plans import learning as ln

SMALL = {"trees": 30, "step": 0.3, "leaves": 16}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(900):
        x, z, noise = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        data.append(("s", 3600 * i, 4 + 3 * x + 0.2 * z + noise * 0.5, x, z, rng.gauss(0, 1)))
    return spark.createDataFrame(data, "series_id string, t long, load double, x double, z double, junk double").selectExpr(
        "series_id", "timestamp_seconds(t) AS timestamp", "load", "x", "z", "junk"
    ).cache()


def test_linear_fit(rows):
    c = ln.fit_linear(rows, ["x", "z"])
    assert c == pytest.approx([4, 3, 0.2], abs=0.1)


def test_singular_fit(rows):
    twice = rows.withColumn("x2", F.col("x"))
    c = ln.fit_linear(twice, ["x", "x2"])
    assert c[1] + c[2] == pytest.approx(3, abs=0.1)


def test_quantile_forecast_calibration(rows):
    out = ln.quantile_forecast(rows, ["x", "z"])
    share = out.agg(*[F.avg((F.col("load") <= F.col(q)).cast("int")) for q in ("q10", "q50", "q90")]).first()
    assert list(share) == pytest.approx([0.1, 0.5, 0.9], abs=0.03)
    assert out.where("lower > upper").count() == 0


def test_pruning_keeps_the_signal(rows):
    got = {r.feature: r for r in ln.permutation_prune(rows, ["x", "junk"], repeats=2, trees=10, depth=5, threshold=0.1).collect()}
    assert got["x"].kept == 1 and got["x"].importance > 0.5 and got["junk"].kept == 0


def test_permutation_uses_every_value_once(rows):
    class Echo:
        """Scores a row with its own x."""

        def transform(self, df):
            return df.withColumn("prediction", F.col("x"))

    base = rows.withColumn("load", F.col("x"))
    out = ln.permutation_importance(Echo(), base, ["x", "junk"], repeats=1).collect()
    got = {r.feature: r.importance for r in out}
    # exchanging x at random costs about twice the variance, exchanging junk costs nothing
    assert got["x"] == pytest.approx(2.0, abs=0.25) and got["junk"] == pytest.approx(0.0, abs=1e-9)


def test_gbt_beats_the_mean(rows):
    model, scored = ln.gbt_forecast(rows, ["x", "z"], 100, **SMALL)
    r = scored.agg(F.count("*"), F.avg(F.pow(F.col("load") - F.col("prediction"), F.lit(2))), F.var_pop("load")).first()
    assert r[0] == 100 and r[1] < 0.3 * r[2]
    assert ln.gain_importance(model, rows.sparkSession).count() == 2


def test_constraints_are_kept(rows):
    grid = np.stack([np.linspace(-3, 3, 100), np.zeros(100)])
    free, bound = (np.diff(ln.fit_gbt(rows, ["x", "z"], monotone=m, **SMALL).scores(grid)) for m in (None, {"x": -1}))
    assert free.max() > 0 and bound.max() <= 1e-12
    assert ln.signs(["temperature_lag_1h", "hour", "load"], {"temperature": 1, "load": -1}) == (1, 0, -1)
    assert ln.signs(["hour"], {"temperature": 1}) == () == ln.signs(["x"], None)


def test_cross_validation_and_search(rows):
    splits = f.rolling_origin_splits(rows, 2, 5, 10)
    out = ln.cross_validate(rows, splits, ["x"], **SMALL).orderBy("split").collect()
    assert [r.split for r in out] == [0, 1] and out[0].n_train == 241 and out[0].test_start >= out[0].train_end
    # the same sizes and a like error as a fit of one split alone
    tagged = f.tag_splits(rows, splits).where("split = 1")
    model = ln.fit_gbt(tagged.where("part = 'train'"), ["x"], patience=0, **SMALL)
    test = ln.predict(model, tagged.where("part = 'test'"))
    n, rmse = test.agg(F.count("*"), F.sqrt(F.avg(F.pow(F.col("load") - F.col("prediction"), F.lit(2))))).first()
    assert out[1].n_test == n and out[1].rmse == pytest.approx(rmse, rel=0.1)
    trials = ln.random_search(rows, splits, ["x"], settings=[{"trees": 3, "leaves": 2}, {"trees": 60, "leaves": 8, "step": 0.2}]).orderBy("trial").collect()
    assert [r.settings["leaves"] for r in trials] == ["2", "8"] and [r.n_folds for r in trials] == [2, 2]
    assert [r.is_best for r in trials] == [0, 1] and trials[1].mean_rmse < trials[0].mean_rmse


def test_multi_horizon_skips_short_data(rows):
    predictions, measured = ln.direct_multi_horizon(rows, ["x"], (1, 880), **SMALL)
    assert [r.horizon for r in measured.collect()] == [1] and predictions.count() > 100


def test_recursion_equals_stepwise_prediction(spark):
    rng = random.Random(4)
    data = [(s, 1700000000 // 3600 * 3600 + 3600 * i, 10 + 5 * math.sin(i / 4) + rng.random()) for s in ("a", "b") for i in range(200)] + [("short", 1700000000, 1.0)]
    rows = spark.createDataFrame(data, "series_id string, s long, load double").selectExpr("series_id", "timestamp_seconds(s) AS timestamp", "load")
    lagged = lag_features(rows, lags=(1, 5))
    model = ln.fit_gbt(lagged, ["load_lag_1h", "load_lag_5h"], **SMALL)
    out = ln.recursive_tree_forecast(model, rows, (1, 5))
    found = {(r.series_id, r.step): (r.timestamp.timestamp(), r.y_pred) for r in out.collect()}
    assert len(found) == 2 * 168
    for name in ("a", "b"):
        values = [v for s, _, v in data if s == name]
        for step in range(1, 169):
            values.append(float(model.scores(np.array([[values[-1]], [values[-5]]]))[0]))
            at, value = found[name, step]
            assert value == values[-1] and at == data[199][1] + 3600 * step
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    hours = lambda history, seconds: np.stack([history[:, -1], (seconds // 3600 % 24).astype(float)])
    assert ln.recursive_tree_forecast(model, rows, (1,), 10, inputs=hours, depth=3).count() == 20


def test_tree_quantiles_on_held_out_rows(rows):
    role = F.when(F.unix_seconds("timestamp") % 10800 == 0, 0).otherwise(1)
    out = ln.quantile_tree_forecast(rows, ["x", "z"], role=role, trees=80, step=0.1, leaves=8)
    share = out.groupBy((role == 1).alias("seen")).agg(*[F.avg((F.col("load") <= F.col(q)).cast("int")) for q in ("q10", "q50", "q90")]).orderBy("seen").collect()
    assert list(share[1])[1:] == pytest.approx([0.1, 0.5, 0.9], abs=0.03)
    assert list(share[0])[1:] == pytest.approx([0.1, 0.5, 0.9], abs=0.1)
    assert out.where("lower > upper").count() == 0


def test_enbpi_covers(rows):
    parts = f.holdout_split(rows, 200)
    out = cf.conformal_enbpi(parts.where("split <> 'test'"), parts.where("split = 'test'"), ["x", "z"], confidence=0.9)
    r = winkler_score(out, 0.1).first()
    assert out.count() == 200 and 0.82 <= r.coverage <= 0.97 and r.mean_width == pytest.approx(1.7, abs=0.4)


def test_leave_one_out_draws():
    draws = cf.block_draws(30, 10)
    assert len(draws) == 30 and all(len(d) == 10 for d in draws)
    assert all(any(b not in d for d in draws) for b in range(10))


def test_recursion_with_features_equals_a_loop(spark):
    rows = spark.createDataFrame([("a", 1700000000 // 3600 * 3600 + 3600 * i, float(i % 5)) for i in range(30)], "series_id string, s long, load double")
    rows = rows.selectExpr("series_id", "timestamp_seconds(s) AS timestamp", "load")

    def features(d):
        return d.withColumns({"lag": F.element_at("history", -2), "mean": F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / 4, "hour": F.hour("timestamp")})

    out = ln.recursive_feature_forecast(lambda d: d.selectExpr("*", "lag * 0.5D + mean * 0.25D + hour * 0.1D AS prediction"), rows, features, 4, 30)
    values, start = [float(i % 5) for i in range(30)], 1700000000 // 3600 * 3600
    for r in out.orderBy("step").collect():
        hour = (start + 3600 * len(values)) // 3600 % 24
        values.append(values[-2] * 0.5 + sum(values[-4:]) / 4 * 0.25 + hour * 0.1)
        assert r.y_pred == pytest.approx(values[-1]) and r.timestamp.timestamp() == start + 3600 * (len(values) - 1)
    assert len(values) == 60


def test_isotonic_recalibration_is_monotone(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(float(i % 50), float(i % 50) + rng.gauss(0, 5), 7.0) for i in range(2000)] + [(None, 1.0, 7.0)], "x double, load double, prediction double")
    out = ln.isotonic_recalibration(rows, "x", 1)
    means = [r.m for r in out.where("x IS NOT NULL").groupBy("x").agg(F.avg("recalibrated").alias("m")).orderBy("x").collect()]
    assert means == sorted(means) and means[-1] - means[0] > 40
    assert out.where("x IS NULL").first().recalibrated == 7.0 and out.count() == 2001
    with pytest.raises(ValueError):
        ln.isotonic_recalibration(rows, "x", 0)


def test_quantiles_do_not_depend_on_the_unit(rows):
    small = rows.withColumn("load", F.col("load") / 1000)
    for q in (0.1, 0.9):
        a, b = ln.quantile_regression(rows, ["x", "z"], q), ln.quantile_regression(small, ["x", "z"], q)
        assert [y * 1000 for y in b] == pytest.approx(a, rel=1e-4, abs=1e-4)
        column = ln.linear_column(a, ["x", "z"])
        share = rows.agg(F.avg((F.col("load") <= column).cast("int"))).first()[0]
        assert share == pytest.approx(q, abs=0.01)
