import datetime as dt

import pytest
from rowsets import as_set
from pyspark.sql import functions as F

from tidegrid.plans import importance as im
from tidegrid.plans import narrative as nl
from tidegrid.plans import shapley as sh
from tidegrid.plans import whatif as wi
from tidegrid.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    data = [("s", 3600 * i, float(i % 7), float((i * 5) % 11), float((i * 3) % 4)) for i in range(60)]
    return spark.createDataFrame(data, "series_id string, t long, a double, b double, c double").selectExpr(
        "series_id", "timestamp_seconds(t) AS timestamp", "a", "b", "c"
    ).cache()


def table(spark, pairs):
    return spark.createDataFrame(list(pairs.items()), "feature string, importance double")


def test_linear_attributions_add_up(rows):
    phi = im.linear_shap(rows, {"a": 2.0, "b": -1.0, "c": 0.5}, 3.0)
    gap = phi.groupBy("series_id", "timestamp").agg(F.abs(F.sum("phi") - F.max("prediction") + F.max("base_value")).alias("g"))
    assert phi.count() == 180 and gap.agg(F.max("g")).first()[0] < 1e-9


def test_sampling_shapley_adds_up_and_finds_linear_weights(rows):
    score = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + 2 * F.col("c"))
    phi = sh.sampling_shapley(rows.limit(10), ["a", "b", "c"], score, rows, 12)
    gap = phi.groupBy("series_id", "timestamp").agg(F.abs(F.sum("phi") - F.max("prediction") + F.max("base_value")).alias("g"))
    assert phi.count() == 30 and gap.agg(F.max("g")).first()[0] < 1e-9
    # the additive feature gets exactly its weight times the distance from the background mean
    bg = sh.sample_rows(rows, 12).agg(F.avg("c")).first()[0]
    off = phi.where("feature = 'c'").agg(F.max(F.abs(F.col("phi") - 2 * (F.col("value") - bg)))).first()[0]
    assert off < 1e-9


def test_interactions(rows):
    both = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + F.col("c"))
    bg_rows = sh.sample_rows(rows, 8).collect()
    got = sh.interaction_values(rows.limit(5), ["a", "b", "c"], ("a", "b"), both, rows, 8).join(rows, ["series_id", "timestamp"]).collect()
    for r in got:
        want = sum((r.a - x.a) * (r.b - x.b) for x in bg_rows) / len(bg_rows)
        assert r.interaction == pytest.approx(want)
    none = sh.interaction_values(rows.limit(5), ["a", "b", "c"], ("a", "c"), both, rows, 8)
    assert none.agg(F.max(F.abs("interaction"))).first()[0] < 1e-9


def test_drift_severity(spark):
    base = table(spark, {"a": 0.5, "b": 0.3, "c": 0.2})
    calm = im.drift_summary(im.importance_drift(base, table(spark, {"a": 0.48, "b": 0.32, "c": 0.2}))).first()
    assert calm.severity == "none" and calm.drift_score == pytest.approx(0.02)
    moved = im.importance_drift(base, table(spark, {"a": 0.2, "b": 0.6, "c": 0.2}))
    summary = im.drift_summary(moved).first()
    assert summary.severity == "medium" and summary.drift_score == pytest.approx(0.3) and summary.num_significant_changes == 2
    text = nl.drift_text(moved).first().text
    assert "severity: medium, score: 0.300" in text and "`b`: +100.0% (now 0.600)" in text and "Monitor closely" in text
    assert nl.drift_text(im.importance_drift(base, base)).first().text == nl.DRIFT_NONE


def test_new_feature_is_flagged(spark):
    out = {r.feature: r for r in im.importance_drift(table(spark, {"a": 1.0}), table(spark, {"a": 0.5, "n": 0.5})).collect()}
    assert out["n"].relative_change is None and out["n"].is_new == 1 and out["n"].significant == 1


@pytest.fixture(scope="module")
def told(spark):
    data = [("temperature", 25.0, 0.3), ("load_lag_1h", 5.2, 0.8), ("hour", 14.0, -0.2)]
    at = dt.datetime(2024, 1, 5, 14, 0)
    return spark.createDataFrame(
        [("s", at, 5.5, 5.0, f, v, p) for f, v, p in data], "series_id string, timestamp timestamp, prediction double, base_value double, feature string, value double, phi double"
    )


def test_explanation_text(told):
    text = nl.explain_rows(told).first().explanation
    assert text.startswith("**Forecast for Friday, January 05 at 14:00**\nPredicted load: **5.50 kW**\n\n")
    assert "  • load from 1 hour ago (5.20 kW) is increasing load by 0.80 kW\n  • current temperature (25.0°C)" in text
    assert "  • time of day (14:00) is decreasing load by 0.20 kW" in text
    assert "*Load is 0.50 kW higher than average, primarily due to load from 1 hour ago.*" in text
    assert text.endswith("| hour | 14.00 | -0.200 |")


def test_alert_text(told):
    loud = told.withColumns({"prediction": F.lit(10.0)})
    row = nl.alert_rows(loud, 8.0).first()
    assert row.alert_type == "HIGH LOAD" and "ALERT" in row.message and "10.00" in row.message and "14:00 on Jan 05" in row.message
    assert nl.alert_rows(loud, 12.0).first().alert_type == "LOW LOAD"


def test_day_names(spark):
    df = spark.createDataFrame([("day_of_week", 0.0), ("day_of_week", 6.0), ("day_of_year", 40.0)], "f string, v double")
    assert [r[0] for r in df.select(nl.value_text(F.col("f"), F.col("v"), "kW")).collect()] == ["Mon", "Sun", "40.0"]


def test_counterfactuals(rows):
    score = lambda d: d.withColumn("prediction", 2 * F.col("a") + F.col("b"))
    out = wi.counterfactual_search(rows.limit(20), F.lit(10.0), score, ["a", "b"], 3, 200)
    good = out.where("success = 1")
    assert good.count() > 20 and good.where("prediction NOT BETWEEN 9.5 AND 10.5").count() == 0
    assert good.where("n_changes NOT BETWEEN 0 AND 2").count() == 0
    never = wi.counterfactual_search(rows.limit(5), F.lit(-1000.0), score, ["a", "b"])
    assert never.count() == 5 and never.where("success = 0").count() == 5
    again = wi.counterfactual_search(rows.limit(20).repartition(7), F.lit(10.0), score, ["a", "b"], 3, 200)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_whatif_zero_base(rows):
    score = lambda d: d.withColumn("prediction", F.col("a") * 0 + F.col("b") - F.col("b"))
    r = wi.whatif(rows.limit(1), {"s": {"a": 5.0}}, score).first()
    assert r.base_prediction == 0 and r.pct_change == 0.0


def test_monotone_audit(rows):
    score = lambda d: d.withColumn("prediction", F.col("a") - F.col("b"))
    out = {r.feature: r.violation_share for r in sh.monotone_audit(rows, {"a": 1, "b": 1}, {"a": [1, 2, 3], "b": [1, 2, 3]}, score).collect()}
    assert out == {"a": 0.0, "b": 1.0}


def test_constraints(spark):
    names = spark.createDataFrame([("temperature",), ("temperature_lag_1h",), ("hour",)], "feature string")
    got = {r.feature: r.monotone_constraint for r in im.constraint_vector(names, {"temp": -1, "temperature": 1}).collect()}
    assert got == {"temperature": 1, "temperature_lag_1h": -1, "hour": 0}


def test_texts_need_no_shuffle_behind_the_scores(rows):
    wide = im.linear_shap(rows, {"a": 2.0, "b": -1.0, "c": 0.5}, 1.0, background=rows.limit(5), long=False)
    long = im.linear_shap(rows, {"a": 2.0, "b": -1.0, "c": 0.5}, 1.0, background=rows.limit(5))
    names = ["series_id", "timestamp", "rank", "feature", "value", "phi"]
    assert as_set(im.top_contributions(wide, 2).select(names)) == as_set(im.top_contributions(long, 2).select(names))
    assert as_set(nl.explain_rows(wide)) == as_set(nl.explain_rows(long))
    plan = nl.explain_rows(wide)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0


def test_drift_history_is_a_table_with_baselines(spark):
    path = scratch_path(spark, "drift")
    day = lambda d, a, b: [(d, "a", a), (d, "b", b)]
    make = lambda rows: spark.createDataFrame(rows, "date string, feature string, importance double").withColumn("date", F.to_date("date"))
    im.save_baseline(make(day("2024-01-01", 0.5, 0.5)), path, "2024-01-01")
    im.record_drift(make(day("2024-01-02", 0.5, 0.5) + day("2024-01-03", 0.1, 0.9)), path)
    im.record_drift(make(day("2024-01-03", 0.1, 0.9)), path, renew_on=("high",))
    im.record_drift(make(day("2024-01-04", 0.1, 0.9)), path)
    got = {str(r.date): (round(r.drift_score, 6), r.severity) for r in im.read_drift_history(spark, path).collect()}
    assert got["2024-01-02"][0] == 0 and got["2024-01-03"] == (0.4, "high") and got["2024-01-04"][0] == 0
    assert {r.feature: r.importance for r in im.read_baseline(spark, path, "2024-01-02").collect()} == {"a": 0.5, "b": 0.5}
