import pytest
from pyspark.sql import functions as F

from tidegrid.plans import experiments as ex
from tidegrid.plans import monitoring as mo
from tidegrid.plans import runs as rn


def test_student_p_values():
    # table values of the two-sided t distribution
    for t, df, p in ((2.228, 10, 0.05), (1.960, 1e6, 0.05), (12.706, 1, 0.05), (2.845, 20, 0.01), (0.0, 5, 1.0)):
        assert ex.student_p(t, df) == pytest.approx(p, abs=2e-4)


def test_ks(spark):
    a = spark.range(100).selectExpr("cast(id AS double) AS x", "cast(id AS double) AS y")
    b = spark.range(100).selectExpr("cast(id AS double) AS x", "cast(id + 50 AS double) AS y")
    out = {r.feature: r for r in mo.ks_drift(a.withColumn("gone", F.lit(1.0)), b, ["x", "y", "gone"]).collect()}
    assert out["x"].ks_statistic == 0 and out["x"].p_value == 1.0 and out["x"].status == "stable"
    assert out["y"].ks_statistic == pytest.approx(0.5) and out["y"].drift == 1 and out["y"].mean_shift == pytest.approx(50)
    assert out["gone"].status == "missing" and out["gone"].drift == 1
    both = [x.withColumn("none", F.lit(None).cast("double")) for x in (a, b)]
    assert [(r.feature, r.status, r.drift) for r in mo.ks_drift(*both, ["none"]).collect()] == [("none", "insufficient_data", 0)]
    few = mo.ks_drift(a, b.limit(5), ["x"]).first()
    assert few.status == "insufficient_data" and few.drift == 0 and few.p_value is None


def errors(spark, pairs):
    return spark.createDataFrame([("s", m, y, p) for m, y, p in pairs], "series_id string, model string, y_true double, y_pred double")


def test_ab_small_sample(spark):
    df = errors(spark, [("champion", 5.5, 5.0), ("challenger", 5.5, 5.2)])
    got = {r.model: r.mae for r in ex.ab_metrics(df).collect()}
    assert got == {"champion": pytest.approx(0.5), "challenger": pytest.approx(0.3)}
    row = ex.ab_significance(df).first()
    assert row.sufficient_data == 0 and row.p_value is None and row.winner is None


def test_ab_winner(spark):
    pairs = [("champion", 0.0, 5.0 + i % 3) for i in range(150)] + [("challenger", 0.0, 1.0 + i % 3) for i in range(150)]
    row = ex.ab_significance(errors(spark, pairs)).first()
    assert row.winner == "challenger" and row.p_value < 1e-6 and row.improvement_pct == pytest.approx(400 / 6)


def test_routing_share_and_stability(spark):
    ids = spark.range(20000).withColumnRenamed("id", "k")
    for method in ("hash", "modular"):
        arms = {r.arm: r["count"] for r in ex.ab_route(ids, "k", 0.1, method=method).groupBy("arm").count().collect()}
        assert arms["challenger"] / 20000 == pytest.approx(0.1, abs=0.01)
    a = ex.ab_route(ids, "k").where("arm = 'challenger'")
    b = ex.ab_route(ids.repartition(9), "k").where("arm = 'challenger'")
    assert a.exceptAll(b).count() == 0


def test_bandit(spark):
    df = errors(spark, [("m", 0.5, 0.0), ("m", 1.5, 0.0), ("n", 9.0, 0.0)])
    got = {r.model: (r.successes, r.failures) for r in ex.bandit_posterior(df).collect()}
    assert got == {"m": (1, 1), "n": (0, 1)}
    share = ex.bandit_probabilities(ex.bandit_posterior(df)).collect()
    assert sum(r.probability for r in share) == pytest.approx(1.0)
    assert {r.model: r.probability for r in share}["m"] > 0.5


def test_run_rows(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', named_struct('b', 7), 'long', repeat('x', 600)) AS cfg, double('NaN') AS bad, 1.5D AS good")
    row = rn.run_rows(df, F.col("id"), "cfg", ["bad", "good"]).first()
    assert row.params["a.b"] == "7" and len(row.params["long"]) == 500 and row.params["long"].endswith("...")
    assert row.metrics == {"good": 1.5}


def test_top_importance_of_a_run(spark):
    table = spark.createDataFrame([(f"f{i}", float(i)) for i in range(15)], "feature string, importance double")
    got = spark.range(1).select(rn.top_importance_params(table).alias("m")).first().m
    assert len(got) == 10 and got["f14"] == 14.0


def test_promotion_and_rollback(spark):
    rows = [("m", 1, "None", 1), ("m", 1, "Production", 2), ("m", 2, "None", 3), ("m", 2, "Production", 4), ("m", 3, "Staging", 5)]
    events = spark.createDataFrame(rows, "name string, version int, stage string, seq long")
    state = lambda e: {r.version: r.stage for r in rn.current_stages(e).collect()}
    assert state(events) == {1: "Archived", 2: "Production", 3: "Staging"}
    up = events.unionByName(rn.promote(events, events.where("version = 3").select("name", "version").distinct(), "Production"))
    assert state(up) == {1: "Archived", 2: "Archived", 3: "Production"}
    assert state(up.unionByName(rn.rollback(up))) == {1: "Archived", 2: "Production", 3: "Archived"}


def test_close_values_fill_many_parts(spark):
    """200,000 values between 1 and 1.0001 are one cell; no part of it has more than a few of them."""
    from tidegrid.operators import ranks

    rows = spark.range(200_000).selectExpr("'k' AS k", "1 + id / 2e9 AS v", "id % 3 AS side")
    cells = rows.groupBy(F.expr(ranks.value_bucket("v"))).count().collect()
    assert len(cells) == 1
    out = ranks.cumulative_counts(rows, ["k"], "v", {"a": F.count_if(F.col("side") == 0), "b": F.count_if(F.col("side") != 0)})
    r = out.agg(F.count("*"), F.max("a_upto"), F.max("b_upto"), F.count_if(F.col("a_upto") + F.col("b_upto") != F.round((F.col("v") - 1) * 2e9) + 1)).first()
    assert tuple(r) == (200_000, 66_667, 133_333, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_sketches_merge_and_bound_the_distance(spark):
    reference = spark.range(60_000).selectExpr("id", "randn(1) AS x", "rand(2) AS y", "cast(id % 7 AS double) AS z")
    current = spark.range(20_000).selectExpr("randn(3) + 0.3 AS x", "rand(4) AS y", "cast(id % 7 AS double) AS z")
    names = ["x", "y", "z"]
    windows = [mo.sketches(reference.where(f"id % 3 = {i}"), names) for i in range(3)]
    merged = mo.merged_sketches(windows[0].unionByName(windows[1]).unionByName(windows[2]))
    found = {r.feature: r for r in mo.sketch_drift(merged, mo.sketches(current, names)).collect()}
    exact = {r.feature: r.ks_statistic for r in mo.ks_drift(reference, current, names).collect()}
    for name in names:
        r = found[name]
        assert (r.n_reference, r.n_current) == (60_000, 20_000) and r.ks_low <= exact[name] <= r.ks_high
    assert found["x"].drift == 1 and found["y"].drift == 0 and found["z"].drift == 0
    assert mo.sketches(reference.where("id < 0"), names).count() == 0
