"""Drift, experiment, run-table and version-table queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import metrics as m
from tidegrid.operators.guards import flag, r6, rounded
from tidegrid.plans import experiments as ex
from tidegrid.plans import monitoring as mo
from tidegrid.plans import runs as rn
from tidegrid.registry.common import hash32_sql, q6, query
from tidegrid.session import scratch_path
from tidegrid.sources import views as v

FEATURES = ["load", "load_lag_1h", "load_lag_24h", "temperature", "humidity"]
BORDER = "2024-01-16"


def _halves(df):
    border = F.lit(BORDER).cast("timestamp")
    return df.where(F.col("timestamp") < border), df.where(F.col("timestamp") >= border)


P_SQL = """CASE WHEN d * sqrt(n * m / (n + m)) < 0.2 THEN 1.0 ELSE least(greatest(list_sum([
    (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * (d * d * n * m / (n + m))) for k in range(1, 101)]), 0), 1) END"""


def ks_sql(names: list[str], table: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, (timestamp < TIMESTAMP '{BORDER}') AS is_ref FROM {table} WHERE {c} IS NOT NULL"
        for c in names
    )
    return f""", long AS ({parts}),
    steps AS (SELECT feature, x, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b FROM long GROUP BY 1, 2),
    cum AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb
        FROM steps WINDOW w AS (PARTITION BY feature ORDER BY x)),
    dist AS (SELECT feature, max(abs(fa - fb)) AS d FROM cum GROUP BY 1),
    n AS (SELECT feature, count(*) FILTER (is_ref)::DOUBLE AS n, count(*) FILTER (NOT is_ref)::DOUBLE AS m,
        avg(x) FILTER (NOT is_ref) AS cm, avg(x) FILTER (is_ref) AS rm FROM long GROUP BY 1),
    ks AS (SELECT *, {P_SQL} AS p FROM dist JOIN n USING (feature))"""


KS_OUT = f"""SELECT feature, CASE WHEN p < 0.05 THEN 'drift' ELSE 'stable' END AS status, (p < 0.05)::INT AS drift,
    {q6('d')} AS ks_statistic, {q6('p')} AS p_value, {q6('cm')} AS current_mean, {q6('rm')} AS reference_mean, {q6('cm - rm')} AS mean_shift FROM ks"""
KS_COLS = ["ks_statistic", "p_value", "current_mean", "reference_mean", "mean_shift"]


@query(
    "ks_drift",
    "model_rows",
    ks_sql(FEATURES, "model_rows")
    + KS_OUT
    + " UNION ALL SELECT 'cloud_cover', 'missing', 1, NULL, NULL, NULL, NULL, NULL"
    + " UNION ALL SELECT 'wind_speed', 'insufficient_data', 0, NULL, NULL, NULL, NULL, NULL",
)
def _(spark, sf):
    before, after = _halves(v.model_rows(spark, sf))
    empty = F.lit(None).cast("double")
    before, after = before.withColumns({"cloud_cover": F.lit(0.0), "wind_speed": empty}), after.withColumn("wind_speed", empty)
    return rounded(mo.ks_drift(before, after, [*FEATURES, "cloud_cover", "wind_speed"]), KS_COLS)


@query("prediction_drift", "predictions", ks_sql(["y_pred"], "predictions") + KS_OUT)
def _(spark, sf):
    before, after = _halves(v.predictions(spark, sf))
    return rounded(mo.prediction_drift(before, after), KS_COLS)


def _sketched(spark, sf):
    before, after = _halves(v.model_rows(spark, sf))
    # the reference is kept as one sketch per series, as windows are, and merged
    kept = [mo.sketches(before.where(F.col("series_id") == s), FEATURES) for s in ("view", "click")]
    rest = mo.sketches(before.where(~F.col("series_id").isin("view", "click")), FEATURES)
    return before, after, mo.sketch_drift(mo.merged_sketches(reduce(DataFrame.unionByName, [*kept, rest])), mo.sketches(after, FEATURES))


@query("sketch_drift")
def _(spark, sf):
    return _sketched(spark, sf)[2]


# The exact distance lies within the bounds read from the sketches.
@query(
    "sketch_drift_check",
    "model_rows",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) FILTER (timestamp < TIMESTAMP '{BORDER}') AS n_reference,
        count(*) FILTER (timestamp >= TIMESTAMP '{BORDER}') AS n_current, 1 AS in_bounds FROM model_rows"""
        for c in FEATURES
    ),
)
def _(spark, sf):
    before, after, found = _sketched(spark, sf)
    exact = mo.ks_drift(before, after, FEATURES).select("feature", F.col("ks_statistic").alias("exact"))
    return found.join(exact, "feature").select("feature", "n_reference", "n_current", flag(F.col("exact").between(F.col("ks_low") - 1e-9, F.col("ks_high") + 1e-9)).alias("in_bounds"))


@query(
    "reference_snapshot",
    "model_rows",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {q6(f'avg({c})')} AS mean, {q6(f'stddev_samp({c})')} AS std, {q6(f'min({c})')} AS min,
        {q6(f'max({c})')} AS max, {q6(f'quantile_cont({c}, 0.25)')} AS q25, {q6(f'quantile_cont({c}, 0.5)')} AS q50,
        {q6(f'quantile_cont({c}, 0.75)')} AS q75 FROM model_rows WHERE timestamp < TIMESTAMP '{BORDER}'"""
        for c in FEATURES
    ),
)
def _(spark, sf):
    before, _after = _halves(v.model_rows(spark, sf))
    path = scratch_path(spark, "reference")
    mo.save_reference(before, FEATURES, path)
    return rounded(mo.load_reference(spark, path), ["mean", "std", "min", "max", "q25", "q50", "q75"])


@query(
    "ab_route",
    "",
    """SELECT event_id, user_id, value, CASE WHEN ((event_id + 42) * 48271 % 2147483647) % 10000 < 1000 THEN 'challenger'
    ELSE 'champion' END AS arm FROM events""",
)
def _(spark, sf):
    return ex.ab_route(v.table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id", method="modular")


@query(
    "ab_route_hash",
    "",
    f"""SELECT CASE WHEN {hash32_sql('event_id', '42')} % 10000 < 1000 THEN 'challenger' ELSE 'champion' END AS arm,
    count(*) AS n, {q6('avg(value)')} AS mean_value FROM events GROUP BY 1""",
)
def _(spark, sf):
    routed = ex.ab_route(v.table(spark, sf, "events").select("event_id", "value"), "event_id")
    return routed.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


AB = """, e AS (SELECT series_id, model, abs(y_true - y_pred) AS e FROM predictions)"""


@query(
    "ab_metrics",
    "predictions",
    AB
    + f""" SELECT series_id, model, count(*) AS n_samples, {q6('avg(e)')} AS mae, {q6('sqrt(avg(e * e))')} AS rmse,
    {q6('stddev_pop(e)')} AS std FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(ex.ab_metrics(v.predictions(spark, sf)), ["mae", "rmse", "std"])


@query(
    "ab_significance",
    "predictions",
    AB
    + f""", s AS (SELECT series_id, count(*) FILTER (model = 'champion') AS n1, count(*) FILTER (model = 'challenger') AS n2,
        avg(e) FILTER (model = 'champion') AS m1, avg(e) FILTER (model = 'challenger') AS m2,
        var_samp(e) FILTER (model = 'champion') AS v1, var_samp(e) FILTER (model = 'challenger') AS v2,
        var_pop(e) FILTER (model = 'champion') AS p1, var_pop(e) FILTER (model = 'challenger') AS p2 FROM e GROUP BY 1)
    SELECT series_id, (n1 >= 100 AND n2 >= 100)::INT AS sufficient_data, n1 AS champion_samples, n2 AS challenger_samples,
        {q6('m1')} AS champion_mae, {q6('m2')} AS challenger_mae, {q6('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} AS t_statistic,
        {q6('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))')} AS degrees_of_freedom,
        {q6('(m1 - m2) / sqrt((p1 + p2) / 2)')} AS cohens_d, {q6('(m1 - m2) / m1 * 100')} AS improvement_pct FROM s""",
)
def _(spark, sf):
    out = ex.ab_significance(v.predictions(spark, sf)).drop("p_value", "significant", "winner", "recommendation")
    return rounded(out, ["champion_mae", "challenger_mae", "t_statistic", "degrees_of_freedom", "cohens_d", "improvement_pct"])


# The p-value is an integral of Student's density, here by Simpson's rule over 4,000 steps.
@query(
    "ab_decision",
    "predictions",
    AB
    + f""" , s AS (SELECT series_id, count(*) FILTER (model = 'champion')::DOUBLE AS n1, count(*) FILTER (model = 'challenger')::DOUBLE AS n2,
        avg(e) FILTER (model = 'champion') AS m1, avg(e) FILTER (model = 'challenger') AS m2,
        var_samp(e) FILTER (model = 'champion') AS v1, var_samp(e) FILTER (model = 'challenger') AS v2 FROM e GROUP BY 1),
    t AS (SELECT series_id, n1 >= 100 AND n2 >= 100 AS enough, m1, m2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
        pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS f FROM s),
    p AS (SELECT series_id, any_value(m1) AS m1, any_value(m2) AS m2, any_value(enough) AS enough, any_value(t) AS t,
        1 - 2 * sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
          * exp(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(f * pi()) - (f + 1) / 2 * ln(1 + pow(abs(t) * k / 4000, 2) / f)) * abs(t) / 12000) AS p
        FROM t, range(0, 4001) r(k) GROUP BY 1)
    SELECT series_id, CASE WHEN enough THEN {q6('t')} END AS t_statistic, CASE WHEN enough THEN {q6('greatest(p, 0)')} END AS p_value,
      (enough AND p < 0.05)::INT AS significant,
      CASE WHEN enough AND p < 0.05 THEN CASE WHEN m2 < m1 THEN 'challenger' ELSE 'champion' END END AS winner,
      CASE WHEN NOT enough THEN 'COLLECT more data' WHEN p < 0.05 AND m2 < m1 THEN 'PROMOTE challenger to production'
        WHEN p < 0.05 THEN 'KEEP champion in production' ELSE 'CONTINUE testing (no significant difference)' END AS recommendation
    FROM p""",
)
def _(spark, sf):
    return rounded(ex.ab_significance(v.predictions(spark, sf)), ["p_value", "t_statistic"]).select(
        "series_id", "t_statistic", "p_value", "significant", "winner", "recommendation"
    )


@query(
    "bandit_posterior",
    "predictions",
    AB
    + """ SELECT series_id, model, count(*) FILTER (e < 20) AS successes, count(*) FILTER (e >= 20) AS failures,
    count(*) FILTER (e < 20) + 1 AS alpha, count(*) FILTER (e >= 20) + 1 AS beta FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    return ex.bandit_posterior(v.predictions(spark, sf), 20.0)


@query("bandit_probabilities")
def _(spark, sf):
    return ex.bandit_probabilities(ex.bandit_posterior(v.predictions(spark, sf), 20.0))


# Every draw has one winner: the shares of the arms of a series add up to one.
@query("bandit_probabilities_check", "predictions", "SELECT series_id, count(DISTINCT model) AS n_arms, 1.0::DOUBLE AS total, 1 AS is_valid FROM predictions GROUP BY 1")
def _(spark, sf):
    shares = ex.bandit_probabilities(ex.bandit_posterior(v.predictions(spark, sf), 20.0))
    valid = F.min(flag(F.col("probability").between(0, 1))).alias("is_valid")
    return rounded(shares.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_arms"), F.sum("probability").alias("total"), valid), ["total"])


# --- runs: one run per series, model and day ------------------------------------------------------------------------

RUN_METRICS = ["rmse", "mae", "n_samples"]
RUNS = """, runs AS (SELECT series_id || '-' || model || '-' || strftime(timestamp, '%Y-%m-%d') AS run_id, series_id, model,
        timestamp::DATE AS date, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
        count(*)::DOUBLE AS n_samples FROM predictions GROUP BY 1, 2, 3, 4)"""


def run_table(spark, sf):
    daily = v.predictions(spark, sf).withColumn("date", F.to_date("timestamp"))
    scores = m.forecast_metrics(daily, ["series_id", "model", "date"]).withColumnRenamed("n", "n_samples")
    nested = scores.withColumn("config", F.struct(F.struct("series_id", "date").alias("data"), F.struct("model").alias("estimator")))
    run_id = F.concat_ws("-", "series_id", "model", F.col("date").cast("string"))
    return rn.run_rows(nested, run_id, "config", RUN_METRICS, ["series_id"])


@query(
    "log_runs",
    "predictions",
    RUNS
    + f""" SELECT run_id, series_id AS data_series, date::VARCHAR AS data_date, model AS estimator_model, {q6('rmse')} AS rmse,
    {q6('mae')} AS mae, {q6('n_samples')} AS n_samples FROM runs""",
)
def _(spark, sf):
    path = scratch_path(spark, "runs")
    rn.log_runs(run_table(spark, sf), path)
    runs = spark.read.parquet(path)
    return runs.select(
        "run_id",
        F.col("params")["data.series_id"].alias("data_series"),
        F.col("params")["data.date"].alias("data_date"),
        F.col("params")["estimator.model"].alias("estimator_model"),
        *[r6(F.col("metrics")[c]).alias(c) for c in RUN_METRICS],
    )


@query(
    "best_run",
    "predictions",
    RUNS
    + f""", k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, run_id) AS k FROM runs)
    SELECT series_id, run_id, {q6('rmse')} AS rmse FROM k WHERE k = 1""",
)
def _(spark, sf):
    best = rn.best_run(run_table(spark, sf), "rmse", keys=["series_id"])
    return best.select("series_id", "run_id", r6(F.col("metrics")["rmse"]).alias("rmse"))


@query(
    "compare_runs",
    "predictions",
    RUNS + f" SELECT run_id, {q6('rmse')} AS rmse, {q6('mae')} AS mae, NULL::DOUBLE AS r2 FROM runs",
)
def _(spark, sf):
    return rounded(rn.compare_runs(run_table(spark, sf), ["rmse", "mae", "r2"]), ["rmse", "mae", "r2"])


# --- versions: the event table read as a log of registrations and stage moves -----------------------------------------

STAGE_SQL = """SELECT 'model_' || (user_id % 10) AS name, (user_id // 10 + 1)::INT AS version,
    CASE event_type WHEN 'signup' THEN 'None' WHEN 'click' THEN 'Staging' WHEN 'purchase' THEN 'Production' ELSE 'Archived' END AS stage,
    event_id AS seq, value FROM events"""
STATE_SQL = f"""WITH e AS ({STAGE_SQL}), last AS (SELECT name, version, arg_max(stage, seq) AS stage, max(seq) AS seq FROM e GROUP BY 1, 2),
    top AS (SELECT name, stage, max(seq) AS top FROM e WHERE stage IN ('Staging', 'Production') GROUP BY 1, 2),
    state AS (SELECT name, version, CASE WHEN top IS NOT NULL AND seq < top THEN 'Archived' ELSE stage END AS stage
        FROM last LEFT JOIN top USING (name, stage))"""


def stage_events(spark, sf):
    events = v.table(spark, sf, "events")
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "None").when(kind == "click", "Staging").when(kind == "purchase", "Production")
    return events.select(
        F.concat(F.lit("model_"), F.col("user_id") % 10).alias("name"),
        (F.floor(F.col("user_id") / 10) + 1).cast("int").alias("version"),
        stage.otherwise("Archived").alias("stage"),
        F.col("event_id").alias("seq"),
        "value",
    )


@query("list_versions", "", STATE_SQL + " SELECT * FROM state")
def _(spark, sf):
    return rn.list_versions(stage_events(spark, sf))


@query("latest_by_stage", "", STATE_SQL + " SELECT name, stage, max(version) AS version FROM state GROUP BY 1, 2")
def _(spark, sf):
    return rn.latest_by_stage(stage_events(spark, sf))


@query(
    "promote",
    "",
    STATE_SQL
    + """, pick AS (SELECT name, max(version) AS version FROM state GROUP BY 1)
    SELECT s.name, s.version, CASE WHEN s.version = p.version THEN 'Production' WHEN s.stage = 'Production' THEN 'Archived'
        ELSE s.stage END AS stage FROM state s JOIN pick p USING (name)""",
)
def _(spark, sf):
    events = stage_events(spark, sf).drop("value")
    newest = rn.current_stages(events).groupBy("name").agg(F.max("version").alias("version"))
    return rn.current_stages(events.unionByName(rn.promote(events, newest, "Production")))


@query(
    "rollback",
    "",
    STATE_SQL
    + """, pick AS (SELECT name, max(version) AS version FROM state WHERE stage = 'Archived' GROUP BY 1)
    SELECT s.name, s.version, CASE WHEN s.version = p.version THEN 'Production' WHEN s.stage = 'Production' AND p.version IS NOT NULL
        THEN 'Archived' ELSE s.stage END AS stage FROM state s LEFT JOIN pick p USING (name)""",
)
def _(spark, sf):
    events = stage_events(spark, sf).drop("value")
    return rn.current_stages(events.unionByName(rn.rollback(events)))


@query(
    "compare_versions",
    "",
    f"""WITH e AS ({STAGE_SQL}), x AS (SELECT name, version, avg(value) AS mean_value, max(value) AS max_value FROM e GROUP BY 1, 2)
    """
    + " UNION ALL ".join(
        f"""SELECT name, '{c}' AS metric, {q6(f'max({c}) FILTER (version = 1)')} AS first,
        {q6(f'max({c}) FILTER (version = 2)')} AS second, {q6(f'max({c}) FILTER (version = 2) - max({c}) FILTER (version = 1)')} AS difference
        FROM x WHERE version IN (1, 2) GROUP BY 1"""
        for c in ("mean_value", "max_value")
    ),
)
def _(spark, sf):
    scores = stage_events(spark, sf).groupBy("name", "version").agg(
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value")
    )
    return rounded(rn.compare_versions(scores, 1, 2, ["mean_value", "max_value"]), ["first", "second", "difference"])
