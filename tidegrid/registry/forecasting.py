"""Splits, naive forecasts, metrics and performance queries."""

from __future__ import annotations

import statistics

from pyspark.sql import functions as F

from tidegrid.operators import metrics as m
from tidegrid.operators.chunks import Grid, over_chunks
from tidegrid.operators.guards import rounded
from tidegrid.operators.series import rolling_time_rmse
from tidegrid.plans import forecast as f
from tidegrid.plans.profile import corrected_kurtosis, corrected_skew
from tidegrid.registry.common import q6, query
from tidegrid.sources import views as v

TEST_ROWS = 72


def ordered(table: str = "load_hourly") -> str:
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS i,
        count(*) OVER (PARTITION BY series_id) AS n, max(timestamp) OVER (PARTITION BY series_id) AS last_ts FROM {table})"""


def next_hour(step: str) -> str:
    return f"last_ts + to_hours(({step})::INT)"


PERSIST = f"SELECT series_id, {next_hour('step')} AS timestamp, step::INT AS step, load AS y_pred FROM o, range(1, 49) t(step) WHERE i = n - 1"
SEASONAL = f"""SELECT l.series_id, l.last_ts + to_hours(step::INT) AS timestamp, step::INT AS step, b.load AS y_pred
    FROM o l JOIN range(1, 49) t(step) ON true JOIN o b ON b.series_id = l.series_id AND b.i = l.n - 24 + (step - 1) % 24
    WHERE l.i = l.n - 1"""
MOVING = f"""SELECT series_id, {next_hour('step')} AS timestamp, step::INT AS step, y_pred FROM
    (SELECT series_id, avg(load) AS y_pred, max(last_ts) AS last_ts FROM o WHERE i >= n - 168 GROUP BY 1), range(1, 49) t(step)"""


def out6(sql: str) -> str:
    return f"SELECT series_id, timestamp, step, {q6('y_pred')} AS y_pred FROM ({sql})"


@query("persistence_forecast", "load_hourly", ordered() + out6(PERSIST))
def _(spark, sf):
    return rounded(f.persistence_forecast(v.load_hourly(spark, sf), 48), ["y_pred"])


@query("seasonal_naive", "load_hourly", ordered() + out6(SEASONAL))
def _(spark, sf):
    return rounded(f.seasonal_naive_forecast(v.load_hourly(spark, sf), 48), ["y_pred"])


@query("moving_average_forecast", "load_hourly", ordered() + out6(MOVING))
def _(spark, sf):
    return rounded(f.moving_average_forecast(v.load_hourly(spark, sf), 48), ["y_pred"])


METRIC = {
    "rmse": "sqrt(avg(pow(y_true - y_pred, 2)))",
    "mae": "avg(abs(y_true - y_pred))",
    "mape": "avg(abs(y_true - y_pred) / (abs(y_true) + 2.220446049250313e-16)) * 100",
    "mape_raw": "avg(abs((y_true - y_pred) / nullif(y_true, 0))) * 100",
    "r2": "1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*))",
    "max_error": "max(abs(y_true - y_pred))",
}


def metric_sql(digits: int = 6) -> str:
    return ", ".join(f"{q6(e, digits)} AS {n}" for n, e in METRIC.items()) + ", count(*) AS n"


def _holdout(spark, sf):
    split = f.holdout_split(v.load_hourly(spark, sf), TEST_ROWS)
    return split.where("split <> 'test'").select("series_id", "timestamp", "load"), split.where("split = 'test'")


@query(
    "compare_baselines",
    "load_hourly",
    f""", a AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS k,
        count(*) OVER (PARTITION BY series_id) AS m FROM load_hourly),
    tr AS (SELECT series_id, timestamp, load FROM a WHERE k < m - {TEST_ROWS}), te AS (SELECT * FROM a WHERE k >= m - {TEST_ROWS})"""
    + ordered("tr")
    + f""", p AS (SELECT *, 'persistence' AS method FROM ({PERSIST}) UNION ALL SELECT *, 'seasonal_naive' FROM ({SEASONAL})
        UNION ALL SELECT *, 'moving_average' FROM ({MOVING})),
    j AS (SELECT p.*, te.load AS y_true FROM p JOIN te USING (series_id, timestamp))
    SELECT series_id, method, {metric_sql(5)} FROM j GROUP BY 1, 2""",
)
def _(spark, sf):
    train, test = _holdout(spark, sf)
    return rounded(f.compare_baselines(train, test, 48), METRIC, 5)


@query(
    "holdout_split",
    "load_hourly",
    ordered()
    + f"""SELECT series_id, timestamp, load, i AS ordinal, n AS ordinal_n, CASE WHEN i >= n - {TEST_ROWS} THEN 'test'
        WHEN i >= n - {TEST_ROWS} - floor((n - {TEST_ROWS}) * 0.2) THEN 'validation' ELSE 'train' END AS split FROM o""",
)
def _(spark, sf):
    return f.holdout_split(v.load_hourly(spark, sf), TEST_ROWS)


def splits_sql(gap: int) -> str:
    needed = 365 + gap + 30
    return f""", span AS (SELECT series_id, min(timestamp) AS a, max(timestamp) AS b,
        date_diff('day', min(timestamp), max(timestamp)) AS total FROM load_daily GROUP BY 1),
    splits AS (SELECT series_id, k::INT AS split, a AS train_start,
        a + to_days((365 + floor(k * ((total - {needed}) / 4))::INT)) AS train_end,
        a + to_days((365 + floor(k * ((total - {needed}) / 4))::INT + {gap})) AS test_start,
        least(a + to_days((365 + floor(k * ((total - {needed}) / 4))::INT + {gap} + 30)), b) AS test_end
        FROM span, range(0, 5) t(k))"""


@query("rolling_origin_splits", "load_daily", splits_sql(7) + " SELECT * FROM splits")
def _(spark, sf):
    return f.rolling_origin_splits(v.load_daily(spark, sf), gap_days=7)


@query("expanding_splits", "load_daily", splits_sql(0) + " SELECT * FROM splits")
def _(spark, sf):
    return f.expanding_splits(v.load_daily(spark, sf))


TAGGED = """, tagged AS (SELECT d.*, split, 'train' AS part FROM load_daily d JOIN splits s USING (series_id)
        WHERE timestamp BETWEEN train_start AND train_end
    UNION ALL SELECT d.*, split, 'test' FROM load_daily d JOIN splits s USING (series_id)
        WHERE timestamp BETWEEN test_start AND test_end)"""


@query("tag_splits", "load_daily", splits_sql(7) + TAGGED + " SELECT * FROM tagged")
def _(spark, sf):
    daily = v.load_daily(spark, sf)
    return f.tag_splits(daily, f.rolling_origin_splits(daily, gap_days=7))


@query(
    "cv_summary",
    "load_daily",
    splits_sql(7)
    + TAGGED
    + f""", mean_model AS (SELECT series_id, split, avg(load) AS y_pred FROM tagged WHERE part = 'train' GROUP BY 1, 2),
    scores AS (SELECT series_id, split, sqrt(avg(pow(load - y_pred, 2))) AS rmse, avg(abs(load - y_pred)) AS mae
        FROM tagged JOIN mean_model USING (series_id, split) WHERE part = 'test' GROUP BY 1, 2)
    SELECT series_id, 'rmse' AS metric, {q6('avg(rmse)', 3)} AS mean, {q6('stddev_samp(rmse)', 3)} AS std, count(*) AS n_splits
        FROM scores GROUP BY 1 UNION ALL
    SELECT series_id, 'mae', {q6('avg(mae)', 3)}, {q6('stddev_samp(mae)', 3)}, count(*) FROM scores GROUP BY 1""",
)
def _(spark, sf):
    daily = v.load_daily(spark, sf)
    tagged = f.tag_splits(daily, f.rolling_origin_splits(daily, gap_days=7))
    model = tagged.where("part = 'train'").groupBy("series_id", "split").agg(F.avg("load").alias("y_pred"))
    test = tagged.where("part = 'test'").withColumnRenamed("load", "y_true").join(model, ["series_id", "split"])
    scores = m.forecast_metrics(test, ["series_id", "split"])
    return rounded(m.cv_summary(scores, ["rmse", "mae"], ["series_id"]), ["mean", "std"], 3)


@query(
    "leakage_check",
    "load_hourly",
    """SELECT series_id, count(*) FILTER (timestamp > TIMESTAMP '2024-01-25') AS n_future_rows,
        min(timestamp) FILTER (timestamp > TIMESTAMP '2024-01-25') AS first_future,
        (count(*) FILTER (timestamp > TIMESTAMP '2024-01-25') = 0)::INT AS passed FROM load_hourly GROUP BY 1""",
)
def _(spark, sf):
    return f.leakage_check(v.load_hourly(spark, sf), "2024-01-25 00:00:00")


@query(
    "split_check",
    "load_hourly",
    ordered()
    + f""", e AS (SELECT series_id, max(timestamp) FILTER (i < n - {TEST_ROWS}) AS train_end,
        min(timestamp) FILTER (i >= n - {TEST_ROWS}) AS test_start FROM o GROUP BY 1)
    SELECT *, {q6('(epoch(test_start) - epoch(train_end)) / 86400')} AS gap_days, (train_end >= test_start)::INT AS overlaps,
        ((epoch(test_start) - epoch(train_end)) / 86400 < 1)::INT AS gap_too_small FROM e""",
)
def _(spark, sf):
    train, test = _holdout(spark, sf)
    return rounded(f.split_check(train, test, gap_days=1), ["gap_days"])


@query("forecast_metrics", "predictions", f"SELECT series_id, model, {metric_sql()} FROM predictions GROUP BY 1, 2")
def _(spark, sf):
    return rounded(m.forecast_metrics(v.predictions(spark, sf)), METRIC)


def segment_sql(name: str, expr: str) -> str:
    return f"""SELECT series_id, model, '{name}' AS segment, ({expr})::INT AS bucket,
        {q6('sqrt(avg(pow(y_true - y_pred, 2)))')} AS rmse, count(*) AS n FROM predictions GROUP BY 1, 2, 4"""


@query(
    "segmented_metrics",
    "predictions",
    " UNION ALL ".join(
        segment_sql(n, e)
        for n, e in (
            ("hour", "hour(timestamp)"),
            ("day_of_week", "isodow(timestamp) - 1"),
            ("season", "(month(timestamp) % 12) // 3"),
            ("all", "-1"),
        )
    ),
)
def _(spark, sf):
    return rounded(m.segmented_metrics(v.predictions(spark, sf)), ["rmse"])


RESIDUAL = ", r AS (SELECT *, y_true - y_pred AS residual FROM predictions)"


def _residuals(spark, sf):
    return v.predictions(spark, sf).withColumn("residual", F.col("y_true") - F.col("y_pred"))


@query(
    "residual_stats",
    "predictions",
    RESIDUAL
    + f""" SELECT series_id, model, {q6('avg(residual)')} AS mean, {q6('stddev_samp(residual)')} AS std,
        {q6('skewness(residual)')} AS skewness, {q6('kurtosis(residual)')} AS kurtosis FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    stats = _residuals(spark, sf).groupBy("series_id", "model").agg(
        F.avg("residual").alias("mean"),
        F.stddev_samp("residual").alias("std"),
        corrected_skew("residual").alias("skewness"),
        corrected_kurtosis("residual").alias("kurtosis"),
    )
    return rounded(stats, ["mean", "std", "skewness", "kurtosis"])


@query(
    "residual_histogram",
    "predictions",
    RESIDUAL
    + """, b AS (SELECT series_id, model, min(residual) AS lo, max(residual) AS hi FROM r GROUP BY 1, 2)
    SELECT series_id, model, least(50, floor((residual - lo) / ((hi - lo) / 50))::INT + 1) AS bin, count(*) AS n
    FROM r JOIN b USING (series_id, model) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return m.residual_histogram(_residuals(spark, sf))


@query(
    "residual_qq",
    "predictions",
    RESIDUAL
    + " UNION ALL ".join(
        f""" SELECT series_id, model, {q6(repr(p))} AS prob, {q6(repr(statistics.NormalDist().inv_cdf(p)))} AS theoretical,
        {q6(f'quantile_cont(residual, {p!r})')} AS sample FROM r GROUP BY 1, 2"""
        for p in m.qq_probs().values()
    ),
)
def _(spark, sf):
    return rounded(m.residual_qq(_residuals(spark, sf)), ["prob", "theoretical", "sample"])


INTERVALS = """, spread AS (SELECT series_id, round(stddev_samp(y_true - y_pred) + 1e-9, 4) AS s FROM predictions
        WHERE model = 'champion' GROUP BY 1),
    intervals AS (SELECT p.*, y_pred - 1.2816 * s AS lower, y_pred + 1.2816 * s AS upper FROM predictions p
        JOIN spread USING (series_id) WHERE model = 'champion')"""


def intervals(spark, sf):
    champion = v.predictions(spark, sf).where("model = 'champion'")
    spread = champion.groupBy("series_id").agg(F.round(F.stddev_samp(F.col("y_true") - F.col("y_pred")) + 1e-9, 4).alias("s"))
    half = 1.2816 * F.col("s")
    return champion.join(spread, "series_id").withColumns({"lower": F.col("y_pred") - half, "upper": F.col("y_pred") + half})


@query(
    "interval_coverage",
    "predictions",
    INTERVALS
    + f""" SELECT series_id, {q6('avg((y_true BETWEEN lower AND upper)::INT)')} AS coverage, {q6('avg(upper - lower)')} AS mean_width,
        {q6('sqrt(avg(pow(y_true - y_pred, 2)))')} AS median_rmse, 0.8::DOUBLE AS expected,
        {q6('avg((y_true BETWEEN lower AND upper)::INT) - 0.8')} AS gap FROM intervals GROUP BY 1""",
)
def _(spark, sf):
    return rounded(m.interval_coverage(intervals(spark, sf), 0.8), ["coverage", "mean_width", "median_rmse", "gap"])


@query(
    "winkler_score",
    "predictions",
    INTERVALS
    + f""" SELECT series_id, {q6('avg((y_true BETWEEN lower AND upper)::INT)')} AS coverage, {q6('avg(upper - lower)')} AS mean_width,
        {q6('avg(upper - lower)')} AS sharpness, {q6('''avg(upper - lower + CASE WHEN y_true < lower THEN 2 / 0.2 * (lower - y_true)
            WHEN y_true > upper THEN 2 / 0.2 * (y_true - upper) ELSE 0 END)''')} AS winkler_score,
        {q6('sqrt(avg(pow(y_true - y_pred, 2)))')} AS rmse, {q6('avg(abs(y_true - y_pred))')} AS mae, 0.8::DOUBLE AS target_coverage,
        {q6('abs(avg((y_true BETWEEN lower AND upper)::INT) - 0.8)')} AS coverage_gap FROM intervals GROUP BY 1""",
)
def _(spark, sf):
    out = m.winkler_score(intervals(spark, sf), 0.2)
    names = ["coverage", "mean_width", "sharpness", "winkler_score", "rmse", "mae", "target_coverage", "coverage_gap"]
    return rounded(out, names)


LEVELS = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
LEVEL_SQL = f""", g AS (SELECT series_id, hour(timestamp) AS h, isodow(timestamp) >= 6 AS we,
        {', '.join(f'quantile_cont(load, {q}) AS {c}' for c, q in LEVELS.items())} FROM load_hourly GROUP BY 1, 2, 3),
    quantiled AS (SELECT l.*, {', '.join(f'g.{c}' for c in LEVELS)} FROM load_hourly l JOIN g ON g.series_id = l.series_id
        AND g.h = hour(l.timestamp) AND g.we = (isodow(l.timestamp) >= 6))"""


@query(
    "conditional_quantiles",
    "load_hourly",
    LEVEL_SQL + f" SELECT series_id, timestamp, load, {', '.join(f'{q6(c)} AS {c}' for c in ('q10', 'q50', 'q90'))} FROM quantiled",
)
def _(spark, sf):
    return rounded(f.conditional_quantiles(v.load_hourly(spark, sf)), ["q10", "q50", "q90"])


@query(
    "pinball_loss",
    "load_hourly",
    LEVEL_SQL
    + " UNION ALL ".join(
        f""" SELECT series_id, '{c}' AS "column", {q}::DOUBLE AS quantile,
        {q6(f'avg(greatest({q} * (load - {c}), ({q} - 1) * (load - {c})))')} AS pinball_loss,
        {q6(f'avg((load <= {c})::INT)')} AS calibration FROM quantiled GROUP BY 1"""
        for c, q in LEVELS.items()
    ),
)
def _(spark, sf):
    rows = f.conditional_quantiles(v.load_hourly(spark, sf), list(LEVELS.values()))
    return rounded(m.pinball_loss(rows, LEVELS, y="load"), ["pinball_loss", "calibration"])


@query(
    "prequential_metrics",
    "predictions",
    f""", s AS (SELECT *, count(*) OVER w AS n_seen, sum(abs(y_true - y_pred)) OVER w AS ae, sum(pow(y_true - y_pred, 2)) OVER w AS se,
        sum(y_true) OVER w AS sy, sum(y_true * y_true) OVER w AS syy FROM predictions
        WINDOW w AS (PARTITION BY series_id, model ORDER BY timestamp ROWS UNBOUNDED PRECEDING))
    SELECT series_id, timestamp, model, n_seen, {q6('ae / n_seen', 5)} AS mae, {q6('sqrt(se / n_seen)', 5)} AS rmse,
        {q6('CASE WHEN n_seen > 1 AND syy - sy * sy / n_seen > 1e-9 THEN 1 - se / (syy - sy * sy / n_seen) END', 5)} AS r2 FROM s""",
)
def _(spark, sf):
    out = m.prequential_metrics(v.predictions(spark, sf)).drop("y_true", "y_pred")
    return rounded(out.withColumn("n_seen", F.col("n_seen").cast("bigint")), ["mae", "rmse", "r2"], 5)


@query(
    "rolling_rmse_alert",
    "predictions",
    f""", s AS (SELECT *, sqrt(avg(pow(y_true - y_pred, 2)) OVER (PARTITION BY series_id, model ORDER BY timestamp
        RANGE BETWEEN INTERVAL '167 hours' PRECEDING AND CURRENT ROW)) AS v FROM predictions)
    SELECT series_id, timestamp, model, {q6('v', 5)} AS rolling_rmse, (v > 60)::INT AS alert FROM s""",
)
def _(spark, sf):
    out = rolling_time_rmse(v.predictions(spark, sf), limit=60.0, keys=["series_id", "model"])
    return rounded(out.drop("y_true", "y_pred"), ["rolling_rmse"], 5)


# Data that are finer than the grid of the buckets, with short buckets.
@query(
    "rolling_rmse_alert_15min",
    "load_15min",
    f""", p AS (SELECT series_id, timestamp, kw AS y_true, lag(kw) OVER (PARTITION BY series_id ORDER BY timestamp) AS y_pred FROM load_15min),
    s AS (SELECT *, sqrt(avg(pow(y_true - y_pred, 2)) OVER (PARTITION BY series_id ORDER BY timestamp
        RANGE BETWEEN INTERVAL '604799 seconds' PRECEDING AND CURRENT ROW)) AS v FROM p WHERE y_pred IS NOT NULL)
    SELECT series_id, timestamp, {q6('v', 5)} AS rolling_rmse, (v > 60)::INT AS alert FROM s""",
)
def _(spark, sf):
    rows = over_chunks(v.load_15min(spark, sf), lambda w: {"y_pred": F.lag("kw", 1).over(w)}, back=1, grid=Grid(900))
    rows = rows.where("y_pred IS NOT NULL").withColumnRenamed("kw", "y_true")
    out = rolling_time_rmse(rows, limit=60.0, grid=Grid(3600, 60))
    return rounded(out.drop("y_true", "y_pred"), ["rolling_rmse"], 5)


# The same with targets far from zero: sums of their squares would leave no digits for the variance.
@query(
    "prequential_metrics_offset",
    "predictions",
    f""", c AS (SELECT *, avg(y_true) OVER (PARTITION BY series_id, model) AS m FROM predictions),
    s AS (SELECT *, count(*) OVER w AS n_seen, sum(pow(y_true - y_pred, 2)) OVER w AS se,
        sum(y_true - m) OVER w AS sy, sum(pow(y_true - m, 2)) OVER w AS syy FROM c
        WINDOW w AS (PARTITION BY series_id, model ORDER BY timestamp ROWS UNBOUNDED PRECEDING))
    SELECT series_id, timestamp, model, n_seen,
        {q6('CASE WHEN n_seen > 1 AND syy - sy * sy / n_seen > 1e-9 THEN 1 - se / (syy - sy * sy / n_seen) END', 3)} AS r2 FROM s""",
)
def _(spark, sf):
    far = v.predictions(spark, sf).withColumns({c: F.col(c) + F.lit(1e8) for c in ("y_true", "y_pred")})
    out = m.prequential_metrics(far).select("series_id", "timestamp", "model", F.col("n_seen").cast("bigint").alias("n_seen"), "r2")
    return rounded(out, ["r2"], 3)


PERF = """, base AS (SELECT series_id, model, sqrt(avg(pow(y_true - y_pred, 2))) AS b FROM predictions
        WHERE timestamp < TIMESTAMP '2024-01-08' GROUP BY 1, 2),
    daily AS (SELECT series_id, model, timestamp::DATE AS date, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
        avg(abs(y_true - y_pred)) AS mae, count(*) AS n_samples FROM predictions GROUP BY 1, 2, 3),
    perf AS (SELECT d.*, (rmse - b) / nullif(b, 0) AS degradation, coalesce((rmse - b) / nullif(b, 0) > 0.3, false)::INT AS alert
        FROM daily d LEFT JOIN base USING (series_id, model))"""


def perf_log(spark, sf):
    predicted = v.predictions(spark, sf)
    first_week = predicted.where(F.col("timestamp") < F.lit("2024-01-08").cast("timestamp"))
    baseline = m.forecast_metrics(first_week).select("series_id", "model", F.col("rmse").alias("baseline_rmse"))
    return m.performance_log(predicted, baseline)


@query(
    "performance_log",
    "predictions",
    PERF
    + f""" SELECT series_id, model, date, {q6('rmse')} AS rmse, {q6('mae')} AS mae, n_samples, {q6('degradation')} AS degradation,
        alert FROM perf""",
)
def _(spark, sf):
    return rounded(perf_log(spark, sf), ["rmse", "mae", "degradation"])


@query(
    "recent_performance",
    "predictions",
    PERF
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY date DESC) AS k FROM perf)
    SELECT series_id, model, count(*) AS n_records, {q6('avg(rmse)')} AS mean_rmse, {q6('stddev_pop(rmse)')} AS std_rmse,
        {q6('min(rmse)')} AS min_rmse, {q6('max(rmse)')} AS max_rmse, sum(alert)::BIGINT AS n_alerts FROM r WHERE k <= 7 GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(m.recent_performance(perf_log(spark, sf)), ["mean_rmse", "std_rmse", "min_rmse", "max_rmse"])


@query(
    "recursive_forecast",
    "load_hourly",
    (
        ordered()
        + f""", state AS (SELECT series_id, max(last_ts) AS last_ts, list(load ORDER BY timestamp) AS s FROM o WHERE i >= n - 24 GROUP BY 1),
    path AS (SELECT series_id, last_ts, 0 AS step, s FROM state UNION ALL
        SELECT series_id, last_ts, step + 1, list_append(s, 5.0 + 0.5 * s[-1] + 0.4 * s[-24]) FROM path WHERE step < 48)
    SELECT series_id, last_ts + to_hours(step) AS timestamp, step, {q6('s[-1]')} AS y_pred FROM path WHERE step > 0"""
    ),
)
def _(spark, sf):
    return rounded(f.recursive_forecast(v.load_hourly(spark, sf), {1: 0.5, 24: 0.4}, 5.0, 48), ["y_pred"])


CONFORMAL = """, r AS (SELECT *, y_true - y_pred AS res, row_number() OVER (PARTITION BY series_id, model ORDER BY timestamp) - 1 AS i
        FROM predictions),
    f AS (SELECT *, quantile_cont(res, 0.05) OVER w AS lo, quantile_cont(res, 0.95) OVER w AS hi FROM r
        WINDOW w AS (PARTITION BY series_id, model ORDER BY timestamp ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"""


@query(
    "conformal_update",
    "predictions",
    CONFORMAL + f" SELECT series_id, timestamp, model, y_true, y_pred, {q6('y_pred + lo')} AS lower, {q6('y_pred + hi')} AS upper FROM f",
)
def _(spark, sf):
    out = f.conformal_update(v.predictions(spark, sf), keys=["series_id", "model"])
    return rounded(out, ["lower", "upper"])


@query(
    "conformal_update_batched",
    "predictions",
    CONFORMAL
    + f""" SELECT a.series_id, a.timestamp, a.model, a.y_true, a.y_pred, {q6('a.y_pred + b.lo')} AS lower,
        {q6('a.y_pred + b.hi')} AS upper FROM f a JOIN f b ON b.series_id = a.series_id AND b.model = a.model AND b.i = a.i // 24 * 24""",
)
def _(spark, sf):
    out = f.conformal_update(v.predictions(spark, sf), step_size=24, keys=["series_id", "model"])
    return rounded(out, ["lower", "upper"])
