"""Model queries, with the functions' default settings.

A fit has no SQL form.  Beside such queries stand ``*_check`` ones whose rows say what must hold of any right fit (sizes, signs,
sums, shares), and SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators.chunks import DAILY
from tidegrid.operators.guards import flag, r6, rounded
from tidegrid.operators.metrics import forecast_metrics, winkler_score
from tidegrid.operators.series import HORIZONS, lag_features
from tidegrid.plans import attributions as at
from tidegrid.plans import conformal as cf
from tidegrid.plans import forecast as f
from tidegrid.plans import importance as im
from tidegrid.plans import learning as ln
from tidegrid.plans import shapley as sh
from tidegrid.registry.common import hash32_sql, q6, query
from tidegrid.registry.explaining import score
from tidegrid.session import cut_lineage
from tidegrid.sources import views as v

FEATURES = list(v.MODEL_TERMS)
#: Rows of the background that attributions are measured against.
BACKGROUND = 100


@query("gbt_forecast")
def _(spark, sf):
    _model, scored = ln.gbt_forecast(v.model_rows(spark, sf), FEATURES, 72)
    return rounded(forecast_metrics(scored, ["series_id"], "load", "prediction"), ["rmse", "mae", "mape", "r2", "max_error"], 4)


# Every test row is scored, errors are ordered, and over all series the fit is closer than the mean of the training rows.
@query(
    "gbt_forecast_check",
    "model_rows",
    """SELECT series_id, least(count(*), 72)::BIGINT AS n, 1 AS ordered, 1 AS near FROM model_rows GROUP BY 1""",
)
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    _model, scored = ln.gbt_forecast(rows, FEATURES, 72)
    ends = rows.groupBy("series_id").agg(F.min("load").alias("a"), F.max("load").alias("b"))
    out = forecast_metrics(scored, ["series_id"], "load", "prediction").join(ends, "series_id")
    ordered = flag((F.col("mae") <= F.col("rmse") + 1e-9) & (F.col("rmse") <= F.col("max_error") + 1e-9))
    return out.select("series_id", F.col("n").cast("long").alias("n"), ordered.alias("ordered"), flag(F.col("rmse") < F.col("b") - F.col("a")).alias("near"))


@query("gbt_importance")
def _(spark, sf):
    model = ln.fit_gbt(v.model_rows(spark, sf), FEATURES)
    return im.top_importance(ln.gain_importance(model, spark), 10)


# Shares of the gain: one for each feature, not negative, all together one.
@query("gbt_importance_check", "", "SELECT 4::BIGINT AS n_features, 1.0::DOUBLE AS total, 1 AS is_valid")
def _(spark, sf):
    gain = ln.gain_importance(ln.fit_gbt(v.model_rows(spark, sf), FEATURES), spark)
    total = r6(F.sum("importance")).alias("total")
    return gain.agg(F.count(F.lit(1)).alias("n_features"), total, F.min(flag(F.col("importance").between(0, 1))).alias("is_valid"))


@query("permutation_prune")
def _(spark, sf):
    return ln.permutation_prune(v.model_rows(spark, sf), FEATURES)


def _daily(spark, sf):
    return lag_features(v.load_daily(spark, sf), lags=(1, 7), grid=DAILY)


DAILY_FEATURES = ["load_lag_1h", "load_lag_7h"]


@query("cross_validate")
def _(spark, sf):
    rows = _daily(spark, sf)
    return ln.cross_validate(rows, f.rolling_origin_splits(v.load_daily(spark, sf), 3, gap_days=1), DAILY_FEATURES)


DAILY_SQL = """SELECT o_orderpriority AS series_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS timestamp, round(sum(o_totalprice), 2) AS load
    FROM orders GROUP BY 1, 2"""


# Sizes and ends of both parts of every split; the error is a number above zero.
@query(
    "cross_validate_check",
    "",
    f"""WITH d AS ({DAILY_SQL}),
    r AS (SELECT * FROM (SELECT *, lag(load, 1) OVER w AS a, lag(load, 7) OVER w AS b FROM d WINDOW w AS (PARTITION BY series_id ORDER BY timestamp))
        WHERE a IS NOT NULL AND b IS NOT NULL AND load IS NOT NULL),
    e AS (SELECT series_id, min(timestamp) AS s, max(timestamp) AS z, date_diff('day', min(timestamp), max(timestamp)) - 396 AS free FROM d GROUP BY 1),
    p AS (SELECT series_id, k::INT AS split, s, s + to_days((365 + floor(k * free / 2))::INT) AS train_end, z FROM e, range(3) t(k)),
    q AS (SELECT *, train_end + INTERVAL 1 DAY AS test_from, least(train_end + INTERVAL 31 DAY, z) AS test_to FROM p)
    SELECT split, count(*) FILTER (timestamp BETWEEN test_from AND test_to) AS n_test, min(timestamp) FILTER (timestamp BETWEEN test_from AND test_to) AS test_start,
      max(timestamp) FILTER (timestamp BETWEEN test_from AND test_to) AS test_end, count(*) FILTER (timestamp <= train_end) AS n_train,
      min(timestamp) FILTER (timestamp <= train_end) AS train_start, max(timestamp) FILTER (timestamp <= train_end) AS train_end, 1 AS has_error
    FROM r JOIN q USING (series_id) GROUP BY split""",
)
def _(spark, sf):
    out = ln.cross_validate(_daily(spark, sf), f.rolling_origin_splits(v.load_daily(spark, sf), 3, gap_days=1), DAILY_FEATURES)
    return out.select("split", "n_test", "test_start", "test_end", "n_train", "train_start", "train_end", flag((F.col("rmse") > 0) & (F.col("mae") <= F.col("rmse"))).alias("has_error"))


@query("random_search")
def _(spark, sf):
    return ln.random_search(_daily(spark, sf), f.rolling_origin_splits(v.load_daily(spark, sf), 3), DAILY_FEATURES)


# Fifty trials over three folds, one best, which nothing beats and which is below the error of yesterday's value.
@query("random_search_check", "", "SELECT 50::BIGINT AS n_trials, 3 AS n_folds, 1::BIGINT AS n_best, 1 AS is_least, 1 AS beats_persistence")
def _(spark, sf):
    rows, splits = _daily(spark, sf), f.rolling_origin_splits(v.load_daily(spark, sf), 3)
    trials = ln.random_search(rows, splits, DAILY_FEATURES)
    tested = f.tag_splits(rows.dropna(subset=["load", *DAILY_FEATURES]), splits).where("part = 'test'")
    naive = tested.groupBy("split").agg(F.sqrt(F.avg(F.pow(F.col("load") - F.col("load_lag_1h"), F.lit(2)))).alias("e")).agg(F.avg("e")).scalar()
    best = F.min(F.when(F.col("is_best") == 1, F.col("mean_rmse")))
    return trials.agg(
        F.count(F.lit(1)).alias("n_trials"), F.min("n_folds").alias("n_folds"), F.sum("is_best").alias("n_best"),
        flag(best == F.min("mean_rmse")).alias("is_least"), flag(best < naive).alias("beats_persistence"),
    )


@query("direct_multi_horizon")
def _(spark, sf):
    predictions, _metrics = ln.direct_multi_horizon(v.model_rows(spark, sf), FEATURES, HORIZONS)
    return predictions


# Which rows are predicted for which horizon, and their true values.
@query(
    "direct_multi_horizon_check",
    "model_rows",
    " UNION ALL ".join(
        f"""SELECT series_id, timestamp, {h} AS horizon, {q6('y', 4)} AS y_true, 1 AS has_prediction FROM (SELECT *, lead(load, {h}) OVER w AS y,
        row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM model_rows WINDOW w AS (PARTITION BY series_id ORDER BY timestamp))
        WHERE y IS NOT NULL AND i - 1 >= n - floor(n * 0.2::DOUBLE)"""
        for h in HORIZONS
    ),
)
def _(spark, sf):
    predictions, _metrics = ln.direct_multi_horizon(v.model_rows(spark, sf), FEATURES, HORIZONS)
    return rounded(predictions, ["y_true"], 4).select("series_id", "timestamp", "horizon", "y_true", flag(F.col("prediction").isNotNull()).alias("has_prediction"))


def _recursion(spark, sf):
    rows = lag_features(v.load_hourly(spark, sf), lags=(1, 24))
    model = ln.fit_gbt(rows, ["load_lag_1h", "load_lag_24h"])
    return ln.recursive_tree_forecast(model, v.load_hourly(spark, sf), (1, 24))


@query("recursive_tree_forecast")
def _(spark, sf):
    return _recursion(spark, sf)


# All 168 steps of every series with a day of history, one after another, within the range of all loads.
@query(
    "recursive_tree_check",
    "load_hourly",
    """SELECT series_id, max(timestamp) + to_hours(k::INT) AS timestamp, k::INT AS step, 1 AS in_range FROM load_hourly, range(1, 169) t(k)
    GROUP BY series_id, k HAVING count(*) >= 24""",
)
def _(spark, sf):
    ends = v.load_hourly(spark, sf).agg(F.struct((2 * F.min("load") - F.max("load")).alias("a"), (2 * F.max("load") - F.min("load")).alias("b"))).scalar()
    out = _recursion(spark, sf).withColumn("_e", ends)
    return out.select("series_id", "timestamp", "step", flag(F.col("y_pred").between(F.col("_e.a"), F.col("_e.b"))).alias("in_range"))


# A formula on lags, a rolling mean of the history and a calendar column, rolled forward.
@query(
    "recursive_feature_forecast",
    "load_hourly",
    f""", f AS (SELECT series_id, max(timestamp) AS t, list(load ORDER BY timestamp)[-24:] AS h, 0 AS step FROM load_hourly GROUP BY 1
    UNION ALL SELECT series_id, t + INTERVAL 1 HOUR, list_append(h, 0.5 * h[-1] + 0.3 * list_avg(h[-3:]) + 0.1 * h[-24] + hour(t + INTERVAL 1 HOUR) * 0.2), step + 1
        FROM f WHERE step < 48)
    SELECT series_id, t AS timestamp, step, {q6('h[-1]', 4)} AS y_pred FROM f WHERE step > 0""",
)
def _(spark, sf):
    def features(rows):
        return rows.withColumns(
            {
                "load_lag_1h": F.element_at("history", -1),
                "load_lag_24h": F.element_at("history", -24),
                "rolling_3h_mean": F.aggregate(F.slice("history", -3, 3), F.lit(0.0), lambda a, x: a + x) / 3,
                "hour": F.hour("timestamp"),
            }
        )

    def formula(rows):
        return rows.selectExpr("*", "0.5D * load_lag_1h + 0.3D * rolling_3h_mean + 0.1D * load_lag_24h + hour * 0.2D AS prediction")

    out = ln.recursive_feature_forecast(formula, v.load_hourly(spark, sf), features, 24, 48)
    return rounded(out, ["y_pred"], 4)


# Labels are monotone in the bins of the feature by construction, so the isotonic fit gives back their means.
@query(
    "isotonic_recalibration",
    "model_rows",
    f"""SELECT floor(temperature / 5)::BIGINT AS cell, count(*) AS n, {q6('avg(2 * floor(temperature / 5) + 3)', 4)} AS mean_recalibrated
    FROM model_rows GROUP BY 1""",
)
def _(spark, sf):
    cell = F.floor(F.col("temperature") / 5)
    rows = v.model_rows(spark, sf).select(cell.alias("cell"), (2 * cell + 3).cast("double").alias("load"), (F.col("humidity") / 10).alias("prediction"))
    out = ln.isotonic_recalibration(rows, "cell", 1)
    return rounded(out.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("recalibrated").alias("mean_recalibrated")), ["mean_recalibrated"], 4)


# The same on a skewed feature with a value for nearly every row: cubes of a lag.
@query(
    "isotonic_recalibration_skewed",
    "model_rows",
    f"""SELECT series_id, timestamp, {q6('2 * load_lag_1h + 3', 4)} AS recalibrated FROM model_rows""",
)
def _(spark, sf):
    skewed = F.pow(F.col("load_lag_1h"), F.lit(3))
    rows = v.model_rows(spark, sf).select("series_id", "timestamp", skewed.alias("skewed"), (2 * F.col("load_lag_1h") + 3).alias("load"), F.lit(0.0).alias("prediction"))
    out = ln.isotonic_recalibration(rows, "skewed", 1)
    return rounded(out.select("series_id", "timestamp", "recalibrated"), ["recalibrated"], 4)


@query(
    "linear_fit",
    "load_hourly weather",
    f"""SELECT series_id, timestamp, load, {q6('i + s * temperature', 4)} AS prediction FROM load_hourly JOIN weather USING (timestamp),
    (SELECT regr_slope(load, temperature) AS s, regr_intercept(load, temperature) AS i FROM load_hourly JOIN weather USING (timestamp))""",
)
def _(spark, sf):
    rows = v.load_hourly(spark, sf).join(v.weather_hourly(spark, sf).select("timestamp", "temperature"), "timestamp")
    fitted = ln.linear_column(ln.fit_linear(rows, ["temperature"]), ["temperature"])
    return rows.select("series_id", "timestamp", "load", r6(fitted, 4).alias("prediction"))


@query("quantile_forecast")
def _(spark, sf):
    out = ln.quantile_forecast(v.model_rows(spark, sf), FEATURES)
    return rounded(out, ["q10", "q50", "q90", "lower", "upper"], 4)


QUANTILES = (0.1, 0.5, 0.9)


@query("quantile_tree_forecast")
def _(spark, sf):
    out = ln.quantile_tree_forecast(v.model_rows(spark, sf), FEATURES, QUANTILES)
    return rounded(out, ["q10", "q50", "q90", "lower", "upper"], 4)


# The share of rows below each quantile is that quantile, within a hundredth.
@query(
    "quantile_tree_check",
    "model_rows",
    "SELECT q::DOUBLE AS quantile, count(*) AS n, 1 AS holds_share FROM model_rows, (VALUES (0.1), (0.5), (0.9)) t(q) GROUP BY q",
)
def _(spark, sf):
    out = ln.quantile_tree_forecast(v.model_rows(spark, sf), FEATURES, QUANTILES)
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), flag(F.col("load") <= F.col(f.quantile_name(q)) + 1e-6).alias("below")) for q in QUANTILES]))
    shares = out.select(pairs.alias("p")).groupBy(F.col("p.quantile").alias("quantile")).agg(F.count(F.lit(1)).alias("n"), F.avg("p.below").alias("share"))
    return shares.select("quantile", "n", flag(F.abs(F.col("share") - F.col("quantile")) <= 0.01).alias("holds_share"))


@query("conformal_enbpi")
def _(spark, sf):
    rows = cut_lineage(f.holdout_split(v.model_rows(spark, sf), 72))
    out = cf.conformal_enbpi(rows.where("split <> 'test'"), rows.where("split = 'test'"), FEATURES)
    return rounded(out, ["y_pred", "lower", "upper"], 4)


# A band for every test row, not upside down, around a prediction.
@query(
    "conformal_check",
    "model_rows",
    "SELECT series_id, least(count(*), 72)::BIGINT AS n, 1 AS is_ordered FROM model_rows GROUP BY 1",
)
def _(spark, sf):
    rows = cut_lineage(f.holdout_split(v.model_rows(spark, sf), 72))
    out = cf.conformal_enbpi(rows.where("split <> 'test'"), rows.where("split = 'test'"), FEATURES)
    return out.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min(flag((F.col("lower") <= F.col("upper")) & F.col("y_pred").isNotNull())).alias("is_ordered"))


@query("conformal_scores")
def _(spark, sf):
    rows = cut_lineage(f.holdout_split(v.model_rows(spark, sf), 72))
    out = cf.conformal_enbpi(rows.where("split <> 'test'"), rows.where("split = 'test'"), FEATURES)
    return winkler_score(out, 0.1)


@query("holdout_experiment")
def _(spark, sf):
    return ln.holdout_experiment(v.model_rows(spark, sf), FEATURES, 72)


# Sizes of both parts and the methods compared over the same test rows.
@query(
    "holdout_experiment_check",
    "model_rows",
    """SELECT method, sum(greatest(n - 72, 0))::BIGINT AS n_train, sum(least(n, 72))::BIGINT AS n_test, 4 AS n_features, 1 AS is_ordered
    FROM (SELECT series_id, count(*) AS n FROM model_rows GROUP BY 1), (VALUES ('persistence'), ('seasonal_naive'), ('moving_average'), ('gbt')) m(method) GROUP BY 1""",
)
def _(spark, sf):
    out = ln.holdout_experiment(v.model_rows(spark, sf), FEATURES, 72)
    return out.select("method", "n_train", "n_test", "n_features", flag(F.col("mae") <= F.col("rmse") + 1e-9).alias("is_ordered"))


@query("permutation_prune_check", "", "SELECT 4::BIGINT AS n_features, 1 AS is_consistent")
def _(spark, sf):
    out = ln.permutation_prune(v.model_rows(spark, sf), FEATURES)
    return out.agg(F.count(F.lit(1)).alias("n_features"), F.min(flag((F.col("kept") == 1) == (F.col("importance") > 0.001))).alias("is_consistent"))


SAMPLE = f"SELECT * FROM model_rows ORDER BY {hash32_sql('series_id', 'timestamp', '42')}, series_id, timestamp LIMIT {{n}}"


@query("sample_rows", "model_rows", " " + SAMPLE.format(n=100))
def _(spark, sf):
    return sh.sample_rows(v.model_rows(spark, sf), 100)


def _tree_phi(spark, sf):
    """Exact attributions of all rows."""
    rows = v.model_rows(spark, sf)
    model = ln.fit_gbt(rows, FEATURES)
    return model, at.tree_shapley(rows, model, rows, BACKGROUND)


# The same walk on the formula model, where the attribution is exact: weight times distance from the background's mean.
@query(
    "shap_values_formula",
    "model_rows",
    f""", bg AS ({SAMPLE.format(n=BACKGROUND)}), m AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM bg)"""
    + " UNION ALL ".join(
        f""" SELECT series_id, timestamp, '{c}' AS feature, {q6(f'model_rows.{c}')} AS value, {q6(f'{w} * (model_rows.{c} - m.{c})')} AS phi
        FROM model_rows, m"""
        for c, w in v.MODEL_TERMS.items()
    ),
)
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    out = sh.sampling_shapley(rows, FEATURES, score, rows, BACKGROUND)
    return rounded(out.select("series_id", "timestamp", "feature", "value", "phi"), ["value", "phi"])


# Without an interaction in the formula every value is zero.
@query(
    "interaction_values_formula",
    "model_rows",
    "SELECT series_id, timestamp, 'load_lag_1h' AS feature_a, 'temperature' AS feature_b, 0.0::DOUBLE AS interaction FROM model_rows",
)
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    return rounded(sh.interaction_values(rows, FEATURES, ("load_lag_1h", "temperature"), score, rows, BACKGROUND), ["interaction"])


@query("shap_values_tree")
def _(spark, sf):
    return _tree_phi(spark, sf)[1]


# The attributions of a row add up to its prediction minus the base value, which is the same for all rows.
@query(
    "shap_additivity",
    "model_rows",
    """SELECT series_id, timestamp, 4::BIGINT AS n_features, 1 AS adds_up, 1 AS one_base FROM model_rows""",
)
def _(spark, sf):
    phi = _tree_phi(spark, sf)[1]
    off = F.abs(F.sum("phi") - (F.first("prediction") - F.first("base_value")))
    return phi.groupBy("series_id", "timestamp").agg(F.count(F.lit(1)).alias("n_features"), flag(off < 1e-6).alias("adds_up"), flag(F.min("base_value") == F.max("base_value")).alias("one_base"))


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("interaction_values")
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    return at.tree_interactions(rows, ln.fit_gbt(rows, FEATURES), PAIRS, rows, BACKGROUND)


# A model of single splits has no interactions: every pair of every row is zero.
@query(
    "interaction_check",
    "model_rows",
    " UNION ALL ".join(f"SELECT series_id, timestamp, '{a}' AS feature_a, '{b}' AS feature_b, 0.0::DOUBLE AS interaction FROM model_rows" for a, b in PAIRS),
)
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    return rounded(at.tree_interactions(rows, ln.fit_gbt(rows, FEATURES, depth=1), PAIRS, rows, BACKGROUND), ["interaction"])


# Trees under constraints never move against them, whatever the other features are.
@query(
    "monotone_audit",
    "model_rows",
    """SELECT 'load_lag_1h' AS feature, 1 AS monotone_constraint, 3 * count(*) AS n_steps, 0::BIGINT AS n_violations,
    0.0::DOUBLE AS violation_share FROM model_rows UNION ALL SELECT 'temperature', -1, 3 * count(*), 0, 0.0 FROM model_rows""",
)
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    model = ln.fit_gbt(rows, FEATURES, monotone={"load_lag_1h": 1, "temperature": -1})
    grids = {"load_lag_1h": [10, 50, 100, 200], "temperature": [0, 10, 20, 30]}
    return sh.monotone_audit(rows, {"load_lag_1h": 1, "temperature": -1}, grids, lambda d: ln.predict(model, d))


@query(
    "monotone_audit_linear",
    "model_rows",
    """SELECT 'load_lag_1h' AS feature, 1 AS monotone_constraint, 3 * count(*) AS n_steps, 0::BIGINT AS n_violations,
    0.0::DOUBLE AS violation_share FROM model_rows UNION ALL
    SELECT 'temperature', -1, 3 * count(*), (3 * count(*))::BIGINT, 1.0 FROM model_rows""",
)
def _(spark, sf):
    grids = {"load_lag_1h": [10, 50, 100, 200], "temperature": [0, 10, 20, 30]}
    return sh.monotone_audit(v.model_rows(spark, sf), {"load_lag_1h": 1, "temperature": -1}, grids, score)


def _report(spark, sf):
    """Tree attributions, their global and hourly importance and the comparison with the gain importance."""
    model, phi = _tree_phi(spark, sf)
    phi = cut_lineage(phi)
    overall = im.global_importance(phi)
    gain = ln.gain_importance(model, spark)
    parts = [
        overall.select(F.lit("global").alias("section"), F.lit("all").alias("item"), "feature", F.col("importance").alias("value")),
        im.time_varying_importance(phi).select(
            F.lit("time").alias("section"), F.concat_ws(" ", "grain", "bucket").alias("item"), "feature", F.col("importance").alias("value")
        ),
        im.importance_comparison(gain, overall).select(
            F.lit("gain").alias("section"), F.lit("normalised").alias("item"), "feature", F.col("model_norm").alias("value")
        ),
        im.top_share(overall, 2).select(F.lit("share").alias("section"), F.lit("top 2").alias("item"), F.lit("").alias("feature"), F.col("top_share").alias("value")),
    ]
    strongest = im.top_contributions(phi, 3).select(
        F.lit("row").alias("section"), F.concat_ws(" ", "series_id", "timestamp", "rank").alias("item"), "feature", F.col("phi").alias("value")
    )
    parts.append(strongest)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("explain_report")
def _(spark, sf):
    return _report(spark, sf)


# How many rows each section has, and that the shares of the gain section reach one.
@query(
    "explain_report_check",
    "model_rows",
    """SELECT 'global' AS section, 4::BIGINT AS n UNION ALL SELECT 'gain', 4 UNION ALL SELECT 'share', 1 UNION ALL SELECT 'row', 3 * count(*) FROM model_rows""",
)
def _(spark, sf):
    return _report(spark, sf).where("section <> 'time'").groupBy("section").agg(F.count(F.lit(1)).alias("n"))
