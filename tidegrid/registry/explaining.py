"""Attribution, importance, what-if and text queries on the linear formula model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators.guards import rounded
from tidegrid.plans import feature_table as ft
from tidegrid.plans import importance as im
from tidegrid.plans import narrative as nl
from tidegrid.plans import whatif as wi
from tidegrid.registry.common import hash32_sql, q6, query
from tidegrid.session import cut_lineage, scratch_path
from tidegrid.sources import views as v

TERMS, BASE = v.MODEL_TERMS, v.MODEL_BASE


def score(df):
    return df.withColumn("prediction", im.linear_score(TERMS, BASE))


SPLIT = "TIMESTAMP '2024-01-16'"


def phi(spark, sf, long=True):
    return im.linear_shap(v.model_rows(spark, sf), TERMS, BASE, long=long)


BASE_SQL = "50 + 0.6 * m1 + 0.2 * m24 + 1.5 * mt - 0.3 * mh"


@query(
    "shap_values",
    "phi scored",
    f"""SELECT p.series_id, p.timestamp, {q6('s.prediction')} AS prediction, {q6(f'(SELECT {BASE_SQL} FROM model_means)')} AS base_value,
        feature, {q6('value')} AS value, {q6('phi')} AS phi FROM phi p JOIN scored s USING (series_id, timestamp)""",
)
def _(spark, sf):
    return rounded(phi(spark, sf), ["prediction", "base_value", "value", "phi"])


IMPORTANCE = ", importance AS (SELECT feature, avg(abs(phi)) AS importance FROM phi GROUP BY 1)"


@query("global_importance", "phi", IMPORTANCE + f" SELECT feature, {q6('importance')} AS importance FROM importance")
def _(spark, sf):
    return rounded(im.global_importance(phi(spark, sf)), ["importance"])


@query(
    "top_importance",
    "phi",
    IMPORTANCE + f" SELECT feature, {q6('importance')} AS importance FROM importance ORDER BY importance.importance DESC, feature LIMIT 3",
)
def _(spark, sf):
    return rounded(im.top_importance(im.global_importance(phi(spark, sf)), 3), ["importance"])


@query(
    "top_share",
    "phi",
    IMPORTANCE
    + f""", t AS (SELECT * FROM importance ORDER BY importance DESC, feature LIMIT 2)
    SELECT {q6('(SELECT sum(importance) FROM t) / sum(importance)')} AS top_share, count(*) AS n_features FROM importance""",
)
def _(spark, sf):
    return rounded(im.top_share(im.global_importance(phi(spark, sf)), 2), ["top_share"])


GRAINS = (("hour", "hour(timestamp)"), ("day_of_week", "isodow(timestamp) - 1"), ("month", "month(timestamp)"))


def varying_sql(agg: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS grain, ({e})::INT AS bucket, feature, {q6(agg)} AS importance FROM phi GROUP BY 2, 3" for n, e in GRAINS
    )


@query("time_varying_importance", "phi", varying_sql("avg(abs(phi))"))
def _(spark, sf):
    return rounded(im.time_varying_importance(phi(spark, sf)), ["importance"])


@query("time_varying_importance_median", "phi", varying_sql("quantile_cont(abs(phi), 0.5)"))
def _(spark, sf):
    return rounded(im.time_varying_importance(phi(spark, sf), "median"), ["importance"])


@query(
    "importance_heatmap_table",
    "phi",
    f""", h AS (SELECT feature, hour(timestamp) AS h, avg(abs(phi)) AS i FROM phi GROUP BY 1, 2),
    m AS (SELECT feature, avg(i) AS i FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
    SELECT feature, {q6('max(m.i)')} AS mean_importance, {', '.join(f'{q6(f"max(h.i) FILTER (h = {k})")} AS h{k:02d}' for k in range(24))}
    FROM h JOIN m USING (feature) GROUP BY 1""",
)
def _(spark, sf):
    out = im.importance_heatmap(phi(spark, sf), 3)
    return rounded(out, [c for c in out.columns if c != "feature"])


RANKED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, timestamp ORDER BY abs(phi) DESC, feature) AS rank
    FROM phi)"""


@query(
    "top_contributions",
    "phi",
    RANKED
    + f""" SELECT series_id, timestamp, rank::INT AS rank, feature, {q6('value')} AS value, {q6('phi')} AS phi,
    {q6('abs(phi)')} AS abs_phi FROM ranked WHERE rank <= 3""",
)
def _(spark, sf):
    return rounded(im.top_contributions(phi(spark, sf, False), 3), ["value", "phi", "abs_phi"])


def model_importance(spark, sf):
    """Absolute weight times the spread of the feature: the importance a linear model reports itself."""
    rows = v.model_rows(spark, sf)
    wide = rows.agg(*[(abs(w) * F.stddev_samp(f)).alias(f) for f, w in TERMS.items()])
    return wide.unpivot([], list(TERMS), "feature", "importance")


MODEL_IMPORTANCE = ", model AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {abs(w)} * stddev_samp({f}) AS importance FROM model_rows" for f, w in TERMS.items()
) + ")"


@query(
    "importance_comparison",
    "phi",
    IMPORTANCE
    + MODEL_IMPORTANCE
    + f""", j AS (SELECT feature, m.importance AS a, i.importance AS b FROM model m JOIN importance i USING (feature))
    SELECT feature, {q6('a')} AS importance_model, {q6('b')} AS importance_shap, {q6('a / (SELECT max(a) FROM j)')} AS model_norm,
        {q6('b / (SELECT max(b) FROM j)')} AS shap_norm FROM j ORDER BY b DESC, feature LIMIT 3""",
)
def _(spark, sf):
    out = im.importance_comparison(model_importance(spark, sf), im.global_importance(phi(spark, sf)), 3)
    return rounded(out, ["importance_model", "importance_shap", "model_norm", "shap_norm"])


SCENARIOS = {
    "heat wave": {"temperature": 38.0},
    "cold spell": {"temperature": -5.0, "humidity": 90.0},
    "low load": {"load_lag_1h": 10.0, "load_lag_24h": 10.0},
}
SCENARIO_SQL = """, scenarios AS (SELECT * FROM (VALUES ('heat wave', 38.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
        ('cold spell', -5.0, 90.0, NULL, NULL), ('low load', NULL, NULL, 10.0, 10.0)) s(scenario, t, h, l1, l24)),
    grid AS (SELECT series_id, timestamp, load, scenario, coalesce(l1, load_lag_1h) AS load_lag_1h,
        coalesce(l24, load_lag_24h) AS load_lag_24h, coalesce(t, temperature) AS temperature, coalesce(h, humidity) AS humidity,
        50 + 0.6 * load_lag_1h + 0.2 * load_lag_24h + 1.5 * temperature - 0.3 * humidity AS base
        FROM model_rows, scenarios),
    answered AS (SELECT *, 50 + 0.6 * grid.load_lag_1h + 0.2 * grid.load_lag_24h + 1.5 * grid.temperature - 0.3 * grid.humidity
        AS modified FROM grid)"""
# inside the grid the unchanged inputs feed the base prediction
SCENARIO_SQL = SCENARIO_SQL.replace(
    "50 + 0.6 * load_lag_1h + 0.2 * load_lag_24h + 1.5 * temperature - 0.3 * humidity AS base",
    "50 + 0.6 * model_rows.load_lag_1h + 0.2 * model_rows.load_lag_24h + 1.5 * model_rows.temperature"
    " - 0.3 * model_rows.humidity AS base",
)


@query(
    "whatif_grid",
    "model_rows",
    SCENARIO_SQL + " SELECT series_id, timestamp, load, scenario, load_lag_1h, load_lag_24h, temperature, humidity FROM grid",
)
def _(spark, sf):
    return wi.whatif_grid(v.model_rows(spark, sf), SCENARIOS)


@query(
    "whatif",
    "model_rows",
    SCENARIO_SQL
    + f""" SELECT series_id, timestamp, scenario, {q6('base')} AS base_prediction, {q6('modified')} AS modified_prediction,
    {q6('modified - base')} AS delta, {q6('CASE WHEN base <> 0 THEN (modified - base) / base * 100 ELSE 0 END', 4)} AS pct_change
    FROM answered""",
)
def _(spark, sf):
    out = wi.whatif(v.model_rows(spark, sf), SCENARIOS, score)
    return rounded(rounded(out, ["base_prediction", "modified_prediction", "delta"]), ["pct_change"], 4)


@query(
    "sensitivity",
    "model_rows",
    f"""SELECT series_id, timestamp, x::DOUBLE AS feature_value,
        {q6('50 + 0.6 * load_lag_1h + 0.2 * load_lag_24h + 1.5 * x - 0.3 * humidity')} AS prediction
    FROM model_rows, (VALUES (-5.0), (5.0), (15.0), (25.0), (35.0)) t(x)""",
)
def _(spark, sf):
    out = wi.sensitivity(v.model_rows(spark, sf), "temperature", [-5, 5, 15, 25, 35], score)
    return rounded(out, ["prediction"])


VARIED = ["temperature", "humidity", "load_lag_1h"]


@query(
    "counterfactual_search",
    "model_rows",
    f""", b AS (SELECT *, 50 + 0.6 * load_lag_1h + 0.2 * load_lag_24h + 1.5 * temperature + -0.3 * humidity AS current_prediction FROM model_rows),
    span AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in VARIED)} FROM model_rows),
    t AS (SELECT b.*, span.*, k, {', '.join(
        f"""CASE WHEN {hash32_sql('series_id', 'timestamp', 'k', f"'pick:{c}:42'")} / 4294967296.0::DOUBLE < 1.0::DOUBLE / 3 + 0.25
            THEN lo_{c} + (hi_{c} - lo_{c}) * ({hash32_sql('series_id', 'timestamp', 'k', f"'value:{c}:42'")} / 4294967296.0::DOUBLE) ELSE {c} END AS n_{c}"""
        for c in VARIED)}
        FROM b, span, range(1, 201) r(k)),
    p AS (SELECT *, 50 + 0.6 * n_load_lag_1h + 0.2 * load_lag_24h + 1.5 * n_temperature + -0.3 * n_humidity AS prediction FROM t),
    h AS (SELECT *, {' + '.join(f'(n_{c} <> {c})::INT' for c in VARIED)} AS n_changes,
        {' + '.join(f'coalesce(abs(n_{c} - {c}) / nullif(hi_{c} - lo_{c}, 0), 0)' for c in VARIED)} AS distance FROM p
        WHERE prediction BETWEEN least(0.8 * current_prediction * 0.95, 0.8 * current_prediction * 1.05)
            AND greatest(0.8 * current_prediction * 0.95, 0.8 * current_prediction * 1.05)),
    best AS (SELECT *, row_number() OVER (PARTITION BY series_id, timestamp ORDER BY n_changes, distance, k) AS rank FROM h QUALIFY rank <= 3)
    SELECT b.series_id, b.timestamp, {q6('b.current_prediction')} AS current_prediction, b.{', b.'.join(f'{c} AS {c}_original' for c in VARIED)},
        {q6('prediction')} AS prediction, n_changes, {q6('distance')} AS distance, {', '.join(f"{q6(f'n_{c}')} AS {c}" for c in VARIED)},
        rank::INT AS rank, (rank IS NOT NULL)::INT AS success
    FROM b LEFT JOIN best ON best.series_id = b.series_id AND best.timestamp = b.timestamp""",
)
def _(spark, sf):
    rows = v.model_rows(spark, sf)
    goal = F.lit(0.8) * F.col("current_prediction")
    out = wi.counterfactual_search(rows, goal, score, VARIED, k=3).drop("desired")
    return rounded(out, ["current_prediction", "prediction", "distance", *VARIED])


CF = """, cf AS (SELECT series_id, timestamp, k::INT AS cf_id, temperature AS t0, humidity AS h0, load_lag_1h AS l0,
        CASE WHEN k <> 2 THEN temperature - 4 * k ELSE temperature END AS t, least(humidity + 10 * k, 100) AS h,
        CASE WHEN k = 3 THEN load_lag_1h * 0.9 ELSE load_lag_1h END AS l FROM model_rows, range(1, 4) r(k)),
    changes AS (SELECT series_id, timestamp, cf_id, 'temperature' AS feature, t0 AS original, t AS counterfactual FROM cf WHERE t0 <> t
        UNION ALL SELECT series_id, timestamp, cf_id, 'humidity', h0, h FROM cf WHERE h0 <> h
        UNION ALL SELECT series_id, timestamp, cf_id, 'load_lag_1h', l0, l FROM cf WHERE l0 <> l)"""


def _changes(spark, sf):
    rows = v.model_rows(spark, sf).withColumn("cf_id", F.explode(F.sequence(F.lit(1), F.lit(3))))
    k = F.col("cf_id")
    cf = rows.select(
        "series_id",
        "timestamp",
        "cf_id",
        *[F.col(f).alias(f"{f}_original") for f in ("temperature", "humidity", "load_lag_1h")],
        F.when(k != 2, F.col("temperature") - 4 * k).otherwise(F.col("temperature")).alias("temperature"),
        F.least(F.col("humidity") + 10 * k, F.lit(100.0)).alias("humidity"),
        F.when(k == 3, F.col("load_lag_1h") * 0.9).otherwise(F.col("load_lag_1h")).alias("load_lag_1h"),
    )
    return wi.counterfactual_changes(cf, ["temperature", "humidity", "load_lag_1h"])


@query(
    "counterfactual_changes",
    "model_rows",
    CF
    + f""" SELECT series_id, timestamp, cf_id, feature, {q6('original')} AS original, {q6('counterfactual')} AS counterfactual,
    {q6('counterfactual - original')} AS delta,
    {q6('CASE WHEN original <> 0 THEN (counterfactual - original) / original * 100 ELSE 0 END', 4)} AS pct_change FROM changes""",
)
def _(spark, sf):
    return rounded(rounded(_changes(spark, sf), ["original", "counterfactual", "delta"]), ["pct_change"], 4)


@query(
    "counterfactual_summary",
    "model_rows",
    CF
    + """, c AS (SELECT series_id, timestamp, feature, count(*) AS n FROM changes GROUP BY 1, 2, 3)
    SELECT series_id, timestamp, string_agg(feature || ' (' || n || ')', ', ' ORDER BY n DESC, feature) AS most_changed,
        sum(n)::BIGINT AS n_changes FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return wi.counterfactual_summary(_changes(spark, sf))


def nudge(x: str) -> str:
    return f"({x}) + sign({x}) * 1e-9"


READABLE = (
    "CASE feature WHEN 'load_lag_1h' THEN 'load from 1 hour ago' WHEN 'load_lag_24h' THEN 'load from same hour yesterday'"
    " WHEN 'temperature' THEN 'current temperature' ELSE 'humidity level' END"
)
VALUE_TEXT = f"""CASE WHEN feature = 'temperature' THEN printf('%.1f°C', {nudge('value')})
    WHEN feature LIKE '%lag%' THEN printf('%.2f kW', {nudge('value')}) ELSE printf('%.2f', {nudge('value')}) END"""


def bullets_sql(sign: str, word: str, title: str) -> str:
    return f"""coalesce('{title}' || chr(10) || string_agg('  • ' || {READABLE} || ' (' || {VALUE_TEXT} || ') is {word} load by '
        || printf('%.2f kW', abs(phi) + 1e-9), chr(10) ORDER BY rank) FILTER (phi {sign} 0 AND side_rank <= 3)
        || chr(10) || chr(10), '')"""


@query(
    "nl_explanation",
    "phi scored",
    RANKED
    + f""", b AS (SELECT {BASE_SQL} AS base FROM model_means),
    p AS (SELECT *, row_number() OVER (PARTITION BY series_id, timestamp, phi > 0 ORDER BY rank) AS side_rank FROM ranked),
    parts AS (SELECT series_id, timestamp, {bullets_sql('>', 'increasing', '**Factors increasing load:**')}
        || {bullets_sql('<', 'decreasing', '**Factors decreasing load:**')} AS bullets,
        arg_min({READABLE}, rank) FILTER (phi > 0) AS up, arg_min({READABLE}, rank) FILTER (phi < 0) AS down,
        string_agg('| ' || feature || ' | ' || printf('%.2f', {nudge('value')}) || ' | ' || CASE WHEN phi > 0 THEN '+' ELSE '' END
            || printf('%.3f', {nudge('phi')}) || ' |', chr(10) ORDER BY rank) AS lines FROM p GROUP BY 1, 2)
    SELECT series_id, timestamp, '**Forecast for ' || strftime(timestamp, '%A, %B %d at %H:%M') || '**' || chr(10)
        || 'Predicted load: **' || printf('%.2f', {nudge('prediction')}) || ' kW**' || chr(10) || chr(10) || bullets || '*'
        || CASE WHEN abs(prediction - base) < 0.1 THEN 'Load is near the typical average for this period.'
            WHEN prediction > base AND up IS NOT NULL THEN 'Load is ' || printf('%.2f', prediction - base + 1e-9)
                || ' kW higher than average, primarily due to ' || up || '.'
            WHEN prediction < base AND down IS NOT NULL THEN 'Load is ' || printf('%.2f', base - prediction + 1e-9)
                || ' kW lower than average, primarily due to ' || down || '.'
            ELSE 'Load is ' || printf('%.2f', abs(prediction - base) + 1e-9) || ' kW '
                || CASE WHEN prediction > base THEN 'higher' ELSE 'lower' END || ' than the typical average.' END
        || '*' || chr(10) || chr(10) || '**Detailed breakdown:**' || chr(10) || '| Feature | Value | Impact |' || chr(10)
        || '|---------|-------|--------|' || chr(10) || lines AS explanation
    FROM parts JOIN scored USING (series_id, timestamp), b""",
)
def _(spark, sf):
    return nl.explain_rows(phi(spark, sf, False))


@query(
    "nl_alert",
    "phi scored",
    RANKED
    + f""", parts AS (SELECT series_id, timestamp, string_agg('  • ' || {READABLE} || ': ' || printf('%+.2f', {nudge('phi')})
        || ' kW' || chr(10), '' ORDER BY rank) AS lines FROM ranked WHERE rank <= 3 GROUP BY 1, 2)
    SELECT series_id, timestamp, CASE WHEN prediction > 120 THEN 'HIGH LOAD' ELSE 'LOW LOAD' END AS alert_type,
        '⚠️ **' || CASE WHEN prediction > 120 THEN 'HIGH LOAD' ELSE 'LOW LOAD' END || ' ALERT** for '
        || strftime(timestamp, '%H:%M on %b %d') || chr(10) || chr(10) || 'Predicted: ' || printf('%.2f', {nudge('prediction')})
        || ' kW (threshold: 120.00 kW)' || chr(10) || chr(10) || '**Contributing factors:**' || chr(10) || lines AS message
    FROM parts JOIN scored USING (series_id, timestamp)""",
)
def _(spark, sf):
    return nl.alert_rows(phi(spark, sf, False), 120.0)


@query(
    "nl_summary_report",
    "phi scored",
    RANKED
    + f""", peak AS (SELECT series_id, arg_max(timestamp, struct_pack(a := prediction, b := -epoch(timestamp))) AS timestamp FROM scored GROUP BY 1),
    pl AS (SELECT series_id, string_agg('  - ' || {READABLE} || ': ' || printf('%+.3f', {nudge('phi')}) || ' kW', chr(10) ORDER BY rank)
        AS lines FROM ranked JOIN peak USING (series_id, timestamp) WHERE rank <= 3 GROUP BY 1),
    i AS (SELECT series_id, feature, avg(abs(phi)) AS i FROM phi GROUP BY 1, 2),
    d AS (SELECT series_id, string_agg('- **' || {READABLE} || '**: avg impact ' || printf('%.3f', i + 1e-9) || ' kW', chr(10)
        ORDER BY i DESC, feature) AS lines FROM i GROUP BY 1),
    s AS (SELECT series_id, avg(prediction) AS a, max(prediction) AS b, min(prediction) AS c, stddev_pop(prediction) AS e
        FROM scored GROUP BY 1)
    SELECT series_id, '# Load Forecast Summary: forecast period' || chr(10) || chr(10) || '## Forecast Statistics' || chr(10)
        || '- **Mean load**: ' || printf('%.2f', {nudge('a')}) || ' kW' || chr(10)
        || '- **Peak load**: ' || printf('%.2f', {nudge('b')}) || ' kW' || chr(10)
        || '- **Minimum load**: ' || printf('%.2f', {nudge('c')}) || ' kW' || chr(10)
        || '- **Std deviation**: ' || printf('%.2f', {nudge('e')}) || ' kW' || chr(10) || chr(10)
        || '## Key Drivers' || chr(10) || d.lines || chr(10) || chr(10) || '## Peak Load Analysis' || chr(10)
        || 'Peak of ' || printf('%.2f', {nudge('b')}) || ' kW' || chr(10) || 'Main contributors to peak:' || chr(10) || pl.lines AS report
    FROM s JOIN d USING (series_id) JOIN pl USING (series_id)""",
)
def _(spark, sf):
    return nl.summary_report(phi(spark, sf, False))


def halves(spark, sf):
    rows = phi(spark, sf)
    border = F.lit("2024-01-16").cast("timestamp")
    return (
        im.global_importance(rows.where(F.col("timestamp") < border)),
        im.global_importance(rows.where(F.col("timestamp") >= border)),
    )


DRIFT = f""", b AS (SELECT feature, i / sum(i) OVER () AS b FROM (SELECT feature, avg(abs(phi)) AS i FROM phi
        WHERE timestamp < {SPLIT} GROUP BY 1)),
    c AS (SELECT feature, i / sum(i) OVER () AS c FROM (SELECT feature, avg(abs(phi)) AS i FROM phi
        WHERE timestamp >= {SPLIT} AND feature <> 'humidity' GROUP BY 1)),
    drift AS (SELECT feature, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(c, 0) - coalesce(b, 0) AS d,
        CASE WHEN b > 0 THEN (coalesce(c, 0) - b) / b END AS r FROM b FULL JOIN c USING (feature)),
    flagged AS (SELECT *, (r IS NULL)::INT AS is_new, coalesce(abs(r) > 0.2, true)::INT AS significant FROM drift)"""


def _drift(spark, sf):
    before, after = halves(spark, sf)
    return im.importance_drift(before, after.where("feature <> 'humidity'"))


@query(
    "importance_drift_join",
    "phi",
    DRIFT + f" SELECT feature, {q6('b')} AS baseline_importance, {q6('c')} AS current_importance FROM drift",
)
def _(spark, sf):
    out = _drift(spark, sf).select("feature", "baseline_importance", "current_importance")
    return rounded(out, ["baseline_importance", "current_importance"])


DRIFT_COLS = ["baseline_importance", "current_importance", "absolute_change", "relative_change"]


@query(
    "importance_drift",
    "phi",
    DRIFT
    + f""" SELECT feature, {q6('b')} AS baseline_importance, {q6('c')} AS current_importance, {q6('d')} AS absolute_change,
    {q6('r')} AS relative_change, is_new, significant FROM flagged""",
)
def _(spark, sf):
    return rounded(_drift(spark, sf), DRIFT_COLS)


SEVERITY_SQL = "CASE WHEN score < 0.1 THEN 'none' WHEN score < 0.2 THEN 'low' WHEN score < 0.4 THEN 'medium' ELSE 'high' END"


@query(
    "importance_drift_summary",
    "phi",
    DRIFT
    + f""" SELECT {q6('score')} AS drift_score, n AS num_significant_changes, top AS top_changes, {SEVERITY_SQL} AS severity FROM
    (SELECT sum(abs(d)) / 2 AS score, sum(significant)::BIGINT AS n, string_agg(feature, ',' ORDER BY abs(d) DESC, feature) AS top
        FROM flagged)""",
)
def _(spark, sf):
    return rounded(im.drift_summary(_drift(spark, sf)), ["drift_score"])


def drift_lines(sign: str, plus: str, title: str) -> str:
    return f"""coalesce('{title}' || chr(10) || string_agg('  - `' || feature || '`: {plus}' || printf('%.1f', {nudge('r * 100')})
        || '% (now ' || printf('%.3f', {nudge('c')}) || ')' || chr(10), '' ORDER BY abs(d) DESC, feature)
        FILTER (d {sign} 0 AND significant = 1) || chr(10), '')"""


@query(
    "drift_text",
    "phi",
    DRIFT
    + f""", k AS (SELECT *, row_number() OVER (PARTITION BY significant ORDER BY abs(d) DESC, feature) AS k FROM flagged),
    t AS (SELECT sum(abs(d)) / 2 AS score, {drift_lines('>', '+', '**Features with INCREASED importance:**')}
        || {drift_lines('<', '', '**Features with DECREASED importance:**')} AS body,
        string_agg(CASE WHEN feature LIKE '%temperature%' THEN '  - Seasonal weather pattern change affecting `' || feature || '`'
            WHEN feature LIKE '%lag%' THEN '  - Change in load autocorrelation structure (`' || feature || '`)'
            ELSE '  - Data distribution shift in `' || feature || '`' END || chr(10), '' ORDER BY k)
            FILTER (significant = 1 AND k <= 2) AS causes, sum(significant) AS n FROM k)
    SELECT {SEVERITY_SQL} AS severity, CASE WHEN score < 0.1
        THEN 'No significant concept drift detected. Feature importance is stable.'
        ELSE '**Concept Drift Detected** (severity: ' || {SEVERITY_SQL} || ', score: ' || printf('%.3f', score + 1e-9) || ')'
        || chr(10) || chr(10) || CASE WHEN n = 0
            THEN 'Overall importance distribution has shifted, but no single feature dominates the change.'
            ELSE body || '**Possible causes:**' || chr(10) || causes || chr(10) || '**Recommended actions:**' || chr(10)
            || CASE WHEN score >= 0.4 THEN '  - Consider retraining the model with recent data' || chr(10)
                || '  - Investigate data quality issues' || chr(10)
               ELSE '  - Monitor closely over next few days' || chr(10) || '  - Schedule model refresh if drift persists' || chr(10)
               END END END AS text FROM t""",
)
def _(spark, sf):
    return nl.drift_text(_drift(spark, sf))


HISTORY = f""", b AS (SELECT feature, i / sum(i) OVER () AS b FROM (SELECT feature, avg(abs(phi)) AS i FROM phi
        WHERE timestamp < TIMESTAMP '2024-01-08' GROUP BY 1)),
    daily AS (SELECT timestamp::DATE AS date, feature, avg(abs(phi)) AS importance FROM phi GROUP BY 1, 2),
    share AS (SELECT date, feature, importance / sum(importance) OVER (PARTITION BY date) AS c FROM daily),
    history AS (SELECT date, sum(abs(c - b)) / 2 AS score FROM share JOIN b USING (feature) GROUP BY 1)"""


def _history(spark, sf):
    rows = phi(spark, sf)
    baseline = im.global_importance(rows.where(F.col("timestamp") < F.lit("2024-01-08").cast("timestamp")))
    daily = im.global_importance(rows.withColumn("date", F.to_date("timestamp")), ["date"])
    return baseline, daily


@query("drift_history", "phi", HISTORY + f" SELECT date, {q6('score')} AS drift_score, {SEVERITY_SQL} AS severity FROM history")
def _(spark, sf):
    baseline, daily = _history(spark, sf)
    out = im.drift_summary(im.importance_drift(baseline, daily, keys=["date"]), keys=["date"])
    return rounded(out.select("date", "drift_score", "severity"), ["drift_score"])


# The table of the history: recorded in two parts, one of them twice, then read back.
@query("drift_history_table", "phi", HISTORY + f" SELECT date, {q6('score')} AS drift_score, {SEVERITY_SQL} AS severity FROM history")
def _(spark, sf):
    baseline, daily = (cut_lineage(t) for t in _history(spark, sf))
    path = scratch_path(spark, "drift")
    im.save_baseline(baseline, path, "2024-01-01")
    middle = F.lit("2024-01-15").cast("date")
    for part in (daily.where(F.col("date") < middle), daily.where(F.col("date") >= middle), daily.where(F.col("date") >= middle)):
        im.record_drift(part, path)
    return rounded(im.read_drift_history(spark, path).select("date", "drift_score", "severity"), ["drift_score"])


@query(
    "drift_history_summary",
    "phi",
    HISTORY
    + f""", r AS (SELECT *, {SEVERITY_SQL} AS severity, row_number() OVER (ORDER BY date DESC) AS k FROM history)
    SELECT count(*) AS num_observations, count(*) FILTER (severity IN ('medium', 'high')) AS num_drift_events,
        string_agg(printf('%.4f', score + 1e-9), ',' ORDER BY date) FILTER (k <= 10) AS recent_drift_scores,
        (SELECT string_agg(feature, ',' ORDER BY b DESC, feature) FROM b) AS baseline_top_features FROM r""",
)
def _(spark, sf):
    baseline, daily = _history(spark, sf)
    scores = im.drift_summary(im.importance_drift(baseline, daily, keys=["date"]), keys=["date"])
    return im.drift_history_summary(scores, baseline)


@query(
    "importance_trend",
    "phi",
    f""", daily AS (SELECT timestamp::DATE AS date, feature, avg(abs(phi)) AS importance FROM phi GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY date DESC) AS rank FROM daily)
    SELECT date, feature, {q6('importance')} AS importance, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    return rounded(im.importance_trend(_history(spark, sf)[1]), ["importance"])


@query(
    "constraint_vector",
    "phi",
    f""", names AS (SELECT unnest([{', '.join(f"'{n}'" for n in ft.feature_names())}]) AS feature)
    SELECT feature, coalesce(importance, 0) AS importance, CASE WHEN feature = 'cdd' THEN 1 WHEN feature = 'hdd' THEN 1
        WHEN feature = 'temperature' THEN -1 WHEN contains(feature, 'cdd') THEN 1 WHEN contains(feature, 'hdd') THEN 1
        WHEN contains(feature, 'temperature') THEN -1 WHEN contains(feature, 'load_lag') THEN 1 ELSE 0 END AS monotone_constraint
    FROM names LEFT JOIN (SELECT feature, {q6('avg(abs(phi))')} AS importance FROM phi GROUP BY 1) USING (feature)""",
)
def _(spark, sf):
    names = spark.createDataFrame([(n,) for n in ft.feature_names()], "feature string")
    known = rounded(im.global_importance(phi(spark, sf)), ["importance"])
    listed = names.join(known, "feature", "left").fillna(0.0, ["importance"])
    return im.constraint_vector(listed, {"cdd": 1, "hdd": 1, "temperature": -1, "load_lag": 1})
