"""Profile and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import joins
from tidegrid.operators.guards import rounded
from tidegrid.plans import profile as p
from tidegrid.registry.common import q6, query
from tidegrid.sources import views as v

COV = ["temperature", "humidity", "wind_speed", "precipitation"]


def merged(spark, sf):
    return joins.merge_load_weather(v.load_hourly(spark, sf), v.weather_hourly(spark, sf), check=False)


MERGED = ", merged AS (SELECT l.*, w.* EXCLUDE (timestamp) FROM load_hourly l LEFT JOIN weather w USING (timestamp))"


def union_columns(columns, template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query(
    "basic_profile",
    "load_hourly",
    """SELECT series_id, count(*) AS n_rows, min(timestamp) AS start, max(timestamp) AS "end",
        (epoch(max(timestamp)) - epoch(min(timestamp)))::BIGINT // 86400 AS duration_days, 1::BIGINT AS n_columns,
        'load' AS columns FROM load_hourly GROUP BY 1""",
)
def _(spark, sf):
    return p.basic_profile(v.load_hourly(spark, sf))


@query(
    "missing_profile",
    "load_hourly weather",
    MERGED
    + union_columns(
        ["load", *COV],
        f""" SELECT series_id, '{{c}}' AS "column", count(*) FILTER ({{c}} IS NULL) AS missing_count,
        min(timestamp) FILTER ({{c}} IS NULL) AS first_missing, max(timestamp) FILTER ({{c}} IS NULL) AS last_missing,
        {q6('count(*) FILTER ({c} IS NULL) / count(*)')} AS missing_ratio,
        (count(*) FILTER ({{c}} IS NULL) / count(*) > 0.05)::INT AS above_limit FROM merged GROUP BY 1""",
    ),
)
def _(spark, sf):
    return rounded(p.missing_profile(merged(spark, sf), ["load", *COV]), ["missing_ratio"])


@query(
    "temporal_coverage",
    "load_hourly",
    f"""SELECT series_id, n_expected, n_actual, n_expected - n_actual AS n_missing, {q6('n_actual / n_expected')} AS coverage
    FROM (SELECT series_id, date_diff('hour', min(timestamp), max(timestamp)) + 1 AS n_expected, count(*) AS n_actual
        FROM load_hourly GROUP BY 1)""",
)
def _(spark, sf):
    return rounded(p.temporal_coverage(v.load_hourly(spark, sf)), ["coverage"])


DIST = {
    "mean": "avg(load)",
    "std": "stddev_samp(load)",
    "min": "min(load)",
    "max": "max(load)",
    "q25": "quantile_cont(load, 0.25)",
    "median": "quantile_cont(load, 0.5)",
    "q75": "quantile_cont(load, 0.75)",
    "skewness": "skewness(load)",
    "kurtosis": "kurtosis(load)",
    "cv": "stddev_samp(load) / avg(load)",
}


def dist_sql(table: str) -> str:
    return f"SELECT series_id, {', '.join(f'{q6(e)} AS {n}' for n, e in DIST.items())} FROM {table} GROUP BY 1"


@query("distribution_stats", "load_hourly", dist_sql("load_hourly"))
def _(spark, sf):
    return rounded(p.distribution_stats(v.load_hourly(spark, sf)), DIST)


@query("distribution_stats_supplier", "load_supplier_daily", dist_sql("load_supplier_daily"))
def _(spark, sf):
    return rounded(p.distribution_stats(v.load_supplier_daily(spark, sf)), DIST)


# The same operator on line-item prices per return flag: few keys, each with a third of all rows.
@query(
    "distribution_stats_hot_keys",
    "",
    f", hot AS (SELECT l_returnflag AS series_id, l_extendedprice AS load FROM lineitem) {dist_sql('hot')}".replace(", hot", "WITH hot", 1),
)
def _(spark, sf):
    hot = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_extendedprice").alias("load"))
    return rounded(p.distribution_stats(hot), DIST)


REF = ["load", "temperature", "humidity", "wind_speed"]


@query(
    "reference_stats",
    "load_hourly weather",
    MERGED
    + union_columns(
        REF,
        f""" SELECT '{{c}}' AS "column", {q6('avg({c})')} AS mean, {q6('stddev_samp({c})')} AS std, {q6('min({c})')} AS min,
        {q6('max({c})')} AS max, {q6('quantile_cont({c}, 0.25)')} AS q25, {q6('quantile_cont({c}, 0.5)')} AS q50,
        {q6('quantile_cont({c}, 0.75)')} AS q75 FROM merged""",
    ),
)
def _(spark, sf):
    return rounded(p.reference_stats(merged(spark, sf), REF), ["mean", "std", "min", "max", "q25", "q50", "q75"])


@query(
    "seasonality",
    "load_daily",
    f""", g AS (SELECT series_id, hour(timestamp) AS h, isodow(timestamp) - 1 AS d, month(timestamp) AS m, load FROM load_daily),
    s AS (SELECT series_id, 'hour' AS grain, h AS bucket, avg(load) AS mean, stddev_samp(load) AS std FROM g GROUP BY 1, 3
        UNION ALL SELECT series_id, 'day_of_week', d, avg(load), stddev_samp(load) FROM g GROUP BY 1, 3
        UNION ALL SELECT series_id, 'month', m, avg(load), stddev_samp(load) FROM g GROUP BY 1, 3)
    SELECT series_id, grain, bucket::INT AS bucket, {q6('mean', 3)} AS mean, {q6('std', 3)} AS std,
        (row_number() OVER (PARTITION BY series_id, grain ORDER BY mean DESC, bucket) = 1)::INT AS is_peak,
        (row_number() OVER (PARTITION BY series_id, grain ORDER BY mean, bucket) = 1)::INT AS is_low FROM s""",
)
def _(spark, sf):
    return rounded(p.seasonality(v.load_daily(spark, sf)), ["mean", "std"], 3)


@query(
    "weekend_profile",
    "load_hourly",
    f"""SELECT series_id, (isodow(timestamp) >= 6)::INT AS is_weekend, hour(timestamp)::INT AS hour, {q6('avg(load)')} AS mean
    FROM load_hourly GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(p.weekend_profile(v.load_hourly(spark, sf)), ["mean"])


@query(
    "outliers_zscore",
    "load_hourly",
    f""", s AS (SELECT series_id, avg(load) AS m, stddev_pop(load) AS sd FROM load_hourly GROUP BY 1)
    SELECT series_id, count(*) FILTER (abs(load - m) / sd > 2) AS n_outliers, count(load) AS n_values,
        {q6('count(*) FILTER (abs(load - m) / sd > 2) / count(load)')} AS outlier_ratio
    FROM load_hourly JOIN s USING (series_id) GROUP BY 1""",
)
def _(spark, sf):
    return rounded(p.outliers_zscore(v.load_hourly(spark, sf), limit=2.0), ["outlier_ratio"])


@query(
    "outliers_iqr",
    "load_hourly",
    f""", q AS (SELECT series_id, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM load_hourly GROUP BY 1),
    b AS (SELECT series_id, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT series_id, {q6('lo')} AS lower_bound, {q6('hi')} AS upper_bound, count(*) FILTER (load < lo OR load > hi) AS n_outliers,
        count(load) AS n_values, {q6('count(*) FILTER (load < lo OR load > hi) / count(load)')} AS outlier_ratio
    FROM load_hourly JOIN b USING (series_id) GROUP BY series_id, lo, hi""",
)
def _(spark, sf):
    return rounded(p.outliers_iqr(v.load_hourly(spark, sf)), ["lower_bound", "upper_bound", "outlier_ratio"])


QUALITY = ["load", "temperature", "humidity"]


@query(
    "data_quality",
    "load_hourly weather",
    MERGED
    + f""", s AS (SELECT series_id, {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in QUALITY)}
        FROM merged GROUP BY 1), j AS (SELECT * FROM merged JOIN s USING (series_id))
    SELECT series_id, 'row_count' AS "check", NULL AS "column", count(*)::DOUBLE AS value, 8760.0::DOUBLE AS threshold,
        (count(*) >= 8760)::INT AS passed FROM j GROUP BY 1 UNION ALL """
    + union_columns(
        QUALITY,
        f"""SELECT series_id, 'missing_ratio', '{{c}}', {q6('count(*) FILTER ({c} IS NULL) / count(*)')}, 0.1,
            (count(*) FILTER ({{c}} IS NULL) / count(*) <= 0.1)::INT FROM j GROUP BY 1 UNION ALL
        SELECT series_id, 'outlier_ratio', '{{c}}', {q6('count(*) FILTER (abs({c} - m_{c}) > 2 * s_{c}) / count(*)')}, NULL, 1
            FROM j GROUP BY 1""",
    ),
)
def _(spark, sf):
    return rounded(p.data_quality(merged(spark, sf), QUALITY, outlier_std=2.0), ["value"])


@query(
    "data_quality_summary",
    "load_hourly weather",
    MERGED
    + """ SELECT series_id, (count(*) >= 8760 AND count(*) FILTER (temperature IS NULL) / count(*) <= 0.03)::INT AS passed,
        (count(*) < 8760)::BIGINT + (count(*) FILTER (temperature IS NULL) / count(*) > 0.03)::BIGINT AS n_issues,
        concat_ws('; ', CASE WHEN count(*) FILTER (temperature IS NULL) / count(*) > 0.03 THEN 'missing_ratio temperature' END,
            CASE WHEN count(*) < 8760 THEN 'row_count' END) AS issues FROM merged GROUP BY 1""",
)
def _(spark, sf):
    return p.quality_summary(p.data_quality(merged(spark, sf), ["load", "temperature"], max_missing_ratio=0.03))


GAPS = """, span AS (SELECT series_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
    FROM load_hourly GROUP BY 1), gone AS (SELECT * FROM span ANTI JOIN load_hourly USING (series_id, timestamp))"""


@query("missing_timestamps", "load_hourly", GAPS + " SELECT * FROM gone")
def _(spark, sf):
    return joins.missing_timestamps(v.load_hourly(spark, sf))


# The raw event hours are used, so every timestamp has copies.
@query(
    "temporal_consistency",
    "load_hourly",
    GAPS
    + """, raw AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp FROM events),
    d AS (SELECT series_id, epoch(timestamp)::BIGINT - epoch(lag(timestamp) OVER (PARTITION BY series_id ORDER BY timestamp))::BIGINT
        AS step FROM raw),
    k AS (SELECT series_id, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT series_id, arg_min(step, -n * 1000000000 + step) AS usual, sum(n) - max(n) AS irregular FROM k GROUP BY 1),
    g AS (SELECT series_id, count(*) AS n_gaps FROM gone GROUP BY 1),
    f AS (SELECT series_id, string_agg(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY timestamp) AS first_gaps
        FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS r FROM gone) WHERE r <= 10 GROUP BY 1)
    SELECT series_id, min(timestamp) AS start, max(timestamp) AS "end", count(*) AS n_rows,
        count(*) - count(DISTINCT timestamp) AS n_duplicates, max(usual)::BIGINT AS usual_step_seconds,
        max(irregular)::BIGINT AS n_irregular, coalesce(max(n_gaps), 0) AS n_gaps, coalesce(max(first_gaps), '') AS first_gaps
    FROM raw LEFT JOIN u USING (series_id) LEFT JOIN g USING (series_id) LEFT JOIN f USING (series_id) GROUP BY 1""",
)
def _(spark, sf):
    raw = v.table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp")
    )
    return p.temporal_consistency(raw)


@query(
    "covariate_stats",
    "load_hourly weather",
    MERGED
    + union_columns(
        COV,
        f""" SELECT '{{c}}' AS "column", {q6('avg({c})')} AS mean, {q6('stddev_samp({c})')} AS std, {q6('min({c})')} AS min,
        {q6('max({c})')} AS max, {q6('count(*) FILTER ({c} IS NULL) / count(*)')} AS missing_ratio FROM merged""",
    ),
)
def _(spark, sf):
    return rounded(p.covariate_stats(merged(spark, sf), COV), ["mean", "std", "min", "max", "missing_ratio"])


@query(
    "load_weather_corr",
    "load_hourly weather",
    MERGED
    + union_columns(COV, f""" SELECT series_id, '{{c}}' AS "column", {q6('corr(load, {c})')} AS correlation FROM merged GROUP BY 1"""),
)
def _(spark, sf):
    return rounded(p.load_weather_corr(merged(spark, sf), COV), ["correlation"])


@query(
    "autocorr_lags",
    "load_hourly",
    ", l AS (SELECT series_id, load, "
    + ", ".join(f"lag(load, {k}) OVER w AS l{k}" for k in p.LAGS)
    + " FROM load_hourly WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)) "
    + " UNION ALL ".join(f"SELECT series_id, {k} AS lag, {q6(f'corr(load, l{k})')} AS autocorrelation FROM l GROUP BY 1" for k in p.LAGS),
)
def _(spark, sf):
    return rounded(p.autocorr_lags(v.load_hourly(spark, sf)), ["autocorrelation"])


@query(
    "acf",
    "load_hourly",
    f""", o AS (SELECT series_id, load - avg(load) OVER (PARTITION BY series_id) AS d,
        row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS i FROM load_hourly),
    v AS (SELECT series_id, sum(d * d) AS v FROM o GROUP BY 1)
    SELECT a.series_id, k::INT AS lag, {q6('sum(a.d * b.d) / max(v.v)')} AS acf
    FROM o a JOIN range(0, 169) t(k) ON true JOIN o b ON b.series_id = a.series_id AND b.i = a.i - k
    JOIN v ON v.series_id = a.series_id GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(p.acf(v.load_hourly(spark, sf)), ["acf"])


# The recursion on the list of autocorrelations: phi holds the coefficients of order k - 1.
@query(
    "pacf",
    "load_hourly",
    f""", o AS (SELECT series_id, load - avg(load) OVER (PARTITION BY series_id) AS d,
        row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS i FROM load_hourly),
    v AS (SELECT series_id, sum(d * d) AS v FROM o GROUP BY 1),
    a AS (SELECT a.series_id, k, sum(a.d * b.d) / max(v.v) AS rho FROM o a JOIN range(0, 51) t(k) ON true
        JOIN o b ON b.series_id = a.series_id AND b.i = a.i - k JOIN v ON v.series_id = a.series_id GROUP BY 1, 2),
    r AS (SELECT series_id, list(rho ORDER BY k) AS rho FROM a GROUP BY 1),
    s AS (
      SELECT series_id, rho, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS last FROM r
      UNION ALL
      SELECT series_id, rho, k + 1, list_append(list_transform(phi, lambda x, j: x - now * phi[len(phi) - j + 1]), now), now FROM (
        SELECT series_id, rho, k, phi, coalesce(
          (rho[k + 2] - coalesce(list_sum(list_transform(phi, lambda x, j: x * rho[k + 2 - j])), 0))
          / nullif(1 - coalesce(list_sum(list_transform(phi, lambda x, j: x * rho[j + 1])), 0), 0), 0) AS now
        FROM s WHERE k + 1 < len(rho)))
    SELECT series_id, k::INT AS lag, {q6('last', 4)} AS pacf FROM s""",
)
def _(spark, sf):
    return rounded(p.pacf(v.load_hourly(spark, sf)), ["pacf"], 4)


@query(
    "linear_trend",
    "load_hourly weather",
    MERGED
    + union_columns(
        COV,
        f""" SELECT series_id, '{{c}}' AS "column", {q6('regr_slope(load, {c})')} AS slope,
        {q6('regr_intercept(load, {c})')} AS intercept, {q6('corr(load, {c})')} AS correlation FROM merged GROUP BY 1""",
    ),
)
def _(spark, sf):
    return rounded(p.linear_trend(merged(spark, sf), COV), ["slope", "intercept", "correlation"])


@query(
    "daily_missing",
    "load_hourly weather",
    MERGED
    + union_columns(
        COV,
        """ SELECT series_id, timestamp::DATE AS date, '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_missing
        FROM merged GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return p.daily_missing(merged(spark, sf), COV)


@query(
    "resample_hourly",
    "load_15min",
    f"""SELECT series_id, date_trunc('hour', timestamp) AS timestamp, {q6('sum(kw / 4)')} AS load FROM load_15min GROUP BY 1, 2
    HAVING sum(kw / 4) > 0""",
)
def _(spark, sf):
    return rounded(p.resample_hourly(v.load_15min(spark, sf)), ["load"])


@query(
    "resample_multi",
    "load_15min",
    " UNION ALL ".join(
        f"SELECT series_id, {e} AS timestamp, {q6('sum(kw / 4)')} AS load, '{g}' AS grain FROM load_15min GROUP BY 1, 2"
        for g, e in (
            ("15min", "timestamp"),
            ("hour", "date_trunc('hour', timestamp)"),
            ("day", "date_trunc('day', timestamp)::TIMESTAMP"),
        )
    ),
)
def _(spark, sf):
    return rounded(p.resample_multi(v.load_15min(spark, sf)), ["load"])


@query(
    "source_summary",
    "load_hourly weather solar",
    f""", s AS (SELECT 'load' AS source, count(*) AS n_rows, 2::BIGINT AS n_columns, min(timestamp) AS start, max(timestamp) AS "end",
        {q6('100.0 * (count(*) - count(load)) / (2 * count(*))')} AS missing_pct FROM load_hourly UNION ALL
    SELECT 'weather', count(*), 7, min(timestamp), max(timestamp), 0.0 FROM weather UNION ALL
    SELECT 'solar', count(*), 5, min(timestamp), max(timestamp), 0.0 FROM solar)
    SELECT *, (SELECT max(start) FROM s) AS common_start, (SELECT min("end") FROM s) AS common_end FROM s""",
)
def _(spark, sf):
    sources = {"load": v.load_hourly(spark, sf), "weather": v.weather_hourly(spark, sf), "solar": v.solar_hourly(spark, sf)}
    return rounded(p.source_summary(sources), ["missing_pct"])


def _report_sql() -> str:
    lag_cols = ", ".join(f"lag(load, {k}) OVER w AS l{k}" for k in p.LAGS)
    parts = []

    def add(section: str, item: str, metric: str, expr: str, table: str = "merged") -> None:
        parts.append(
            f"SELECT series_id, '{section}' AS section, '{item}' AS item, '{metric}' AS metric, {q6(expr)} AS value FROM {table} GROUP BY 1"
        )

    add("basic", "", "n_rows", "count(*)")
    add("basic", "", "duration_days", "(epoch(max(timestamp)) - epoch(min(timestamp)))::BIGINT // 86400")
    add("basic", "", "n_columns", "8")
    for c in ("load", "temperature", "humidity"):
        add("missing", c, "missing_count", f"count(*) FILTER ({c} IS NULL)")
        add("missing", c, "missing_ratio", f"count(*) FILTER ({c} IS NULL) / count(*)")
    expected = "(date_diff('hour', min(timestamp), max(timestamp)) + 1)"
    for m, e in (
        ("n_expected", expected), ("n_actual", "count(*)"), ("n_missing", f"{expected} - count(*)"), ("coverage", f"count(*) / {expected}")
    ):
        add("coverage", "", m, e)
    for m, e in DIST.items():
        add("distribution", "", m, e)
    for k in p.LAGS:
        add("autocorrelation", str(k), "autocorrelation", f"corr(load, l{k})", "lags")
    add("outliers_zscore", "", "n_outliers", "count(*) FILTER (abs(load - m) / sd > 5)", "stats")
    add("outliers_zscore", "", "outlier_ratio", "count(*) FILTER (abs(load - m) / sd > 5) / count(load)", "stats")
    add("outliers_iqr", "", "n_outliers", "count(*) FILTER (load < lo OR load > hi)", "stats")
    add("outliers_iqr", "", "lower_bound", "max(lo)", "stats")
    add("outliers_iqr", "", "upper_bound", "max(hi)", "stats")
    for c in ("temperature", "humidity"):
        add("correlation", c, "correlation", f"corr(load, {c})")
        for m, e in (("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("max", "max({c})"), ("missing_ratio", "count(*) FILTER ({c} IS NULL) / count(*)")):
            add("covariates", c, m, e.format(c=c))
        add("trend", c, "slope", f"regr_slope(load, {c})")
        add("trend", c, "intercept", f"regr_intercept(load, {c})")
    grains = {"hour": "hour(timestamp)", "day_of_week": "isodow(timestamp) - 1", "month": "month(timestamp)"}
    for grain, e in grains.items():
        for m, value in (("mean", "avg(load)"), ("std", "stddev_samp(load)")):
            parts.append(f"SELECT series_id, 'seasonality', '{grain} ' || ({e})::INT, '{m}', {q6(value)} FROM merged GROUP BY 1, {e}")
    parts.append(f"SELECT series_id, 'weekend', (isodow(timestamp) >= 6)::INT || ' ' || hour(timestamp)::INT, 'mean', {q6('avg(load)')} FROM merged GROUP BY 1, 3")
    issues = ["(count(*) < 8760)::INT", *[f"(count(*) FILTER ({c} IS NULL) / count(*) > 0.1)::INT" for c in ("load", "temperature", "humidity")]]
    add("quality", "", "n_issues", " + ".join(issues))
    add("quality", "", "passed", f"({' + '.join(issues)} = 0)::INT")
    add("consistency", "", "n_duplicates", "count(*) - count(DISTINCT timestamp)")
    add("consistency", "", "n_gaps", "(date_diff('hour', min(timestamp), max(timestamp)) + 1) - count(DISTINCT timestamp)")
    for m, e in (("usual_step_seconds", "arg_min(step, -n * 1000000000 + step)"), ("n_irregular", "sum(n) - max(n)")):
        add("consistency", "", m, e, "steps")
    parts.append(f"""SELECT a.series_id, 'acf', k::INT::VARCHAR, 'acf', {q6('sum(a.d * b.d) / max(vv.v)')} FROM o a JOIN range(0, 169) t(k) ON true
        JOIN o b ON b.series_id = a.series_id AND b.i = a.i - k JOIN vv ON vv.series_id = a.series_id GROUP BY a.series_id, k""")
    return (
        MERGED
        + f""", lags AS (SELECT series_id, load, {lag_cols} FROM load_hourly WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)),
        m AS (SELECT series_id, avg(load) AS m, stddev_pop(load) AS sd, quantile_cont(load, 0.25) AS q1,
            quantile_cont(load, 0.75) AS q3 FROM load_hourly GROUP BY 1),
        stats AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM load_hourly JOIN m USING (series_id)),
        dd AS (SELECT series_id, epoch(timestamp)::BIGINT - epoch(lag(timestamp) OVER (PARTITION BY series_id ORDER BY timestamp))::BIGINT
            AS step FROM load_hourly),
        steps AS (SELECT series_id, step, count(*) AS n FROM dd WHERE step IS NOT NULL GROUP BY 1, 2),
        o AS (SELECT series_id, load - avg(load) OVER (PARTITION BY series_id) AS d,
            row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS i FROM load_hourly),
        vv AS (SELECT series_id, sum(d * d) AS v FROM o GROUP BY 1) """
        + " UNION ALL ".join(parts)
    )


@query("profile_report", "load_hourly weather", _report_sql())
def _(spark, sf):
    return rounded(p.profile_report(merged(spark, sf), ["temperature", "humidity"]), ["value"])
