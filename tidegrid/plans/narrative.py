"""Texts for predictions, periods, alerts and drift, built with string expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.plans.importance import severity_of

ROW = ("series_id", "timestamp")

# Readable feature names.
DESCRIPTIONS = {
    "load_lag_1h": "load from 1 hour ago",
    "load_lag_2h": "load from 2 hours ago",
    "load_lag_24h": "load from same hour yesterday",
    "rolling_3h_mean": "average load over past 3 hours",
    "rolling_6h_mean": "average load over past 6 hours",
    "rolling_24h_mean": "average load over past 24 hours",
    "temperature": "current temperature",
    "humidity": "humidity level",
    "hour": "time of day",
    "day_of_week": "day of the week",
    "is_weekend": "weekend indicator",
    "is_holiday": "holiday indicator",
    "is_business_hour": "business hours",
    "ghi": "solar irradiance",
    "hdd": "heating degree days",
    "cdd": "cooling degree days",
}
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Sentences and line formats of the texts.
HEADER = "**Forecast for %s**"
PREDICTED = "Predicted load: **%.2f %s**"
UP_TITLE = "**Factors increasing load:**"
DOWN_TITLE = "**Factors decreasing load:**"
NEAR_AVERAGE = "Load is near the typical average for this period."
WITH_DRIVER = "Load is %.2f %s %s than average, primarily due to %s."
WITHOUT_DRIVER = "Load is %.2f %s %s than the typical average."
TABLE_HEAD = ["**Detailed breakdown:**", "| Feature | Value | Impact |", "|---------|-------|--------|"]
DRIFT_NONE = "No significant concept drift detected. Feature importance is stable."
DRIFT_HEAD = "**Concept Drift Detected** (severity: %s, score: %.3f)\n\n"
DRIFT_SPREAD = "Overall importance distribution has shifted, but no single feature dominates the change."
DRIFT_UP = "**Features with INCREASED importance:**\n"
DRIFT_DOWN = "**Features with DECREASED importance:**\n"
DRIFT_CAUSES = "**Possible causes:**\n"
CAUSES = {
    "temperature": "  - Seasonal weather pattern change affecting `%s`\n",
    "lag": "  - Change in load autocorrelation structure (`%s`)\n",
    "hour": "  - Shift in temporal consumption patterns (`%s`)\n",
    "day": "  - Shift in temporal consumption patterns (`%s`)\n",
    "holiday": "  - Holiday/calendar effects changing (`%s`)\n",
}
OTHER_CAUSE = "  - Data distribution shift in `%s`\n"
ACTIONS_TITLE = "\n**Recommended actions:**\n"
ACTIONS_HIGH = "  - Consider retraining the model with recent data\n  - Investigate data quality issues\n"
ACTIONS_ELSE = "  - Monitor closely over next few days\n  - Schedule model refresh if drift persists\n"


def fmt(pattern: str, *args: Column) -> Column:
    """``format_string`` whose numbers are pushed off the rounding tie."""
    return F.format_string(pattern, *args)


def _n(c: Column) -> Column:
    return c + F.signum(c) * 1e-9


def _names() -> Column:
    return F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])


def readable(feature: Column, plain: bool = False) -> Column:
    """Description of a feature; an unknown name keeps its text (``plain``) or loses its underscores."""
    return F.coalesce(F.try_element_at(_names(), feature), feature if plain else F.replace(feature, F.lit("_"), F.lit(" ")))


def value_text(feature: Column, value: Column, unit: str) -> Column:
    name = F.lower(feature)
    weekday = F.when(
        (value >= 0) & (value < 7), F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.floor(value).cast("int") + 1)
    ).otherwise(value.cast("string"))
    return (
        F.when(name.contains("hour"), fmt("%02d:00", value.cast("int")))
        .when(name.contains("day"), weekday)
        .when(name.contains("temperature"), fmt("%.1f°C", _n(value)))
        .when(name.contains("lag") | name.contains("rolling"), fmt(f"%.2f {unit}", _n(value)))
        .otherwise(fmt("%.2f", _n(value)))
    )


def with_contributions(phi: DataFrame, keys: Sequence[str] = ROW, n: int = 5) -> DataFrame:
    """One row per explained row with ``parts``: its ``n`` strongest contributions, strongest first.

    A table that has ``parts`` already stays where it is; a long one is grouped.
    """
    if "parts" in phi.columns:
        return phi.withColumn("parts", F.slice("parts", 1, n))
    part = F.struct(
        (-F.abs("phi")).alias("o"), F.col("feature").alias("feature"), F.col("value").alias("value"), F.col("phi").alias("phi")
    )
    return phi.groupBy(*keys, "prediction", "base_value").agg(F.slice(F.sort_array(F.collect_list(part)), 1, n).alias("parts"))


def explain_rows(phi: DataFrame, keys: Sequence[str] = ROW, unit: str = "kW", details: bool = True, ts: str = "timestamp") -> DataFrame:
    """Text for every explained row."""
    rows = with_contributions(phi, keys)
    up = F.filter("parts", lambda x: x["phi"] > 0)
    down = F.filter("parts", lambda x: x["phi"] < 0)

    def bullets(parts: Column, word: str) -> Column:
        def line(x: Column) -> Column:
            head = F.when(x["value"].isNotNull(), fmt("%s (%s)", readable(x["feature"]), value_text(x["feature"], x["value"], unit)))
            return fmt(f"  • %s is {word} load by %.2f {unit}", F.coalesce(head, readable(x["feature"])), _n(F.abs(x["phi"])))

        return F.transform(F.slice(parts, 1, 3), line)

    def block(parts: Column, title: str, word: str) -> Column:
        lines = F.concat(F.array(F.lit(title)), bullets(parts, word), F.array(F.lit("")))
        return F.when(F.size(parts) > 0, lines).otherwise(F.array().cast("array<string>"))

    diff = F.col("prediction") - F.col("base_value")
    direction = F.when(diff > 0, "higher").otherwise("lower")
    driver = F.when(diff > 0, F.try_element_at(up, F.lit(1))["feature"]).when(diff < 0, F.try_element_at(down, F.lit(1))["feature"])
    context = (
        F.when(F.abs(diff) < 0.1, NEAR_AVERAGE)
        .when(driver.isNotNull(), fmt(WITH_DRIVER, _n(F.abs(diff)), F.lit(unit), direction, readable(driver)))
        .otherwise(fmt(WITHOUT_DRIVER, _n(F.abs(diff)), F.lit(unit), direction))
    )
    lines = [
        F.array(
            fmt(HEADER, F.date_format(ts, "EEEE, MMMM dd 'at' HH:mm")),
            fmt(PREDICTED, _n(F.col("prediction")), F.lit(unit)),
            F.lit(""),
        ),
        block(up, UP_TITLE, "increasing"),
        block(down, DOWN_TITLE, "decreasing"),
        F.array(F.concat(F.lit("*"), context, F.lit("*"))),
    ]
    if details:

        def table_line(x: Column) -> Column:
            impact = F.when(x["phi"] > 0, fmt("+%.3f", _n(x["phi"]))).otherwise(fmt("%.3f", _n(x["phi"])))
            return fmt("| %s | %s | %s |", x["feature"], F.coalesce(fmt("%.2f", _n(x["value"])), F.lit("N/A")), impact)

        lines += [F.array(F.lit(""), *[F.lit(t) for t in TABLE_HEAD]), F.transform("parts", table_line)]
    return rows.select(*keys, F.array_join(F.concat(*lines), "\n").alias("explanation"))


def alert_rows(phi: DataFrame, threshold: float, keys: Sequence[str] = ROW, unit: str = "kW", ts: str = "timestamp") -> DataFrame:
    """Alert text for every explained row: HIGH LOAD above the threshold, else LOW LOAD."""
    rows = with_contributions(phi, keys, 3)
    kind = F.when(F.col("prediction") > threshold, "HIGH LOAD").otherwise("LOW LOAD")
    head = fmt("⚠️ **%s ALERT** for %s\n\n", kind, F.date_format(ts, "HH:mm 'on' MMM dd"))
    level = fmt(f"Predicted: %.2f {unit} (threshold: %.2f {unit})\n\n", _n(F.col("prediction")), F.lit(threshold + 1e-9))
    lines = F.transform("parts", lambda x: fmt(f"  • %s: %+.2f {unit}\n", readable(x["feature"], True), _n(x["phi"])))
    text = F.concat(head, level, F.lit("**Contributing factors:**\n"), F.array_join(lines, ""))
    return rows.select(*keys, kind.alias("alert_type"), text.alias("message"))


def summary_report(phi: DataFrame, group: Sequence[str] = ("series_id",), ts: str = "timestamp", unit: str = "kW", period: str = "forecast period"):
    """One report per group: statistics, five main drivers and the three main contributors to the peak."""
    rows = with_contributions(phi, [*group, ts], 3)
    stats = rows.groupBy(*group).agg(
        F.avg("prediction").alias("mean"),
        F.max("prediction").alias("peak"),
        F.min("prediction").alias("low"),
        F.stddev_pop("prediction").alias("std"),
        F.max_by("parts", F.struct(F.col("prediction"), -F.unix_seconds(ts))).alias("peak_parts"),
    )
    long = phi.select(*group, F.inline("parts")) if "parts" in phi.columns else phi
    importance = long.groupBy(*group, "feature").agg(F.avg(F.abs("phi")).alias("importance"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), F.col("feature").alias("f"))))
    drivers = importance.groupBy(*group).agg(F.slice(ranked, 1, 5).alias("drivers"))
    lines = F.concat(
        F.array(
            F.lit(f"# Load Forecast Summary: {period}"),
            F.lit(""),
            F.lit("## Forecast Statistics"),
            fmt(f"- **Mean load**: %.2f {unit}", _n(F.col("mean"))),
            fmt(f"- **Peak load**: %.2f {unit}", _n(F.col("peak"))),
            fmt(f"- **Minimum load**: %.2f {unit}", _n(F.col("low"))),
            fmt(f"- **Std deviation**: %.2f {unit}", _n(F.col("std"))),
            F.lit(""),
            F.lit("## Key Drivers"),
        ),
        F.transform("drivers", lambda x: fmt(f"- **%s**: avg impact %.3f {unit}", readable(x["f"], True), _n(-x["o"]))),
        F.array(
            F.lit(""),
            F.lit("## Peak Load Analysis"),
            fmt(f"Peak of %.2f {unit}", _n(F.col("peak"))),
            F.lit("Main contributors to peak:"),
        ),
        F.transform("peak_parts", lambda x: fmt(f"  - %s: %+.3f {unit}", readable(x["feature"], True), _n(x["phi"]))),
    )
    return stats.join(drivers, list(group)).select(*group, F.array_join(lines, "\n").alias("report"))


def drift_text(drift: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Explanation of an importance drift table (one row per feature and key)."""
    part = F.struct(
        (-F.abs("absolute_change")).alias("o"),
        F.col("feature").alias("f"),
        F.col("absolute_change").alias("d"),
        F.col("relative_change").alias("r"),
        F.col("current_importance").alias("c"),
    )
    rows = drift.groupBy(*keys).agg(
        (F.sum(F.abs("absolute_change")) / 2).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("significant") == 1, part))).alias("s"),
    )
    severity = severity_of(F.col("score"))

    def change_line(x: Column) -> Column:
        plus = F.when(x["d"] > 0, "+").otherwise("")
        pct = F.coalesce(F.concat(plus, fmt("%.1f%%", _n(x["r"] * 100))), F.lit("new"))
        return fmt("  - `%s`: %s (now %.3f)\n", x["f"], pct, _n(x["c"]))

    def block(parts: Column, title: str) -> Column:
        body = F.concat(F.lit(title), F.array_join(F.transform(F.slice(parts, 1, 3), change_line), ""), F.lit("\n"))
        return F.when(F.size(parts) > 0, body).otherwise("")

    def cause(x: Column) -> Column:
        out = fmt(OTHER_CAUSE, x["f"])
        for word, text in reversed(CAUSES.items()):
            out = F.when(F.lower(x["f"]).contains(word), fmt(text, x["f"])).otherwise(out)
        return out

    head = fmt(DRIFT_HEAD, severity, _n(F.col("score")))
    body = F.concat(
        head,
        block(F.filter("s", lambda x: x["d"] > 0), DRIFT_UP),
        block(F.filter("s", lambda x: x["d"] < 0), DRIFT_DOWN),
        F.lit(DRIFT_CAUSES),
        F.array_join(F.transform(F.slice("s", 1, 2), cause), ""),
        F.lit(ACTIONS_TITLE),
        F.when(severity == "high", ACTIONS_HIGH).otherwise(ACTIONS_ELSE),
    )
    text = (
        F.when(severity == "none", DRIFT_NONE).when(F.size("s") == 0, F.concat(head, F.lit(DRIFT_SPREAD))).otherwise(body)
    )
    return rows.select(*keys, severity.alias("severity"), text.alias("text"))
