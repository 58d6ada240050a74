"""Attributions and importance tables.  An attribution table is long: (keys, prediction, base_value, feature, value, phi)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import edge_rows, Grid
from tidegrid.operators.guards import flag, ratio
from tidegrid.operators.ranks import percentiles
from tidegrid.session import cut_lineage

ROW = ("series_id", "timestamp")


def linear_score(terms: Mapping[str, float], intercept: float = 0.0, overrides: Mapping[str, Column] | None = None) -> Column:
    given = overrides or {}
    return reduce(lambda a, b: a + b, [F.lit(w) * given.get(f, F.col(f)) for f, w in terms.items()], F.lit(intercept))


def linear_shap(
    df: DataFrame,
    terms: Mapping[str, float],
    intercept: float = 0.0,
    background: DataFrame | None = None,
    keys: Sequence[str] = ROW,
    long: bool = True,
) -> DataFrame:
    """Exact attributions of a linear model: weight times distance from the background mean.

    ``long`` gives a row per feature; otherwise a row keeps its contributions as the array ``parts``, strongest first, which
    the texts and ``top_contributions`` read without a shuffle.
    """
    means = (df if background is None else background).agg(F.struct(*[F.avg(f).alias(f) for f in terms])).scalar()
    rows = df.select(*keys, *terms).withColumn("_mean", means)
    base = linear_score(terms, intercept, {f: F.col("_mean")[f] for f in terms})
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("value"),
                (F.lit(w) * (F.col(f) - F.col("_mean")[f])).alias("phi"),
            )
            for f, w in terms.items()
        ]
    )
    scored = rows.select(*keys, linear_score(terms, intercept).alias("prediction"), base.alias("base_value"), parts.alias("_p"))
    if long:
        return scored.select(*keys, "prediction", "base_value", F.inline("_p"))
    return scored.select(*keys, "prediction", "base_value", strongest_first("_p").alias("parts"))


def strongest_first(parts: str) -> Column:
    """An array of (feature, value, phi) by falling size of phi, then by feature, with that order in front."""
    return F.array_sort(
        F.transform(parts, lambda x: F.struct((-F.abs(x["phi"])).alias("o"), x["feature"].alias("feature"), x["value"].alias("value"), x["phi"].alias("phi")))
    )


def global_importance(phi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def top_importance(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def time_varying_importance(phi: DataFrame, aggregation: str = "mean", ts: str = "timestamp") -> DataFrame:
    """Importance by hour, weekday and month; ``mean``, or the median for any other name."""
    names = ["hour", "day_of_week", "month"]
    parts = phi.select(
        "feature",
        F.abs("phi").alias("_a"),
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        F.month(ts).alias("month"),
    )
    if aggregation == "mean":
        sets = [[F.col("feature"), F.col(n)] for n in names]
        grouped = parts.groupingSets(sets, F.col("feature"), *[F.col(n) for n in names]).agg(F.avg("_a").alias("importance"))
        grain = F.lit(names[-1])
        for n in reversed(names[:-1]):
            grain = F.when(F.col(n).isNotNull(), n).otherwise(grain)
        return grouped.select(grain.alias("grain"), F.coalesce(*names).alias("bucket"), "feature", "importance")
    long = parts.unpivot(["feature", "_a"], names, "grain", "bucket")
    return percentiles(long, ["grain", "bucket", "feature"], "_a", {"importance": 0.5})


def importance_heatmap(phi: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` features with the largest mean over the hours, one column per hour."""
    hourly = time_varying_importance(phi).where("grain = 'hour'")
    table = hourly.groupBy("feature").pivot("bucket", list(range(24))).agg(F.max("importance"))
    means = hourly.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    best = means.orderBy(F.desc("mean_importance"), "feature").limit(n)
    return best.join(table, "feature").withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


def top_contributions(phi: DataFrame, n: int = 5, keys: Sequence[str] = ROW) -> DataFrame:
    """The ``n`` strongest contributions of each explained row (a row has one entry per feature, or the array ``parts``)."""
    if "parts" in phi.columns:
        each = phi.select(*keys, F.posexplode(F.slice("parts", 1, n)).alias("_i", "_x"))
        return each.select(*keys, (F.col("_i") + 1).alias("rank"), "_x.feature", "_x.value", "_x.phi", F.abs("_x.phi").alias("abs_phi"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("phi")), "feature")
    ranked = phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select(*keys, "rank", "feature", "value", "phi", F.abs("phi").alias("abs_phi"))


def importance_comparison(model: DataFrame, shap: DataFrame, n: int = 10) -> DataFrame:
    """Both importances divided by their largest value, top ``n`` by attribution."""
    both = model.select("feature", F.col("importance").alias("importance_model")).join(
        shap.select("feature", F.col("importance").alias("importance_shap")), "feature"
    )
    peaks = both.agg(F.struct(F.max("importance_model").alias("m"), F.max("importance_shap").alias("s"))).scalar()
    out = both.withColumn("_peak", peaks).withColumns(
        {
            "model_norm": ratio(F.col("importance_model"), F.col("_peak.m")),
            "shap_norm": ratio(F.col("importance_shap"), F.col("_peak.s")),
        }
    )
    return out.drop("_peak").orderBy(F.desc("shap_norm"), "feature").limit(n)


def top_share(importance: DataFrame, n: int = 5) -> DataFrame:
    """Share of the whole importance held by the ``n`` largest features."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(n).agg(F.sum("importance")).scalar()
    return importance.agg(F.sum("importance").alias("total"), F.count(F.lit(1)).alias("n_features")).select(
        ratio(top, F.col("total")).alias("top_share"), "n_features"
    )


# --- importance drift ---------------------------------------------------------------------------------------------

# Upper score limits of the severity classes.
SEVERITY = {"none": 0.1, "low": 0.2, "medium": 0.4}


def severity_of(score: Column) -> Column:
    out = F.lit("high")
    for name, limit in reversed(SEVERITY.items()):
        out = F.when(score < limit, name).otherwise(out)
    return out


def normalised(importance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Importances divided by their sum per key; a zero sum leaves them as they are."""
    totals = importance.groupBy(*keys).agg(F.sum("importance").alias("_total"))
    if keys:
        joined = importance.join(totals, list(keys))
    else:
        joined = importance.withColumn("_total", totals.scalar())
    share = F.when(F.col("_total") > 0, F.col("importance") / F.col("_total")).otherwise(F.col("importance"))
    return joined.withColumn("importance", share).drop("_total")


def importance_drift(baseline: DataFrame, current: DataFrame, limit: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """Change of each feature's share; a feature on one side only counts as 0 on the other.

    ``keys`` are extra key columns of ``current`` (for example a date); the baseline is repeated for each of them.
    """
    base = normalised(baseline).select("feature", F.col("importance").alias("baseline_importance"))
    now = normalised(current, keys)
    if keys:
        # one array with an entry per feature, attached to each key
        shares = base.agg(F.collect_list(F.struct("feature", "baseline_importance"))).scalar()
        base = now.select(*keys).distinct().select(*keys, F.inline(shares))
    both = base.join(now.withColumnRenamed("importance", "current_importance"), [*keys, "feature"], "full_outer").fillna(
        0.0, ["baseline_importance", "current_importance"]
    )
    change = F.col("current_importance") - F.col("baseline_importance")
    relative = F.when(F.col("baseline_importance") > 0, change / F.col("baseline_importance"))
    return both.withColumns({"absolute_change": change, "relative_change": relative}).withColumns(
        {
            "is_new": flag(F.col("relative_change").isNull()),
            "significant": flag(F.coalesce(F.abs("relative_change") > limit, F.lit(True))),
        }
    )


def drift_summary(drift: DataFrame, top: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Score, severity and the features with the largest change (as many rows per key as there are features)."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.abs("absolute_change")).alias("o"), F.col("feature").alias("f"))))
    out = drift.groupBy(*keys).agg(
        (F.sum(F.abs("absolute_change")) / 2).alias("drift_score"),
        F.sum("significant").alias("num_significant_changes"),
        F.array_join(F.transform(F.slice(ranked, 1, top), lambda x: x["f"]), ",").alias("top_changes"),
    )
    return out.withColumn("severity", severity_of(F.col("drift_score")))


def drift_history_summary(history: DataFrame, baseline: DataFrame, top: int = 10) -> DataFrame:
    """Counts, the last ten scores and the leading baseline features from a history (date, drift_score, severity)."""
    recent = history.select("date", "drift_score").orderBy(F.desc("date")).limit(10)
    latest = F.transform(
        F.sort_array(F.collect_list(F.struct(F.col("date").alias("t"), F.col("drift_score").alias("s")))),
        lambda x: F.format_string("%.4f", x["s"] + 1e-9),
    )
    leading = normalised(baseline).orderBy(F.desc("importance"), "feature").limit(top)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), F.col("feature").alias("f"))))
    names = leading.agg(F.array_join(F.transform(ranked, lambda x: x["f"]), ",")).scalar()
    return history.agg(
        F.count(F.lit(1)).alias("num_observations"),
        F.count_if(F.col("severity").isin("medium", "high")).alias("num_drift_events"),
    ).select(
        "*",
        recent.agg(F.array_join(latest, ",")).scalar().alias("recent_drift_scores"),
        names.alias("baseline_top_features"),
    )


def append_drift(scores: DataFrame, path: str) -> None:
    """Add drift scores (with a ``date``) to the history table at ``path``; a date that is recorded again is replaced."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/history")


def read_drift_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/history").withColumn("date", F.to_date("date"))


def save_baseline(importance: DataFrame, path: str, since: str) -> None:
    """Keep an importance table as the baseline from the day ``since`` on; earlier baselines stay readable."""
    importance.select("feature", "importance").write.mode("overwrite").parquet(f"{path}/baseline/since={since}")


def read_baseline(spark: SparkSession, path: str, on: str | None = None) -> DataFrame:
    """The baseline in force on a day (default: the newest one): feature, importance."""
    every = spark.read.parquet(f"{path}/baseline").withColumn("since", F.to_date("since"))
    if on is not None:
        every = every.where(F.col("since") <= F.lit(on).cast("date"))
    newest = every.agg(F.max("since")).scalar()
    return every.where(F.col("since") == newest).select("feature", "importance")


def record_drift(current: DataFrame, path: str, renew_on: Sequence[str] = ()) -> DataFrame:
    """Compare ``current`` (date, feature, importance) with the newest baseline, add the scores to the history, return them.

    If the last of these days has a severity named in ``renew_on``, its importances become the baseline from then on.
    """
    spark = current.sparkSession
    baseline = read_baseline(spark, path)
    scores = cut_lineage(drift_summary(importance_drift(baseline, current, keys=["date"]), keys=["date"]).select("date", "drift_score", "severity"))
    append_drift(scores, path)
    last = scores.orderBy(F.desc("date")).first()
    if last is not None and last.severity in renew_on:
        save_baseline(current.where(F.col("date") == F.lit(last.date)), path, str(last.date))
    return scores


def importance_trend(history: DataFrame, window: int = 10) -> DataFrame:
    """The last ``window`` importances of each feature from a history (date, feature, importance)."""
    stamped = history.withColumn("_at", F.col("date").cast("timestamp"))
    return edge_rows(stamped, window, ["feature"], "_at", Grid(86400)).drop("_at")


def constraint_vector(names: DataFrame, constraints: Mapping[str, int]) -> DataFrame:
    """-1 / 0 / 1 per feature: exact name first, else the first constraint whose name is part of the feature name."""
    f = F.col("feature")
    value = F.lit(0)
    for part, sign in reversed(constraints.items()):
        value = F.when(f.contains(part), sign).otherwise(value)
    for exact, sign in constraints.items():
        value = F.when(f == exact, sign).otherwise(value)
    return names.withColumn("monotone_constraint", value)
