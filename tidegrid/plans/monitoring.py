"""Distribution drift: two-sample Kolmogorov-Smirnov per feature over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.guards import flag
from tidegrid.operators.ranks import cumulative_counts
from tidegrid.plans.profile import long_columns, reference_stats

NUMERIC = ("double", "float", "int", "bigint")


def kolmogorov_p(distance: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the KS distance."""
    lam = distance * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # below 0.2 the alternating series has not settled and the value is 1 to six digits
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_distance(long: DataFrame, keys: Sequence[str], value: str, is_reference: Column) -> DataFrame:
    """Largest gap between the two cumulative shares per key, with both counts."""
    counts = {"ref": F.count_if(is_reference), "cur": F.count_if(~is_reference)}
    cum = cumulative_counts(long, keys, value, counts)
    gap = F.abs(F.try_divide(F.col("ref_upto"), F.col("ref_total")) - F.try_divide(F.col("cur_upto"), F.col("cur_total")))
    return cum.groupBy(*keys).agg(
        F.max(gap).alias("ks_statistic"), F.max("ref_total").alias("n_reference"), F.max("cur_total").alias("n_current")
    )


def ks_drift(reference: DataFrame, current: DataFrame, features: Sequence[str], threshold: float = 0.05, min_rows: int = 10):
    """One row per numeric feature of the reference: status, distance, p-value and means."""
    numeric = [f for f in features if dict(reference.dtypes).get(f) in NUMERIC]
    present = [f for f in numeric if f in current.columns]
    gone = [f for f in numeric if f not in current.columns]
    sides = long_columns(reference, present, []).withColumn("is_ref", F.lit(True)).unionByName(
        long_columns(current, present, []).withColumn("is_ref", F.lit(False))
    )
    sides = sides.where("value IS NOT NULL")
    means = sides.groupBy("column").agg(
        F.avg(F.when(~F.col("is_ref"), F.col("value"))).alias("current_mean"),
        F.avg(F.when(F.col("is_ref"), F.col("value"))).alias("reference_mean"),
    )
    asked = reference.sparkSession.createDataFrame([(f,) for f in present], "column string")
    measured = ks_distance(sides, ["column"], "value", F.col("is_ref")).join(means, "column")
    # a feature without a value on either side keeps its row
    out = asked.join(measured, "column", "left").fillna(0, ["n_reference", "n_current"])
    enough = F.col("n_current") >= min_rows
    known = enough & (F.col("n_reference") > 0)
    p = F.when(known, kolmogorov_p(F.col("ks_statistic"), F.col("n_reference").cast("double"), F.col("n_current").cast("double")))
    out = out.withColumn("p_value", p).select(
        F.col("column").alias("feature"),
        F.when(~enough, "insufficient_data")
        .when(~known, "no_reference")
        .when(F.col("p_value") < threshold, "drift")
        .otherwise("stable")
        .alias("status"),
        F.coalesce(flag(F.col("p_value") < threshold), F.lit(0)).alias("drift"),
        F.when(known, F.col("ks_statistic")).alias("ks_statistic"),
        "p_value",
        "current_mean",
        "reference_mean",
        (F.col("current_mean") - F.col("reference_mean")).alias("mean_shift"),
    )
    if gone:
        empty = [F.lit(None).cast("double").alias(c) for c in out.columns[3:]]
        names = F.explode(F.array(*[F.lit(f) for f in gone])).alias("feature")
        absent = reference.sparkSession.range(1).select(names, F.lit("missing").alias("status"), F.lit(1).alias("drift"), *empty)
        out = out.unionByName(absent)
    return out


def prediction_drift(reference: DataFrame, current: DataFrame, column: str = "y_pred", threshold: float = 0.05) -> DataFrame:
    return ks_drift(reference.select(column), current.select(column), [column], threshold)


#: Size of a KLL sketch, and the share of rows by which a rank read from it can be off (99 % confidence).
SKETCH_K, RANK_ERROR = 1000, 0.0033
#: Points of each sketch at which the two are compared.
SKETCH_POINTS = 500


def sketches(df: DataFrame, features: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(feature, n, sketch): a mergeable KLL sketch of every numeric feature; null and NaN values are left out."""
    long = long_columns(df, features, []).where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy(F.col("column").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """One sketch per feature from the sketches of several windows, whose rows are not read again."""
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_drift(reference: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """KS test on two tables of ``sketches``: the distance with its bounds, its p-value and whether the lower bound is significant.

    Both distributions are read as quantiles at SKETCH_POINTS steps and compared at all of these; the true distance is at most
    the rank error of each sketch and one step of each side away.
    """
    both = reference.select("feature", F.col("n").alias("n_reference"), F.col("sketch").alias("_r")).join(
        current.select("feature", F.col("n").alias("n_current"), F.col("sketch").alias("_c")), "feature"
    )
    shares = F.array(*[F.lit(i / SKETCH_POINTS) for i in range(1, SKETCH_POINTS + 1)])
    read = both.select("feature", "n_reference", "n_current", *[F.kll_sketch_get_quantile_double(s, shares).alias(s) for s in ("_r", "_c")])
    below = lambda side, x: F.size(F.filter(side, lambda q: q <= x)) / SKETCH_POINTS
    gaps = F.transform(F.array_distinct(F.concat("_r", "_c")), lambda x: F.abs(below("_r", x) - below("_c", x)))
    out = read.select("feature", "n_reference", "n_current", F.array_max(gaps).alias("ks_statistic"))
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    slack = 2 * (RANK_ERROR + 1 / SKETCH_POINTS)
    low, high = F.greatest(F.col("ks_statistic") - slack, F.lit(0.0)), F.least(F.col("ks_statistic") + slack, F.lit(1.0))
    out = out.withColumns({"ks_low": low, "ks_high": high, "p_value": kolmogorov_p(F.col("ks_statistic"), n, m)})
    return out.withColumn("drift", flag(kolmogorov_p(F.col("ks_low"), n, m) < threshold))


def save_reference(reference: DataFrame, features: Sequence[str], path: str) -> None:
    reference_stats(reference, features).write.mode("overwrite").parquet(path)


def load_reference(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
