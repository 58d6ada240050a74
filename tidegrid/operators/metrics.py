"""Forecast, interval and quantile metrics as grouped aggregates."""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, edge_rows, running_sums
from tidegrid.operators.guards import flag, ratio
from tidegrid.operators.ranks import percentiles
from tidegrid.session import settled

SERIES_MODEL = ("series_id", "model")
EPS = 2.0**-52


def metric_columns(y: str = "y_true", yhat: str = "y_pred") -> dict[str, Column]:
    """rmse, mae, mape, r2 and max_error over the pairs in a group."""
    t, e = F.col(y), F.col(y) - F.col(yhat)
    sse = F.sum(e * e)
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mape": F.avg(F.abs(e) / (F.abs(t) + EPS)) * 100,
        "mape_raw": F.avg(F.abs(F.try_divide(e, t))) * 100,
        "r2": 1 - ratio(sse, F.var_pop(t) * F.count(t)),
        "max_error": F.max(F.abs(e)),
        "n": F.count(F.lit(1)),
    }


def forecast_metrics(df: DataFrame, keys: Sequence[str] = SERIES_MODEL, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    pairs = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return pairs.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(y, yhat).items()])


def segmented_metrics(
    df: DataFrame, keys: Sequence[str] = SERIES_MODEL, y: str = "y_true", yhat: str = "y_pred", ts: str = TS
) -> DataFrame:
    """RMSE by hour, weekday, season and overall, in one pass."""
    names = ["hour", "day_of_week", "season"]
    parts = df.select(
        *keys,
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        F.floor((F.month(ts) % 12) / 3).cast("int").alias("season"),
        F.pow(F.col(y) - F.col(yhat), F.lit(2)).alias("_se"),
    )
    base = [F.col(k) for k in keys]
    sets = [base + [F.col(n)] for n in names] + [base]
    grouped = parts.groupingSets(sets, *base, *[F.col(n) for n in names]).agg(
        F.sqrt(F.avg("_se")).alias("rmse"), F.count(F.lit(1)).alias("n")
    )
    segment = F.lit("all")
    for n in reversed(names):
        segment = F.when(F.col(n).isNotNull(), n).otherwise(segment)
    return grouped.select(*keys, segment.alias("segment"), F.coalesce(*names, F.lit(-1)).alias("bucket"), "rmse", "n")


def residual_histogram(df: DataFrame, column: str = "residual", bins: int = 50, keys: Sequence[str] = SERIES_MODEL) -> DataFrame:
    """Equal-width bins 1 .. ``bins`` between the smallest and the largest value of each group; the last is closed."""
    bounds = settled(df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.least(F.lit(bins), F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("_lo"), width)), F.lit(0)) + 1)
    return (
        df.where(F.col(column).isNotNull())
        .join(bounds, list(keys))
        .groupBy(*keys, bin_no.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def qq_probs(n: int = 19) -> dict[str, float]:
    return {f"p{i}": i / (n + 1) for i in range(1, n + 1)}


def residual_qq(df: DataFrame, column: str = "residual", points: int = 19, keys: Sequence[str] = SERIES_MODEL) -> DataFrame:
    """Sample quantiles against standard normal quantiles on a fixed probability grid."""
    probs = qq_probs(points)
    sample = percentiles(df, keys, column, probs)
    normal = statistics.NormalDist()
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("prob"), F.lit(normal.inv_cdf(p)).alias("theoretical"), F.col(n).alias("sample"))
            for n, p in probs.items()
        ]
    )
    return sample.select(*keys, F.inline(rows))


def interval_coverage(
    df: DataFrame, expected: float, keys: Sequence[str] = KEYS, y: str = "y_true", yhat: str = "y_pred", low: str = "lower", high: str = "upper"
) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.avg(flag(F.col(y).between(F.col(low), F.col(high)))).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("mean_width"),
        F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), F.lit(2)))).alias("median_rmse"),
    )
    return out.withColumns({"expected": F.lit(expected), "gap": F.col("coverage") - expected})


def winkler_score(
    df: DataFrame, alpha: float, keys: Sequence[str] = KEYS, y: str = "y_true", yhat: str = "y_pred", low: str = "lower", high: str = "upper"
) -> DataFrame:
    t, l, u = F.col(y), F.col(low), F.col(high)
    penalty = F.when(t < l, (2 / alpha) * (l - t)).when(t > u, (2 / alpha) * (t - u)).otherwise(0.0)
    out = df.groupBy(*keys).agg(
        F.avg(flag(t.between(l, u))).alias("coverage"),
        F.avg(u - l).alias("mean_width"),
        F.avg(u - l).alias("sharpness"),
        F.avg(u - l + penalty).alias("winkler_score"),
        F.sqrt(F.avg(F.pow(t - F.col(yhat), F.lit(2)))).alias("rmse"),
        F.avg(F.abs(t - F.col(yhat))).alias("mae"),
    )
    return out.withColumns({"target_coverage": F.lit(1 - alpha), "coverage_gap": F.abs(F.col("coverage") - (1 - alpha))})


def pinball_loss(df: DataFrame, quantiles: dict[str, float], keys: Sequence[str] = KEYS, y: str = "y_true") -> DataFrame:
    """Pinball loss and share of values at or below each predicted quantile; ``quantiles`` maps column to level."""
    structs = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(q).alias("quantile"),
                F.avg(F.greatest(q * (F.col(y) - F.col(c)), (q - 1) * (F.col(y) - F.col(c)))).alias("pinball_loss"),
                F.avg(flag(F.col(y) <= F.col(c))).alias("calibration"),
            ).alias(c)
            for c, q in quantiles.items()
        ]
    )
    return structs.unpivot(list(keys), list(quantiles), "column", "_s").select(*keys, "column", "_s.*")


def prequential_metrics(
    df: DataFrame,
    keys: Sequence[str] = SERIES_MODEL,
    y: str = "y_true",
    yhat: str = "y_pred",
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Running MAE, RMSE and R2 after each row.

    Targets are measured from the mean of their series, so the running variance keeps its digits whatever the level.
    """
    centre = settled(df.groupBy(*keys).agg(F.avg(y).alias("_centre")), "centre")
    level = centre.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_centre")
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(level[f"_key_{k}"]) for k in keys])
    df = df.join(level, same, "left").drop(*[f"_key_{k}" for k in keys])
    t, e = F.col(y) - F.col("_centre"), F.col(y) - F.col(yhat)
    sums = {"_n": F.lit(1), "_ae": F.abs(e), "_se": e * e, "_y": t, "_yy": t * t}
    out = running_sums(df, sums, keys, ts, grid)
    n = F.col("_n")
    spread = F.col("_yy") - F.col("_y") * F.col("_y") / n
    return out.withColumns(
        {
            "n_seen": n,
            "mae": F.col("_ae") / n,
            "rmse": F.sqrt(F.col("_se") / n),
            "r2": F.when((n > 1) & (spread > 1e-9), 1 - F.col("_se") / spread),
        }
    ).drop(*sums, "_centre")


def performance_log(
    df: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str] = SERIES_MODEL,
    y: str = "y_true",
    yhat: str = "y_pred",
    ts: str = TS,
    limit: float = 0.3,
) -> DataFrame:
    """Daily RMSE / MAE with the relative loss against ``baseline`` (keys, baseline_rmse); zero counts as unset."""
    e = F.col(y) - F.col(yhat)
    daily = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n_samples")
    )
    return with_degradation(daily, baseline, keys, limit)


def with_degradation(daily: DataFrame, baseline: DataFrame, keys: Sequence[str] = SERIES_MODEL, limit: float = 0.3) -> DataFrame:
    """Relative loss of each record's RMSE against the key's baseline, and the alert flag."""
    base = F.when(F.col("baseline_rmse") != 0, F.col("baseline_rmse"))
    out = daily.join(baseline.select(*keys, "baseline_rmse"), list(keys), "left")
    out = out.withColumn("degradation", (F.col("rmse") - base) / base)
    return out.withColumn("alert", flag(F.col("degradation") > limit)).drop("baseline_rmse")


def recent_performance(log: DataFrame, last_n: int = 7, keys: Sequence[str] = SERIES_MODEL) -> DataFrame:
    """Summary of the last ``last_n`` records per key (std with ddof 0)."""
    recent = edge_rows(log.withColumn("_at", F.col("date").cast("timestamp")), last_n, keys, "_at", Grid(86400))
    return recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.avg("rmse").alias("mean_rmse"),
        F.stddev_pop("rmse").alias("std_rmse"),
        F.min("rmse").alias("min_rmse"),
        F.max("rmse").alias("max_rmse"),
        F.sum("alert").alias("n_alerts"),
    )


def cv_summary(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and std of each metric over the splits."""
    long = metrics.select(*keys, *names).unpivot(list(keys), list(names), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n_splits")
    )
