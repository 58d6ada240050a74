"""Profile of many series: statistics come from grouped aggregates, one row (or a few) per series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, edge_rows, gap_islands, gap_steps, over_chunks, with_halo
from tidegrid.operators.guards import flag, ratio, safe_corr
from tidegrid.operators.ranks import percentiles
from tidegrid.operators.series import LAGS
from tidegrid.session import settled

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def long_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(keys, extra, column, value) with every value as double."""
    doubles = df.select(*keys, *extra, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([*keys, *extra], list(columns), "column", "value")


def per_column(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fields) -> DataFrame:
    """One aggregation pass for all columns: ``fields(c)`` gives the struct of column ``c``; rows (keys, column, fields)."""
    structs = df.groupBy(*keys).agg(*[F.struct(*fields(c)).alias(c) for c in columns])
    return structs.unpivot(list(keys), list(columns), "column", "_s").select(*keys, "column", "_s.*")


def corrected_skew(column: str) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * ratio(F.sqrt(n * (n - 1)), n - 2))


def corrected_kurtosis(column: str) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 3, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def basic_profile(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    columns = [c for c in df.columns if c not in (*keys, ts)]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.withColumns(
        {
            "duration_days": F.floor((F.unix_seconds("end") - F.unix_seconds("start")) / 86400),
            "n_columns": F.lit(len(columns)).cast("bigint"),
            "columns": F.lit(",".join(columns)),
        }
    )


def missing_profile(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, ts: str = TS, limit: float = 0.05
) -> DataFrame:
    def fields(c: str) -> list[Column]:
        gone = F.col(c).isNull()
        return [
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(gone).alias("missing_count"),
            F.min(F.when(gone, F.col(ts))).alias("first_missing"),
            F.max(F.when(gone, F.col(ts))).alias("last_missing"),
        ]

    out = per_column(df, keys, columns, fields)
    share = ratio(F.col("missing_count"), F.col("n_rows"))
    return out.withColumns({"missing_ratio": share, "above_limit": flag(share > limit)}).drop("n_rows")


def temporal_coverage(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """Expected and present grid points.  Each timestamp is counted once, so duplicates do not hide gaps."""
    sec = F.unix_seconds(F.col(ts))
    points = df.groupBy(*keys, sec.alias("_sec")).agg(F.count(F.lit(1)).alias("_n"))
    # phase of the grid = phase of the first row
    first = points.groupBy(*keys).agg(
        F.min("_sec").alias("_lo"), F.max("_sec").alias("_hi"), F.sum("_n").alias("n_actual")
    )
    phases = points.groupBy(*keys, (F.col("_sec") % grid.step_seconds).alias("_phase")).agg(
        F.count(F.lit(1)).alias("_points")
    )
    on_grid = first.withColumn("_phase", F.col("_lo") % grid.step_seconds).join(phases, [*keys, "_phase"])
    expected = F.floor((F.col("_hi") - F.col("_lo")) / grid.step_seconds) + 1
    return on_grid.select(
        *keys,
        expected.alias("n_expected"),
        "n_actual",
        (expected - F.col("_points")).alias("n_missing"),
        ratio(F.col("n_actual"), expected).alias("coverage"),
    )


def distribution_stats(
    df: DataFrame,
    column: str = "load",
    keys: Sequence[str] = KEYS,
    accuracy: int | None = None,
) -> DataFrame:
    moments = df.groupBy(*keys).agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        corrected_skew(column).alias("skewness"),
        corrected_kurtosis(column).alias("kurtosis"),
    )
    quantiles = percentiles(df, keys, column, QUARTILES, accuracy)
    return moments.withColumn("cv", ratio(F.col("std"), F.col("mean"))).join(quantiles, list(keys), "left")


def reference_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), accuracy: int | None = None):
    """mean, std, min, max and quartiles per numeric column (and key)."""
    long = long_columns(df, columns, keys)
    at = [*keys, "column"]
    moments = per_column(
        df,
        keys,
        columns,
        lambda c: [
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ],
    )
    return moments.join(percentiles(long, at, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, accuracy), at, "left")


def seasonality(df: DataFrame, column: str = "load", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Mean and std by hour, weekday and month in one pass; peak and low bucket (the first on ties) are flagged."""
    parts = df.select(
        *keys, F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"), F.month(ts).alias("month"), column
    )
    names = ["hour", "day_of_week", "month"]
    sets = [[F.col(k) for k in keys] + [F.col(n)] for n in names]
    grouped = parts.groupingSets(sets, *[F.col(k) for k in keys], *[F.col(n) for n in names]).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )
    grain = F.when(F.col("hour").isNotNull(), "hour").when(F.col("day_of_week").isNotNull(), "day_of_week").otherwise("month")
    rows = grouped.select(*keys, grain.alias("grain"), F.coalesce(*names).alias("bucket"), "mean", "std")
    # at most 24 + 7 + 12 rows per series
    w = Window.partitionBy(*keys, "grain")
    peak = F.max_by("bucket", F.struct(F.col("mean"), -F.col("bucket"))).over(w)
    low = F.min_by("bucket", F.struct(F.col("mean"), F.col("bucket"))).over(w)
    return rows.withColumns(
        {"is_peak": flag(F.col("bucket") == peak), "is_low": flag(F.col("bucket") == low)}
    )


def weekend_profile(df: DataFrame, column: str = "load", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    return df.groupBy(*keys, flag(F.weekday(ts) >= 5).alias("is_weekend"), F.hour(ts).alias("hour")).agg(
        F.avg(column).alias("mean")
    )


def outliers_zscore(df: DataFrame, column: str = "load", keys: Sequence[str] = KEYS, limit: float = 5.0) -> DataFrame:
    stats = settled(df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s")))
    far = F.abs(ratio(F.col(column) - F.col("_m"), F.col("_s"))) > limit
    out = df.join(stats, list(keys)).groupBy(*keys).agg(
        F.count_if(far).alias("n_outliers"), F.count(column).alias("n_values")
    )
    return out.withColumn("outlier_ratio", ratio(F.col("n_outliers"), F.col("n_values")))


def outliers_iqr(
    df: DataFrame, column: str = "load", keys: Sequence[str] = KEYS, factor: float = 1.5, accuracy: int | None = None
) -> DataFrame:
    q = percentiles(df, keys, column, {"q1": 0.25, "q3": 0.75}, accuracy)
    spread = F.col("q3") - F.col("q1")
    bounds = q.select(
        *keys, (F.col("q1") - factor * spread).alias("lower_bound"), (F.col("q3") + factor * spread).alias("upper_bound")
    )
    bounds, x = settled(bounds), F.col(column)
    out = df.join(bounds, list(keys)).groupBy(*keys, "lower_bound", "upper_bound").agg(
        F.count_if((x < F.col("lower_bound")) | (x > F.col("upper_bound"))).alias("n_outliers"),
        F.count(column).alias("n_values"),
    )
    return out.withColumn("outlier_ratio", ratio(F.col("n_outliers"), F.col("n_values")))


def data_quality(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    max_missing_ratio: float = 0.1,
    outlier_std: float = 5.0,
    min_rows: int = 8760,
) -> DataFrame:
    """Check rows (check, column, value, threshold, passed); outlier counts are informative and always pass."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    sums = df.join(settled(stats), list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.count_if(F.col(c).isNull()).cast("double").alias(f"_missing_{c}") for c in columns],
        *[
            F.count_if(F.abs(F.col(c) - F.col(f"_m_{c}")) > outlier_std * F.col(f"_s_{c}")).cast("double").alias(f"_out_{c}")
            for c in columns
        ],
    )

    def check(name: str, column: str | None, value: Column, threshold: float | None, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(column).cast("string").alias("column"),
            value.alias("value"),
            F.lit(threshold).cast("double").alias("threshold"),
            flag(passed).alias("passed"),
        )

    n = F.col("_n")
    rows = [check("row_count", None, n, float(min_rows), n >= min_rows)]
    for c in columns:
        share = ratio(F.col(f"_missing_{c}"), n)
        rows.append(check("missing_ratio", c, share, max_missing_ratio, share <= max_missing_ratio))
        rows.append(check("outlier_ratio", c, ratio(F.col(f"_out_{c}"), n), None, F.lit(True)))
    return sums.select(*keys, F.inline(F.array(*rows)))


def quality_summary(checks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per series: passed flag and the texts of the failed checks."""
    text = F.concat_ws(" ", "check", F.coalesce("column", F.lit("")))
    return checks.groupBy(*keys).agg(
        F.min("passed").alias("passed"),
        F.count_if(F.col("passed") == 0).alias("n_issues"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.when(F.col("passed") == 0, F.trim(text))))).alias("issues"),
    )


def temporal_consistency(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """Duplicates, gaps and irregular steps.  Copies of a timestamp are merged to a count before any window."""
    points = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    span = points.groupBy(*keys).agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.sum("_n").alias("n_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("n_duplicates"),
    )
    step = F.unix_seconds(F.col(ts))
    steps = over_chunks(
        points, lambda w: {"_step": step - F.unix_seconds(F.lag(ts, 1).over(w))}, back=1, keys=keys, ts=ts, grid=grid, carry=[]
    )
    real = steps.where("_step IS NOT NULL").select(*keys, "_step", F.lit(1).alias("_k"))
    copies = points.where("_n > 1").select(*keys, F.lit(0).alias("_step"), (F.col("_n") - 1).alias("_k"))
    sizes = real.unionByName(copies).groupBy(*keys, "_step").agg(F.sum("_k").alias("_k"))
    usual = sizes.groupBy(*keys).agg(
        F.min_by("_step", F.struct(-F.col("_k"), F.col("_step"))).alias("usual_step_seconds"),
        (F.sum("_k") - F.max("_k")).alias("n_irregular"),
    )
    islands = settled(gap_islands(points, keys, ts, grid), "gaps")
    gaps = islands.groupBy(*keys).agg(F.sum("_missing").alias("n_gaps"))
    # the first ten missing steps are in the first ten gaps, and in the first ten steps of each
    early = edge_rows(islands.withColumn(ts, F.timestamp_seconds("_first")), 10, keys, ts, grid, last=False).drop(ts)
    gone = gap_steps(early.withColumn("_missing", F.least("_missing", F.lit(10))), keys, ts, grid)
    shown = edge_rows(gone, 10, keys, ts, grid, last=False).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))), ",").alias("first_gaps")
    )
    out = span.join(usual, list(keys), "left").join(gaps, list(keys), "left").join(shown, list(keys), "left")
    return out.withColumns(
        {
            "n_gaps": F.coalesce("n_gaps", F.lit(0)),
            "n_irregular": F.coalesce("n_irregular", F.lit(0)),
            "first_gaps": F.coalesce("first_gaps", F.lit("")),
        }
    )


def covariate_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    def fields(c: str) -> list[Column]:
        return [
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("missing_ratio"),
        ]

    return per_column(df, keys, columns, fields)


def load_weather_corr(df: DataFrame, columns: Sequence[str], load: str = "load", keys: Sequence[str] = KEYS) -> DataFrame:
    def fields(c: str) -> list[Column]:
        return [safe_corr(F.col(load), F.col(c)).alias("correlation")]

    return per_column(df, keys, columns, fields)


def autocorr_lags(
    df: DataFrame, column: str = "load", lags: Sequence[int] = LAGS, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    """Pearson correlation of the non-NULL series with itself shifted by k rows."""
    wide = over_chunks(
        df.where(F.col(column).isNotNull()).select(*keys, ts, column),
        lambda w: {f"_{k}": F.lag(column, k).over(w) for k in lags},
        back=max(lags), keys=keys, ts=ts, grid=grid, carry=[column],
    )
    pairs = wide.groupBy(*keys).agg(
        *[safe_corr(F.col(column), F.col(f"_{k}")).alias(str(k)) for k in lags]
    )
    rows = pairs.unpivot(list(keys), [str(k) for k in lags], "lag", "autocorrelation")
    return rows.withColumn("lag", F.col("lag").cast("int")).where("autocorrelation IS NOT NULL")


def lagged_products(own: np.ndarray, known: np.ndarray, max_lag: int) -> np.ndarray:
    """Sums of ``own[i]`` times the value k places before it, for k = 0 .. ``max_lag`` or as far as there are values.

    ``own`` are the last values of ``known``.  One forward and one inverse FFT, instead of a product per value and lag.
    """
    size = 1 << max(1, (2 * len(known) - 1).bit_length())
    padded = np.zeros(len(known))
    padded[len(known) - len(own) :] = own
    products = np.fft.irfft(np.fft.rfft(padded, size) * np.conj(np.fft.rfft(known, size)), size)
    return products[: min(max_lag, len(known) - 1) + 1]


def acf(
    df: DataFrame, column: str = "load", max_lag: int = 168, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    """Autocorrelation with the full-series mean and variance, for lags 0 .. ``max_lag``.

    Every bucket with the ``max_lag`` rows before it is correlated by FFT in one Arrow group; what is shuffled after that are
    buckets times lags, however many rows there are.
    """
    present = df.where(F.col(column).isNotNull()).select(*keys, ts, F.col(column).cast("double").alias("_x"))
    means = settled(present.groupBy(*keys).agg(F.avg("_x").alias("_m")))
    centred = present.join(means, list(keys)).select(*keys, ts, (F.col("_x") - F.col("_m")).alias("_d"))
    rows = with_halo(centred, max_lag, keys=keys, ts=ts, grid=grid).select(*keys, "_bucket", ts, "_d", "_own")
    named = [f"{k} {kind}" for k, kind in rows.dtypes if k in keys]

    def correlate(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        own = np.asarray(table["_own"].to_pylist(), bool)
        values = table["_d"].to_numpy()
        sums = lagged_products(values[own], values, max_lag)
        columns = {k: pa.array([key[i].as_py()] * len(sums), key[i].type) for i, k in enumerate(keys)}
        return pa.table({**columns, "lag": pa.array(np.arange(len(sums)), pa.int32()), "_c": pa.array(sums)})

    parts = rows.groupBy(*keys, "_bucket").applyInArrow(correlate, ", ".join([*named, "lag int", "_c double"]))
    sums = parts.groupBy(*keys, "lag").agg(F.sum("_c").alias("_c"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("_c"))).over(Window.partitionBy(*keys))
    return sums.select(*keys, "lag", ratio(F.col("_c"), zero).alias("acf"))


def _durbin_levinson(rho: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations 0 .. K."""
    out, phi = [1.0], []
    for k in range(1, len(rho)):
        num = rho[k] - sum(p * rho[k - 1 - j] for j, p in enumerate(phi))
        den = 1.0 - sum(p * rho[j + 1] for j, p in enumerate(phi))
        last = num / den if den else 0.0
        phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
        out.append(last)
    return out


def pacf(df: DataFrame, column: str = "load", max_lag: int = 50, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Durbin-Levinson recursion on the ``max_lag`` + 1 autocorrelations of each series (that many rows per group)."""
    source = acf(df, column, max_lag, keys, **kw)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        head = {k: rows[k].iloc[0] for k in keys}
        values = _durbin_levinson(rows["acf"].tolist())
        return pd.DataFrame({**head, "lag": rows["lag"].to_numpy(), "pacf": values})

    fields = ", ".join(f"{k} {dict(source.dtypes)[k]}" for k in keys)
    return source.groupBy(*keys).applyInPandas(solve, f"{fields}, lag int, pacf double")


def linear_trend(df: DataFrame, columns: Sequence[str], load: str = "load", keys: Sequence[str] = KEYS) -> DataFrame:
    def fields(c: str) -> list[Column]:
        return [
            F.regr_slope(load, c).alias("slope"),
            F.regr_intercept(load, c).alias("intercept"),
            safe_corr(F.col(load), F.col(c)).alias("correlation"),
        ]

    return per_column(df, keys, columns, fields)


def daily_missing(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    counts = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([*keys, "date"], list(columns), "column", "n_missing")


def resample_hourly(df: DataFrame, column: str = "kw", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Quarter-hour power to hourly energy; hours without a positive sum are dropped."""
    return (
        df.groupBy(*keys, F.date_trunc("hour", ts).alias(ts)).agg(F.sum(F.col(column) / 4).alias("load")).where("load > 0")
    )


def resample_multi(df: DataFrame, column: str = "kw", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """15-minute, hourly and daily energy.  The coarser grains are built from the finer ones, already aggregated."""
    energy = (F.col(column) / 4).alias("_e")
    quarter = df.select(*keys, F.col(ts), energy).groupBy(*keys, ts).agg(F.sum("_e").alias("load"))
    hour = quarter.groupBy(*keys, F.date_trunc("hour", ts).alias(ts)).agg(F.sum("load").alias("load"))
    day = hour.groupBy(*keys, F.date_trunc("day", ts).alias(ts)).agg(F.sum("load").alias("load"))
    grains = {"15min": quarter, "hour": hour, "day": day}
    return reduce(DataFrame.unionByName, [d.withColumn("grain", F.lit(g)) for g, d in grains.items()])


def source_summary(sources: Mapping[str, DataFrame], ts: str = TS) -> DataFrame:
    """Rows, columns, range and missing cells per source, plus the range all sources share."""
    parts = []
    for name, df in sources.items():
        columns = [c for c in df.columns if c != ts]
        holes = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
        parts.append(
            df.agg(
                F.lit(name).alias("source"),
                F.count(F.lit(1)).alias("n_rows"),
                F.lit(len(columns)).cast("bigint").alias("n_columns"),
                F.min(ts).alias("start"),
                F.max(ts).alias("end"),
                (100 * ratio(holes, F.count(F.lit(1)) * len(columns))).alias("missing_pct"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    common = rows.agg(F.max("start").alias("common_start"), F.min("end").alias("common_end"))
    return rows.withColumns({"common_start": common.select("common_start").scalar(), "common_end": common.select("common_end").scalar()})


def profile_report(
    df: DataFrame, covariates: Sequence[str], column: str = "load", keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY,
    is_written: bool = False,
) -> DataFrame:
    """All profile sections as one long table (keys, section, item, metric, value).

    The sections read their columns from one written copy of the input (``is_written``: it is a plain table already).
    """
    df = df if is_written else settled(df, "profile")

    def section(name: str, part: DataFrame, item: str | None, metrics: Sequence[str]) -> DataFrame:
        label = F.col(item).cast("string") if item else F.lit("")
        wide = part.select(*keys, label.alias("item"), *[F.col(m).cast("double").alias(m) for m in metrics])
        long = wide.unpivot([*keys, "item"], list(metrics), "metric", "value")
        return long.select(*keys, F.lit(name).alias("section"), "item", "metric", "value")

    base = df.select(*keys, ts, column)
    parts = [
        section("basic", basic_profile(df, keys, ts), None, ["n_rows", "duration_days", "n_columns"]),
        section("missing", missing_profile(df, [column, *covariates], keys, ts), "column", ["missing_count", "missing_ratio"]),
        section("coverage", temporal_coverage(base, keys, ts, grid), None, ["n_expected", "n_actual", "n_missing", "coverage"]),
        section(
            "distribution",
            distribution_stats(base, column, keys),
            None,
            ["mean", "std", "min", "max", "q25", "median", "q75", "skewness", "kurtosis", "cv"],
        ),
        section("autocorrelation", autocorr_lags(base, column, keys=keys, ts=ts, grid=grid), "lag", ["autocorrelation"]),
        section("outliers_zscore", outliers_zscore(base, column, keys), None, ["n_outliers", "outlier_ratio"]),
        section("outliers_iqr", outliers_iqr(base, column, keys), None, ["n_outliers", "lower_bound", "upper_bound"]),
        section("correlation", load_weather_corr(df, covariates, column, keys), "column", ["correlation"]),
        section("seasonality", seasonality(base, column, keys, ts).withColumn("at", F.concat_ws(" ", "grain", "bucket")), "at", ["mean", "std"]),
        section("weekend", weekend_profile(base, column, keys, ts).withColumn("at", F.concat_ws(" ", "is_weekend", "hour")), "at", ["mean"]),
        section("covariates", covariate_stats(df, covariates, keys), "column", ["mean", "std", "min", "max", "missing_ratio"]),
        section("trend", linear_trend(df, covariates, column, keys), "column", ["slope", "intercept"]),
        section("quality", quality_summary(data_quality(df, [column, *covariates], keys), keys), None, ["passed", "n_issues"]),
        section("consistency", temporal_consistency(base, keys, ts, grid), None, ["n_duplicates", "n_gaps", "n_irregular", "usual_step_seconds"]),
        section("acf", acf(base, column, keys=keys, ts=ts, grid=grid), "lag", ["acf"]),
    ]
    return reduce(DataFrame.unionByName, parts)
