"""Lag, rolling, difference, target and cleaning windows of a series, chunked so that no series is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, full_grid, over_chunks, over_time_chunks

# Default lags, window lengths and horizons in rows.
LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
WINDOWS = (3, 6, 12, 24, 168)
WEATHER_LAGS = (1, 3, 6)
DIFFS = (1, 24, 168)
HORIZONS = (1, 6, 12, 24, 48, 168)
DEFAULT_STATS = ("mean", "std", "min", "max")
ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def lag_columns(w: WindowSpec, column: str, lags: Sequence[int], prefix: str | None = None) -> dict[str, Column]:
    return {f"{prefix or column}_lag_{k}h": F.lag(column, k).over(w) for k in lags if k > 0}


def rolling_columns(
    w: WindowSpec, column: str, windows: Sequence[int], stats: Sequence[str] = DEFAULT_STATS
) -> dict[str, Column]:
    """Statistics of the ``n`` rows before the current one; any aggregate name Spark knows may be listed."""
    out: dict[str, Column] = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        for stat in stats:
            agg = ROLLING[stat](column) if stat in ROLLING else F.expr(f"{stat}({column})")
            out[f"rolling_{n}h_{stat}"] = agg.over(frame)
    return out


def diff_columns(w: WindowSpec, column: str, periods: Sequence[int]) -> dict[str, Column]:
    return {f"diff_{p}h": F.col(column) - F.lag(column, p).over(w) for p in periods}


def range_column(w: WindowSpec, column: str = "temperature", rows: int = 24) -> Column:
    frame = w.rowsBetween(1 - rows, 0)
    return F.max(column).over(frame) - F.min(column).over(frame)


def lag_features(
    df: DataFrame, column: str = "load", lags: Sequence[int] = LAGS, grid: Grid = HOURLY, aligned: bool = False, **kw
) -> DataFrame:
    """Positional lags; with ``aligned`` missing hours are filled with NULL rows first, so k rows are k hours."""
    if aligned:
        keys, ts = kw.get("keys", KEYS), kw.get("ts", TS)
        df = full_grid(df, keys, ts, grid).join(df, [*keys, ts], "left")
    return over_chunks(df, lambda w: lag_columns(w, column, lags), back=max(lags), grid=grid, carry=[column], **kw)


def rolling_features(
    df: DataFrame,
    column: str = "load",
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = DEFAULT_STATS,
    grid: Grid = HOURLY,
    **kw,
) -> DataFrame:
    return over_chunks(
        df, lambda w: rolling_columns(w, column, windows, stats), back=max(windows), grid=grid, carry=[column], **kw
    )


def diff_features(df: DataFrame, column: str = "load", periods: Sequence[int] = DIFFS, grid: Grid = HOURLY, **kw):
    return over_chunks(df, lambda w: diff_columns(w, column, periods), back=max(periods), grid=grid, carry=[column], **kw)


def weather_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = WEATHER_LAGS, grid: Grid = HOURLY, **kw):
    def build(w: WindowSpec) -> dict[str, Column]:
        return {n: e for c in columns for n, e in lag_columns(w, c, lags).items()}

    return over_chunks(df, build, back=max(lags), grid=grid, carry=columns, **kw)


def temp_range(df: DataFrame, column: str = "temperature", grid: Grid = HOURLY, **kw) -> DataFrame:
    return over_chunks(df, lambda w: {"temp_range_24h": range_column(w, column)}, back=23, grid=grid, carry=[column], **kw)


def solar_rolling(df: DataFrame, grid: Grid = HOURLY, **kw) -> DataFrame:
    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            "ghi_rolling_3h": F.avg("ghi").over(w.rowsBetween(-2, 0)),
            "ghi_rolling_6h": F.avg("ghi").over(w.rowsBetween(-5, 0)),
            "ghi_change_1h": F.col("ghi") - F.lag("ghi", 1).over(w),
        }

    return over_chunks(df, build, back=5, grid=grid, carry=["ghi"], **kw)


def horizon_targets(
    df: DataFrame, column: str = "load", horizons: Sequence[int] = HORIZONS, grid: Grid = HOURLY, **kw
) -> DataFrame:
    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"target_{h}h": F.lead(column, h).over(w) for h in horizons}

    return over_chunks(df, build, ahead=max(horizons), grid=grid, carry=[column], **kw)


def safe_lags(
    df: DataFrame, prediction_time: str, column: str = "load", lags: Sequence[int] = (1, 24, 168), grid: Grid = HOURLY
) -> DataFrame:
    """Lags that are NULL for rows after the time at which the prediction is made."""
    out = lag_features(df, column, lags, grid)
    known = F.col(TS) <= F.lit(prediction_time).cast("timestamp")
    return out.withColumns({f"{column}_lag_{k}h": F.when(known, F.col(f"{column}_lag_{k}h")) for k in lags})


def fill_short_gaps(
    df: DataFrame,
    columns: Sequence[str],
    max_gap: int = 3,
    method: str = "interpolate",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Complete the grid, then fill runs of at most ``max_gap`` missing steps (``interpolate`` or ``forward_fill``).

    ``drop`` keeps only the rows whose columns are all present.  Frames reach ``max_gap`` rows, so chunks suffice.
    """
    if method == "drop":
        return df.dropna(subset=list(columns))
    if method not in ("interpolate", "forward_fill"):
        raise ValueError(f"unknown method: {method}")
    whole = full_grid(df, keys, ts, grid).join(df, [*keys, ts], "left")

    def build(w: WindowSpec) -> dict[str, Column]:
        before, after = w.rowsBetween(-max_gap, -1), w.rowsBetween(1, max_gap)
        out: dict[str, Column] = {}
        for c in columns:
            stamp = F.when(F.col(c).isNotNull(), F.unix_seconds(ts))
            out[f"_p_{c}"] = F.last(c, ignorenulls=True).over(before)
            out[f"_pt_{c}"] = F.last(stamp, ignorenulls=True).over(before)
            out[f"_n_{c}"] = F.first(c, ignorenulls=True).over(after)
            out[f"_nt_{c}"] = F.first(stamp, ignorenulls=True).over(after)
        return out

    wide = over_chunks(whole, build, back=max_gap, ahead=max_gap, keys=keys, ts=ts, grid=grid, carry=columns)
    now = F.unix_seconds(ts)
    fills: dict[str, Column] = {}
    for c in columns:
        span = F.col(f"_nt_{c}") - F.col(f"_pt_{c}")
        short = span <= (max_gap + 1) * grid.step_seconds
        share = (now - F.col(f"_pt_{c}")) / span
        line = F.col(f"_p_{c}") + (F.col(f"_n_{c}") - F.col(f"_p_{c}")) * share
        fills[c] = F.coalesce(c, F.when(short, line) if method == "interpolate" else F.col(f"_p_{c}"))
    return wide.withColumns(fills).drop(*[f"_{k}_{c}" for c in columns for k in ("p", "pt", "n", "nt")])


def rolling_time_rmse(
    df: DataFrame,
    y: str = "y_true",
    yhat: str = "y_pred",
    days: int = 7,
    limit: float = 1.0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """RMSE of the last ``days`` days (by time) with an alert flag; the halo reaches as far back in time as the frame."""

    def build(w: WindowSpec) -> dict[str, Column]:
        by_time = w.orderBy("_sec").rangeBetween(-(days * 86400) + 1, 0)
        return {"rolling_rmse": F.sqrt(F.avg("_se").over(by_time))}

    prepared = df.withColumns({"_se": F.pow(F.col(y) - F.col(yhat), F.lit(2)), "_sec": F.unix_seconds(ts)})
    out = over_time_chunks(prepared, build, days * 86400, keys=keys, ts=ts, grid=grid)
    return out.withColumn("alert", (F.col("rolling_rmse") > limit).cast("int")).drop("_se", "_sec")
