"""Naive, recursive and quantile forecasts, and temporal splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, edge_rows, over_chunks, with_ordinal
from tidegrid.operators.guards import flag
from tidegrid.operators.metrics import forecast_metrics
from tidegrid.operators.ranks import percentiles
from tidegrid.session import settled

METHODS = ("persistence", "seasonal_naive", "moving_average")


def horizon_rows(ends: DataFrame, horizon: int, keys: Sequence[str], ts: str, grid: Grid, carry: Sequence[str]) -> DataFrame:
    """``horizon`` rows per series after its last timestamp, with step number ``step`` from 1."""
    rows = ends.select(*keys, ts, *carry, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return rows.withColumn(ts, F.timestamp_seconds(F.unix_seconds(ts) + F.col("step") * grid.step_seconds))


def persistence_forecast(
    df: DataFrame, horizon: int = 24, column: str = "load", keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    ends = df.groupBy(*keys).agg(F.max_by(column, ts).alias("y_pred"), F.max(ts).alias(ts))
    return horizon_rows(ends, horizon, keys, ts, grid, ["y_pred"])


def seasonal_naive_forecast(
    df: DataFrame, horizon: int = 24, season: int = 24, column: str = "load", keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    """Value one season (in rows) back; where the series is shorter than a season, its last value."""
    ends = df.groupBy(*keys).agg(F.max_by(column, ts).alias("_last"), F.max(ts).alias(ts))
    steps = horizon_rows(ends, horizon, keys, ts, grid, ["_last"])
    steps = steps.withColumn("_back", season - (F.col("step") - 1) % season)
    recent = edge_rows(df, season, keys, ts, grid, rank="_back").select(*keys, "_back", F.col(column).alias("_value"))
    out = steps.join(recent, [*keys, "_back"], "left")
    return out.select(*keys, ts, "step", F.coalesce("_value", "_last").alias("y_pred"))


def moving_average_forecast(
    df: DataFrame, horizon: int = 24, window: int = 168, column: str = "load", keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    recent = edge_rows(df, window, keys, ts, grid)
    ends = recent.groupBy(*keys).agg(F.avg(column).alias("y_pred"), F.max(ts).alias(ts))
    return horizon_rows(ends, horizon, keys, ts, grid, ["y_pred"])


def naive_forecasts(df: DataFrame, horizon: int, methods: Sequence[str] = METHODS, season: int = 24, window: int = 168, **kw):
    made = {
        "persistence": lambda: persistence_forecast(df, horizon, **kw),
        "seasonal_naive": lambda: seasonal_naive_forecast(df, horizon, season, **kw),
        "moving_average": lambda: moving_average_forecast(df, horizon, window, **kw),
    }
    unknown = set(methods) - set(made)
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
    return reduce(DataFrame.unionByName, [made[m]().withColumn("method", F.lit(m)) for m in methods])


def compare_baselines(
    train: DataFrame,
    test: DataFrame,
    horizon: int = 24,
    methods: Sequence[str] = METHODS,
    column: str = "load",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    pooled: bool = False,
    **kw,
) -> DataFrame:
    """Metrics of each naive method on the timestamps it shares with the test rows, per series or over all of them."""
    predicted = naive_forecasts(train, horizon, methods, column=column, keys=keys, ts=ts, **kw)
    truth = test.select(*keys, ts, F.col(column).alias("y_true"))
    return forecast_metrics(predicted.join(truth, [*keys, ts]), ["method"] if pooled else [*keys, "method"])


def holdout_split(
    df: DataFrame, test_rows: int, val_share: float = 0.2, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    """Add ``split``: the last ``test_rows`` rows are test, the last ``val_share`` of the others validation."""
    numbered = with_ordinal(df, keys, ts, grid)
    n_train = F.col("ordinal_n") - test_rows
    n_val = F.floor(n_train * F.lit(val_share))
    split = (
        F.when(F.col("ordinal") >= n_train, "test").when(F.col("ordinal") >= n_train - n_val, "validation").otherwise("train")
    )
    return numbered.withColumn("split", split)


def rolling_origin_splits(
    df: DataFrame,
    n_splits: int = 5,
    test_days: int = 30,
    min_train_days: int = 365,
    gap_days: int = 0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
) -> DataFrame:
    """Split bounds per series; all bounds are inclusive.  A series that is too short fails the query."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("train_start"), F.max(ts).alias("_end"))
    total = F.floor((F.unix_seconds("_end") - F.unix_seconds("train_start")) / 86400)
    needed = min_train_days + gap_days + test_days
    message = F.concat(F.lit("Insufficient data: "), total, F.lit(f" days available, {needed} days required"))
    free = F.when(total < needed, F.raise_error(message).cast("bigint")).otherwise(total - needed)
    step = F.col("_free") / (n_splits - 1) if n_splits > 1 else F.lit(0.0)
    rows = span.withColumn("_free", free).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.unix_seconds("train_start")
    train_end = start + (min_train_days + F.floor(F.col("split") * step)) * 86400
    test_start = train_end + gap_days * 86400
    test_end = F.least(test_start + test_days * 86400, F.unix_seconds("_end"))
    return rows.select(
        *keys,
        F.col("split").cast("int").alias("split"),
        "train_start",
        F.timestamp_seconds(train_end).alias("train_end"),
        F.timestamp_seconds(test_start).alias("test_start"),
        F.timestamp_seconds(test_end).alias("test_end"),
    )


def expanding_splits(
    df: DataFrame, n_splits: int = 5, test_days: int = 30, initial_train_days: int = 365, keys: Sequence[str] = KEYS, ts: str = TS
) -> DataFrame:
    """Same arithmetic without a gap."""
    return rolling_origin_splits(df, n_splits, test_days, initial_train_days, 0, keys, ts)


def tag_splits(df: DataFrame, splits: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, strict: bool = False) -> DataFrame:
    """Rows of each split with ``part`` train or test; a row may belong to several splits.

    The join is an equi-join on the series with a range condition.  With a zero gap the border row is in both parts;
    ``strict`` keeps it out of the test part.
    """
    t = F.col(ts)
    in_train = t.between(F.col("train_start"), F.col("train_end"))
    in_test = t.between(F.col("test_start"), F.col("test_end"))
    if strict:
        in_test = in_test & (t > F.col("train_end"))
    parts = F.array_compact(F.array(F.when(in_train, F.lit("train")), F.when(in_test, F.lit("test"))))
    joined = df.join(settled(splits), list(keys)).where(in_train | in_test)
    return joined.select(*df.columns, "split", F.explode(parts).alias("part"))


def leakage_check(df: DataFrame, prediction_time: str, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    late = F.col(ts) > F.lit(prediction_time).cast("timestamp")
    out = df.groupBy(*keys).agg(F.count_if(late).alias("n_future_rows"), F.min(F.when(late, F.col(ts))).alias("first_future"))
    return out.withColumn("passed", flag(F.col("n_future_rows") == 0))


def assert_no_leakage(df: DataFrame, prediction_time: str, keys: Sequence[str] = KEYS, ts: str = TS) -> None:
    bad = leakage_check(df, prediction_time, keys, ts).agg(F.sum("n_future_rows"), F.min("first_future")).first()
    if bad[0]:
        raise ValueError(f"Data leakage: {bad[0]} rows after {prediction_time}, first {bad[1]}")


def split_check(
    train: DataFrame, test: DataFrame, gap_days: int = 0, keys: Sequence[str] = KEYS, ts: str = TS
) -> DataFrame:
    """Per series: does training end before the test starts, and is the gap wide enough?"""
    a = train.groupBy(*keys).agg(F.max(ts).alias("train_end"))
    b = test.groupBy(*keys).agg(F.min(ts).alias("test_start"))
    gap = (F.unix_seconds("test_start") - F.unix_seconds("train_end")) / 86400
    return a.join(b, list(keys)).withColumns(
        {
            "gap_days": gap,
            "overlaps": flag(F.col("train_end") >= F.col("test_start")),
            "gap_too_small": flag(gap < gap_days),
        }
    )


def recursive_forecast(
    df: DataFrame,
    weights: Mapping[int, float],
    intercept: float = 0.0,
    horizon: int = 24,
    column: str = "load",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Linear autoregression fed with its own predictions; ``weights`` maps a lag in rows to its weight.

    The state is the array of the last ``max(lag)`` values, so a series needs that many rows and no more.
    """
    depth = max(weights)
    recent = edge_rows(df, depth, keys, ts, grid, rank="_back")
    state = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col(column).alias("v"))))
    start = recent.groupBy(*keys).agg(F.max(ts).alias(ts), F.transform(state, lambda x: x["v"]).alias("_state"))
    start = start.where(F.size("_state") == depth)

    def step(values: Column, _: Column) -> Column:
        terms = [F.lit(float(w)) * F.element_at(values, F.lit(-k)) for k, w in weights.items()]
        return F.concat(values, F.array(reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_state"), step)
    made = start.select(*keys, ts, F.posexplode(F.slice(path, depth + 1, horizon)).alias("_pos", "y_pred"))
    step_no = F.col("_pos") + 1
    return made.select(
        *keys, F.timestamp_seconds(F.unix_seconds(ts) + step_no * grid.step_seconds).alias(ts), step_no.alias("step"), "y_pred"
    )


def quantile_name(q: float) -> str:
    return f"q{int(q * 100)}"


def conditional_quantiles(
    df: DataFrame,
    quantiles: Sequence[float] = (0.1, 0.5, 0.9),
    column: str = "load",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    accuracy: int | None = None,
) -> DataFrame:
    """Each row with the quantiles of its (series, hour, weekend) group."""
    tagged = df.withColumns({"_hour": F.hour(ts), "_weekend": flag(F.weekday(ts) >= 5)})
    at = [*keys, "_hour", "_weekend"]
    levels = settled(percentiles(tagged, at, column, {quantile_name(q): q for q in quantiles}, accuracy))
    return tagged.join(levels, at, "left").drop("_hour", "_weekend")


def conformal_update(
    df: DataFrame,
    alpha: float = 0.1,
    window: int = 100,
    step_size: int = 1,
    keys: Sequence[str] = KEYS,
    y: str = "y_true",
    yhat: str = "y_pred",
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Prediction intervals from the last ``window`` residuals before the row, refreshed every ``step_size`` rows."""
    residual = df.withColumn("_res", F.col(y) - F.col(yhat))

    def build(w) -> dict[str, Column]:
        return {"_past": F.sort_array(F.collect_list("_res").over(w.rowsBetween(-window, -1)))}

    def level(p: float) -> Column:
        """Interpolated percentile of the sorted array of at most ``window`` residuals."""
        at = f"({p!r}D * (size(_past) - 1))"
        low, high = f"_past[cast(floor({at}) AS int)]", f"_past[cast(least(floor({at}) + 1, size(_past) - 1) AS int)]"
        return F.expr(f"CASE WHEN size(_past) > 0 THEN {low} + ({high} - {low}) * ({at} - floor({at})) END")

    out = over_chunks(residual, build, back=window, keys=keys, ts=ts, grid=grid, carry=["_res"])
    out = out.withColumns({"_lo": level(alpha / 2), "_hi": level(1 - alpha / 2)}).drop("_past")
    if step_size > 1:
        # the whole step uses the quantiles known at its first row; a step has ``step_size`` rows
        out = with_ordinal(out, keys, ts, grid).withColumn("_step", F.floor(F.col("ordinal") / step_size))
        first = Window.partitionBy(*keys, "_step").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.first(c).over(first) for c in ("_lo", "_hi")}).drop("ordinal", "ordinal_n", "_step")
    return out.withColumns({"lower": F.col(yhat) + F.col("_lo"), "upper": F.col(yhat) + F.col("_hi")}).drop(
        "_res", "_lo", "_hi"
    )
