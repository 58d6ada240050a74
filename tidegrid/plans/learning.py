"""Boosted trees, forests and linear models, and everything that needs several fits."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, edge_rows
from tidegrid.operators.guards import flag, require_columns
from tidegrid.operators.metrics import metric_columns
from tidegrid.operators.series import horizon_targets
from tidegrid.plans import boosting
from tidegrid.plans.boosting import NONE, TRAIN, VALID, Ensemble, Fit, Settings
from tidegrid.plans.forecast import compare_baselines, holdout_split, quantile_name
from tidegrid.session import cut_lineage, settled

PARALLEL_FITS = 4


def signs(features: Sequence[str], constraints: Mapping[str, int] | None) -> tuple[int, ...]:
    """The sign of every feature; a feature without one of its own takes that of the first name that it contains."""
    if not constraints:
        return ()
    found = [constraints.get(f, next((s for name, s in constraints.items() if name in f), 0)) for f in features]
    return tuple(found) if any(found) else ()


def fit_gbt(
    train: DataFrame, features: Sequence[str], label: str = "load", validation: str | None = None, monotone: Mapping[str, int] | None = None, **settings
) -> Ensemble:
    """Boosted trees; with a boolean ``validation`` column boosting stops when its error stops falling.

    ``monotone`` gives the sign that the prediction must follow in a feature; ``settings`` are those of boosting.Settings.
    """
    role = F.when(F.col(validation), VALID).otherwise(TRAIN) if validation else F.lit(TRAIN)
    binned = boosting.bin_rows(train, features, [label], [role])
    model = boosting.fit_all(binned, [Fit(Settings(monotone=signs(features, monotone), **settings))])[0]
    if model is None:
        raise ValueError("no training rows")
    return model


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with the ``prediction`` of a fitted model."""
    return model.transform(df).drop("_features")


def gain_importance(model: Ensemble, spark: SparkSession) -> DataFrame:
    """(feature, importance) of a fitted tree model; one row per feature."""
    return spark.createDataFrame(list(model.importances().items()), "feature string, importance double")


def _run_all(jobs: Sequence[Callable[[], object]]) -> list:
    """Run a few independent fits at the same time; each of them is a distributed job."""
    with ThreadPoolExecutor(min(PARALLEL_FITS, max(1, len(jobs)))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def gbt_forecast(
    df: DataFrame, features: Sequence[str], test_rows: int, label: str = "load", keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY, **settings
) -> tuple[Ensemble, DataFrame]:
    """Fit on the training part, stop early on the validation part, score the test part."""
    rows = df.dropna(subset=[label, *features])
    split = holdout_split(rows, test_rows, keys=keys, ts=ts, grid=grid).withColumn("_val", F.col("split") == "validation")
    split = cut_lineage(split.select(*keys, ts, *dict.fromkeys([label, *features]), "split", "_val"))
    model = fit_gbt(split.where("split <> 'test'"), features, label, "_val", **settings)
    return model, predict(model, split.where("split = 'test'")).drop("_val", "split")


# --- permutation importance -----------------------------------------------------------------------------------------


#: Rows among which the values of a feature are exchanged.
BUCKET_ROWS = 6000


def permutation_importance(
    model,
    df: DataFrame,
    features: Sequence[str],
    label: str = "load",
    repeats: int = 5,
    seed: int = 42,
    keys: Sequence[str] = (*KEYS, TS),
) -> DataFrame:
    """Loss of R2 when one feature is exchanged between rows.

    Rows are dealt out to buckets by a hash; in a bucket every row takes the value of its predecessor in hash order and the
    first one that of the last, so each value is used exactly once and nothing is sorted beyond a bucket.  (The only row of
    a bucket keeps its own value.)  All features are tried on one exploded pass per repeat.
    """
    rows = df.select(*keys, label, *features).dropna()
    spread = rows.agg((F.var_pop(label) * F.count(label)).alias("sst"), F.count(F.lit(1)).alias("n")).first()
    if not spread.n or not spread.sst:
        raise ValueError("permutation importance needs rows with a varying target")
    sse = F.sum(F.pow(F.col(label) - F.col("prediction"), F.lit(2)))
    base = 1 - predict(model, rows).agg(sse).first()[0] / spread.sst
    buckets = max(1, round(spread.n / BUCKET_ROWS))
    parts = []
    for repeat in range(repeats):
        mixed = rows.withColumn("_h", F.xxhash64(*keys, F.lit(seed), F.lit(repeat)))
        mixed = mixed.withColumns({"_part": F.pmod("_h", F.lit(buckets)), "_own_values": F.struct(*features)})
        turn = Window.partitionBy("_part").orderBy("_h", *keys)
        last = F.last("_own_values").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        donated = mixed.withColumn("_donor", F.coalesce(F.lag("_own_values", 1).over(turn), last))
        tried = donated.withColumn("_changed", F.explode(F.array(*[F.lit(f) for f in features])))
        swapped = {
            f: F.when((F.col("_changed") == f) & F.col("_donor").isNotNull(), F.col(f"_donor.{f}")).otherwise(F.col(f))
            for f in features
        }
        scored = predict(model, tried.withColumns(swapped)).groupBy(F.col("_changed").alias("feature")).agg(sse.alias("sse"))
        parts.append(scored.withColumn("repeat", F.lit(repeat)))
    losses = reduce(DataFrame.unionByName, parts)
    loss = F.lit(base) - (1 - F.col("sse") / F.lit(spread.sst))
    return losses.groupBy("feature").agg(F.avg(loss).alias("importance"), F.stddev_pop(loss).alias("importance_std"))


def permutation_prune(
    df: DataFrame,
    features: Sequence[str],
    label: str = "load",
    threshold: float = 0.001,
    repeats: int = 5,
    trees: int = 50,
    depth: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Random forest, permutation importance and the keep decision per feature."""
    rows = df.dropna(subset=[label, *features])
    forest = RandomForestRegressor(
        featuresCol="_features", labelCol=label, predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=seed
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), forest]).fit(rows)
    out = permutation_importance(model, rows, features, label, repeats, seed)
    return out.withColumn("kept", flag(F.col("importance") > threshold))


# --- temporal validation ----------------------------------------------------------------------------------------------


def split_roles(df: DataFrame, splits: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> tuple[DataFrame, list[int], list[Column]]:
    """``df`` with the bounds of its series' splits, the split numbers, and the role of a row in each (at most ten or so).

    All bounds are inclusive; a row at the border of a split without a gap is in both parts.
    """
    numbers = [r[0] for r in splits.select("split").distinct().orderBy("split").collect()]
    bounds = F.map_from_entries(F.collect_list(F.struct("split", F.struct("train_start", "train_end", "test_start", "test_end"))))
    rows = df.join(settled(splits.groupBy(*keys).agg(bounds.alias("_bounds"))), list(keys), "left")
    roles = []
    for n in numbers:
        own = F.col("_bounds")[F.lit(n)]
        inside = lambda a, b, own=own, part=NONE: F.when(F.col(ts).between(own[a], own[b]), part).otherwise(NONE)
        roles.append(F.coalesce(inside("train_start", "train_end", part=TRAIN) + inside("test_start", "test_end", part=VALID), F.lit(NONE)))
    return rows, numbers, roles


def cross_validate(
    df: DataFrame,
    splits: DataFrame,
    features: Sequence[str],
    label: str = "load",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    monotone: Mapping[str, int] | None = None,
    **settings,
) -> DataFrame:
    """One fit per split, metrics and sizes per split; splits without rows are left out.

    The rows are binned and written once, all splits are fitted together, and one scan scores the test parts.
    """
    rows, numbers, roles = split_roles(df.dropna(subset=[label, *features]), splits, keys, ts)
    parts = F.array(*[F.struct(F.lit(n).alias("split"), r.alias("role")) for n, r in zip(numbers, roles, strict=True)])
    rows = cut_lineage(rows.select(*keys, ts, label, *features, parts.alias("_parts")))
    binned = boosting.bin_rows(rows, features, [label], [F.col("_parts")[i]["role"] for i in range(len(numbers))])
    models = boosting.fit_all(binned, [Fit(Settings(patience=0, monotone=signs(features, monotone), **settings), role=i) for i in range(len(numbers))])
    fitted = {n: m for i, (n, m) in enumerate(zip(numbers, models, strict=True)) if m and binned.sizes.get((0, i, VALID))}
    if not fitted:
        raise ValueError("no split has both training and test rows")
    tagged = rows.select(*keys, ts, label, *features, F.explode("_parts").alias("_p")).where(F.col("_p.role") != NONE)
    tagged = tagged.select("*", F.col("_p.split").alias("split"), F.col("_p.role").alias("_role")).where(F.col("split").isin(list(fitted)))
    test = F.col("_role").bitwiseAND(VALID) != 0
    train = F.col("_role").bitwiseAND(TRAIN) != 0
    scored = tagged.withColumn("prediction", boosting.column_of(fitted, F.when(test, F.col("split"))))
    return scored.withColumn("_y", F.when(test, F.col(label))).groupBy("split").agg(
        *[c.alias(n) for n, c in metric_columns("_y", "prediction").items() if n != "n"],
        F.count_if(test).alias("n_test"),
        F.min(F.when(test, F.col(ts))).alias("test_start"),
        F.max(F.when(test, F.col(ts))).alias("test_end"),
        F.count_if(train).alias("n_train"),
        F.min(F.when(train, F.col(ts))).alias("train_start"),
        F.max(F.when(train, F.col(ts))).alias("train_end"),
    )


def trial_settings(n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded random settings; the step size and both penalties are drawn on a log scale."""
    rng = random.Random(seed)
    log = lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high)))
    return [
        {
            "leaves": rng.randint(16, 128),
            "depth": rng.randint(3, 12),
            "step": round(log(0.01, 0.3), 5),
            "trees": rng.randint(100, 1000),
            "min_rows": rng.randint(10, 100),
            "row_share": round(rng.uniform(0.5, 1.0), 3),
            "feature_share": round(rng.uniform(0.5, 1.0), 3),
            "l1": log(1e-8, 10.0),
            "l2": log(1e-8, 10.0),
        }
        for _ in range(n_trials)
    ]


def random_search(
    df: DataFrame,
    splits: DataFrame,
    features: Sequence[str],
    label: str = "load",
    n_trials: int = 50,
    seed: int = 42,
    patience: int = 30,
    settings: Sequence[dict] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
) -> DataFrame:
    """Trial table (trial, settings, n_folds, mean RMSE over the folds, best flag); all trials and folds are fitted together.

    A fold's RMSE is that of its best number of trees on the test part.  ``settings`` replaces the drawn settings; the table
    reports what every trial was fitted with.
    """
    rows, numbers, roles = split_roles(df.dropna(subset=[label, *features]), splits, keys, ts)
    binned = boosting.bin_rows(rows, features, [label], roles)
    folds = [i for i in range(len(numbers)) if binned.sizes.get((0, i, TRAIN)) and binned.sizes.get((0, i, VALID))]
    drawn = trial_settings(n_trials, seed) if settings is None else list(settings)
    asked = [(n, Fit(Settings(patience=patience, seed=seed, **one), role=i)) for n, one in enumerate(drawn) for i in folds]
    models = boosting.fit_all(binned, [f for _, f in asked])
    reached: dict[int, list[float]] = {n: [] for n in range(len(drawn))}
    for (n, _), model in zip(asked, models, strict=True):
        reached[n].append(min(model.history))
    out = [(n, {k: str(x) for k, x in one.items()}, len(reached[n]), sum(reached[n]) / len(reached[n]) if reached[n] else None) for n, one in enumerate(drawn)]
    trials = df.sparkSession.createDataFrame(out, "trial int, settings map<string,string>, n_folds int, mean_rmse double")
    best = trials.agg(F.min_by("trial", F.struct(F.col("mean_rmse").isNull(), "mean_rmse", "trial"))).scalar()
    return trials.withColumn("is_best", flag(F.col("trial") == best))


def direct_multi_horizon(
    df: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    label: str = "load",
    min_train: int = 100,
    min_val: int = 10,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """One model per horizon on a temporal 80/20 split: (predictions, metrics); horizons with few rows are skipped.

    The features are binned once, with a label for every horizon, and all horizons are fitted together.
    """
    wide = cut_lineage(
        holdout_split(horizon_targets(df.dropna(subset=list(features)), label, horizons, grid, keys=keys, ts=ts), 0, 0.2, keys, ts, grid)
    )
    targets = [f"target_{h}h" for h in horizons]
    binned = boosting.bin_rows(wide, features, targets, [F.when(F.col("split") == "train", TRAIN).when(F.col("split") == "validation", VALID).otherwise(NONE)])
    enough = [i for i in range(len(horizons)) if binned.sizes.get((i, 0, TRAIN), 0) >= min_train and binned.sizes.get((i, 0, VALID), 0) >= min_val]
    if not enough:
        raise ValueError("no horizon has enough rows")
    models = boosting.fit_all(binned, [Fit(Settings(**settings), label=i) for i in enough])
    fitted = {horizons[i]: m for i, m in zip(enough, models, strict=True)}
    pairs = F.explode(F.array(*[F.struct(F.lit(horizons[i]).alias("horizon"), F.col(targets[i]).cast("double").alias("y_true")) for i in enough]))
    long = wide.where("split = 'validation'").select(*keys, ts, *features, pairs.alias("_h")).where("_h.y_true IS NOT NULL")
    long = long.select(*keys, ts, *features, F.col("_h.horizon").alias("horizon"), F.col("_h.y_true").alias("y_true"))
    scored = long.withColumn("prediction", boosting.column_of(fitted, F.col("horizon"))).select(*keys, ts, "horizon", "y_true", "prediction")
    measured = scored.groupBy("horizon").agg(*[c.alias(n) for n, c in metric_columns("y_true", "prediction").items() if n in ("rmse", "mae", "n")])
    return scored, measured


def recursive_feature_forecast(
    score: Callable[[DataFrame], DataFrame],
    df: DataFrame,
    make_features: Callable[[DataFrame], DataFrame],
    depth: int,
    horizon: int,
    column: str = "load",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Feed a model with its own predictions: one pass per step over one row per series.

    At each step ``make_features`` gets the rows (keys, ``ts`` of the step, ``history``: the last ``depth`` values, oldest
    first, predictions included) and adds whatever the model reads: lags and rolling statistics of the history, calendar
    columns of the timestamp, joined covariates.  ``score`` adds ``prediction``.  Series with fewer values are left out.
    """
    recent = edge_rows(df, depth, keys, ts, grid, rank="_back")
    history = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col(column).cast("double").alias("v")))), lambda x: x["v"]
    )
    rows = recent.groupBy(*keys).agg(F.max(ts).alias("_from"), history.alias("_all")).where(F.size("_all") == depth)
    for step in range(1, horizon + 1):
        at = F.timestamp_seconds(F.unix_seconds("_from") + F.lit(step * grid.step_seconds)).alias(ts)
        inputs = make_features(rows.select(*keys, at, F.slice("_all", -depth, depth).alias("history"), "_from", "_all"))
        rows = score(inputs).select(*keys, "_from", F.concat("_all", F.array(F.col("prediction").cast("double"))).alias("_all"))
        if step % 24 == 0 and step < horizon:
            rows = cut_lineage(rows)
    out = rows.select(*keys, "_from", F.posexplode(F.slice("_all", depth + 1, horizon)).alias("_pos", "y_pred"))
    step_no = F.col("_pos") + 1
    return out.select(*keys, F.timestamp_seconds(F.unix_seconds("_from") + step_no * grid.step_seconds).alias(ts), step_no.alias("step"), "y_pred")


def recursive_tree_forecast(
    model: Ensemble,
    df: DataFrame,
    lags: Sequence[int],
    horizon: int = 168,
    column: str = "load",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
    inputs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    depth: int | None = None,
) -> DataFrame:
    """The recursion for a tree model, all steps in one stage: (keys, ``ts``, step, y_pred).

    A row per series holds its last values; its task walks the trees for a whole batch of series and appends the prediction, step
    after step.  Without ``inputs`` the model's features are lags, in the order of ``lags``; else ``inputs`` makes them (features
    by series) from the last ``depth`` values (series by place, oldest first) and the seconds of the step.  Series with fewer values
    are left out.
    """
    depth = depth or max(lags)
    recent = edge_rows(df, depth, keys, ts, grid, rank="_back")
    values = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col(column).cast("double").alias("v")))), lambda x: x["v"])
    rows = recent.groupBy(*keys).agg(F.max(ts).alias("_from"), values.alias("_all")).where(F.size("_all") == depth)
    rows = rows.select(*keys, F.unix_seconds("_from").alias("_s"), "_all")
    picked = [depth - k for k in lags]

    def run(batches):
        for batch in batches:
            known = np.array(batch.column(batch.num_columns - 1).to_pylist(), np.float64).reshape(-1, depth)
            seconds = batch.column(batch.num_columns - 2).to_numpy()
            whole = np.concatenate([known, np.empty((len(known), horizon))], 1)
            for step in range(horizon):
                now = whole[:, step : step + depth]
                x = now[:, picked].T if inputs is None else inputs(now, seconds + (step + 1) * grid.step_seconds)
                whole[:, depth + step] = model.scores(np.ascontiguousarray(x))
            found = pa.array(list(whole[:, depth:]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=batch.schema.names)

    out = rows.mapInArrow(run, rows.schema).select(*keys, "_s", F.posexplode("_all").alias("_p", "y_pred"))
    step = F.col("_p") + 1
    return out.select(*keys, F.timestamp_seconds(F.col("_s") + step * grid.step_seconds).alias(ts), step.alias("step"), "y_pred")


def isotonic_recalibration(df: DataFrame, feature: str, sign: int, prediction: str = "prediction", label: str = "load") -> DataFrame:
    """Add ``recalibrated``: the prediction plus the difference that makes its mean monotone in ``feature``.

    The mean prediction and the mean label of every value of the feature are compared; the isotonic fit of the label means,
    weighted by their counts (rising for ``sign`` 1, falling for -1), replaces the prediction means.  Values without a label
    take the fit between their neighbours.  Rows without the feature keep their prediction.  The fit gathers the pooled runs
    of values on the driver: as many as there are different fitted means, at most two for each value.
    """
    if sign not in (1, -1):
        raise ValueError("sign must be 1 or -1")
    value = F.nullif(F.col(feature).cast("double"), F.lit(float("nan"))) + F.lit(0.0)
    keyed = df.withColumn("_value", value)
    known = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    means = keyed.where(F.col("_value").isNotNull() & F.col(prediction).isNotNull()).groupBy("_value").agg(
        F.avg(F.when(known, F.col(label))).alias("_label"),
        F.coalesce(F.avg(F.when(known, F.col(prediction))), F.avg(prediction)).alias("_mean"),
        F.count_if(known).cast("double").alias("_weight"),
    )
    means = cut_lineage(means)
    fit = IsotonicRegression(featuresCol="_value", labelCol="_label", weightCol="_weight", predictionCol="_fit", isotonic=sign > 0).fit(means.where("_weight > 0"))
    shift = fit.transform(means).select("_value", (F.col("_fit") - F.col("_mean")).alias("_shift"))
    moved = F.col(prediction) + F.coalesce("_shift", F.lit(0.0))
    return keyed.join(shift, "_value", "left").withColumn("recalibrated", moved).drop("_value", "_shift")


# --- linear models from sufficient statistics -------------------------------------------------------------------------


def _gram_columns(features: Sequence[str], label: str, weight: Column | None = None) -> list[Column]:
    """Sums of the weighted cross products of (1, features) and with the label: the size depends on p only."""
    w = weight if weight is not None else F.lit(1.0)
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    cells = [F.sum(w * xs[i] * xs[j]).alias(f"g_{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    return cells + [F.sum(w * x * F.col(label)).alias(f"b_{i}") for i, x in enumerate(xs)]


def _solve(row: Mapping[str, float], p: int) -> np.ndarray:
    """Coefficients from the sums; columns are scaled first, and a singular system gets its smallest solution."""
    gram = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = row[f"g_{i}_{j}"]
    target = np.array([row[f"b_{i}"] for i in range(p)])
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return np.linalg.lstsq(gram / np.outer(scale, scale), target / scale, rcond=1e-13)[0] / scale


def linear_column(coefficients: Sequence[float], features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col(f) for c, f in zip(coefficients[1:], features)], F.lit(float(coefficients[0])))


def fit_linear(df: DataFrame, features: Sequence[str], label: str = "load") -> list[float]:
    """Least squares: one aggregation, then a (p+1)-sized solve on the driver."""
    rows = df.dropna(subset=[label, *features])
    return [float(x) for x in _solve(rows.agg(*_gram_columns(features, label)).first().asDict(), len(features) + 1)]


def quantile_regression(
    df: DataFrame, features: Sequence[str], q: float, label: str = "load", rounds: int = 200, eps: float = 1e-1, tolerance: float = 1e-6
) -> list[float]:
    """Linear quantile regression by reweighted least squares; each round is one aggregation.

    ``eps`` is the share of the mean absolute residual below which residuals weigh alike; it shrinks with every round.
    Rounds go on until the pinball loss changes by less than ``tolerance`` of itself with ``eps`` at its end, so the
    result does not depend on the unit of the data.
    """
    coefficients = fit_linear(df, features, label)
    before, last_eps = None, 1e-4
    for _ in range(rounds):
        residual = F.col(label) - linear_column(coefficients, features)
        loss = F.avg(F.greatest(q * residual, (q - 1) * residual)).alias("_loss")
        scale, pinball = df.agg(F.avg(F.abs(residual)).alias("_scale"), loss).first()
        if not scale or (before is not None and eps <= last_eps and abs(before - pinball) <= tolerance * pinball):
            break
        before = pinball
        weight = F.when(residual >= 0, q).otherwise(1 - q) / F.greatest(F.abs(residual), F.lit(eps * scale))
        row = df.agg(*_gram_columns(features, label, weight)).first().asDict()
        coefficients = [float(x) for x in _solve(row, len(features) + 1)]
        eps = max(last_eps, eps * 0.7)
    return coefficients


def quantile_forecast(
    df: DataFrame, features: Sequence[str], quantiles: Sequence[float] = (0.1, 0.5, 0.9), label: str = "load", rounds: int = 200
) -> DataFrame:
    """Add one predicted column per quantile (``q10`` ...) plus ``lower`` and ``upper`` from the outer ones."""
    rows = cut_lineage(df.dropna(subset=[label, *features]))
    fits = _run_all([lambda q=q: quantile_regression(rows, features, q, label, rounds) for q in quantiles])
    out = rows.withColumns({quantile_name(q): linear_column(c, features) for q, c in zip(quantiles, fits)})
    names = [quantile_name(q) for q in sorted(quantiles)]
    return out.withColumns({"lower": F.least(*names) if len(names) > 1 else F.col(names[0]), "upper": F.greatest(*names) if len(names) > 1 else F.col(names[0])})


def quantile_tree_forecast(
    df: DataFrame,
    features: Sequence[str],
    quantiles: Sequence[float] = (0.1, 0.5, 0.9),
    label: str = "load",
    role: Column | None = None,
    **settings,
) -> DataFrame:
    """Boosted trees for every quantile, fitted together: one column each (``q10`` ...) plus ``lower`` and ``upper``.

    Trees follow the gradients of the pinball loss; every leaf gets the exact quantile of its residuals.  ``role`` says which rows
    train and which stop the boosting early (default: all train); all rows are predicted.
    """
    rows = cut_lineage(df.dropna(subset=[label, *features]))
    binned = boosting.bin_rows(rows, features, [label], [F.lit(TRAIN) if role is None else role])
    models = boosting.fit_all(binned, [Fit(Settings(quantile=q, **settings)) for q in quantiles])
    if None in models:
        raise ValueError("no training rows")
    out = rows.withColumns({quantile_name(q): m.column() for q, m in zip(quantiles, models, strict=True)})
    names = [quantile_name(q) for q in sorted(quantiles)]
    return out.withColumns({"lower": F.least(*names) if len(names) > 1 else F.col(names[0]), "upper": F.greatest(*names) if len(names) > 1 else F.col(names[0])})


# --- whole experiment -------------------------------------------------------------------------------------------------


def holdout_experiment(
    df: DataFrame, features: Sequence[str], test_rows: int, label: str = "load", forest: int = 50, forest_depth: int = 10, repeats: int = 5, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY, **settings
) -> DataFrame:
    """Split, naive baselines, pruning, fit, metrics: one results row per method, each over all test rows together."""
    spark = df.sparkSession
    rows = cut_lineage(holdout_split(df.dropna(subset=[label, *features]), test_rows, keys=keys, ts=ts, grid=grid))
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    naive = compare_baselines(train, test, test_rows, column=label, keys=keys, ts=ts, grid=grid, pooled=True)
    naive = naive.select("method", "rmse", "mae", "mape", "r2", "max_error")
    pruned = permutation_prune(rows.where("split = 'train'"), features, label, repeats=repeats, trees=forest, depth=forest_depth)
    kept = [r[0] for r in pruned.where("kept = 1").orderBy("feature").collect()] or list(features)
    model = fit_gbt(train.withColumn("_val", F.col("split") == "validation"), kept, label, "_val", **settings)
    scored = predict(model, test)
    names = ("rmse", "mae", "mape", "r2", "max_error")
    boosted = scored.agg(*[c.alias(n) for n, c in metric_columns(label, "prediction").items() if n in names])
    both = naive.unionByName(boosted.withColumn("method", F.lit("gbt")))
    sizes = rows.agg(F.struct(F.count_if(F.col("split") != "test").alias("a"), F.count_if(F.col("split") == "test").alias("b"))).scalar()
    return both.withColumn("_n", sizes).select(
        "method", *names, F.col("_n.a").alias("n_train"), F.col("_n.b").alias("n_test"),
        F.lit(len(features)).alias("n_features"), F.lit(len(kept)).alias("n_features_kept"), F.lit(",".join(kept)).alias("features_kept"),
    )
