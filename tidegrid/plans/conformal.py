"""Ensemble batch prediction intervals (EnbPI) with a linear base learner, per series."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, with_ordinal
from tidegrid.operators.ranks import percentiles
from tidegrid.plans.learning import _gram_columns, _solve
from tidegrid.session import settled


def block_draws(resamples: int, blocks: int, seed: int = 42) -> list[list[int]]:
    """Drawn block numbers of each resampling."""
    rng = random.Random(seed)
    return [[rng.randrange(blocks) for _ in range(blocks)] for _ in range(resamples)]


def fit_ensemble(
    df: DataFrame, features: Sequence[str], label: str, resamples: int, blocks: int, keys: Sequence[str], seed: int
) -> DataFrame:
    """(keys, block, loo, ensemble): mean coefficients of the resamples without the block, and of all resamples.

    The rows enter only through per-block sums; a group of the pandas step has ``blocks`` rows.
    """
    stats = df.groupBy(*keys, "block").agg(*_gram_columns(features, label))
    cells = [c for c in stats.columns if c not in (*keys, "block")]
    size, draws = len(features) + 1, block_draws(resamples, blocks, seed)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        by_block = rows.set_index("block")[cells]
        fits = []
        for draw in draws:
            total = by_block.reindex(draw).fillna(0.0).sum()
            fits.append((set(draw), _solve(total.to_dict(), size)))
        whole = np.mean([c for _, c in fits], axis=0)
        out = []
        for block in by_block.index:
            unseen = [c for seen, c in fits if block not in seen]
            out.append(np.mean(unseen, axis=0) if unseen else whole)
        head = {k: rows[k].iloc[0] for k in keys}
        return pd.DataFrame(
            {**head, "block": by_block.index.to_numpy(), "loo": [list(x) for x in out], "ensemble": [list(whole)] * len(out)}
        )

    types = dict(stats.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["block int, loo array<double>, ensemble array<double>"])
    return stats.groupBy(*keys).applyInPandas(solve, schema)


def _linear(coefficients: Column, features: Sequence[str]) -> Column:
    total = coefficients[0]
    for i, f in enumerate(features, 1):
        total = total + coefficients[i] * F.col(f)
    return total


def conformal_enbpi(
    train: DataFrame,
    future: DataFrame,
    features: Sequence[str],
    label: str = "load",
    confidence: float = 0.9,
    resamples: int = 30,
    blocks: int = 10,
    betas: int = 21,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
    seed: int = 42,
) -> DataFrame:
    """Predictions and intervals for ``future``: leave-one-out residual quantiles, the shift that gives the narrowest band."""
    alpha = 1 - confidence
    rows = with_ordinal(train.dropna(subset=[label, *features]).select(*keys, ts, label, *features), keys, ts, grid)
    rows = rows.withColumn("block", F.floor(F.col("ordinal") * blocks / F.col("ordinal_n")).cast("int")).drop("ordinal", "ordinal_n")
    # one row per series and block; kept, because residuals and predictions both need it
    ensemble = settled(fit_ensemble(rows, features, label, resamples, blocks, keys, seed), "ensemble")
    residuals = rows.join(ensemble, [*keys, "block"]).select(*keys, (F.col(label) - _linear(F.col("loo"), features)).alias("_res"))
    steps = [alpha * i / (betas - 1) for i in range(betas)]
    probs = {**{f"lo{i}": b for i, b in enumerate(steps)}, **{f"hi{i}": min(1.0, 1 - alpha + b) for i, b in enumerate(steps)}}
    levels = percentiles(residuals, keys, "_res", probs)
    bands = F.array(
        *[
            F.struct((F.col(f"hi{i}") - F.col(f"lo{i}")).alias("width"), F.lit(b).alias("beta"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
            for i, b in enumerate(steps)
        ]
    )
    best = levels.select(*keys, F.array_min(bands).alias("band"))
    model = settled(ensemble.groupBy(*keys).agg(F.min_by("ensemble", "block").alias("ensemble")).join(best, list(keys)), "model")
    scored = future.dropna(subset=list(features)).join(model, list(keys)).withColumn("y_pred", _linear(F.col("ensemble"), features))
    return scored.select(
        *keys, ts, F.col(label).alias("y_true"), "y_pred", (F.col("y_pred") + F.col("band.lo")).alias("lower"),
        (F.col("y_pred") + F.col("band.hi")).alias("upper"), F.col("band.beta").alias("beta"),
    )
