"""Hooks for user code: scalar scoring functions and per-chunk pandas functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid


def score_udf(predict: Callable[[pd.DataFrame], Sequence[float]], features: Sequence[str]) -> Column:
    """Column with ``predict`` applied to Arrow batches of the feature columns: any object with a vectorised predict."""
    names = list(features)

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(predict(pd.concat(columns, axis=1, keys=names)), dtype="float64")

    return score(*[F.col(f).cast("double") for f in names])


def apply_per_chunk(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """``fn`` on one time bucket of one series at a time, rows in time order: at most ``bucket_steps`` rows per call."""

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows.sort_values(ts).drop(columns="_bucket"))

    return df.withColumn("_bucket", grid.bucket(ts)).groupBy(*keys, "_bucket").applyInPandas(ordered, schema)
