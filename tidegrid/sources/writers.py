"""Sinks: tables, importance lists, result records and batch scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.guards import require_columns


def write_table(
    df: DataFrame, path: str, file_format: str = "parquet", partition_by: Sequence[str] = (), compression: str | None = None
) -> str:
    """Parquet (snappy unless told otherwise) or CSV (not compressed unless told otherwise)."""
    if file_format not in ("parquet", "csv"):
        raise ValueError(f"Unsupported file format: {file_format}")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "parquet":
        writer.option("compression", compression or "snappy").parquet(path)
    else:
        if compression:
            writer = writer.option("compression", compression)
        writer.option("header", True).csv(path)
    return path


def write_importance(importance: DataFrame, path: str) -> str:
    """(feature, importance), largest first, as CSV."""
    importance.select("feature", "importance").orderBy(F.desc("importance"), "feature").write.mode("overwrite").option(
        "header", True
    ).csv(path)
    return path


def write_results(results: DataFrame, path: str) -> str:
    """Result records as JSON lines."""
    results.write.mode("overwrite").json(path)
    return path


def score_batch(
    df: DataFrame, model: Transformer, features: Sequence[str], keys: Sequence[str] = ("series_id", "timestamp"), path: str | None = None
) -> DataFrame:
    """Apply a fitted model; missing features raise, extra columns are dropped, features come in model order."""
    require_columns(df, features, "scoring input")
    scored = model.transform(df.select(*keys, *features)).select(*keys, "prediction")
    if path is None:
        return scored
    write_table(scored, path)
    return df.sparkSession.read.parquet(path)
