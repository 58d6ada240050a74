"""Run and model-version tables: append-only rows, state derived by grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ("Staging", "Production")
TEXT_LIMIT = 500


def flatten_names(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all leaf fields."""
    names: list[str] = []
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            names += flatten_names(field.dataType, f"{prefix}{field.name}.")
        else:
            names.append(f"{prefix}{field.name}")
    return names


def clipped(value: Column) -> Column:
    """Text of at most 500 characters; longer text keeps its first 497 and an ellipsis."""
    text = value.cast("string")
    return F.when(F.length(text) > TEXT_LIMIT, F.concat(F.left(text, F.lit(TEXT_LIMIT - 3)), F.lit("..."))).otherwise(text)


def flatten_params(df: DataFrame, column: str) -> Column:
    """Map from dotted name to clipped text for a nested struct column."""
    schema = df.schema[column].dataType
    names = flatten_names(schema)
    pairs = [x for n in names for x in (F.lit(n), clipped(F.col(f"{column}.{n}")))]
    return F.create_map(*pairs)


def metric_map(columns: Sequence[str]) -> Column:
    """Map of the named numbers without NULL and NaN."""
    pairs = [x for c in columns for x in (F.lit(c), F.nanvl(F.col(c).try_cast("double"), F.lit(None)))]
    return F.map_filter(F.create_map(*pairs), lambda _, x: x.isNotNull())


def run_rows(df: DataFrame, run_id: Column, params: str, metrics: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Rows of the run table: ``run_id``, flattened params and metrics."""
    return df.select(run_id.alias("run_id"), *extra, flatten_params(df, params).alias("params"), metric_map(metrics).alias("metrics"))


def top_importance_params(importance: DataFrame, n: int = 10) -> Column:
    """Scalar map of the ``n`` largest importances, to be added to a run."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(n)
    return best.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance")))).scalar()


def log_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def best_run(runs: DataFrame, metric: str, ascending: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """The run with the smallest (or largest) value of a metric; ties go to the first run id."""
    scored = runs.withColumn("_m", F.try_element_at("metrics", F.lit(metric))).where("_m IS NOT NULL")
    order = F.struct(F.col("_m") if ascending else -F.col("_m"), F.col("run_id"))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("run_id", "params", "metrics"), order).alias("_r"))
    return best.select(*keys, "_r.*")


def compare_runs(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Runs with one column per metric."""
    return runs.select("run_id", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])


# --- versions -----------------------------------------------------------------------------------------------------
# A version table row is an event (name, version, stage, seq): registration has stage 'None', later events move it.


def current_stages(events: DataFrame) -> DataFrame:
    """Stage of every version now.

    Its last event decides, but a version in a served stage is archived once another one was moved there later.
    """
    last = events.groupBy("name", "version").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))
    served = events.where(F.col("stage").isin(*STAGES))
    holder = served.groupBy("name", "stage").agg(F.max("seq").alias("_top"))
    out = last.join(holder, ["name", "stage"], "left")
    displaced = F.col("_top").isNotNull() & (F.col("seq") < F.col("_top"))
    return out.select("name", "version", F.when(displaced, "Archived").otherwise(F.col("stage")).alias("stage"))


def list_versions(events: DataFrame) -> DataFrame:
    return current_stages(events).orderBy("name", F.desc("version"))


def latest_by_stage(events: DataFrame) -> DataFrame:
    return current_stages(events).groupBy("name", "stage").agg(F.max("version").alias("version"))


def promote(events: DataFrame, targets: DataFrame, stage: str) -> DataFrame:
    """Events that move ``targets`` (name, version) to ``stage``; appending them archives the current holders."""
    at = events.groupBy("name").agg((F.max("seq") + 1).alias("seq"))
    return targets.join(at, "name").select("name", "version", F.lit(stage).alias("stage"), "seq")


def rollback(events: DataFrame) -> DataFrame:
    """Events that bring the highest archived version of each model back to production."""
    best = current_stages(events).where("stage = 'Archived'").groupBy("name").agg(F.max("version").alias("version"))
    return promote(events, best, "Production")


def compare_versions(metrics: DataFrame, first: int, second: int, names: Sequence[str]) -> DataFrame:
    """Metrics of two versions side by side: (name, metric, first, second, difference)."""
    picked = metrics.where(F.col("version").isin(first, second))
    long = picked.unpivot(["name", "version"], list(names), "metric", "value")
    wide = long.groupBy("name", "metric").agg(
        F.max(F.when(F.col("version") == first, F.col("value"))).alias("first"),
        F.max(F.when(F.col("version") == second, F.col("value"))).alias("second"),
    )
    return wide.withColumn("difference", F.col("second") - F.col("first"))
