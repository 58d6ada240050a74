"""What-if grids, sensitivity curves and counterfactual search for any score expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.guards import flag, hash32

ROW = ("series_id", "timestamp")
Score = Callable[[DataFrame], DataFrame]


def scored_by(expression: Column) -> Score:
    """A score function from a column expression; a fitted ML model's ``transform`` can be used instead."""
    return lambda df: df.withColumn("prediction", expression)


def whatif_grid(df: DataFrame, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Every row under every scenario (a short literal list), with the scenario's values put in place."""
    changed = sorted({f for s in scenarios.values() for f in s})
    entries = [
        F.struct(
            F.lit(name).alias("scenario"),
            *[F.lit(float(s[f]) if f in s else None).cast("double").alias(f"_new_{f}") for f in changed],
        )
        for name, s in scenarios.items()
    ]
    rows = df.select("*", F.inline(F.array(*entries)))
    return rows.withColumns({f: F.coalesce(f"_new_{f}", f) for f in changed}).drop(*[f"_new_{f}" for f in changed])


def whatif(df: DataFrame, scenarios: Mapping[str, Mapping[str, float]], score: Score, keys: Sequence[str] = ROW) -> DataFrame:
    """Base and changed prediction, difference and percentage (0 for a zero base) of each row and scenario."""
    base = score(df).withColumnRenamed("prediction", "base_prediction")
    out = score(whatif_grid(base, scenarios)).withColumnRenamed("prediction", "modified_prediction")
    delta = F.col("modified_prediction") - F.col("base_prediction")
    return out.select(
        *keys,
        "scenario",
        "base_prediction",
        "modified_prediction",
        delta.alias("delta"),
        F.when(F.col("base_prediction") != 0, delta / F.col("base_prediction") * 100).otherwise(0.0).alias("pct_change"),
    )


def sensitivity(df: DataFrame, feature: str, values: Sequence[float], score: Score, keys: Sequence[str] = ROW) -> DataFrame:
    """Prediction of each row for each value of one feature."""
    grid = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(x)) for x in values])))
    return score(grid).select(*keys, F.col(feature).alias("feature_value"), "prediction")


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) that depends on the key columns only, not on the partitioning."""
    return hash32(*parts) / F.lit(2.0**32)


def counterfactual_search(
    df: DataFrame,
    desired: Column,
    score: Score,
    vary: Sequence[str],
    k: int = 3,
    candidates: int = 200,
    permitted: Mapping[str, tuple[float, float]] | None = None,
    seed: int = 42,
    keys: Sequence[str] = ROW,
    tolerance: float = 0.05,
) -> DataFrame:
    """Up to ``k`` changed rows per query row whose prediction is within 5 % of ``desired``.

    Each query row gets ``candidates`` hash-seeded tries: a random subset of ``vary`` takes random values in its range
    (the permitted one, else the observed one).  Fewest changes win, then the smallest scaled distance.  A row without
    a hit comes back once with ``success = 0``.
    """
    spans = df.agg(F.struct(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in vary])).scalar()
    named = [F.col(c) for c in keys]
    base = score(df).withColumnRenamed("prediction", "current_prediction")
    base = base.withColumns({"desired": desired, "_span": spans, **{f"_was_{f}": F.col(f) for f in vary}})
    tries = base.withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(candidates))))
    fresh: dict[str, Column] = {}
    for f in vary:
        lo, hi = (F.lit(float(x)) for x in permitted[f]) if permitted and f in permitted else (F.col(f"_span.{f}.lo"), F.col(f"_span.{f}.hi"))
        pick = _uniform(*named, "_try", F.lit(f"pick:{f}:{seed}")) < 1.0 / len(vary) + 0.25
        fresh[f] = F.when(pick, lo + (hi - lo) * _uniform(*named, "_try", F.lit(f"value:{f}:{seed}"))).otherwise(F.col(f))
    moved = score(tries.withColumns(fresh))
    width = {f: F.nullif(F.col(f"_span.{f}.hi") - F.col(f"_span.{f}.lo"), F.lit(0.0)) for f in vary}
    changes = sum((flag(F.col(f) != F.col(f"_was_{f}")) for f in vary), F.lit(0))
    distance = sum((F.coalesce(F.abs(F.col(f) - F.col(f"_was_{f}")) / width[f], F.lit(0.0)) for f in vary), F.lit(0.0))
    bounds = [F.col("desired") * (1 - tolerance), F.col("desired") * (1 + tolerance)]
    hits = moved.where(F.col("prediction").between(F.least(*bounds), F.greatest(*bounds))).select(
        *keys, "_try", "prediction", changes.alias("n_changes"), distance.alias("distance"), *vary
    )
    order = Window.partitionBy(*keys).orderBy("n_changes", "distance", "_try")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_try")
    head = base.select(*keys, "current_prediction", "desired", *[F.col(f"_was_{f}").alias(f"{f}_original") for f in vary])
    out = head.join(best, list(keys), "left")
    return out.withColumn("success", flag(F.col("rank").isNotNull()))


def counterfactual_changes(cf: DataFrame, features: Sequence[str], keys: Sequence[str] = (*ROW, "cf_id")) -> DataFrame:
    """Changed features of each counterfactual; ``cf`` holds ``<f>_original`` and ``<f>`` for every feature."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"{f}_original").cast("double").alias("original"),
                F.col(f).cast("double").alias("counterfactual"),
            )
            for f in features
        ]
    )
    rows = cf.select(*keys, F.inline(entries)).where("original <> counterfactual")
    delta = F.col("counterfactual") - F.col("original")
    return rows.withColumns(
        {"delta": delta, "pct_change": F.when(F.col("original") != 0, delta / F.col("original") * 100).otherwise(0.0)}
    )


def counterfactual_summary(changes: DataFrame, keys: Sequence[str] = ROW, cf_id: str = "cf_id", top: int = 3) -> DataFrame:
    """Per explained row: the features changed most often, as ``name (count)``."""
    counts = changes.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("feature").alias("f"))))
    label = F.transform(F.slice(ranked, 1, top), lambda x: F.format_string("%s (%d)", x["f"], -x["o"]))
    return counts.groupBy(*keys).agg(F.array_join(label, ", ").alias("most_changed"), F.sum("n").alias("n_changes"))
