"""Sampling Shapley values for any scored model: coalition rows are exploded, scored and averaged by Spark."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.guards import flag, hash32

ROW = ("series_id", "timestamp")
Score = Callable[[DataFrame], DataFrame]


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] = ROW, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same rows in every run (a top-n, so no full sort)."""
    return df.orderBy(hash32(*keys, F.lit(seed)), *keys).limit(n)


def background_array(df: DataFrame, features: Sequence[str], n: int, keys: Sequence[str] = ROW, seed: int = 42) -> Column:
    """The feature values of ``n`` sampled rows as one array value."""
    picked = sample_rows(df.dropna(subset=list(features)), n, keys, seed)
    return picked.agg(F.sort_array(F.collect_list(F.struct(hash32(*keys).alias("_o"), *features)))).scalar()


def _orders(features: Sequence[str], count: int, seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    return [rng.sample(range(len(features)), len(features)) for _ in range(count)]


def sampling_shapley(
    df: DataFrame,
    features: Sequence[str],
    score: Score,
    background: DataFrame,
    n_background: int = 20,
    keys: Sequence[str] = ROW,
    seed: int = 42,
) -> DataFrame:
    """Long attribution table.  Sum of phi = prediction minus mean prediction of the background, exactly.

    Order i of the features goes with background row i.  Walking along the order replaces the background values one by
    one; a score counts for the feature just replaced and against the next one.  A row is expanded to
    ``n_background * (p + 1)`` scored rows, which are summed per feature before they leave the task.
    """
    p = len(features)
    back = background_array(background, features, n_background, keys, seed)
    orders = _orders(features, n_background, seed)
    # order of the features and, per feature, the step at which it is replaced
    order_lit = F.array(*[F.array(*[F.lit(features[f]) for f in o]) for o in orders])
    step_lit = F.array(*[F.array(*[F.lit(o.index(f) + 1) for f in range(p)]) for o in orders])
    rows = df.select(*keys, F.struct(*features).alias("_x")).withColumn("_back", back)
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.least(F.size("_back"), F.lit(n_background)) - 1)))
    rows = rows.withColumns({"_n": F.least(F.size("_back"), F.lit(n_background)), "_order": F.element_at(order_lit, F.col("_b") + 1), "_steps": F.element_at(step_lit, F.col("_b") + 1), "_bg": F.element_at("_back", F.col("_b") + 1)}).drop("_back")
    rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(p))))
    mixed = rows.withColumns(
        {f: F.when(F.col("_steps")[i] <= F.col("_s"), F.col(f"_x.{f}")).otherwise(F.col(f"_bg.{f}")) for i, f in enumerate(features)}
    )
    scored = score(mixed)
    share = F.col("prediction") / F.col("_n")
    gains = F.array_compact(
        F.array(
            F.when(F.col("_s") > 0, F.struct(F.try_element_at("_order", F.greatest(F.col("_s"), F.lit(1))).alias("feature"), share.alias("gain"))),
            F.when(F.col("_s") < p, F.struct(F.try_element_at("_order", F.col("_s") + 1).alias("feature"), (-share).alias("gain"))),
        )
    )
    # full coalitions give the prediction, empty ones the base value; both are carried as pseudo features
    ends = F.array_compact(
        F.array(
            F.when(F.col("_s") == p, F.struct(F.lit("__prediction").alias("feature"), share.alias("gain"))),
            F.when(F.col("_s") == 0, F.struct(F.lit("__base").alias("feature"), share.alias("gain"))),
        )
    )
    sums = scored.select(*keys, F.inline(F.concat(gains, ends))).groupBy(*keys, "feature").agg(F.sum("gain").alias("phi"))
    # one row per explained row and feature from here on
    wide = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "phi"))).alias("_m"))
    values = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    entries = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col("_m")[f].alias("phi")) for f in features]
    )
    return values.join(wide, list(keys)).select(
        *keys, F.col("_m")["__prediction"].alias("prediction"), F.col("_m")["__base"].alias("base_value"), F.inline(entries)
    )


def interaction_values(
    df: DataFrame,
    features: Sequence[str],
    pair: tuple[str, str],
    score: Score,
    background: DataFrame,
    n_background: int = 20,
    keys: Sequence[str] = ROW,
    seed: int = 42,
) -> DataFrame:
    """Shapley interaction of a feature pair per row: f(S+ij) - f(S+i) - f(S+j) + f(S), averaged over random sets S."""
    first, second = pair
    others = [f for f in features if f not in pair]
    rng = random.Random(seed)
    sets = []
    for _ in range(n_background):
        order = rng.sample(range(len(others) + 1), len(others) + 1)  # the pair moves as one element
        cut = order.index(len(others))
        sets.append([others[i] for i in order[:cut]])
    member = F.array(*[F.array(*[F.lit(f in s) for f in others]) if others else F.array(F.lit(False)) for s in sets])
    back = background_array(background, features, n_background, keys, seed)
    rows = df.select(*keys, F.struct(*features).alias("_x")).withColumn("_back", back)
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.least(F.size("_back"), F.lit(n_background)) - 1)))
    rows = rows.withColumns({"_bg": F.element_at("_back", F.col("_b") + 1), "_in": F.element_at(member, F.col("_b") + 1)}).drop("_back")
    corners = F.array(
        *[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(s).alias("sign")) for a, b, s in ((True, True, 1.0), (True, False, -1.0), (False, True, -1.0), (False, False, 1.0))]
    )
    rows = rows.select("*", F.inline(corners))

    def chosen(f: str) -> Column:
        if f == first:
            return F.col("i")
        if f == second:
            return F.col("j")
        return F.col("_in")[others.index(f)]

    mixed = rows.withColumns({f: F.when(chosen(f), F.col(f"_x.{f}")).otherwise(F.col(f"_bg.{f}")) for f in features})
    out = score(mixed).groupBy(*keys).agg((F.sum(F.col("sign") * F.col("prediction")) / F.count_distinct("_b")).alias("interaction"))
    return out.select(*keys, F.lit(first).alias("feature_a"), F.lit(second).alias("feature_b"), "interaction")


def monotone_audit(
    df: DataFrame, constraints: dict[str, int], values: dict[str, Sequence[float]], score: Score, keys: Sequence[str] = ROW, tolerance: float = 1e-9
) -> DataFrame:
    """Share of grid steps on which the prediction moves against the wanted sign, per constrained feature."""
    parts = []
    for feature, sign in constraints.items():
        if sign == 0 or feature not in values:
            continue
        grid = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(x)) for x in sorted(values[feature])])))
        order = Window.partitionBy(*keys).orderBy(feature)
        step = F.col("prediction") - F.lag("prediction").over(order)
        parts.append(
            score(grid).withColumn("_step", step).where("_step IS NOT NULL").agg(
                F.lit(feature).alias("feature"),
                F.lit(sign).alias("monotone_constraint"),
                F.count(F.lit(1)).alias("n_steps"),
                F.sum(flag(F.col("_step") * sign < -tolerance)).alias("n_violations"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("violation_share", F.try_divide("n_violations", "n_steps"))
