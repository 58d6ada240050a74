"""Exact order statistics (percentiles, cumulative counts) without one task per large group.

A value falls into a cell that depends on the value only (power of two and 12 leading binary digits), so the cell
borders are the same in every run and on every executor.  Ranks come from a running sum over the cell totals plus a
running sum inside the cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import settled

CELLS = 4096


def value_bucket(v: str) -> str:
    """SQL text of the order-preserving integer cell of a double: ``CELLS`` cells per power of two, 0 alone.

    The power comes from a logarithm and is then corrected by exact comparisons, so no rounding can swap two values.
    """
    guess = f"floor(log2(abs({v})))"
    power = (
        f"(CASE WHEN pow(2D, {guess}) > abs({v}) THEN {guess} - 1 WHEN pow(2D, {guess} + 1) <= abs({v}) THEN {guess} + 1"
        f" ELSE {guess} END)"
    )
    cell = f"floor((abs({v}) / pow(2D, {power}) - 1) * {CELLS}) + ({power} + 1100) * {CELLS}"
    return f"coalesce(CASE WHEN {v} = 0 THEN 0L ELSE cast(signum({v}) * ({cell}) AS bigint) END, 0L)"


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, value): for each count ``c`` the columns ``c``, ``c_upto`` (running) and ``c_total``.

    Running sums come from the totals of cells, of equal parts of each cell's own range, and of the values in a part: values that
    lie close together fill many parts, so they are not sorted in one task.
    """
    counts = counts or {"n": F.count(F.lit(1))}
    key_list = ", ".join(f"`{k}`" for k in keys)
    values = df.where(f"`{value}` IS NOT NULL").groupBy(*keys, value).agg(*[e.alias(c) for c, e in counts.items()])
    values = values.withColumn("_cell", F.expr(value_bucket(f"`{value}`")))
    at = [*keys, "_cell"]
    totals = values.groupBy(*at).agg(F.min(value).cast("double").alias("_min"), F.max(value).cast("double").alias("_max"), *[F.sum(c).alias(f"_s_{c}") for c in counts])
    # one row per key and cell: a few thousand per power of two, however many values there are
    cells = totals.selectExpr(
        *[f"`{k}`" for k in at], "_min", "_max",
        *[f"sum(_s_{c}) OVER (PARTITION BY {key_list} ORDER BY _cell) - _s_{c} AS _before_{c}" for c in counts],
        *[f"sum(_s_{c}) OVER (PARTITION BY {key_list}) AS {c}_total" for c in counts],
    )
    share = f"CASE WHEN _max > _min THEN least(floor((`{value}` - _min) / (_max - _min) * {CELLS}), {CELLS} - 1) ELSE 0 END"
    placed = values.join(settled(cells, "cells"), at).withColumn("_part", F.expr(share)).drop("_min", "_max")
    inner = [*at, "_part"]
    sizes = placed.groupBy(*inner).agg(*[F.sum(c).alias(f"_p_{c}") for c in counts])
    parts = sizes.selectExpr(
        *[f"`{k}`" for k in inner], *[f"sum(_p_{c}) OVER (PARTITION BY {key_list}, _cell ORDER BY _part) - _p_{c} AS _within_{c}" for c in counts]
    )
    local = f"OVER (PARTITION BY {key_list}, _cell, _part ORDER BY `{value}` ROWS UNBOUNDED PRECEDING)"
    return placed.join(parts, inner).selectExpr(
        *[f"`{k}`" for k in keys],
        f"`{value}`",
        *[x for c in counts for x in (c, f"_before_{c} + _within_{c} + sum({c}) {local} AS {c}_upto", f"{c}_total")],
    )


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join that also pairs null keys; the key columns come from the left."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_right_{k}"]) for k in on])
    return left.join(named, same).drop(*[f"_right_{k}" for k in on])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles, one row per key and one column per entry of ``probs``.

    One way for groups of any size: values are counted per cell, then inside the few cells that hold a wanted rank per
    equal part of the cell's own range, and only the values of the parts that hold a rank are counted one by one.  So no
    group is held by one task, also when all its values lie close together.
    """
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs).drop("_all")
    present = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    key_text = [f"`{k}`" for k in keys]
    key_list = ", ".join(key_text)
    levels = ", ".join(f"{float(p)!r}D" for p in probs.values())
    low, high = "floor({at})", "least(floor({at}) + 1, _total - 1)"

    def covers(rank: str, at: str) -> str:
        return f"(_before <= {rank.format(at=at)} AND {rank.format(at=at)} < _before + _n)"

    wanted = f"transform(array({levels}), (p, i) -> struct(i, p * (_total - 1) AS at))"
    hits = f"filter({wanted}, x -> {covers(low, 'x.at')} OR {covers(high, 'x.at')})"
    celled = present.withColumn("_cell", F.expr(value_bucket("_v")))
    totals = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    placed = totals.selectExpr(
        *key_text, "_cell", "_n", "_min", "_max",
        f"sum(_n) OVER (PARTITION BY {key_list} ORDER BY _cell) - _n AS _before", f"sum(_n) OVER (PARTITION BY {key_list}) AS _total",
    )
    # at most two cells per percentile and key, and two parts of each
    cells = placed.where(f"size({hits}) > 0").selectExpr(*key_text, "_cell", "_min", "_max", "_total", "_before AS _cell_before")
    at = [*keys, "_cell", "_part"]
    share = f"CASE WHEN _max > _min THEN least(floor((_v - _min) / (_max - _min) * {CELLS}), {CELLS} - 1) ELSE 0 END"
    inner = _join_null_safe(celled, cells, [*keys, "_cell"]).withColumn("_part", F.expr(share))
    parts = inner.groupBy(*at, "_total", "_cell_before").agg(F.count(F.lit(1)).alias("_n"))
    upto = f"sum(_n) OVER (PARTITION BY {key_list}, _cell ORDER BY _part)"
    parts = parts.selectExpr(*key_text, "_cell", "_part", "_total", "_n", f"_cell_before + {upto} - _n AS _before")
    parts = parts.where(f"size({hits}) > 0").selectExpr(*key_text, "_cell", "_part", "_before AS _part_before")
    counted = _join_null_safe(inner, parts, at).groupBy(*at, "_total", "_part_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = f"sum(_n) OVER (PARTITION BY {key_list}, _cell, _part ORDER BY _v ROWS UNBOUNDED PRECEDING)"
    ranked = counted.selectExpr(*key_text, "_total", "_v", "_n", f"_part_before + {inside} - _n AS _before")
    hit = ranked.selectExpr(*key_text, "_total", "_v", "_n", "_before", f"inline({hits}) AS (_i, _at)")
    sides = hit.groupBy(*keys, "_i").agg(
        F.expr(f"max(CASE WHEN {covers(low, '_at')} THEN _v END) AS _lo"),
        F.expr(f"max(CASE WHEN {covers(high, '_at')} THEN _v END) AS _hi"),
        F.expr("max(_at - floor(_at)) AS _share"),
    )
    result = "_lo + (_hi - _lo) * _share"
    return sides.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN _i = {i} THEN {result} END) AS `{n}`") for i, n in enumerate(probs)])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int | None = None) -> DataFrame:
    """Exact by default; with ``accuracy`` a mergeable sketch of that size is used instead."""
    if accuracy is None:
        return exact_percentiles(df, keys, value, probs)
    return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, accuracy).alias(n) for n, p in probs.items()])
