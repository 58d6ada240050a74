"""Joins of load, weather, solar and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import HOURLY, KEYS, TS, Grid, gap_islands, gap_steps
from tidegrid.operators.guards import flag


def period_slice(df: DataFrame, start: str, end: str, ts: str = TS) -> DataFrame:
    """Rows from the start day to the end day, both included; the bounds are constants, so they reach the scan."""
    return df.where(
        (F.col(ts) >= F.to_timestamp(F.lit(start))) & (F.col(ts) < F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1)))
    )


def sample_join(left: DataFrame, right: DataFrame, start: str, end: str, ts: str = TS) -> DataFrame:
    return period_slice(left, start, end, ts).join(period_slice(right, start, end, ts), ts)


def merge_load_weather(load: DataFrame, weather: DataFrame, how: str = "left", ts: str = TS, check: bool = True) -> DataFrame:
    """Equi-join on the timestamp; clashing names get ``_weather``.

    The query fails if the time ranges do not overlap: the ranges are scalar subqueries of the plan, so nothing runs before it does.
    (An empty load table has no rows to fail for.)
    """
    if check:
        mine = load.agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("b"))).scalar()
        other = weather.agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("b"))).scalar()
        apart = other["a"].isNull() | (mine["a"] > other["b"]) | (other["a"] > mine["b"])
        text = lambda c: F.coalesce(c.cast("string"), F.lit("nothing"))
        message = F.concat(F.lit("No overlap between load ("), text(mine["a"]), F.lit(" .. "), text(mine["b"]), F.lit(") and weather ("), text(other["a"]), F.lit(" .. "), text(other["b"]), F.lit(")"))
        load = load.where(F.when(apart, F.raise_error(message).cast("boolean")).otherwise(True))
    clash = {c: f"{c}_weather" for c in weather.columns if c in load.columns and c != ts}
    return load.join(weather.withColumnsRenamed(clash), ts, how)


def merge_solar(df: DataFrame, solar: DataFrame, ts: str = TS) -> DataFrame:
    """Inner join on common timestamps; only columns that are not there yet are added."""
    return df.join(solar.select(ts, *[c for c in solar.columns if c not in df.columns]), ts)


def grid_event_flag(df: DataFrame, events: DataFrame, ts: str = TS) -> DataFrame:
    """``has_grid_event`` = an event starts exactly at this timestamp."""
    at = events.select(ts).distinct().withColumn("_hit", F.lit(1))
    return df.join(at, ts, "left").withColumn("has_grid_event", flag(F.col("_hit") == 1)).drop("_hit")


def grid_event_interval_flag(df: DataFrame, events: DataFrame, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """``has_grid_event`` = start <= timestamp < start + duration.

    Each event is spread over the grid cells it touches.  In a cell only the last end of every start counts (a maximum with map-side
    combine: at most as many rows as a cell has seconds); a sweep in order of the starts merges these to disjoint spans, so the
    array of a cell is bounded, however many events overlap there.  The range join is an equi-join on the cell.
    """
    step = grid.step_seconds
    begin = F.unix_seconds(F.col(ts))
    spans = events.select(begin.alias("_from"), (begin + (F.col("duration_hours") * 3600).cast("bigint")).alias("_to"))
    spans = spans.where(F.col("_to") > F.col("_from")).groupBy("_from").agg(F.max("_to").alias("_to"))
    cells = spans.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step)))
    )
    low, high = F.col("_cell") * step, (F.col("_cell") + 1) * step
    starts = cells.groupBy("_cell", F.greatest("_from", low).alias("_s")).agg(F.max(F.least("_to", high)).alias("_e"))
    along = Window.partitionBy("_cell").orderBy("_s")
    reached = F.max("_e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("_new", flag(reached.isNull() | (F.col("_s") > reached)))
    islands = marked.withColumn("_island", F.sum("_new").over(along)).groupBy("_cell", "_island").agg(F.min("_s").alias("s"), F.max("_e").alias("e"))
    per_cell = islands.groupBy("_cell").agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    at = F.unix_seconds(F.col(ts))
    joined = df.withColumn("_cell", F.floor(at / step)).join(per_cell, "_cell", "left")
    hit = F.exists("_spans", lambda x: (x["s"] <= F.unix_seconds(F.col(ts))) & (F.unix_seconds(F.col(ts)) < x["e"]))
    return joined.withColumn("has_grid_event", flag(hit)).drop("_cell", "_spans")


def missing_timestamps(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """Steps between the first and the last row of a series that have no row; only gaps are expanded."""
    return gap_steps(gap_islands(df, keys, ts, grid), keys, ts, grid)


def align_predictions(truth: DataFrame, predicted: DataFrame, on: Sequence[str] = (*KEYS, TS)) -> DataFrame:
    """Rows present on both sides."""
    return truth.join(predicted, list(on))


def merge_all_sources(load: DataFrame, weather: DataFrame, solar: DataFrame, events: DataFrame) -> DataFrame:
    return grid_event_flag(merge_solar(merge_load_weather(load, weather), solar), events)
