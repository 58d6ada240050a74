"""Windows over long series without putting a whole series into one task.

A series is cut into time buckets of ``bucket_steps`` grid steps.  With one row per (key, grid step) a bucket has at
most ``bucket_steps`` rows, however long or hot its series is.  Positional frames that reach across a bucket border
get the rows they need as a *halo*: copies of the last (or first) few rows of neighbouring buckets.  Which buckets
need whose rows is decided on a table with one row per bucket, so gaps and almost empty buckets are handled exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.session import settled

KEYS = ("series_id",)
TS = "timestamp"


@dataclass(frozen=True)
class Grid:
    """Sampling step and the number of steps per bucket."""

    step_seconds: int = 3600
    bucket_steps: int = 6000

    def bucket(self, ts: str = TS) -> Column:
        return F.floor(F.unix_seconds(F.col(ts)) / F.lit(self.step_seconds * self.bucket_steps))


HOURLY = Grid()
DAILY = Grid(step_seconds=86400)


def _bucketed(df: DataFrame, grid: Grid, ts: str) -> DataFrame:
    return df.withColumn("_bucket", grid.bucket(ts))


def _halo(df: DataFrame, reach: int, backwards: bool, keys: Sequence[str], ts: str) -> DataFrame:
    """Copies of rows for the buckets that need them; ``backwards`` feeds later buckets from earlier ones."""
    near, far = (F.desc, F.asc) if backwards else (F.asc, F.desc)
    at = [*keys, "_bucket"]
    edge = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*at).orderBy(near(ts)))).where(
        F.col("_rank") <= reach
    )
    along = Window.partitionBy(*keys).orderBy(far("_bucket"))
    # counted on its own: a partial count before the shuffle, no sort
    sizes = df.groupBy(*at).agg(F.least(F.count(F.lit(1)), F.lit(reach)).alias("_size"))
    sizes = sizes.withColumn("_upto", F.sum("_size").over(along))
    following = F.collect_list(F.struct(F.col("_bucket").alias("to"), (F.col("_upto") - F.col("_size")).alias("before")))
    route = sizes.select(
        *at, F.col("_upto").alias("_mine"), following.over(along.rowsBetween(1, reach)).alias("_next")
    ).select(
        *at,
        F.filter(
            F.transform("_next", lambda x: F.struct(x["to"].alias("to"), (x["before"] - F.col("_mine")).alias("gap"))),
            lambda x: x["gap"] < reach,
        ).alias("_next"),
    )
    sent = edge.join(route, at).withColumn(
        "_to", F.explode(F.filter("_next", lambda x: F.col("_rank") + x["gap"] <= reach))
    )
    return sent.withColumn("_bucket", F.col("_to.to")).drop("_rank", "_next", "_to")


def with_halo(
    df: DataFrame,
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with their ``_bucket`` and ``_own`` true, and copies (``_own`` false) of the ``back`` rows before and ``ahead`` rows behind it."""
    own = _bucketed(df, grid, ts)
    wanted = list(dict.fromkeys([*keys, ts, "_bucket", *(carry if carry is not None else df.columns)]))
    parts = [own.withColumn("_own", F.lit(True))]
    for reach, backwards in ((back, True), (ahead, False)):
        if reach > 0:
            parts.append(_halo(own.select(*wanted), reach, backwards, keys, ts).withColumn("_own", F.lit(False)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def over_chunks(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``build(window)`` columns, where the frames reach at most ``back`` / ``ahead`` rows.

    ``carry`` names the value columns the expressions read; only these travel with the halo.  Needs unique (keys, ts).
    """
    rows = with_halo(df, back, ahead, keys, ts, grid, carry)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    return rows.withColumns(build(w)).where("_own").drop("_own", "_bucket")


def over_time_chunks(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    back_seconds: int,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
) -> DataFrame:
    """Add ``build(window partition)`` columns whose frames reach back less than ``back_seconds`` of time.

    Every row is also sent to the later buckets that begin within that time, so neither the density of the data nor
    copies of a timestamp matter.  The window passed to ``build`` has no order; the caller orders it by time.
    """
    own = _bucketed(df, grid, ts)
    width = grid.step_seconds * grid.bucket_steps
    last = F.floor((F.unix_seconds(F.col(ts)) + F.lit(back_seconds - 1)) / F.lit(width))
    rows = own.withColumn("_to", F.explode_outer(F.sequence(F.col("_bucket"), last)))
    rows = rows.withColumn("_own", F.coalesce(F.col("_to") == F.col("_bucket"), F.lit(True)))
    return rows.withColumns(build(Window.partitionBy(*keys, "_to"))).where("_own").drop("_own", "_bucket", "_to")


def with_ordinal(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY, name: str = "ordinal"
) -> DataFrame:
    """Add the 0-based position of each row in its series and the series length ``<name>_n``."""
    own = _bucketed(df, grid, ts)
    at = [*keys, "_bucket"]
    sizes = own.groupBy(*at).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *at,
        (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias(f"{name}_n"),
    )
    local = F.row_number().over(Window.partitionBy(*at).orderBy(ts))
    return own.join(offsets, at).withColumn(name, F.col("_before") + local - 1).drop("_bucket", "_before")


def edge_rows(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    grid: Grid = HOURLY,
    rank: str = "rank",
    last: bool = True,
) -> DataFrame:
    """The last (or first) ``n`` rows of each series with their rank, first cut per bucket, then per series."""
    order = F.desc(ts) if last else F.asc(ts)
    at = Window.partitionBy(*keys, "_bucket").orderBy(order)
    cut = _bucketed(df, grid, ts).withColumn(rank, F.row_number().over(at)).where(F.col(rank) <= n).drop(rank, "_bucket")
    return cut.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col(rank) <= n)


def running_sums(
    df: DataFrame, sums: dict[str, Column], keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY
) -> DataFrame:
    """Add running totals of ``sums`` up to and including each row: bucket totals first, then a local running sum."""
    own = _bucketed(df, grid, ts).withColumns(sums)
    at = [*keys, "_bucket"]
    totals = own.groupBy(*at).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*at, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    local = Window.partitionBy(*at).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = own.join(offsets, at).withColumns({c: F.col(f"_b_{c}") + F.sum(c).over(local) for c in sums})
    return out.drop("_bucket", *[f"_b_{c}" for c in sums])


def gap_islands(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """One row per gap: keys, ``_first`` (seconds of the first missing step) and ``_missing`` (how many steps are missing).

    Steps count from the first row of a series.  A gap is found at the row behind it, from the row before, also over the border
    of a bucket; what is generated and shuffled follows the gaps, not the time span.  Copies of a timestamp do not matter.
    """
    step = grid.step_seconds
    at = F.unix_seconds(F.col(ts))
    starts = settled(df.groupBy(*keys).agg(F.unix_seconds(F.min(ts)).alias("_start")), "starts")
    near = over_chunks(df.select(*keys, ts), lambda w: {"_before": F.unix_seconds(F.lag(ts, 1).over(w))}, back=1, keys=keys, ts=ts, grid=grid, carry=[])
    wide = near.where(F.col("_before") < at).join(starts, list(keys))
    # the last step at or before the earlier row, and the last one before the later row
    held = F.floor((F.col("_before") - F.col("_start")) / step)
    reached = F.floor((at - 1 - F.col("_start")) / step)
    found = wide.select(*keys, (F.col("_start") + (held + 1) * step).alias("_first"), (reached - held).alias("_missing"))
    return found.where("_missing > 0")


def gap_steps(gaps: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """Every missing (keys, ``ts``) of ``gap_islands``; a long gap is cut into bucket-sized pieces before its steps are generated."""
    step, width = grid.step_seconds, grid.bucket_steps
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_missing") - 1, F.lit(width).cast("long")))
    pieces = gaps.select(*keys, "_first", "_missing", starts.alias("_from"))
    upto = F.least(F.col("_missing"), F.col("_from") + width) - 1
    steps = F.explode(F.sequence(F.col("_from"), upto))
    return pieces.select(*keys, "_first", steps.alias("_k")).select(*keys, F.timestamp_seconds(F.col("_first") + F.col("_k") * step).alias(ts))


def full_grid(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, grid: Grid = HOURLY) -> DataFrame:
    """Every expected (key, timestamp) between the first and last row of each series.

    The time span is cut into buckets before the steps are generated, so a long series is expanded by many tasks.
    """
    width = grid.step_seconds * grid.bucket_steps
    span = df.groupBy(*keys).agg(
        F.unix_seconds(F.min(ts)).alias("_lo"), F.unix_seconds(F.max(ts)).alias("_hi")
    )
    starts = span.select("*", F.explode(F.sequence("_lo", "_hi", F.lit(width))).alias("_start"))
    starts = starts.repartition(*keys, "_start")
    end = F.least(F.col("_hi"), F.col("_start") + F.lit(width - grid.step_seconds))
    steps = F.explode(F.sequence(F.col("_start"), end, F.lit(grid.step_seconds)))
    return starts.select(*keys, steps.alias("_at")).select(*keys, F.timestamp_seconds("_at").alias(ts))
