"""Holiday dimension and the calendar features joined from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.guards import flag

SCHEMA = "holiday_date date, name string, kind string, category int"

# Holiday categories by name (1 major, 2 minor, 3 religious, 4 regional, 0 none).
CATEGORIES = {
    1: ["New Year's Day", "Memorial Day", "Independence Day", "Labor Day", "Thanksgiving", "Christmas Day"],
    2: ["Martin Luther King Jr. Day", "Presidents' Day", "Veterans Day"],
    3: ["Easter", "Good Friday"],
    4: ["Patriots' Day", "Juneteenth"],
}

# Extra holidays and special events.
CUSTOM_HOLIDAYS = ["2023-12-26", "2024-12-26", "2025-12-26"]
SPECIAL_EVENTS = {
    "Super Bowl Sunday": ["2023-02-12", "2024-02-11", "2025-02-09"],
    "Daylight Saving Time Start": ["2023-03-12", "2024-03-10", "2025-03-09"],
    "Daylight Saving Time End": ["2023-11-05", "2024-11-03", "2025-11-02"],
}


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th given weekday of a month (0 = Monday); ``n = -1`` is the last one."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def _federal_days(year: int) -> dict[str, dt.date]:
    days = {
        "New Year's Day": dt.date(year, 1, 1),
        "Martin Luther King Jr. Day": _nth_weekday(year, 1, 0, 3),
        "Presidents' Day": _nth_weekday(year, 2, 0, 3),
        "Memorial Day": _nth_weekday(year, 5, 0, -1),
        "Independence Day": dt.date(year, 7, 4),
        "Labor Day": _nth_weekday(year, 9, 0, 1),
        "Columbus Day": _nth_weekday(year, 10, 0, 2),
        "Veterans Day": dt.date(year, 11, 11),
        "Thanksgiving": _nth_weekday(year, 11, 3, 4),
        "Christmas Day": dt.date(year, 12, 25),
    }
    if year >= 2021:
        days["Juneteenth"] = dt.date(year, 6, 19)
    return days


def us_holidays(
    spark: SparkSession,
    years: Iterable[int],
    custom: Iterable[str] = CUSTOM_HOLIDAYS,
    events: Mapping[str, Iterable[str]] = SPECIAL_EVENTS,
    observed: bool = True,
) -> DataFrame:
    """Federal holidays by rule, with the observed day of those that fall on a weekend, plus custom days and events."""
    category = {name: c for c, names in CATEGORIES.items() for name in names}
    rows = []
    for year in years:
        for name, day in _federal_days(year).items():
            rows.append((day, name, "standard", category.get(name, 0)))
            shift = {5: -1, 6: 1}.get(day.weekday())
            if observed and shift:
                rows.append((day + dt.timedelta(days=shift), f"{name} (observed)", "standard", category.get(name, 0)))
    rows += [(dt.date.fromisoformat(d), "Custom holiday", "custom", 0) for d in custom]
    rows += [(dt.date.fromisoformat(d), name, "event", 0) for name, dates in events.items() for d in dates]
    return spark.createDataFrame(rows, SCHEMA)


def _nearest(days: Column, date: Column) -> Column:
    """Signed days to the nearest entry of a sorted date array: future positive, a tie goes to the future."""
    ahead = F.datediff(F.try_element_at(F.filter(days, lambda d: d >= date), F.lit(1)), date)
    behind = F.datediff(F.try_element_at(F.filter(days, lambda d: d <= date), F.lit(-1)), date)
    return F.when(ahead.isNull() | (-behind < ahead), behind).otherwise(ahead)


def date_dimension(dates: DataFrame, holidays: DataFrame, days_before: int = 2, days_after: int = 1) -> DataFrame:
    """Calendar columns for each distinct ``date``.  Size: one row per calendar day, whatever the number of readings."""
    real = F.col("kind").isin("standard", "custom")
    free = holidays.where(real).agg(F.array_sort(F.collect_set("holiday_date"))).scalar()
    by_day = holidays.groupBy(F.col("holiday_date").alias("date")).agg(
        F.max(flag(real)).alias("is_holiday"),
        F.max(flag(F.col("kind") == "event")).alias("is_special_event"),
        F.coalesce(F.min(F.when(real & (F.col("category") > 0), F.col("category"))), F.lit(0)).alias("holiday_type"),
    )
    d = F.col("date")
    near = F.col("days_to_holiday")

    def free_within(sign: int) -> Column:
        return F.array_contains("_free", F.date_add(d, sign)) | F.array_contains("_free", F.date_add(d, 2 * sign))

    return (
        dates.join(by_day, "date", "left")
        .withColumn("_free", free)
        .withColumn("days_to_holiday", _nearest(F.col("_free"), d))
        .select(
            "date",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("is_holiday", "is_special_event", "holiday_type")],
            near,
            flag((near > 0) & (near <= days_before)).alias("is_before_holiday"),
            flag((near < 0) & (near >= -days_after)).alias("is_after_holiday"),
            flag((F.weekday(d) == 4) & free_within(1)).alias("is_friday_before_weekend_holiday"),
            flag((F.weekday(d) == 0) & free_within(-1)).alias("is_monday_after_weekend_holiday"),
        )
    )


def calendar_features(
    df: DataFrame,
    holidays: DataFrame,
    ts: str = "timestamp",
    days_before: int = 2,
    days_after: int = 1,
    days_of: DataFrame | None = None,
) -> DataFrame:
    """Join the calendar columns on the date.  ``days_of`` is a cheaper table with the same days, if there is one.

    The dimension has one row per calendar day (a century is 36,525 rows), so it is broadcast and the rows stay put.
    """
    dated = df.withColumn("date", F.to_date(ts))
    days = (df if days_of is None else days_of).select(F.to_date(ts).alias("date")).distinct()
    dim = date_dimension(days, holidays, days_before, days_after)
    return dated.join(F.broadcast(dim), "date", "left").drop("date")
