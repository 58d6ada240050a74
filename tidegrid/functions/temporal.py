"""Calendar parts of a timestamp as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.guards import flag


# Column names in table order.
TEMPORAL_NAMES = [
    "hour",
    "day_of_week",
    "day_of_month",
    "day_of_year",
    "week_of_year",
    "month",
    "quarter",
    "is_weekend",
    "is_business_hour",
    "season",
]
CYCLICAL_NAMES = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]


def temporal_expressions(ts: str = "timestamp") -> dict[str, Column]:
    t = F.col(ts)
    hour, weekday, month = F.hour(t), F.weekday(t), F.month(t)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(t),
        "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t),
        "month": month,
        "quarter": F.quarter(t),
        "is_weekend": flag(weekday >= 5),
        "is_business_hour": flag((hour >= 9) & (hour < 17) & (weekday < 5)),
        "season": F.floor((month % 12) / 3).cast("int"),
    }


def cyclical_expressions(ts: str = "timestamp") -> dict[str, Column]:
    t = F.col(ts)
    cycles = {"hour": (F.hour(t), 24), "day_of_week": (F.weekday(t), 7), "month": (F.month(t), 12)}
    out: dict[str, Column] = {}
    for name, (value, period) in cycles.items():
        angle = value * F.lit(2 * math.pi / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def toggled(expressions: Mapping[str, Column], toggles: Mapping[str, bool] | None) -> dict[str, Column]:
    """Only the expressions that are switched on; a name that is absent from ``toggles`` is on."""
    unknown = set(toggles or {}) - set(expressions)
    if unknown:
        raise ValueError(f"unknown feature names: {', '.join(sorted(unknown))}")
    return {n: e for n, e in expressions.items() if (toggles or {}).get(n, True)}


def temporal_features(df: DataFrame, ts: str = "timestamp", toggles: Mapping[str, bool] | None = None) -> DataFrame:
    return df.withColumns(toggled(temporal_expressions(ts), toggles))


def cyclical_features(df: DataFrame, ts: str = "timestamp", toggles: Mapping[str, bool] | None = None) -> DataFrame:
    return df.withColumns(toggled(cyclical_expressions(ts), toggles))
