"""Weather and solar formulas as column expressions; NULL in gives NULL out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.guards import flag, ratio

# Degree-day base temperature (deg C).
DEGREE_DAY_BASE = 18.3

# Rothfusz regression coefficients (deg F, % humidity).
ROTHFUSZ = {
    "const": -42.379,
    "t": 2.04901523,
    "h": 10.14333127,
    "th": -0.22475541,
    "tt": -0.00683783,
    "hh": -0.05481717,
    "tth": 0.00122874,
    "thh": 0.00085282,
    "tthh": -0.00000199,
}

# Plausible range of each variable.
RANGES = {
    "temperature": (-50.0, 60.0),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 50.0),
    "precipitation": (0.0, 500.0),
    "pressure": (900.0, 1100.0),
}

# Names under which providers deliver each variable.
ALIASES = {
    "temperature": ["temp", "temperature_2m"],
    "humidity": ["relative_humidity", "humidity"],
    "wind_speed": ["wind_speed_10m", "windspeed"],
    "precipitation": ["rain", "precip"],
    "cloud_cover": ["cloudiness", "cloud_coverage"],
    "pressure": ["surface_pressure", "pressure_msl"],
    "dew_point": ["dewpoint", "dew_point_2m"],
    "feels_like": ["apparent_temperature"],
}


def _above_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def degree_day_expressions(temperature: str = "temperature", base: float = DEGREE_DAY_BASE) -> dict[str, Column]:
    t = F.col(temperature)
    return {"hdd": _above_zero(F.lit(base) - t), "cdd": _above_zero(t - F.lit(base))}


def heat_index(temperature: str = "temperature", humidity: str = "humidity") -> Column:
    """Apparent temperature in deg C; below 27 deg C the temperature itself."""
    c, h = F.col(temperature), F.col(humidity)
    f = c * 9 / 5 + 32
    terms = {
        "const": F.lit(1.0),
        "t": f,
        "h": h,
        "th": f * h,
        "tt": f * f,
        "hh": h * h,
        "tth": f * f * h,
        "thh": f * h * h,
        "tthh": f * f * h * h,
    }
    total = sum((F.lit(w) * terms[name] for name, w in ROTHFUSZ.items()), F.lit(0.0))
    return F.when(c < 27, c).otherwise((total - 32) * 5 / 9)


def discomfort_index(temperature: str = "temperature", humidity: str = "humidity") -> Column:
    t = F.col(temperature)
    return t - 0.55 * (1 - F.col(humidity) / 100) * (t - 14.5)


def wind_chill(temperature: str = "temperature", wind: str = "wind_speed", wind_unit: str = "m/s") -> Column:
    """Environment Canada wind chill, where it applies (cold and windy), else the temperature."""
    t = F.col(temperature)
    v = F.col(wind) * (3.6 if wind_unit == "m/s" else 1.0)
    p = F.pow(v, F.lit(0.16))
    return F.when((t <= 10) & (v > 4.8), 13.12 + 0.6215 * t - 11.37 * p + 0.3965 * t * p).otherwise(t)


def interaction_expressions(ts: str = "timestamp") -> dict[str, Column]:
    t = F.col("temperature")
    return {
        "temp_x_hour": t * F.hour(ts),
        "temp_x_weekend": t * flag(F.weekday(ts) >= 5),
        "humidity_x_temp": F.col("humidity") * t,
    }


def weather_features(
    df: DataFrame, base: float = DEGREE_DAY_BASE, with_wind_chill: bool = False, wind_unit: str = "m/s"
) -> DataFrame:
    out = df.withColumns(
        {**degree_day_expressions(base=base), "heat_index": heat_index(), "discomfort_index": discomfort_index()}
    )
    return out.withColumn("wind_chill", wind_chill(wind_unit=wind_unit)) if with_wind_chill else out


def solar_expressions() -> dict[str, Column]:
    dni, dhi, ghi = F.col("dni"), F.col("dhi"), F.col("ghi")
    clear = ghi / (F.col("toa_radiation") + 1e-6)
    return {
        "solar_direct_ratio": dni / (dni + dhi + 1e-6),
        "clearness_index": F.when(clear.isNotNull(), F.least(F.greatest(clear, F.lit(0.0)), F.lit(1.0))),
        "solar_available": flag(ghi > 50),
        "ghi_normalized": ghi / 1000,
        "sunshine_fraction": F.col("sunshine_seconds") / 3600,
    }


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """One row per variable: how many values lie outside its allowed range."""
    present = {n: r for n, r in ranges.items() if n in df.columns}
    counts = df.agg(
        *[
            F.struct(
                F.count(n).alias("n_values"),
                F.count_if(~F.col(n).between(low, high)).alias("n_violations"),
                F.lit(low).alias("min_allowed"),
                F.lit(high).alias("max_allowed"),
            ).alias(n)
            for n, (low, high) in present.items()
        ]
    )
    rows = counts.unpivot([], list(present), "variable", "r").select("variable", "r.*")
    return rows.withColumn("violation_ratio", ratio(F.col("n_violations"), F.col("n_values")))


def null_out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    return df.withColumns(
        {n: F.when(F.col(n).between(low, high), F.col(n)) for n, (low, high) in ranges.items() if n in df.columns}
    )


def standard_names(df: DataFrame, aliases: Mapping[str, list[str]] = ALIASES) -> DataFrame:
    """Merge provider-specific columns into the standard names (first non-NULL wins) and drop the originals."""
    out = df
    for name, others in aliases.items():
        present = [c for c in dict.fromkeys([name, *others]) if c in df.columns]
        if present and present != [name]:
            out = out.withColumn(name, F.coalesce(*[F.col(c) for c in present])).drop(*[c for c in present if c != name])
    return out
