from __future__ import annotations

import math
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def load(spark):
    """720 hours of a daily sine with noise, one series."""
    rng = random.Random(42)
    rows = [("a", 1672531200 + 3600 * i, 5 + 3 * math.sin(2 * math.pi * i / 24) + rng.gauss(0, 0.5)) for i in range(720)]
    df = spark.createDataFrame(rows, "series_id string, s long, load double")
    return df.selectExpr("series_id", "timestamp_seconds(s) AS timestamp", "load").cache()


@pytest.fixture(scope="session")
def weather(spark):
    rng = random.Random(7)
    rows = [
        (1672531200 + 3600 * i, rng.gauss(15, 10), rng.uniform(20, 100), rng.uniform(0, 15), rng.expovariate(2), rng.gauss(1013, 8), rng.uniform(0, 100), rng.uniform(0, 360))
        for i in range(720)
    ]
    names = "temperature double, humidity double, wind_speed double, precipitation double, pressure double, cloud_cover double, wind_direction double"
    df = spark.createDataFrame(rows, f"s long, {names}")
    return df.selectExpr("timestamp_seconds(s) AS timestamp", *[n.split()[0] for n in names.split(", ")]).cache()


@pytest.fixture(scope="session")
def gappy(spark):
    """Three series with random gaps, one of them almost empty."""
    rng = random.Random(3)
    rows = []
    for name, keep in (("x", 0.9), ("y", 0.5), ("z", 0.05)):
        for i in range(300):
            if rng.random() < keep:
                rows.append((name, 1700000000 // 3600 * 3600 + 3600 * i, float(rng.randint(0, 50))))
    df = spark.createDataFrame(rows, "series_id string, s long, load double")
    return df.selectExpr("series_id", "timestamp_seconds(s) AS timestamp", "load").cache()
