"""A/B tests and bandits on tables of prediction errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.guards import flag, hash32

KEYS = ("series_id",)


def ab_route(df: DataFrame, key: str, split: float = 0.1, seed: int = 42, method: str = "hash") -> DataFrame:
    """Stable assignment of each key to champion or challenger.

    ``hash`` mixes the key with the seed; ``modular`` is the same idea in plain integer arithmetic.
    """
    cut = int(round(split * 10000))
    if method == "hash":
        slot = hash32(key, F.lit(seed)) % 10000
    elif method == "modular":
        slot = ((F.col(key) + seed) * 48271 % 2147483647) % 10000
    else:
        raise ValueError(f"unknown method: {method}")
    return df.withColumn("arm", F.when(slot < cut, "challenger").otherwise("champion"))


def ab_metrics(df: DataFrame, keys: Sequence[str] = KEYS, arm: str = "model", y: str = "y_true", yhat: str = "y_pred"):
    """Samples, MAE, RMSE and error std (ddof 0) per arm."""
    e = F.abs(F.col(y) - F.col(yhat))
    return df.groupBy(*keys, arm).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.stddev_pop(e).alias("std"),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for i in range(1, 500):
        for num in (
            i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
            -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return value


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, from the regularised incomplete beta function."""
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def student_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    values = [None if pd.isna(a) or pd.isna(b) else student_p(float(a), float(b)) for a, b in zip(t, df)]
    return pd.Series(values, dtype="float64")


def ab_significance(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    arm: str = "model",
    y: str = "y_true",
    yhat: str = "y_pred",
    min_samples: int = 100,
    level: float = 0.05,
) -> DataFrame:
    """Welch test of the absolute errors, one row per key; the p-value is worked out on that single row."""
    e = F.abs(F.col(y) - F.col(yhat))

    def of(name: str) -> Column:
        return F.when(F.col(arm) == name, e)

    stats = df.groupBy(*keys).agg(
        *[
            agg(of(name)).alias(f"_{tag}_{short}")
            for short, name in (("a", "champion"), ("b", "challenger"))
            for tag, agg in (("n", F.count), ("m", F.avg), ("v", F.var_samp), ("p", F.var_pop))
        ]
    )
    n1, n2, m1, m2 = F.col("_n_a"), F.col("_n_b"), F.col("_m_a"), F.col("_m_b")
    s1, s2 = F.col("_v_a") / n1, F.col("_v_b") / n2
    pooled = F.sqrt((F.col("_p_a") + F.col("_p_b")) / 2)
    enough = (n1 >= min_samples) & (n2 >= min_samples)
    out = stats.select(
        *keys,
        flag(enough).alias("sufficient_data"),
        n1.alias("champion_samples"),
        n2.alias("challenger_samples"),
        m1.alias("champion_mae"),
        m2.alias("challenger_mae"),
        F.when(enough, F.try_divide(m1 - m2, F.sqrt(s1 + s2))).alias("t_statistic"),
        F.when(enough, F.try_divide((s1 + s2) * (s1 + s2), s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))).alias("degrees_of_freedom"),
        F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0).alias("cohens_d"),
        F.when(m1 > 0, (m1 - m2) / m1 * 100).otherwise(0.0).alias("improvement_pct"),
    )
    out = out.withColumn("p_value", student_p_value("t_statistic", "degrees_of_freedom"))
    sure = F.coalesce(F.col("p_value") < level, F.lit(False))
    better = F.col("challenger_mae") < F.col("champion_mae")
    winner = F.when(sure & better, "challenger").when(sure, "champion")
    advice = (
        F.when(F.col("sufficient_data") == 0, "COLLECT more data")
        .when(sure & better, "PROMOTE challenger to production")
        .when(sure, "KEEP champion in production")
        .otherwise("CONTINUE testing (no significant difference)")
    )
    return out.withColumns({"significant": flag(sure), "winner": winner, "recommendation": advice})


def bandit_posterior(
    df: DataFrame, threshold: float = 1.0, keys: Sequence[str] = KEYS, arm: str = "model", y: str = "y_true", yhat: str = "y_pred"
) -> DataFrame:
    """Successes (error below the threshold), failures and the Beta posterior with a flat prior."""
    hit = F.abs(F.col(y) - F.col(yhat)) < threshold
    out = df.groupBy(*keys, arm).agg(F.count_if(hit).alias("successes"), F.count_if(~hit).alias("failures"))
    return out.withColumns({"alpha": F.col("successes") + 1, "beta": F.col("failures") + 1})


def bandit_probabilities(
    posterior: DataFrame, n_samples: int = 1000, seed: int = 42, keys: Sequence[str] = KEYS, arm: str = "model"
) -> DataFrame:
    """Share of ``n_samples`` Thompson draws that each arm wins; draws are seeded by key and arm."""

    @F.pandas_udf("array<double>")
    def draws(alpha: pd.Series, beta: pd.Series, start: pd.Series) -> pd.Series:
        out = [np.random.default_rng(int(s)).beta(float(a), float(b), n_samples) for a, b, s in zip(alpha, beta, start)]
        return pd.Series(out)

    start = F.pmod(F.xxhash64(*keys, arm, F.lit(seed)), F.lit(2**31 - 1))
    drawn = posterior.select(*keys, arm, F.posexplode(draws("alpha", "beta", start)).alias("_draw", "_x"))
    won = drawn.groupBy(*keys, "_draw").agg(F.max_by(arm, "_x").alias(arm))
    share = won.groupBy(*keys, arm).agg((F.count(F.lit(1)) / n_samples).alias("probability"))
    return posterior.select(*keys, arm).join(share, [*keys, arm], "left").fillna(0.0, ["probability"])
