"""Exact tree attributions against the enumeration of all coalitions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.plans import attributions as at
from tidegrid.plans import boosting as bo

NAMES = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for i in range(400):
        x = [rng.gauss(0, 1) for _ in NAMES]
        data.append(("s", 3600 * i, x[0] * x[1] + 2 * (x[2] > 0) + x[3] - 0.5 * x[4] * (x[5] > 0.3), *x))
    df = spark.createDataFrame(data, "series_id string, t long, load double, " + ", ".join(f"{n} double" for n in NAMES))
    return df.selectExpr("series_id", "timestamp_seconds(t) AS timestamp", "load", *NAMES).cache()


@pytest.fixture(scope="module")
def model(rows):
    binned = bo.bin_rows(rows, NAMES, ["load"], [F.lit(bo.TRAIN)], 32)
    return bo.fit_all(binned, [bo.Fit(bo.Settings(trees=12, step=0.3, leaves=14, depth=6, min_rows=5, patience=0))])[0]


def enumerated(model, x, back):
    """phi and all pair interactions of one row by every coalition."""
    p = len(x)
    score = {}
    for size in range(p + 1):
        for s in itertools.combinations(range(p), size):
            mixed = back.copy()
            mixed[list(s)] = x[list(s), None]
            score[frozenset(s)] = model.scores(mixed).mean()
    w = lambda s, n: math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)
    phi = [sum(w(len(s), p) * (score[s | {i}] - score[s]) for s in score if i not in s) for i in range(p)]
    pair = {
        (i, j): sum(w(len(s), p - 1) * (score[s | {i, j}] - score[s | {i}] - score[s | {j}] + score[s]) for s in score if i not in s and j not in s)
        for i, j in itertools.combinations(range(p), 2)
    }
    return phi, pair, score[frozenset()]


@pytest.mark.parametrize("limit", [10, 2])
def test_equals_the_enumeration_of_coalitions(model, rows, monkeypatch, limit):
    monkeypatch.setattr(at, "TABLE_FEATURES", limit)
    data = np.array([tuple(r) for r in rows.select(*NAMES).collect()]).T
    back, x = data[:, :30], data[:, 30:42].copy()
    x[2, 0] = np.nan
    explainer = at.Explainer(model, back)
    pairs = list(itertools.combinations(range(6), 2))
    phi, inter = explainer.values(x), explainer.pairs(x, pairs)
    for k in range(x.shape[1]):
        want, both, base = enumerated(model, x[:, k], back)
        assert phi[k] == pytest.approx(want, abs=1e-9) and explainer.base == pytest.approx(base, abs=1e-9)
        assert inter[k] == pytest.approx([both[p] for p in pairs], abs=1e-9)
    assert phi.sum(1) == pytest.approx(model.scores(x) - explainer.base, abs=1e-9)


def test_table_adds_up_and_scans_the_rows_once(model, rows):
    phi = at.tree_shapley(rows, model, rows, 100)
    sums = phi.groupBy("series_id", "timestamp").agg(F.sum("phi").alias("s"), F.first("prediction").alias("p"), F.first("base_value").alias("b"), F.count("*").alias("n"))
    assert sums.where("n <> 6 OR abs(s - (p - b)) > 1e-9").count() == 0 and sums.count() == 400
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    inter = at.tree_interactions(rows, model, [("a", "b"), ("c", "d")], rows, 100)
    strength = {r.feature_a: r.m for r in inter.groupBy("feature_a").agg(F.avg(F.abs("interaction")).alias("m")).collect()}
    assert strength["a"] > 1.5 * strength["c"]
    with pytest.raises(ValueError):
        at.tree_shapley(rows, model, rows.limit(0))
