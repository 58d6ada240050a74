"""Histogram boosting against a plain trainer that looks at every row for every possible split."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.plans import boosting as bo

SMALL = bo.Settings(trees=6, step=0.3, leaves=6, depth=4, min_rows=5, patience=0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(700):
        x, z = rng.gauss(0, 1), float(rng.randrange(6))
        data.append((i, 3 * x + (z > 2) * 2 + rng.gauss(0, 0.4), x, z, rng.random(), i % 5))
    data.append((700, None, 0.0, 1.0, 0.5, 0))
    return spark.createDataFrame(data, "i long, load double, x double, z double, junk double, part int").cache()


def roles():
    return [F.when(F.col("part") == 0, bo.VALID).otherwise(bo.TRAIN), F.when(F.col("part") == 1, bo.VALID).when(F.col("part") == 2, bo.NONE).otherwise(bo.TRAIN)]


@pytest.fixture(scope="module")
def binned(rows):
    return bo.bin_rows(rows.repartition(3, "i"), ["x", "z", "junk"], ["load"], roles(), 16)


def all_rows(binned, fit):
    names = ("block", "n", "bins", "labels", "roles")
    return bo.Rows([bo.Block(*[bytes(r[n]) if n in names[2:] else r[n] for n in names], fit) for r in binned.blocks.collect()])


def plain_tree(x, y, prediction, use, growing, g_unit):
    """The same tree by a walk over all rows for every node, feature and cut."""
    s = growing.settings
    value = lambda g, h, low, high: min(max(-math.copysign(max(abs(g) - s.l1, 0), g) / max(h + s.l2, 1e-300), low), high)
    cost = lambda g, h, v: g * v + 0.5 * (h + s.l2) * v * v + s.l1 * abs(v)
    nodes = [{"rows": np.flatnonzero(use), "low": -math.inf, "high": math.inf, "value": 0.0, "cut": None}]
    level, leaves, depth = [0], 1, 0
    gradient = bo.gradients(y, prediction, s)
    while level and depth < s.depth and leaves < s.leaves:
        found = {}
        for n in level:
            own, low, high = nodes[n]["rows"], nodes[n]["low"], nodes[n]["high"]
            whole = gradient[own].sum() * g_unit
            best = (0.0, None)
            for f in growing.chosen:
                for cut in range(16):
                    left, right = own[x[f, own] <= cut], own[x[f, own] > cut]
                    if min(len(left), len(right)) < s.min_rows:
                        continue
                    gl, gr = gradient[left].sum() * g_unit, gradient[right].sum() * g_unit
                    vl, vr, vt = value(gl, len(left), low, high), value(gr, len(right), low, high), value(whole, len(own), low, high)
                    if s.monotone and s.monotone[f] * (vr - vl) < 0:
                        continue
                    gain = cost(whole, len(own), vt) - cost(gl, len(left), vl) - cost(gr, len(right), vr)
                    if gain > best[0]:
                        best = (gain, (f, cut, left, right, vl, vr))
            if best[1]:
                found[n] = best
        taken = sorted(sorted(found, key=lambda n: (-found[n][0], n))[: s.leaves - leaves])
        leaves, depth, level = leaves + len(taken), depth + bool(taken), []
        for n in taken:
            f, cut, left, right, vl, vr = found[n][1]
            low, high, sign = nodes[n]["low"], nodes[n]["high"], s.monotone[f] if s.monotone else 0
            nodes[n]["cut"] = (f, cut, len(nodes))
            middle = (vl + vr) / 2
            for side, (own, v) in enumerate(((left, vl), (right, vr))):
                below = (side == 0) == (sign > 0)
                bounds = (low, high) if not sign else (low, min(high, middle)) if below else (max(low, middle), high)
                if len(own) >= 2 * s.min_rows:
                    level.append(len(nodes))
                nodes.append({"rows": own, "low": bounds[0], "high": bounds[1], "value": v, "cut": None})
    return nodes


@pytest.mark.parametrize("settings", [SMALL, bo.Settings(trees=4, leaves=5, depth=3, min_rows=8, l1=2.0, l2=3.0, row_share=0.6, feature_share=0.7, monotone=(1, 0, -1), patience=0)])
def test_same_trees_as_a_plain_trainer(binned, settings):
    data = all_rows(binned, bo.Fit(settings))
    start, trees, _ = bo.grow_in_memory(data, settings, binned.unit, bo._size(binned))
    prediction = np.full(len(data.y), start)
    for number, tree in enumerate(trees):
        growing = bo.Growing(settings, number, 3)
        nodes = plain_tree(data.bins, data.y, prediction, data.drawn(settings, number), growing, binned.unit)
        assert len(nodes) == len(tree.feature)
        for node, f, cut, left, value in zip(nodes, tree.feature, tree.bin, tree.left, tree.value, strict=True):
            if node["cut"]:
                # cuts with no rows between them are the same cut
                own = node["rows"]
                assert f == node["cut"][0] and left == node["cut"][2]
                assert ((data.bins[f, own] <= cut) == (data.bins[f, own] <= node["cut"][1])).all()
            else:
                assert f == -1 and value == pytest.approx(settings.step * node["value"] / binned.unit, abs=1)
        prediction = prediction + np.array(tree.value)[tree.leaf_of(data.bins)]


def test_both_ways_give_the_same_trees(binned, monkeypatch):
    monkeypatch.setattr(bo, "WRITE_TREES", 2)
    monkeypatch.setattr(bo, "HISTOGRAM_BYTES", 5000)
    make = lambda **kw: bo.Settings(**{"trees": 4, "step": 0.3, "leaves": 5, "depth": 3, "min_rows": 10, "patience": 2, **kw})
    fits = [
        (0, bo.Fit(make())), (1, bo.Fit(make(seed=7, row_share=0.5, l1=1.0), role=1)), (2, bo.Fit(make(quantile=0.9, trees=3))),
        (3, bo.Fit(make(monotone=(1, 0, 0), step=1.0, trees=12), role=1)),
    ]
    near, far = bo.fit_in_tasks(binned, fits), bo.fit_over_rows(binned, fits)
    assert near == far and set(near) == {0, 1, 2, 3}
    assert len(near[3][1]) < 12  # stopped early


def test_partitioning_does_not_matter(rows):
    found = []
    for n in (1, 4):
        b = bo.bin_rows(rows.repartition(n, "i"), ["x", "z"], ["load"], roles(), 16)
        found.append(bo.fit_all(b, [bo.Fit(bo.Settings(trees=5, leaves=4, row_share=1.0, patience=0))])[0])
    assert (found[0].value == found[1].value).all() and (found[0].threshold == found[1].threshold).all()


def test_prediction_over_real_values_equals_the_bins(rows, binned):
    fit = bo.Fit(SMALL)
    model = bo.fit_all(binned, [fit])[0]
    scored = model.transform(rows).where("load IS NOT NULL")
    sse, n, spread = scored.agg(F.sum(F.pow(F.col("load") - F.col("prediction"), F.lit(2))), F.count("*"), F.var_pop("load")).first()
    assert sse / n < 0.3 * spread
    data = all_rows(binned, fit)
    prediction = np.full(len(data.y), round(model.start / binned.unit))
    start, trees, _ = bo.grow_in_memory(data, SMALL, binned.unit, bo._size(binned))
    for tree in trees:
        prediction = prediction + np.array(tree.value)[tree.leaf_of(data.bins)]
    known = data.y != np.iinfo(np.int64).min
    assert sse == pytest.approx((((data.y - prediction)[known] * binned.unit) ** 2).sum(), rel=1e-6)


def test_saved_model_predicts_the_same(rows, binned, spark, tmp_path):
    model = bo.fit_all(binned, [bo.Fit(SMALL)])[0]
    model.save(spark, str(tmp_path / "m"))
    again = bo.Ensemble.load(spark, str(tmp_path / "m"))
    pair = rows.select(model.column().alias("a"), again.column().alias("b")).where("a <> b")
    assert pair.count() == 0 and again.importances() == model.importances()


def test_monotone_models_never_move_against_their_sign(binned):
    model = bo.fit_all(binned, [bo.Fit(bo.Settings(trees=40, step=0.2, leaves=12, min_rows=5, monotone=(-1, 1, 0), patience=0))])[0]
    rng = np.random.default_rng(1)
    for f, sign in ((0, -1), (1, 1)):
        x = rng.normal(0, 1, (3, 200))
        grid = np.repeat(x[:, :, None], 50, 2)
        grid[f] = np.linspace(-3, 6, 50)
        steps = np.diff(model.scores(grid.reshape(3, -1)).reshape(200, 50), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert model.n_trees == 40


def test_quantiles_hold_their_share(rows):
    b = bo.bin_rows(rows, ["x", "z"], ["load"], [F.when(F.col("part") == 0, bo.NONE).otherwise(bo.TRAIN)], 32)
    fits = [bo.Fit(bo.Settings(trees=60, step=0.2, leaves=8, min_rows=15, quantile=q, patience=0)) for q in (0.1, 0.5, 0.9)]
    models = bo.fit_all(b, fits)
    held = rows.where("part <> 0 AND load IS NOT NULL")
    shares = held.agg(*[F.avg((F.col("load") <= m.column()).cast("int")) for m in models]).first()
    assert list(shares) == pytest.approx([0.1, 0.5, 0.9], abs=0.04)


def test_fits_without_rows_and_empty_tables(rows):
    b = bo.bin_rows(rows.where("i < 0"), ["x"], ["load"], [F.lit(bo.TRAIN)])
    assert bo.fit_all(b, [bo.Fit(SMALL)]) == [None]
    b = bo.bin_rows(rows.withColumn("x", F.lit(1.0)), ["x"], ["load"], [F.lit(bo.TRAIN), F.lit(bo.NONE)])
    one, none = bo.fit_all(b, [bo.Fit(SMALL), bo.Fit(SMALL, role=1)])
    assert none is None and one.n_trees == 6 and set(one.feature.tolist()) == {-1}


def test_exact_sums():
    r = np.random.default_rng(2).integers(-(2**26), 2**26, 1000)
    assert bo.squares(r) == sum(int(v) ** 2 for v in r.tolist())
    assert bo.quantile_of(np.array([1, 2, 3, 4]), 0.5) == 2 and bo.quantile_of(np.array([5]), 0.1) == 5
