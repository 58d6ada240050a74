"""Exact Shapley values of tree ensembles against background rows, from a table of leaf paths.

A leaf is reached by a mixture of a row and a background row exactly if every feature on its path comes from the side that keeps to
the path's interval.  So a leaf with m features gives a game with two sets, the features only the row can fill and those only the
background can, whose Shapley values have a closed form.  Background rows enter as counts per pattern of kept intervals, rows by
their pattern: the work per row is a look-up for each leaf, in one scan of the rows.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidegrid.plans.boosting import Ensemble
from tidegrid.plans.shapley import ROW, sample_rows

#: Up to so many features on a path all patterns are worked out once; beyond, those that a batch has.
TABLE_FEATURES = 10


@dataclasses.dataclass
class Leaf:
    """Value of a leaf and, for each feature on its path, the interval (low, high] that leads to it."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """Bits of the kept intervals of every row of ``x`` (features by rows)."""
        out = np.zeros(x.shape[1], np.int64)
        for j, f in enumerate(self.features):
            out |= ((x[f] > self.low[j]) & (x[f] <= self.high[j])).astype(np.int64) << j
        return out


def leaf_paths(model: Ensemble) -> list[Leaf]:
    """All leaves of all trees."""
    out = []
    for root in model.roots.tolist():
        stack = [(root, {})]
        while stack:
            node, path = stack.pop()
            f = int(model.feature[node])
            if f < 0:
                names = sorted(path)
                out.append(Leaf(float(model.value[node]), names, [path[n][0] for n in names], [path[n][1] for n in names]))
                continue
            low, high = path.get(f, (-math.inf, math.inf))
            cut, child = float(model.threshold[node]), int(model.left[node])
            stack.append((child + 1, {**path, f: (max(low, cut), high)}))
            stack.append((child, {**path, f: (low, min(high, cut))}))
    return out


def _filled(x: np.ndarray) -> np.ndarray:
    """Missing values go to the right of every cut."""
    return np.where(np.isnan(x), np.inf, x)


_FACTORIAL = np.array([math.factorial(n) for n in range(171)], np.float64)


def _weight(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """a! b! / total!; 0 where a or b is negative."""
    good = (a >= 0) & (b >= 0)
    return np.where(good, _FACTORIAL[np.maximum(a, 0)] * _FACTORIAL[np.maximum(b, 0)] / _FACTORIAL[np.maximum(total, 0)], 0.0)


class LeafGame:
    """A leaf with its background: Shapley values and pair interactions by the pattern of a row."""

    def __init__(self, leaf: Leaf, background: np.ndarray):
        self.leaf, self.m = leaf, len(leaf.features)
        self.seen, n = np.unique(leaf.patterns(background), return_counts=True)
        self.share = n / background.shape[1]
        self.full = (1 << self.m) - 1
        self.tables: dict[object, np.ndarray] = {}

    def _sets(self, patterns: np.ndarray):
        """By pattern and background pattern: the two sets, their sizes and the weight (0 where the leaf cannot be reached)."""
        x, z = patterns[:, None], self.seen[None, :]
        a, b = x & ~z, z & ~x
        return a, b, np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64), ((x | z) == self.full) * self.share * self.leaf.value

    def values(self, patterns: np.ndarray) -> np.ndarray:
        """(patterns, features on the path)."""
        a, b, na, nb, weight = self._sets(patterns)
        gain, loss = weight * _weight(na - 1, nb, na + nb), weight * _weight(na, nb - 1, na + nb)
        return np.stack([(gain * (a >> j & 1) - loss * (b >> j & 1)).sum(1) for j in range(self.m)], 1) if self.m else np.zeros((len(patterns), 0))

    def pair(self, patterns: np.ndarray, i: int, j: int) -> np.ndarray:
        """The interaction of the i-th and j-th feature on the path."""
        a, b, na, nb, weight = self._sets(patterns)
        ai, aj, bi, bj = a >> i & 1, a >> j & 1, b >> i & 1, b >> j & 1
        one, total = na + nb - 1, weight
        both = _weight(na - 2, nb, one) * (ai & aj) + _weight(na, nb - 2, one) * (bi & bj)
        apart = _weight(na - 1, nb - 1, one) * ((ai & bj) | (bi & aj))
        return (total * (both - apart)).sum(1)

    def look_up(self, key: object, patterns: np.ndarray, make) -> np.ndarray:
        """``make(patterns)`` through a table of all patterns, or of the distinct ones here."""
        if self.m <= TABLE_FEATURES:
            if key not in self.tables:
                self.tables[key] = make(np.arange(1 << self.m))
            return self.tables[key][patterns]
        distinct, at = np.unique(patterns, return_inverse=True)
        return make(distinct)[at]


class Explainer:
    """Attributions of batches of rows."""

    def __init__(self, model: Ensemble, background: np.ndarray):
        background = _filled(background)
        self.model = model
        self.games = [LeafGame(leaf, background) for leaf in leaf_paths(model) if leaf.value]
        self.base = model.start + sum(float(g.share[g.seen == g.full].sum()) * g.leaf.value for g in self.games)

    def values(self, x: np.ndarray) -> np.ndarray:
        """phi (rows by features); each row adds up to its prediction minus the base."""
        x = _filled(x)
        out = np.zeros((x.shape[1], len(x)))
        for g in self.games:
            if g.m:
                out[:, g.leaf.features] += g.look_up("phi", g.leaf.patterns(x), g.values)
        return out

    def pairs(self, x: np.ndarray, wanted: Sequence[tuple[int, int]]) -> np.ndarray:
        """Interactions (rows by wanted pairs)."""
        x = _filled(x)
        out = np.zeros((x.shape[1], len(wanted)))
        for g in self.games:
            place = {f: j for j, f in enumerate(g.leaf.features)}
            mine = [(n, place[i], place[j]) for n, (i, j) in enumerate(wanted) if i in place and j in place]
            patterns = g.leaf.patterns(x) if mine else None
            for n, i, j in mine:
                out[:, n] += g.look_up((i, j), patterns, lambda p, g=g, i=i, j=j: g.pair(p, i, j))
        return out


def _background(df: DataFrame, features: Sequence[str], n: int, keys: Sequence[str], seed: int) -> np.ndarray:
    picked = sample_rows(df.dropna(subset=list(features)), n, keys, seed).select(*[F.col(f).cast("double") for f in features]).collect()
    if not picked:
        raise ValueError("no background rows")
    return np.array([tuple(r) for r in picked], np.float64).T


def _explained(df: DataFrame, model: Ensemble, background: np.ndarray, keys: Sequence[str], made) -> DataFrame:
    """keys, features, prediction, base_value and ``found``: the array that ``made(explainer, x)`` gives for every row."""
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in model.features])
    p = len(model.features)
    added = [StructField("prediction", DoubleType()), StructField("base_value", DoubleType()), StructField("found", ArrayType(DoubleType()))]
    out = StructType([*rows.schema.fields, *added])

    def run(batches):
        explainer = Explainer(model, background)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[batch.num_columns - p :]])
            found = made(explainer, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x)), pa.array(np.full(len(found), explainer.base)), lists], names=out.names)

    return rows.mapInArrow(run, out)


def tree_shapley(df: DataFrame, model: Ensemble, background: DataFrame, n_background: int = 100, keys: Sequence[str] = ROW, seed: int = 42) -> DataFrame:
    """Long attribution table (keys, prediction, base_value, feature, value, phi) of all rows, exact for the background.

    The background are ``n_background`` rows drawn by a hash of their key.  The sum of phi is the prediction minus the base value,
    which is the mean prediction of the background.
    """
    x = _background(background, model.features, n_background, keys, seed)
    wide = _explained(df, model, x, keys, lambda explainer, rows: explainer.values(rows))
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col("found")[i].alias("phi")) for i, f in enumerate(model.features)])
    return wide.select(*keys, "prediction", "base_value", F.inline(entries))


def tree_interactions(
    df: DataFrame, model: Ensemble, pairs: Sequence[tuple[str, str]], background: DataFrame, n_background: int = 100, keys: Sequence[str] = ROW, seed: int = 42
) -> DataFrame:
    """Shapley interactions of feature pairs (keys, feature_a, feature_b, interaction) of all rows, exact for the background."""
    x = _background(background, model.features, n_background, keys, seed)
    wanted = [(model.features.index(a), model.features.index(b)) for a, b in pairs]
    wide = _explained(df, model, x, keys, lambda explainer, rows: explainer.pairs(rows, wanted))
    entries = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col("found")[i].alias("interaction")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*keys, F.inline(entries))
