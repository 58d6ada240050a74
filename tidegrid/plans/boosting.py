"""Gradient boosting on histograms: many fits (trials, folds, horizons, quantiles) over one written table of binned rows.

Features are binned once; labels and predictions are whole multiples of a fixed unit, so every sum is exact and a tree does not
depend on how the rows are dealt out.  A tree grows level by level: for all nodes of a level the sums of gradients per feature and
bin decide the splits.  There are two ways to get these sums, which give the same trees:

* over the rows (``fit_over_rows``): one aggregate per level sums the histograms of all fits; the driver sees chosen splits only.
* in a task per fit (``fit_in_tasks``): a fit whose rows are at most TASK_ROWS gets its blocks into one task, and fits run side by
  side.  A search over small folds is many such fits.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.guards import require_columns
from tidegrid.session import scratch_path

#: Bins of a feature, and rows of a block.
BINS, BLOCK_ROWS = 64, 32_768
#: Rows that a task may hold for a fit; larger fits take one aggregate per level.
TASK_ROWS = 1_000_000
#: Labels have this many bits; sums of gradients of 2**38 rows fit into a long.
LABEL_BITS = 24
#: Gradients of the pinball loss are multiples of this.
PINBALL_UNIT = 2.0**-20
#: Trees after which the rows' predictions are written again when a fit runs over the rows.
WRITE_TREES = 10
#: Bytes of histograms that a task holds at once; more fits than that take turns.
HISTOGRAM_BYTES = 256_000_000
#: Roles of a row; one that has both is TRAIN + VALID.
NONE, TRAIN, VALID = 0, 1, 2
#: Bits of the cells in which a residual's rank is looked for, first and last.
RANK_BITS = 14


@dataclasses.dataclass(frozen=True)
class Settings:
    """What a fit is told.  ``quantile`` None means squared error; ``monotone`` has a sign for every feature, or none."""

    trees: int = 500
    step: float = 0.05
    leaves: int = 31
    depth: int = 16
    min_rows: int = 20
    row_share: float = 0.8
    feature_share: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    patience: int = 50
    quantile: float | None = None
    monotone: tuple[int, ...] = ()
    seed: int = 42


@dataclasses.dataclass(frozen=True)
class Fit:
    """One model to fit: its settings, the column of labels and the column of roles (train, validation, none)."""

    settings: Settings
    label: int = 0
    role: int = 0


@dataclasses.dataclass
class Binned:
    """Written blocks (block, n, bins, labels, roles) of the rows and what is needed to read them."""

    features: list[str]
    edges: list[np.ndarray]
    blocks: DataFrame
    unit: float
    #: rows by (label, role column, TRAIN or VALID)
    sizes: dict[tuple[int, int, int], int]


@dataclasses.dataclass
class Tree:
    """Flat arrays by node: the feature (-1: leaf), the last bin of the left child, that child (the right one is next), the value."""

    feature: list[int] = dataclasses.field(default_factory=lambda: [-1])
    bin: list[int] = dataclasses.field(default_factory=lambda: [0])
    left: list[int] = dataclasses.field(default_factory=lambda: [0])
    value: list[int] = dataclasses.field(default_factory=lambda: [0])
    gain: list[float] = dataclasses.field(default_factory=lambda: [0.0])
    depth: int = 0

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Node of every row of ``bins`` (features by rows)."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node = np.zeros(bins.shape[1], np.int64)
        if len(self.feature) == 1:
            return node
        rows = np.arange(bins.shape[1])
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, left[node] + (bins[np.maximum(f, 0), rows] > cut[node]), node)
        return node


# --- binned rows --------------------------------------------------------------------------------------------------------


def _unit(largest: float) -> float:
    """A power of two, so that labels are multiples of it with LABEL_BITS bits."""
    return 2.0 ** (math.ceil(math.log2(largest)) - LABEL_BITS) if largest > 0 else 1.0


def bin_rows(df: DataFrame, features: Sequence[str], labels: Sequence[str], roles: Sequence[Column], bins: int = BINS) -> Binned:
    """The rows of ``df`` without nulls in ``features``, binned at quantiles of each feature and written in blocks.

    ``roles`` are whole numbers: NONE, TRAIN, VALID or the sum of both.  A row counts for a fit only where its label is not null.
    """
    require_columns(df, [*features, *labels], "training table")
    spark, p, k, m = df.sparkSession, len(features), len(labels), len(roles)
    xs = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    ys = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_y{i}") for i, c in enumerate(labels)]
    rows = df.dropna(subset=list(features)).select(*xs, *ys, *[r.cast("int").alias(f"_r{i}") for i, r in enumerate(roles)])
    probs = [i / bins for i in range(1, bins)]
    ends = rows.agg(
        *[F.percentile_approx(f"_x{i}", probs, 10_000).alias(f"e{i}") for i in range(p)],
        *[F.max(F.abs(f"_y{i}")).alias(f"y{i}") for i in range(k)],
    ).first()
    edges = [np.unique(np.array(ends[f"e{i}"] or [], np.float64)) for i in range(p)]
    unit = _unit(max([ends[f"y{i}"] or 0.0 for i in range(k)], default=0.0))

    def blocks(batches):
        held, n, block = [], 0, 0

        def row(table: pa.Table):
            x = np.stack([np.searchsorted(edges[i], table.column(i).to_numpy(), "left") for i in range(p)]) if p else np.zeros((0, len(table)))
            y = np.stack([table.column(p + i).to_numpy() for i in range(k)])
            known = ~np.isnan(y)
            y = np.where(known, np.rint(np.where(known, y, 0) / unit), np.iinfo(np.int64).min).astype("<i8")
            r = np.stack([np.nan_to_num(table.column(p + k + i).to_numpy()) for i in range(m)])
            data = [x.astype(np.uint8).tobytes(), y.tobytes(), r.astype(np.uint8).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(table)]), *[pa.array([d], pa.binary()) for d in data]], names=["block", "n", "bins", "labels", "roles"])

        from pyspark import TaskContext

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                number = (TaskContext.get().partitionId() << 32) + block
                yield row(pa.Table.from_batches(held))
                held, n, block = [], 0, block + 1
        if n:
            number = (TaskContext.get().partitionId() << 32) + block
            yield row(pa.Table.from_batches(held))

    path = scratch_path(spark, "binned")
    schema = "block long, n long, bins binary, labels binary, roles binary"
    rows.mapInArrow(blocks, schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)

    def counts(batches):
        total = np.zeros((k, m, 4), np.int64)
        for batch in batches:
            for n, y, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                y, r = np.frombuffer(y, "<i8").reshape(k, n), np.frombuffer(r, np.uint8).reshape(m, n)
                for a in range(k):
                    for b in range(m):
                        total[a, b] += np.bincount(r[b][y[a] != np.iinfo(np.int64).min], minlength=4)[:4]
        at = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*[pa.array(a) for a in at], pa.array(total.ravel())], names=["label", "role", "part", "n"])

    counted = table.select("n", "labels", "roles").mapInArrow(counts, "label long, role long, part long, n long")
    sizes: dict[tuple[int, int, int], int] = {}
    for r in counted.groupBy("label", "role", "part").agg(F.sum("n").alias("n")).collect():
        for part in (TRAIN, VALID):
            sizes[r.label, r.role, part] = sizes.get((r.label, r.role, part), 0) + (r.n if r.part & part else 0)
    return Binned(list(features), edges, table, unit, sizes)


class Block:
    """Rows of a block as arrays: bins (features by rows), labels and roles of one fit, and where its rows stand."""

    def __init__(self, number: int, n: int, bins: bytes, labels: bytes, roles: bytes, fit: Fit):
        self.number = number
        self.bins = np.frombuffer(bins, np.uint8).reshape(-1, n)
        self.y = np.frombuffer(labels, "<i8").reshape(-1, n)[fit.label]
        role = np.frombuffer(roles, np.uint8).reshape(-1, n)[fit.role]
        known = self.y != np.iinfo(np.int64).min
        self.train, self.valid = (role & TRAIN > 0) & known, (role & VALID > 0) & known

    def drawn(self, settings: Settings, tree: int) -> np.ndarray:
        """The training rows that tree number ``tree`` sees: a draw that depends on seed, tree and block only."""
        if settings.row_share >= 1:
            return self.train
        draw = np.random.default_rng([settings.seed, tree, self.number & 0xFFFFFFFF, self.number >> 32]).random(len(self.y))
        return self.train & (draw < settings.row_share)


class Rows(Block):
    """Several blocks as one."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda b: b.number)
        self.bins = np.concatenate([b.bins for b in self.blocks], 1)
        self.y, self.train, self.valid = (np.concatenate([getattr(b, a) for b in self.blocks]) for a in ("y", "train", "valid"))

    def drawn(self, settings: Settings, tree: int) -> np.ndarray:
        return np.concatenate([b.drawn(settings, tree) for b in self.blocks])


# --- one level of a tree ------------------------------------------------------------------------------------------------


def gradients(y: np.ndarray, prediction: np.ndarray, settings: Settings) -> np.ndarray:
    """Whole gradients: of the squared error in units of the label, of the pinball loss in PINBALL_UNIT."""
    if settings.quantile is None:
        return prediction - y
    up, down = round((1 - settings.quantile) / PINBALL_UNIT), -round(settings.quantile / PINBALL_UNIT)
    return np.where(prediction >= y, up, down)


def histograms(bins: np.ndarray, node: np.ndarray, rows: np.ndarray, gradient: np.ndarray, nodes: int, chosen: Sequence[int], size: int) -> np.ndarray:
    """(nodes, chosen features, bins, 2): sums of gradients and counts of the ``rows`` by node (below 0: none)."""
    rows = np.flatnonzero(rows & (node >= 0))
    base, g = node[rows] * size, gradient[rows].astype(np.float64)
    out = np.empty((nodes, len(chosen), size, 2), np.int64)
    for i, f in enumerate(chosen):
        at = base + bins[f, rows]
        out[:, i, :, 0] = np.bincount(at, g, nodes * size).reshape(nodes, size)
        out[:, i, :, 1] = np.bincount(at, minlength=nodes * size).reshape(nodes, size)
    return out


def _objective(g, h, value, settings: Settings):
    return g * value + 0.5 * (h + settings.l2) * value * value + settings.l1 * np.abs(value)


def _value(g, h, settings: Settings, low, high):
    shrunk = np.sign(g) * np.maximum(np.abs(g) - settings.l1, 0)
    return np.clip(-shrunk / np.maximum(h + settings.l2, 1e-300), low, high)


def best_splits(hist: np.ndarray, chosen: Sequence[int], low: np.ndarray, high: np.ndarray, settings: Settings, unit: float) -> list[tuple]:
    """(gain, feature, bin, values and counts of both children) of every node; gain 0 where none is allowed.

    Of equal gains the first feature and the smallest bin.  Values keep to the node's bounds; a split on a constrained feature
    must not move them against its sign.
    """
    left = np.cumsum(hist, 2)
    total = left[:, :1, -1:, :]
    right = total - left
    low, high = low[:, None, None], high[:, None, None]
    gl, gr, gt = (x[..., 0].astype(np.float64) * unit for x in (left, right, total))
    hl, hr, ht = (x[..., 1].astype(np.float64) for x in (left, right, total))
    vl, vr, vt = (_value(g, h, settings, low, high) for g, h in ((gl, hl), (gr, hr), (gt, ht)))
    gain = _objective(gt, ht, vt, settings) - _objective(gl, hl, vl, settings) - _objective(gr, hr, vr, settings)
    allowed = (left[..., 1] >= settings.min_rows) & (right[..., 1] >= settings.min_rows)
    if settings.monotone:
        sign = np.array([settings.monotone[f] for f in chosen])[None, :, None]
        allowed &= sign * (vr - vl) >= 0
    gain = np.where(allowed, gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    out = []
    for n, at in enumerate(best.tolist()):
        i, b = divmod(at, gain.shape[2])
        out.append((float(flat[n, at]), int(chosen[i]), b, float(vl[n, i, b]), float(vr[n, i, b]), int(left[n, i, b, 1]), int(right[n, i, b, 1])))
    return out


class Growing:
    """A tree that grows by levels; the frontier are the nodes that may still be split."""

    def __init__(self, settings: Settings, number: int, p: int, root: float = 0.0):
        self.settings, self.number, self.tree = settings, number, Tree()
        self.real = [root]
        self.bounds = [(-math.inf, math.inf)]
        self.frontier = [0]
        self.leaves = 1
        draw = np.random.default_rng([settings.seed, number, 7])
        size = max(1, round(p * settings.feature_share))
        self.chosen = sorted(draw.choice(p, size, replace=False).tolist()) if p else []

    @property
    def open(self) -> bool:
        return bool(self.frontier) and self.tree.depth < self.settings.depth and self.leaves < self.settings.leaves and bool(self.chosen)

    def places(self, leaf: np.ndarray) -> np.ndarray:
        """Place in the frontier of every row's node, -1 if its node is not in it."""
        at = np.full(len(self.tree.feature), -1, np.int64)
        at[self.frontier] = np.arange(len(self.frontier))
        return at[leaf]

    def low_high(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.bounds[n][0] for n in self.frontier]), np.array([self.bounds[n][1] for n in self.frontier])

    def split(self, found: list[tuple]) -> None:
        """Split the frontier's nodes, those with the largest gains first, while leaves are left."""
        order = sorted((i for i, f in enumerate(found) if f[0] > 0), key=lambda i: (-found[i][0], i))
        chosen = sorted(order[: self.settings.leaves - self.leaves])
        children, tree = [], self.tree
        for i in chosen:
            gain, feature, cut, vl, vr, nl, nr = found[i]
            node, child = self.frontier[i], len(tree.feature)
            tree.feature[node], tree.bin[node], tree.left[node], tree.gain[node] = feature, cut, child, gain
            low, high = self.bounds[node]
            sign = self.settings.monotone[feature] if self.settings.monotone else 0
            middle = (vl + vr) / 2
            for side, (value, rows) in enumerate(((vl, nl), (vr, nr))):
                tree.feature.append(-1)
                tree.bin.append(0)
                tree.left.append(0)
                tree.value.append(0)
                tree.gain.append(0.0)
                self.real.append(value)
                below = sign and (side == 0) == (sign > 0)
                self.bounds.append((low, min(high, middle)) if below else (max(low, middle), high) if sign else (low, high))
                if rows >= 2 * self.settings.min_rows:
                    children.append(child + side)
        self.leaves += len(chosen)
        if chosen:
            tree.depth += 1
        self.frontier = children

    def finish(self, unit: float, refitted: dict[int, int] | None = None) -> Tree:
        """The tree with its leaves' values in units of the label, times the step; ``refitted`` replaces the leaves' own."""
        for node, feature in enumerate(self.tree.feature):
            if feature < 0:
                value = self.real[node] / unit if refitted is None else refitted.get(node, 0)
                low, high = self.bounds[node]
                if refitted is not None and self.settings.monotone:
                    value = min(max(value, low / unit), high / unit)
                self.tree.value[node] = round(self.settings.step * value)
        self.frontier = []
        return self.tree


def quantile_of(sorted_values: np.ndarray, q: float) -> int:
    """The least value that a share of at least ``q`` does not exceed."""
    return int(sorted_values[max(1, math.ceil(q * len(sorted_values))) - 1])


def squares(r: np.ndarray) -> int:
    """The exact sum of the squares of whole numbers below 2**39."""
    high, low = r >> 12, r & 4095
    dot = lambda a, b: int((a * b).sum())
    return (dot(high, high) << 24) + (dot(high, low) << 13) + dot(low, low)


def losses(y: np.ndarray, prediction: np.ndarray, settings: Settings) -> tuple[int, int]:
    """Exact parts of the loss of some rows: squares, or sums above and below."""
    r = y - prediction
    if settings.quantile is None:
        return squares(r), 0
    return int(r[r > 0].sum()), int(-r[r < 0].sum())


def mean_loss(parts: Sequence[int], n: int, settings: Settings, unit: float) -> float:
    """RMSE, or mean pinball loss."""
    if not n:
        return math.inf
    if settings.quantile is None:
        return math.sqrt(parts[0] / n) * unit
    return (settings.quantile * parts[0] + (1 - settings.quantile) * parts[1]) / n * unit


class Patience:
    """Early stopping: the number of trees with the least loss."""

    def __init__(self, settings: Settings, has_valid: bool):
        self.settings, self.has_valid = settings, has_valid
        self.best, self.loss, self.history = 0, math.inf, []

    def told(self, loss: float) -> bool:
        """Take the loss after one more tree; whether to go on."""
        self.history.append(loss)
        if loss < self.loss:
            self.best, self.loss = len(self.history) - 1, loss
        return not (self.has_valid and self.settings.patience and len(self.history) - 1 - self.best >= self.settings.patience)

    def kept(self, trees: list[Tree]) -> list[Tree]:
        return trees[: self.best] if self.has_valid and self.settings.patience else trees


# --- fits ---------------------------------------------------------------------------------------------------------------


def _start(y: np.ndarray, settings: Settings) -> int:
    if settings.quantile is not None:
        return quantile_of(np.sort(y), settings.quantile)
    return round(int(y.sum()) / len(y))


def grow_in_memory(rows: Rows, settings: Settings, unit: float, size: int) -> tuple[int, list[Tree], list[float]]:
    """Start value, trees and losses of a fit whose rows are all here."""
    y, p = rows.y, len(rows.bins)
    start = _start(y[rows.train], settings)
    prediction = np.full(len(y), start, np.int64)
    g_unit = unit if settings.quantile is None else PINBALL_UNIT
    n_valid = int(rows.valid.sum())
    patience, trees = Patience(settings, n_valid > 0), []
    loss = lambda: mean_loss(losses(y[rows.valid], prediction[rows.valid], settings), n_valid, settings, unit)
    go = patience.told(loss())
    while go and len(trees) < settings.trees:
        growing = Growing(settings, len(trees), p)
        drawn = rows.drawn(settings, len(trees))
        gradient = gradients(y, prediction, settings)
        leaf = np.zeros(len(y), np.int64)
        while growing.open:
            hist = histograms(rows.bins, growing.places(leaf), drawn, gradient, len(growing.frontier), growing.chosen, size)
            growing.split(best_splits(hist, growing.chosen, *growing.low_high(), settings, g_unit))
            leaf = growing.tree.leaf_of(rows.bins)
        refitted = None
        if settings.quantile is not None:
            r, at = (y - prediction)[drawn], leaf[drawn]
            order = np.lexsort((r, at))
            names, first = np.unique(at[order], return_index=True)
            refitted = {int(k): quantile_of(part, settings.quantile) for k, part in zip(names, np.split(r[order], first[1:]), strict=True)}
        tree = growing.finish(unit, refitted)
        prediction = prediction + np.array(tree.value, np.int64)[leaf]
        trees.append(tree)
        go = patience.told(loss())
    return start, patience.kept(trees), patience.history


def _dumped(trees: list[Tree]) -> str:
    return json.dumps([dataclasses.astuple(t) for t in trees])


def _loaded(text: str) -> list[Tree]:
    return [Tree(*t) for t in json.loads(text)]


def _size(binned: Binned) -> int:
    return max([len(e) + 1 for e in binned.edges], default=1)


def fit_in_tasks(binned: Binned, fits: Sequence[tuple[int, Fit]]) -> dict[int, tuple[int, list[Tree], list[float]]]:
    """Fits side by side, each in the task that its number is dealt to; (number, fit) with at most TASK_ROWS rows each."""
    spark, size, unit = binned.blocks.sparkSession, _size(binned), binned.unit
    wanted = dict(fits)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        fit = wanted[number]
        columns = [table.column(c).to_pylist() for c in ("block", "n", "bins", "labels", "roles")]
        start, trees, history = grow_in_memory(Rows([Block(*row, fit) for row in zip(*columns, strict=True)]), fit.settings, unit, size)
        return pa.table({"fit": [number], "start": pa.array([start], pa.int64()), "trees": [_dumped(trees)], "history": pa.array([history], pa.list_(pa.float64()))})

    numbers = F.array(*[F.lit(n).cast("long") for n in wanted])
    dealt = binned.blocks.select(F.explode(numbers).alias("fit"), "*").repartition(len(wanted), "fit")
    found = dealt.groupBy("fit").applyInArrow(run, "fit long, start long, trees string, history array<double>")
    return {r.fit: (r.start, _loaded(r.trees), list(r.history)) for r in found.collect()}


class _Running:
    """A fit that runs over the rows: what the driver knows of it."""

    def __init__(self, fit: Fit, start: int, n_valid: int, p: int):
        self.fit, self.start, self.p, self.n_valid = fit, start, p, n_valid
        self.trees: list[Tree] = []
        self.patience = Patience(fit.settings, n_valid > 0)
        self.growing: Growing | None = None
        self.done = False

    def next_tree(self) -> None:
        self.growing = Growing(self.fit.settings, len(self.trees), self.p)


def _summed_arrays(table: pa.Table, shape) -> np.ndarray:
    return functools.reduce(np.add, [np.frombuffer(d, np.int64) for d in table["sums"].to_pylist()]).reshape(shape)


def _map_blocks(state: DataFrame, wanted: dict[int, object], one) -> DataFrame:
    """(fit, sums): for every fit the sum over a task's blocks of the arrays that ``one(block, prediction, number)`` gives."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, n, bins, labels, roles, predictions in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                held = np.frombuffer(predictions, np.int64).reshape(-1, n)
                for k, (row, fit) in wanted.items():
                    sums = one(Block(number, n, bins, labels, roles, fit), held[row], k)
                    total[k] = total[k] + sums if k in total else sums
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].astype(np.int64).tobytes() for k in keys], pa.binary())], names=["fit", "sums"])

    return state.select("block", "n", "bins", "labels", "roles", "predictions").mapInArrow(run, "fit long, sums binary")


def _predicted(held: np.ndarray, bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for tree in trees:
        held = held + np.array(tree.value, np.int64)[tree.leaf_of(bins)]
    return held


def _write_state(state: DataFrame, recent: dict[int, list[Tree]], order: Sequence[int]) -> DataFrame:
    """The blocks with the predictions of all fits after ``recent`` trees."""

    def run(batches):
        for batch in batches:
            out = []
            for n, bins, predictions in zip(*(batch.column(i).to_pylist() for i in (1, 2, 5)), strict=True):
                held, x = np.frombuffer(predictions, np.int64).reshape(-1, n), np.frombuffer(bins, np.uint8).reshape(-1, n)
                out.append(np.stack([_predicted(held[row], x, recent.get(k, [])) for row, k in enumerate(order)]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=batch.schema.names)

    spark, path = state.sparkSession, scratch_path(state.sparkSession, "predictions")
    columns = ["block", "n", "bins", "labels", "roles", "predictions"]
    state.select(*columns).mapInArrow(run, state.select(*columns).schema).write.parquet(path)
    return spark.read.schema(state.select(*columns).schema).parquet(path)


def _ranks(state: DataFrame, wanted: dict[int, tuple], leaf_and_residual, places: dict[int, int], quantiles: dict[int, float]) -> dict[int, dict[int, int]]:
    """Exact quantile of whole numbers by fit and leaf: cells of 2**RANK_BITS values first, then the values of one cell each."""
    offset, cells = 1 << (2 * RANK_BITS - 1), 1 << RANK_BITS

    def counted(picked):
        def one(block, held, k):
            place, r = leaf_and_residual(block, held, k)
            r = np.where(place >= 0, r, 0) + offset
            if (r < 0).any() or (r >= 2 * offset).any():
                raise ValueError("a residual is too large for its cells")
            if picked is None:
                value, use = r >> RANK_BITS, place >= 0
            else:
                cell = np.array(picked[k], np.int64)
                use = (place >= 0) & ((r >> RANK_BITS) == cell[np.maximum(place, 0)])
                value = r & (cells - 1)
            return np.bincount(place[use] * cells + value[use], minlength=places[k] * cells)

        def merge(key, table):
            k = key[0].as_py()
            total = _summed_arrays(table, (places[k], cells))
            before = np.cumsum(total, 1)
            # the rank that is still looked for: from the share, then what the first step left over
            n = before[:, -1]
            want = np.maximum(1, np.ceil(quantiles[k] * n)).astype(np.int64) if picked is None else np.array(left_over[k], np.int64)
            at = (before < want[:, None]).sum(1)
            at = np.minimum(at, cells - 1)
            rest = want - np.where(at > 0, before[np.arange(len(at)), at - 1], 0)
            return pa.table({"fit": pa.array([k], pa.int64()), "at": pa.array([at.tolist()], pa.list_(pa.int64())), "rest": pa.array([rest.tolist()], pa.list_(pa.int64())), "n": pa.array([n.tolist()], pa.list_(pa.int64()))})

        return _map_blocks(state, wanted, one).groupBy("fit").applyInArrow(merge, "fit long, at array<long>, rest array<long>, n array<long>").collect()

    left_over: dict[int, list[int]] = {}
    first = counted(None)
    picked = {r.fit: list(r["at"]) for r in first}
    left_over.update({r.fit: list(r.rest) for r in first})
    full = {r.fit: list(r.n) for r in first}
    return {r.fit: {i: (picked[r.fit][i] << RANK_BITS) + at - offset for i, at in enumerate(r["at"]) if full[r.fit][i]} for r in counted(picked)}


def fit_over_rows(binned: Binned, fits: Sequence[tuple[int, Fit]]) -> dict[int, tuple[int, list[Tree], list[float]]]:
    """Fits of any number of rows: one aggregate per level for all of them; predictions are written every WRITE_TREES trees."""
    size, unit, p, order = _size(binned), binned.unit, len(binned.features), [n for n, _ in fits]
    rows_of = {k: i for i, k in enumerate(order)}
    zero = F.expr(f"unhex(repeat('00', cast(8 * {len(order)} * n as int)))")
    state = binned.blocks.select("*", zero.alias("predictions"))
    all_fits = {k: (rows_of[k], fit) for k, fit in fits}
    # start values
    quantiles = {k: f.settings.quantile for k, f in fits if f.settings.quantile is not None}
    means = {k: v for k, v in all_fits.items() if k not in quantiles}
    starts: dict[int, int] = {}
    if means:
        sums = _map_blocks(state, means, lambda b, held, k: np.array([b.y[b.train].sum(), b.train.sum()], np.int64))
        total = sums.groupBy("fit").applyInArrow(lambda key, t: pa.table({"fit": [key[0].as_py()], "s": [_summed_arrays(t, 2).tolist()]}), "fit long, s array<long>")
        starts = {r.fit: round(r.s[0] / r.s[1]) for r in total.collect()}
    if quantiles:
        whole = {k: all_fits[k] for k in quantiles}
        found = _ranks(state, whole, lambda b, held, k: (np.where(b.train, 0, -1), b.y), dict.fromkeys(quantiles, 1), quantiles)
        starts |= {k: found[k][0] for k in quantiles}
    running = {k: _Running(fit, starts[k], binned.sizes.get((fit.label, fit.role, VALID), 0), p) for k, fit in fits}
    state = _write_state(state, {k: [Tree(value=[starts[k]])] for k in order}, order)
    written = dict.fromkeys(order, 0)

    def recent(k: int) -> list[Tree]:
        return running[k].trees[written[k] :]

    def current(bins: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
        return _predicted(held, bins, trees_since[k])

    while True:
        trees_since = {k: recent(k) for k in order}
        told = {k: all_fits[k] for k, r in running.items() if not r.done}
        if not told:
            break

        def loss(b, held, k):
            part = losses(b.y[b.valid], current(b.bins, held, k)[b.valid], told[k][1].settings)
            # squares need more than a long: three parts of 40 bits
            return np.array([(v >> shift) & (2**40 - 1) for v in part for shift in (0, 40, 80)], np.int64)

        sums = _map_blocks(state, told, loss).groupBy("fit").applyInArrow(lambda key, t: pa.table({"fit": [key[0].as_py()], "s": [_summed_arrays(t, 6).tolist()]}), "fit long, s array<long>")
        for r in sums.collect():
            one = running[r.fit]
            parts = [sum(v << (40 * i) for i, v in enumerate(r.s[j : j + 3])) for j in (0, 3)]
            go = one.patience.told(mean_loss(parts, one.n_valid, one.fit.settings, unit))
            one.done = not go or len(one.trees) >= one.fit.settings.trees
        growing = {k: r for k, r in running.items() if not r.done}
        for r in growing.values():
            r.next_tree()
        while level := {k: r for k, r in growing.items() if r.growing.open}:
            for group in _groups(level, size):
                one, splits = _level({k: r.growing for k, r in group.items()}, current, size, unit)
                sums = _map_blocks(state, {k: all_fits[k] for k in group}, one)
                for r in sums.groupBy("fit").applyInArrow(splits, "fit long, found string").collect():
                    growing[r.fit].growing.split([tuple(x) for x in json.loads(r.found)])
        refit = {k: r.growing for k, r in growing.items() if r.fit.settings.quantile is not None}
        values: dict[int, dict[int, int]] = {}
        if refit:

            def residual(b, held, k):
                g = refit[k]
                leaf = g.tree.leaf_of(b.bins)
                return np.where(b.drawn(g.settings, g.number), leaf, -1), b.y - current(b.bins, held, k)

            values = _ranks(state, {k: all_fits[k] for k in refit}, residual, {k: len(g.tree.feature) for k, g in refit.items()}, quantiles)
        for k, r in growing.items():
            r.trees.append(r.growing.finish(unit, values.get(k)))
        if any(len(r.trees) - written[k] >= WRITE_TREES for k, r in growing.items()):
            state = _write_state(state, {k: recent(k) for k in order}, order)
            written = {k: len(running[k].trees) for k in order}
    return {k: (r.start, r.patience.kept(r.trees), r.patience.history) for k, r in running.items()}


def _level(plans: dict[int, Growing], current, size: int, unit: float):
    """Histograms of a level over a block, and the splits that their sums decide."""

    def one(b: Block, held: np.ndarray, k: int) -> np.ndarray:
        g = plans[k]
        gradient = gradients(b.y, current(b.bins, held, k), g.settings)
        return histograms(b.bins, g.places(g.tree.leaf_of(b.bins)), b.drawn(g.settings, g.number), gradient, len(g.frontier), g.chosen, size).ravel()

    def splits(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        g = plans[k]
        hist = _summed_arrays(table, (len(g.frontier), len(g.chosen), size, 2))
        found = best_splits(hist, g.chosen, *g.low_high(), g.settings, unit if g.settings.quantile is None else PINBALL_UNIT)
        return pa.table({"fit": pa.array([k], pa.int64()), "found": [json.dumps(found)]})

    return one, splits


def _groups(level: dict[int, _Running], size: int):
    """Fits whose histograms of a level fit into a task together."""
    held, total = {}, 0
    for k, r in level.items():
        need = 16 * len(r.growing.frontier) * len(r.growing.chosen) * size
        if held and total + need > HISTOGRAM_BYTES:
            yield held
            held, total = {}, 0
        held[k] = r
        total += need
    if held:
        yield held


# --- fitted models ------------------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Ensemble:
    """A fitted model: trees with real thresholds in flat arrays, walked by batches of rows."""

    features: list[str]
    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    depth: np.ndarray
    history: list[float]

    @classmethod
    def of(cls, binned: Binned, start: int, trees: list[Tree], history: list[float]) -> Ensemble:
        sizes = np.array([len(t.feature) for t in trees], np.int64)
        roots = np.cumsum(sizes) - sizes
        flat = lambda name, kind: np.array([x for t in trees for x in getattr(t, name)], kind)
        feature, cut = flat("feature", np.int64), flat("bin", np.int64)
        # the last bin of a feature has no upper edge
        edge = lambda f, b: binned.edges[f][b] if f >= 0 and b < len(binned.edges[f]) else math.inf
        threshold = np.array([edge(f, b) for f, b in zip(feature.tolist(), cut.tolist(), strict=True)], np.float64)
        left = flat("left", np.int64) + np.repeat(roots, sizes)
        depth = np.array([t.depth for t in trees], np.int64)
        return cls(binned.features, start * binned.unit, feature, threshold, left, flat("value", np.float64) * binned.unit, flat("gain", np.float64), roots, depth, history)

    @property
    def n_trees(self) -> int:
        return len(self.roots)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows (features by rows); a missing value goes to the right."""
        out = np.full(x.shape[1], self.start)
        rows = np.arange(x.shape[1])
        for root, depth in zip(self.roots.tolist(), self.depth.tolist(), strict=True):
            node = np.full(x.shape[1], root)
            for _ in range(depth):
                f = self.feature[node]
                node = np.where(f >= 0, self.left[node] + ~(x[np.maximum(f, 0), rows] <= self.threshold[node]), node)
            out += self.value[node]
        return out

    def column(self) -> Column:
        """The prediction as a column over the features."""
        model = self

        @F.pandas_udf("double")
        def walk(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])))

        return walk(*[F.col(f).cast("double") for f in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())

    def importances(self) -> dict[str, float]:
        """Gain of every feature as a share of all."""
        total = np.bincount(self.feature[self.feature >= 0], self.gain[self.feature >= 0], len(self.features))
        return {f: float(x) for f, x in zip(self.features, total / total.sum() if total.sum() else total, strict=True)}

    def save(self, spark: SparkSession, path: str) -> None:
        state = {f.name: (v.tolist() if isinstance(v := getattr(self, f.name), np.ndarray) else v) for f in dataclasses.fields(self)}
        spark.createDataFrame([(json.dumps(state),)], "model string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        state = json.loads(spark.read.text(path, wholetext=True).first()[0])
        whole = ("feature", "left", "roots", "depth")
        arrays = {n: np.array(state[n], np.int64 if n in whole else np.float64) for n in ("feature", "threshold", "left", "value", "gain", "roots", "depth")}
        return cls(state["features"], state["start"], *(arrays[n] for n in ("feature", "threshold", "left", "value", "gain", "roots", "depth")), state["history"])


def column_of(models: dict[int, Ensemble], selector: Column) -> Column:
    """The prediction of the model that ``selector`` names; null for numbers without a model.  All read the same features."""
    features = next(iter(models.values())).features

    @F.pandas_udf("double")
    def walk(number: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
        out, wanted = np.full(len(number), np.nan), number.to_numpy(np.float64, na_value=np.nan)
        for k, model in models.items():
            rows = np.flatnonzero(wanted == k)
            if len(rows):
                out[rows] = model.scores(x[:, rows])
        return pd.Series(out)

    return F.nanvl(walk(selector.cast("double"), *[F.col(f).cast("double") for f in features]), F.lit(None))


def fit_all(binned: Binned, fits: Sequence[Fit]) -> list[Ensemble | None]:
    """A model for every fit; None where a fit has no training rows."""
    size = lambda f: sum(binned.sizes.get((f.label, f.role, part), 0) for part in (TRAIN, VALID))
    wanted = [(n, f) for n, f in enumerate(fits) if binned.sizes.get((f.label, f.role, TRAIN), 0)]
    small, large = [(n, f) for n, f in wanted if size(f) <= TASK_ROWS], [(n, f) for n, f in wanted if size(f) > TASK_ROWS]
    found = (fit_in_tasks(binned, small) if small else {}) | (fit_over_rows(binned, large) if large else {})
    return [Ensemble.of(binned, *found[n]) if n in found else None for n in range(len(fits))]
