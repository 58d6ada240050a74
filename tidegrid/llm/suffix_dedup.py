"""Suffix-array dedup (operator 8): byte strings that occur twice, found by a hash-compared suffix sort.

Distinct runs that share an anchor (see ``repeats``) are dealt out to tasks by anchor.  A task sorts the suffixes that start
at the anchors by mergesort; two suffixes are compared by a binary search for their common extension over prefix hashes,
so a comparison takes logarithmic time.  The suffixes that start before the anchors are then put in order one byte at a time:
a stable sort by the byte in front keeps the order behind it.  Windows that are equal are neighbours in that order; what the
hashes call equal is compared byte by byte.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch
from tidegrid.llm.repeats import Bytes, keyed, repeated_runs, run_contents, without_spans
from tidegrid.llm.rolling import INVERSE, byte_symbols, powers, prefix_hashes

WINDOW = 400
GRAM = 32
#: Runs of a task, on average, and the most distinct runs with one anchor that go to one task.
BIN = 4096
CONTENT = "key long, digest long, n int, anchor int, sharers long, content binary"


class Suffixes:
    """The runs of a task: their bytes one behind another, prefix hashes, the anchors and ends, and their groups."""

    def __init__(self, contents: list[bytes], anchors: np.ndarray, groups: np.ndarray, window: int):
        self.window, self.groups = window, groups
        data = b"".join(contents)
        self.bytes = np.frombuffer(data, np.uint8)
        self.prefix = prefix_hashes(byte_symbols(data))
        sizes = np.array([len(c) for c in contents], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.anchors = self.starts + anchors
        self.scale = powers(INVERSE, len(self.prefix))

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.scale[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at the anchors of runs x and y, by binary search."""
        a, b = self.anchors[x], self.anchors[y]
        most = np.minimum(self.ends[x] - a, self.ends[y] - b)
        length = np.zeros(len(x), np.int64)
        step = 1 << int(most.max(initial=1)).bit_length()
        while step:
            longer = length + step
            test = np.flatnonzero(longer <= most)
            same = self.hashes(a[test], longer[test]) == self.hashes(b[test], longer[test])
            length[test[same]] = longer[test[same]]
            step >>= 1
        return length

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether run x sorts before run y by (group, suffix at the anchor); equal ones as ``ties`` says."""
        size = self.common(x, y)
        a, b = self.anchors[x] + size, self.anchors[y] + size
        end_x, end_y = a >= self.ends[x], b >= self.ends[y]
        last = len(self.bytes) - 1
        less = np.where(end_x | end_y, np.where(end_x & end_y, ties, end_x), self.bytes[np.minimum(a, last)] < self.bytes[np.minimum(b, last)])
        return np.where(self.groups[x] != self.groups[y], self.groups[x] < self.groups[y], less)

    def sorted(self) -> np.ndarray:
        """Mergesort of the runs, all merges of a level at once: an element's place is its own plus its rank in the other half."""
        n, width = len(self.ends), 1
        order = np.arange(n)
        place = np.arange(n)
        while width < n:
            block = place // width
            other = (block ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            first = low.copy()
            right = (block & 1).astype(bool)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                smaller = self.before(order[middle], order[open_], right[open_])
                low[open_[smaller]] = middle[smaller] + 1
                high[open_[~smaller]] = middle[~smaller]
            merged = np.empty(n, np.int64)
            merged[place - block * width + np.minimum(block, block ^ 1) * width + low - first] = order
            order, width = merged, width * 2
        return order

    def equal_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, neighbour, offset before the anchor) of all neighbouring windows with equal hashes."""
        back = self.anchors - self.starts
        least = np.maximum(0, self.window - (self.ends - self.anchors))
        order = self.sorted()
        found = []
        for j in range(int(back.max(initial=-1)) + 1):
            if j:
                order = order[back[order] >= j]
                order = order[np.argsort(self.bytes[self.anchors[order] - j], kind="stable")]
            whole = least[order] <= j
            at = np.where(whole, self.anchors[order] - j, 0)
            h = self.hashes(at, np.where(whole, self.window, 0))
            same = np.flatnonzero((h[1:] == h[:-1]) & whole[1:] & whole[:-1] & (self.groups[order[1:]] == self.groups[order[:-1]]))
            found.append((order[same], order[same + 1], np.full(len(same), j)))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def verified(s: Suffixes, contents: list[bytes], x: np.ndarray, y: np.ndarray, j: np.ndarray):
    """(run, window) of both sides of all pairs whose bytes are equal: pairs on consecutive windows are compared at once."""
    order = np.lexsort((j, y, x))
    x, y, j = x[order], y[order], j[order]
    new = (np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0) | (np.diff(j, prepend=-9) != 1)
    cuts = np.flatnonzero(new)
    back = s.anchors - s.starts
    runs, windows = [], []
    for a, b in zip(cuts, np.append(cuts[1:], len(x)), strict=False):
        p, q, low, high = int(x[a]), int(y[a]), int(j[a]), int(j[b - 1])

        def part(r, most, least):
            return contents[r][back[r] - most : back[r] - least + s.window]  # noqa: B023

        offsets = np.arange(low, high + 1)
        if part(p, high, low) != part(q, high, low):
            offsets = np.array([k for k in offsets if part(p, k, k) == part(q, k, k)], np.int64)
        for r in (p, q):
            runs.append(np.full(len(offsets), r))
            windows.append(back[r] - offsets)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *runs]), np.concatenate([none, *windows])


def ranges_of(run: np.ndarray, window: np.ndarray):
    """Maximal ranges (run, from, to) of window numbers."""
    pairs = np.unique(np.stack([run, window], axis=1), axis=0) if len(run) else np.zeros((0, 2), np.int64)
    new = np.flatnonzero((np.diff(pairs[:, 0], prepend=-1) != 0) | (np.diff(pairs[:, 1], prepend=-9) != 1))
    past = np.append(new[1:], len(pairs))[: len(new)]
    return pairs[new, 0], pairs[new, 1], pairs[past - 1, 1] + 1


def sort_runs(window: int):
    """For a task's runs, the ranges of their windows that another of them has too."""

    def run(table: pa.Table) -> pa.Table:
        key, digest = table["key"].to_numpy(), table["digest"].to_numpy()
        _, one = np.unique(np.stack([key, digest], axis=1), axis=0, return_index=True)
        table, key, digest = table.take(pa.array(one)), key[one], digest[one]
        contents = table["content"].to_pylist()
        s = Suffixes(contents, table["anchor"].to_numpy().astype(np.int64), np.unique(key, return_inverse=True)[1], window)
        r, a, b = ranges_of(*verified(s, contents, *s.equal_windows()))
        return pa.table({"key": key[r], "digest": digest[r], "a": a.astype(np.int32), "b": b.astype(np.int32)})

    return run


def _window_rows(window: int):
    """Every window of runs whose anchor is too common for one task, by a digest of its bytes."""

    def run(batches):
        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                data, n = content.as_py(), batch.column("n")[i].as_py()
                names = [hashlib.blake2b(data[k : k + window], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in ("key", "digest")] + [pa.array(range(n), pa.int32()), pa.array(names)], names=["key", "digest", "w", "name"])

    return run


def shared_windows(contents: DataFrame, window: int = WINDOW, limit: int = BIN) -> DataFrame:
    """(key, digest, a, b): ranges of windows that a distinct run has in common with another of the same anchor.

    Anchors with more than ``limit`` distinct runs are spread by window: their windows' digests are counted in a shuffle.
    """
    contents = contents.where("sharers > 1")
    few = contents.where(F.col("sharers") <= limit)
    bins = max(1, math.ceil(few.count() / limit))
    dealt = few.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    sorted_ = dealt.groupBy("bin").applyInArrow(sort_runs(window), "key long, digest long, a int, b int")
    rows = contents.where(F.col("sharers") > limit).mapInArrow(_window_rows(window), "key long, digest long, w int, name binary")
    again = rows.join(rows.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "name")
    return sorted_.unionByName(again.select("key", "digest", F.col("w").alias("a"), (F.col("w") + 1).alias("b")))


def _contents(window: int):
    """The bytes of a text's runs, some hundred runs a batch."""
    names = ["key", "digest", "n", "anchor", "sharers"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def make(seq: Bytes, runs: list[dict]):
        for at in range(0, len(runs), 512):
            part = runs[at : at + 512]
            columns = [pa.array([r[k] for r in part], t) for k, t in zip(names, types, strict=True)]
            content = pa.array([seq.content(r["first"], r["first"] + r["n"] + window - 1) for r in part], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, content], names=[*names, "content"])

    return make


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = BIN, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes).

    Every byte that is covered by a ``window``-byte string which also starts anywhere else in the input goes; matches do
    not cross texts, overlaps count, and strings are judged on the input.  Null texts are empty; whole copies of a row
    are copies like any other; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    places, runs = repeated_runs(rows, Bytes, window, gram, scratch)

    contents = scratch.write(run_contents(rows, runs.where("sharers > 1"), _contents(window), Bytes, CONTENT), "contents")
    whole = runs.where("copies > 1").select("key", "digest", F.lit(0).alias("a"), F.col("n").alias("b"))
    ranges = scratch.write(whole.unionByName(shared_windows(contents, window, limit)), "ranges")
    scratch.drop(contents)
    found = without_spans(rows, places, ranges, Bytes, window, with_text)
    names = [F.col("id").alias(id_col), F.col("size").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), "kept_sha256"]
    return found.select(*names, *(["kept"] if with_text else []))
