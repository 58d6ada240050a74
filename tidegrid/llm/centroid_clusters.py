"""Centroid clustering (operator 13): k-means on integers over Hilbert-ordered blocks with zone maps.

Vectors are ordered along a Hilbert curve and cut into blocks that hold their least and greatest component in every dimension.
In each round the box of a block bounds its distance to every centroid; only centroids whose least possible distance is not above
the least greatest one can be the nearest for any vector in it, and only these are compared exactly.  The driver holds the
centroids and their sums, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, prepared

#: Components are scaled by this and floored; results beyond LIMIT are set to it, so that a squared distance is a long.
SCALE, LIMIT = 256, 2**27
#: Bits of a component in the curve's key: of its place between the least and the greatest in its dimension.
KEY_BITS = 4
#: Vectors of a block, and of a task that orders them.
BLOCK, TASK = 256, 100_000
#: Up to here sums of products are exact in double precision.
EXACT = 2**53


def hilbert_keys(places: np.ndarray, bits: int) -> list[bytes]:
    """Key of every row of ``places`` (whole numbers of ``bits`` bits): its distance along the Hilbert curve, big-endian.

    The axes become the transposed index by exchanging and inverting low bits from the highest bit down, then Gray decoding;
    all rows at once.
    """
    x = places.T.astype(np.uint32).copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q = np.uint32(1 << bit)
        low = np.uint32(q - 1)
        for i in range(n):
            inverted = (x[i] & q) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    # bits of all axes, the highest first
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def usable(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(vec_id, x): scaled components of the vectors with ``size`` components, none null or non-finite."""
    x = F.col(vector_col).cast("array<double>")
    good = (F.size(x) == size) & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform("x", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-2.0 * LIMIT), F.least(F.lit(2.0 * LIMIT), SCALE * c))))).cast("int"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).select("vec_id", whole.alias("x"))


def first_centroids(scaled: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``salt`` and their id, in that order; of equal ids the lesser vector first."""
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    order = [F.col("vec_id").isNull(), "h", "x"]
    return np.array([r.x for r in scaled.select("vec_id", "x", name.alias("h")).orderBy(*order).limit(k).collect()], np.int64)


def hilbert_blocks(scaled: DataFrame, size: int, rows: int, key_bits: int = KEY_BITS, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """(ids, matrix, low, high): blocks of neighbours on the curve with their boxes.

    Equal keys are parted by a hash of the row's number, so a vector that a third of the rows share fills many tasks.
    """
    ends = scaled.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("d").collect()
    low = np.array([r.low for r in ends], np.int64)
    span = np.maximum(1, np.array([r.high for r in ends], np.int64) - low + 1)

    def keyed(batches):
        for batch in batches:
            x = _matrix(batch.column(1), size).astype(np.int64)
            keys = hilbert_keys(((x - low) << key_bits) // span, key_bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "x", "turn", "key"])

    def cut(batches):
        ids, held, n = [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(_matrix(batch.column(1), size))
            n += batch.num_rows
            while n >= block:
                x = np.concatenate(held)
                yield _block(ids[:block], x[:block])
                ids, held, n = ids[block:], [x[block:]], n - block
        if n:
            yield _block(ids, np.concatenate(held))

    turned = scaled.select("vec_id", "x", F.xxhash64(F.monotonically_increasing_id()).alias("turn"))
    placed = turned.mapInArrow(keyed, "vec_id long, x array<int>, turn long, key binary")
    parts = max(1, math.ceil(rows / task))
    ordered = placed.repartitionByRange(parts, "key", "turn").sortWithinPartitions("key", "turn").select("vec_id", "x")
    return ordered.mapInArrow(cut, "ids array<long>, matrix binary, low array<int>, high array<int>")


def _block(ids: list, x: np.ndarray) -> pa.RecordBatch:
    low, high = x.min(0), x.max(0)
    columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()]), pa.array([low], pa.list_(pa.int32())), pa.array([high], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "matrix", "low", "high"])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be the nearest of a vector between ``low`` and ``high``."""
    under, over = low - centroids, centroids - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(x: np.ndarray, centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row (of equal distances the smaller number) and the squared distance, exactly."""
    some = candidates(low, high, centroids)
    c = centroids[some]
    reach = int(max(np.abs(low).max(), np.abs(high).max(), np.abs(c).max()))
    if 4 * reach * reach * x.shape[1] < EXACT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        away = (f * f).sum(1)[:, None] - 2 * f @ g.T + (g * g).sum(1)
    else:
        away = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    best = away.argmin(1)
    return some[best], away[np.arange(len(x)), best].astype(np.int64)


def _assigned(batches, centroids: np.ndarray):
    """(ids, matrix, clusters, distances) of every block."""
    size = centroids.shape[1]
    for batch in batches:
        for ids, data, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            x = np.frombuffer(data, "<i4").reshape(-1, size).astype(np.int64)
            yield ids, x, *nearest(x, centroids, np.array(low, np.int64), np.array(high, np.int64))


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, d, n, total): members and sum of every component of every cluster that has members.

    A task adds up its blocks, so what is shuffled has a fixed size per task.
    """

    def run(batches):
        k, size = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids):
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        some = np.flatnonzero(n)
        columns = [np.repeat(some, size), np.tile(np.arange(size), len(some)), np.repeat(n[some], size), total[some].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["cluster", "d", "n", "total"])

    return blocks.mapInArrow(run, "cluster long, d long, n long, total long").groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def assignments(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        for ids, _, cluster, away in _assigned(batches, centroids):
            columns = [pa.array(ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def fitted_centroids(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds; each replaces the non-empty ones by the floor of their members' mean."""
    centroids = centroids.copy()
    for _ in range(rounds):
        for r in cluster_sums(blocks, centroids).collect():
            centroids[r.cluster, r.d] = r.total // r.n
    return centroids


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length than ``size``, null ones and those with a null or non-finite component are left out; so are all other
    columns.  Scaled components beyond 2^27 are set to it.  Copies are vectors of their own; a null id comes last when the first
    centroids are chosen.  With fewer vectors than ``k`` there are as many centroids; an empty table gives no rows.
    """
    spark = prepared(vectors.sparkSession)
    scratch = Scratch(spark)
    scaled = scratch.write(usable(vectors, id_col, vector_col, size), "scaled")
    rows, start = scaled.count(), first_centroids(scaled, k, salt)
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not rows:
        return spark.createDataFrame([], schema)
    blocks = scratch.write(hilbert_blocks(scaled, size, rows), "blocks")
    scratch.drop(scaled)
    centroids = fitted_centroids(blocks, start, rounds)
    found = scratch.write(assignments(blocks, centroids), "assigned")
    scratch.drop(blocks)
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(n, sums[n], sum(sums.values()), digests[n]) for n in sorted(sums)]
    # as many rows as there are centroids
    clusters = F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(clusters, "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
