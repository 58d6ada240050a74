"""What the operators share: words, row keys, written tables, connected components."""

from __future__ import annotations

import contextlib
import gc
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import prepare, scratch_path

#: White space that separates words: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch.  Texts are long, so batches are short; long texts are cut further inside the functions.
BATCH_ROWS = 256


def prepared(spark: SparkSession) -> SparkSession:
    """Settings of the session that the operators' memory bounds rely on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, its true size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the jobs that run inside, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Written tables of one run; those that later tables have replaced can be given back, with the shuffle files behind them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``df`` as a table, in folders of its own for each value of ``by``."""
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        # shuffle files of finished jobs go when the driver's objects for them are collected
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame, folder: str = "") -> None:
        """Delete a table, or one ``folder`` of it, that no later step reads."""
        for name in {n for f in table.inputFiles() if (n := f.rpartition("/")[0]).endswith(folder)}:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str) -> list:
    """Columns ``_d`` and ``_h`` that name a row: its id (null: the smallest long) and a hash of its text.

    Rows with the same id and different texts have different keys; whole copies of a row share a key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(text).alias("_h")]


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): one row (node, root) per node, root the smallest node reachable.

    Alternates two contractions until nothing changes: every node passes its larger neighbours, then its smaller ones,
    to the least node next to it.  Both are a minimum with map-side combine and an equi-join, so a node with very many
    neighbours is neither gathered in a task nor paired up.  Every round is a written table.  Self links are ignored;
    an empty input gives an empty result.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        links = _both_ways(edges)
        up = links.join(_least_neighbour(links), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(up.where("u <> v").distinct(), "edges")
        least = _least_neighbour(large)
        own = least.select("u", F.col("m").alias("v"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = own.unionByName(down).where("u <> v")
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    nodes = root.select(F.col("u").alias("node"), "root")
    return nodes.unionByName(root.select(F.col("root").alias("node"), "root").distinct())


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores behind, whichever no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^31 in size, signs folded into the last bit, their bytes plane by plane, compressed."""
    numbers = numbers.astype(np.int64)
    folded = (np.abs(numbers) << 1 | (numbers < 0)).astype("<u4")
    return zlib.compress(folded.view(np.uint8).reshape(-1, 4).T.tobytes(), 4)


def unpacked_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    folded = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.where(folded & 1, -(folded >> 1), folded >> 1)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``starts``, one behind another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
