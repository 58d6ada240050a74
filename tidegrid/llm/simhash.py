"""SimHash near-dedup (operator 3): meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of both.  Every distinct fingerprint emits
its ball of radius r, equal variants meet in a shuffle, and members of a meeting are linked to its least member.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import components, row_key, unused, written

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once, so that memory does not follow the length of a text.
CHUNK = 50_000
#: Variants that a task emits, on average.
VARIANTS = 2_000_000


def simhash(text: bytes | None, size: int = 3) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if over half of its shingles' XXH64 (seed 42) set it; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    spans = list(zip(starts, ends[size - 1 :], strict=False)) or [(0, len(joined) + 1)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), CHUNK):
        data = b"".join([digest(joined[a : b - 1], SEED) for a, b in spans[i : i + CHUNK]])
        ones += np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(_d, _h, id, fp): key and id of every row, its fingerprint as a signed long; null texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            found = [simhash(x.as_py(), size) for x in batch.column(3)]
            columns = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=["_d", "_h", "id", "fp"])

    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "_d long, _h long, id long, fp long")


def ball_masks(radius: int) -> list[int]:
    """Every 64-bit mask of at most ``radius`` bits, as signed longs."""
    places = itertools.chain.from_iterable(itertools.combinations(range(BITS), r) for r in range(radius + 1))
    masks = [sum(1 << p for p in bits) for bits in places]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (u, v) that connect all distinct values of ``fp`` within ``max_bits`` (even) of each other.

    Distinct fingerprints that share a variant are all within twice the radius, so each is linked with the least of them:
    a star instead of all pairs.  A variant has at most as many members as the ball, whatever the data.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: it is twice the radius of the balls")
    masks = ball_masks(max_bits // 2)
    ball = F.explode(F.array(*[F.lit(m) for m in masks]))
    # a task emits a bounded number of variants, however small the fingerprints look to the planner
    parts = max(1, math.ceil(prints.count() * len(masks) / VARIANTS))
    variants = prints.select("fp").repartition(parts, "fp").distinct().select("fp", ball.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> least")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= max_bits
    return least.where(near).select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint, named by the least fingerprint in it."""
    roots = written(components(fingerprint_links(prints, max_bits)), "roots")
    distinct = prints.select("fp").distinct()
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Null texts and texts without words have fingerprint zero and are linked like any other.  Null ids are never a
    component_id unless all ids of the component are null.  Other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "simhash")
    rooted = prints.groupBy("fp").agg(F.min("id").alias("least")).join(_rooted(prints, max_bits), "fp")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(groups, "root").select("fp", "component_id")
    named = prints.join(by_print, "fp")
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the row of the smallest id of every ``root``; ``rows`` (_d, _h, id, root) has the keys of all."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "_d", "_h")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    gone = rows.join(first, "root").where((F.col("first._d") != F.col("_d")) | (F.col("first._h") != F.col("_h"))).select("_d", "_h").distinct()
    gone = written(gone, "near")
    key = row_key(id_col, text_col)
    d, h = unused(docs, "_key_d"), unused(docs, "_key_h")
    marked = docs.select("*", key[0].alias(d), key[1].alias(h))
    return marked.join(gone, (marked[d] == gone["_d"]) & (marked[h] == gone["_h"]), "left_anti").drop(d, h)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of every component, the one with the smallest id; all columns as they were.

    Of different texts with that id the one with the least hash stays; null ids are chosen last.  Whole copies of the row that
    stays are not told apart and stay too: remove them with exact dedup first.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "simhash")
    return keep_first(docs, prints.join(_rooted(prints, max_bits), "fp"), id_col, text_col)
