"""Benchmark decontamination (operator 2): size-partitioned MinHash containment search, verified by exact containment.

Column functions only.  A test item is short and a document may be long, so a MinHash of the document says little about
the item: its values come from the rest of the document.  Here the item alone is sampled, by the shingle that is least under
each of some hash functions; the share of these samples that a document holds estimates how much of the item it contains,
whatever the document's length.  Items are partitioned by size: each partition has its own number of hash functions and
of samples that a candidate must hold, and meets only documents that are large enough.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import row_key, written

SHINGLE = 5
THRESHOLD = 0.8
#: Hash functions of a partition, and the chance to miss an item of just the threshold's containment.
HASHES = 16
MISS = 1e-6


def words(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles(w: F.Column, hashed: bool, size: int = SHINGLE) -> F.Column:
    """Distinct runs of ``size`` words of a word array (fewer: the whole; none: none), as text or as XXH64.

    ``w`` must be a plain column: an expression would be evaluated again for every run.
    """
    last = F.greatest(F.size(w) - size + 1, F.lit(1))

    def one(i):
        text = F.concat_ws(" ", F.slice(w, i, F.lit(size)))
        return F.xxhash64(text) if hashed else text

    kind = "bigint" if hashed else "string"
    return F.when(F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), one))).otherwise(F.expr(f"CAST(array() AS array<{kind}>)"))


def runs(w: F.Column, size: F.Column | int, hashed: bool) -> F.Column:
    """Distinct runs of just ``size`` words of a word array; none if it has fewer."""
    text = lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(size) if isinstance(size, int) else size))
    n = F.size(w) - size + 1
    found = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(text(i)) if hashed else text(i))
    none = F.expr(f"CAST(array() AS array<{'bigint' if hashed else 'string'}>)")
    return F.when(n > 0, F.array_distinct(found)).otherwise(none)


def required(k: int, threshold: float, miss: float = MISS) -> int:
    """The most samples out of ``k`` that a candidate can be asked for, so that a true one fails with chance ``miss`` at most."""
    below, m = 0.0, 0
    while m < k:
        below += math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def item_samples(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, n, need, i, hash): MinHash samples of items whose ``shingles`` number ``n``.

    Items of up to HASHES shingles keep all of them and need ``threshold`` of these; larger ones keep the least shingle
    under each of HASHES functions and need what ``required`` says.
    """
    small = F.col("n") <= HASHES
    every = items.where(small).select("item_id", "n", F.ceil(F.col("n") * threshold - 1e-9).alias("need"), F.posexplode("hashes").alias("i", "hash"))
    one = items.where(~small).select("item_id", "n", F.explode("hashes").alias("hash"))
    drawn = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))))
    least = drawn.groupBy("item_id", "n", "i").agg(F.min_by("hash", F.xxhash64("i", "hash")).alias("hash"))
    return every.unionByName(least.withColumn("need", F.lit(required(HASHES, threshold)).cast("long")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, _h, item_id, n_item, n_shared, containment): documents that hold at least ``threshold`` of an item's shingles.

    Shingles are distinct runs of five lower-case words.  An item of one to four words has one shingle, all its words, and is looked
    for among the runs of as many words of every document; items and documents without words are in no result.  ``_h`` is the
    hash of the row's text.  Whole copies of a row give one row; null texts
    are empty.  The benchmark is joined by shingle, so Spark broadcasts its samples only while their written size is below
    its limit.
    """
    source = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    items = source.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), shingles(F.col("w"), False).alias("shingles"), shingles(F.col("w"), True).alias("hashes"))
    items = written(items.withColumn("n", F.size("shingles").cast("long")).withColumn("item_key", F.monotonically_increasing_id()), "items").where("n > 0")
    # the word numbers of short items: at most four values
    short = sorted(r.size for r in items.where(F.col("size") < SHINGLE).select("size").distinct().collect())
    named = items.drop("item_id").withColumnRenamed("item_key", "item_id")
    samples = written(item_samples(named, threshold), "samples")
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    every = F.array_distinct(F.concat(*[runs(F.col("w"), k, True) for k in (*short, SHINGLE)])) if short else runs(F.col("w"), SHINGLE, True)
    held = rows.select("_d", "_h", "id", every.alias("hashes"))
    probes = held.select("_d", "_h", F.size("hashes").alias("size"), F.explode_outer("hashes").alias("hash"))
    # explode_outer and the aggregate below keep Spark from pushing a filter under the projections, where the words would be
    # split again for every shingle; the join: the partitions that a document's size admits
    met = probes.join(samples, "hash").where(F.col("size") >= F.ceil(F.col("n") * threshold - 1e-9))
    counted = met.groupBy("_d", "_h", "item_id").agg(F.countDistinct("i").alias("hits"), F.max("need").alias("need"))
    pairs = written(counted.where("hits >= need").select("_d", "_h", F.col("item_id").alias("item_key")), "candidates")
    known = pairs.join(items.select("item_key", "item_id", F.col("size").alias("item_size"), "shingles", "n"), "item_key")
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = keyed.join(known, ["_d", "_h"]).withColumn("w", words(F.col("text"))).withColumn("own", runs(F.col("w"), F.col("item_size"), False))
    shared = F.size(F.array_intersect("own", "shingles")).cast("long")
    found = both.select("id", "_h", "item_id", F.col("n").alias("n_item"), shared.alias("shared"))
    found = found.groupBy("id", "_h", "item_id", "n_item").agg(F.max("shared").alias("n_shared"))
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)
    return found.withColumnRenamed("id", id_col)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row (id, item_id, n_item, n_shared, containment) per id and item; of several texts with an id the fullest."""
    found = contaminated(docs, benchmark, id_col, **options)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("m")
    return found.groupBy(id_col, "item_id").agg(best).select(id_col, "item_id", "m.n_item", "m.n_shared", "m.containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns as they were."""
    found = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("_id"), F.col("_h").alias("_text")).distinct()
    gone = written(found, "contaminated")
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (text == gone["_text"]), "left_anti")
