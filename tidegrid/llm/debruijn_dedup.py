"""Substring dedup (operator 7): De Bruijn compaction of token k-mers.

A window of K words is an edge from its first K - 1 words to its last K - 1.  Edges of runs that share an anchor (see
``repeats``) are counted; repeated ones are joined back to where they stand, and edges that follow each other without a
branch compact into paths.  An edge is named by the rolling hash of its words and by a digest that is taken from the words
at its source coordinates, so no two different windows pass as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import rolling
from tidegrid.llm.common import Scratch
from tidegrid.llm.repeats import Words, keyed, repeated_runs, run_contents, without_spans

WINDOW = 35
GRAM = 8
EDGE = "key long, digest long, w int, edge long, proof long, prev long, next long"
#: Edges of an Arrow batch.
BATCH = 20_000


def edge_batches(window: int):
    """Edges of a text's runs; the neighbours of an edge are known inside its run only."""

    def make(seq: Words, runs: list[dict]):
        prefix = rolling.prefix_hashes(seq.symbols())
        held, size = [], 0
        for r in runs:
            starts = np.arange(r["first"], r["first"] + r["n"])
            edge = rolling.mixed(rolling.span_hashes(prefix, starts, starts + window)).view(np.int64)
            proof = np.frombuffer(b"".join([hashlib.blake2b(seq.content(i, i + window), digest_size=8).digest() for i in starts.tolist()]), np.int64)
            held.append((np.full(len(edge), r["key"]), np.full(len(edge), r["digest"]), np.arange(len(edge), dtype=np.int32), edge, proof, np.roll(edge, 1), np.roll(edge, -1), np.arange(len(edge)) == 0, np.arange(len(edge)) == len(edge) - 1))
            size += len(edge)
            if size >= BATCH:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return make


def _batch(held: list[tuple]) -> pa.RecordBatch:
    key, digest, w, edge, proof, prev, after, first, last = (np.concatenate(c) for c in zip(*held, strict=True))
    columns = [pa.array(c) for c in (key, digest, w, edge, proof)] + [pa.array(prev, mask=first), pa.array(after, mask=last)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "digest", "w", "edge", "proof", "prev", "next"])


def repeated_paths(edges: DataFrame) -> DataFrame:
    """(key, digest, a, b, edge): nonbranching paths of repeated edges, at every place where they stand, with their first edge.

    Degrees come from one aggregate with map-side combine.  A path ends where its edges' places disagree about the next edge
    or the one before, or where one of the places ends.  Paths are numbered inside a run, which has few edges.
    """
    same = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    degrees = edges.groupBy("edge", "proof").agg(F.count("*").alias("times"), same("prev").alias("one_in"), same("next").alias("one_out")).where("times > 1")
    placed = edges.join(degrees, ["edge", "proof"]).select("key", "digest", "w", "edge", F.coalesce("one_in", F.lit(False)).alias("one_in"), F.coalesce("one_out", F.lit(False)).alias("one_out"))
    run = Window.partitionBy("key", "digest").orderBy("w")
    goes_on = (F.lag("w").over(run) == F.col("w") - 1) & F.lag("one_out").over(run) & F.col("one_in")
    numbered = placed.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("path", F.sum("new").over(run))
    paths = numbered.groupBy("key", "digest", "path").agg(F.min("w").alias("a"), (F.max("w") + 1).alias("b"), F.min_by("edge", "w").alias("edge"))
    return paths.select("key", "digest", "a", "b", "edge")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining words).

    Words are runs of other characters than white space, unchanged.  Every word that is covered by a ``window``-word sequence
    which also starts anywhere else in the input goes; windows do not cross texts and are judged on the input.  The rest is
    joined by single spaces.  Null texts have no words; whole copies of a row are copies like any other; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    places, runs = repeated_runs(rows, Words, window, gram, scratch)
    shared = runs.where("sharers > 1")
    edges = scratch.write(run_contents(rows, shared, edge_batches(window), Words, EDGE), "edges")
    whole = runs.where("copies > 1").select("key", "digest", F.lit(0).alias("a"), F.col("n").alias("b"))
    ranges = scratch.write(whole.unionByName(repeated_paths(edges).drop("edge")), "ranges")
    scratch.drop(edges)
    found = without_spans(rows, places, ranges, Words, window, with_text)
    names = [F.col("id").alias(id_col), F.col("size").alias("n_words"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), "kept_sha256"]
    return found.select(*names, *(["kept"] if with_text else []))
