"""Shared frame of the two substring operators: which windows of a corpus may repeat, and the removal of their spans.

Every text is cut into runs of windows with one anchor (``rolling``).  Equal windows lie in runs with equal anchor hashes,
so only runs whose hash occurs twice matter.  A run that occurs twice as a whole is settled by counting.  What is left are
distinct runs that share an anchor: their windows are compared by the operators.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import rolling
from tidegrid.llm.common import Scratch, row_key

RUN = "key long, digest long, first int, n int, anchor int"


class Bytes:
    """A text as its UTF-8 bytes."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    def __len__(self) -> int:
        return len(self.text)

    def symbols(self) -> np.ndarray:
        return rolling.byte_symbols(self.text)

    def content(self, start: int, end: int) -> bytes:
        return self.text[start:end]

    def kept(self, gone: np.ndarray) -> bytes:
        return np.frombuffer(self.text, np.uint8)[~gone].tobytes()


class Words:
    """A text as its words; their content is joined by single spaces."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.starts, self.ends = rolling.word_spans(self.text)
        self.joined = b" ".join(self.text.split())
        self.at = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def symbols(self) -> np.ndarray:
        return rolling.word_symbols(self.text, self.starts, self.ends)

    def content(self, start: int, end: int) -> bytes:
        return self.joined[self.at[start] : self.at[end] - 1]

    def kept(self, gone: np.ndarray) -> bytes:
        words = self.joined.split(b" ") if len(self) else []
        return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def digest64(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=8).digest()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _h, id, text): key of the row, its id, its text as bytes."""
    return docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def text_runs(rows: DataFrame, kind: type, window: int, gram: int) -> DataFrame:
    """Every run of every text: _d, _h, key (of the anchor), digest (of the content), first window, n windows, anchor's place."""

    def run(batches):
        for batch in batches:
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i, text in enumerate(batch.column(2)):
                seq = kind(text.as_py())
                if len(seq) < window:
                    continue
                first, past, place, key = rolling.window_runs(seq.symbols(), window, gram)
                digests = b"".join([digest64(seq.content(a, b)) for a, b in zip(first.tolist(), (past + window - 1).tolist(), strict=True)])
                parts.append((np.full(len(first), d[i]), np.full(len(first), h[i]), key.view(np.int64), np.frombuffer(digests, np.int64), first, past - first, place - first))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t, copy=False)) for c, t in zip(columns, [np.int64] * 4 + [np.int32] * 3, strict=True)], names=["_d", "_h", "key", "digest", "first", "n", "anchor"])

    return rows.select("_d", "_h", "text").mapInArrow(run, f"_d long, _h long, {RUN}")


def repeated_runs(rows: DataFrame, kind: type, window: int, gram: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(places, runs): where runs with a repeated anchor hash stand, and the distinct ones among them.

    ``runs`` has copies (how often the run stands anywhere), sharers (distinct runs with its anchor hash) and one place.
    """
    found = scratch.write(text_runs(rows, kind, window, gram), "runs")
    # a written side: a join with an aggregate on the same key could not split the rows of a hot key
    often = scratch.write(found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "often")
    places = scratch.write(found.join(often, "key"), "places")
    scratch.drop(found)
    scratch.drop(often)
    one = places.groupBy("key", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("_d", "_h", "first")).alias("at"), F.first("n").alias("n"), F.first("anchor").alias("anchor")
    )
    distinct = scratch.write(one.select("key", "digest", "copies", "n", "anchor", "at.*"), "distinct")
    sharers = scratch.write(distinct.groupBy("key").agg(F.count("*").alias("sharers")), "sharers")
    return places, distinct.join(sharers, "key")


def run_contents(rows: DataFrame, runs: DataFrame, make: Callable, kind: type, schema: str) -> DataFrame:
    """``make(sequence, runs)`` yields batches of ``schema`` for the ``runs`` of a text, which is read once for all of them."""
    by_text = runs.groupBy("_d", "_h").agg(F.collect_list(F.struct("key", "digest", "first", "n", "anchor", "sharers")).alias("runs"))

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                yield from make(kind(text.as_py()), wanted.as_py())

    return rows.select("_d", "_h", "text").join(by_text, ["_d", "_h"]).select("text", "runs").mapInArrow(run, schema)


def without_spans(rows: DataFrame, places: DataFrame, ranges: DataFrame, kind: type, window: int, with_text: bool = False) -> DataFrame:
    """Take out what repeated windows cover: id, size, removed, spans (maximal removed runs), sha256 of the rest[, the rest].

    ``ranges`` has (key, digest, a, b): of the run's windows, those from ``a`` to before ``b`` repeat.
    """
    spans = places.join(ranges, ["key", "digest"]).select("_d", "_h", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + F.lit(window - 1)).alias("b"))
    by_text = spans.groupBy("_d", "_h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = rows.join(by_text, ["_d", "_h"], "left").select("id", "text", "spans")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, size long, removed long, spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                seq = kind(text.as_py())
                change = np.zeros(len(seq) + 1, np.int64)
                for s in found.as_py() or []:
                    change[s["a"]] += 1
                    change[s["b"]] -= 1
                gone = np.cumsum(change)[:-1] > 0
                rest = seq.kept(gone)
                starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out.append((len(seq), int(gone.sum()), starts, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
            names = ["id", "size", "removed", "spans", "kept_sha256", "kept"]
            columns = [batch.column(0), *map(pa.array, zip(*out, strict=True))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return joined.mapInArrow(run, schema)
