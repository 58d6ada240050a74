"""Exact dedup (operator 10): Golomb-coded fingerprint exchange.

Every row gets a fingerprint of its normalised text.  Blocks of rows send their sorted fingerprints, Rice-coded, to the
owners of fingerprint ranges; owners send back one bit per fingerprint that occurs more than once; only the suspects'
texts are shuffled and compared byte for byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import SPACE, unused, written

#: Fingerprints of a message between a block and an owner, on average: blocks and owners grow with the root of the rows.
MESSAGE = 64
#: Bits of a fingerprint beyond those needed to number the rows: one in 2**16 unique rows is suspected in vain.
SLACK_BITS = 16


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Rice code (Golomb with a power of two) of sorted distinct unsigned values: (parameter, bytes)."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(float(values[-1]) / len(values)).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    return k, np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def golomb_decode(n: int, k: int, data: bytes) -> np.ndarray:
    """The ``n`` values that ``golomb_encode`` wrote."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    stops = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(stops, prepend=-1) - 1
    low = bits[stops[-1] + 1 : stops[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _block_hashes(fp: pa.ChunkedArray, owners: int, bits: int):
    """Sorted distinct short fingerprints of a block, whether each repeats in it, its row's place, and its owner."""
    short = fp.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
    values, place, count = np.unique(short, return_inverse=True, return_counts=True)
    owner = (values.astype(np.float64) * (owners / 2.0**bits)).astype(np.int64)
    return values, place, count > 1, np.minimum(owner, owners - 1)


def _send(owners: int, bits: int):
    def send(block: pa.Table) -> pa.Table:
        values, _, repeated, owner = _block_hashes(block["fp"], owners, bits)
        out = {"block": [], "owner": [], "n": [], "k": [], "hashes": [], "repeated": []}
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):
            k, data = golomb_encode(values[a:b])
            row = (block["block"][0].as_py(), int(owner[a]), int(b - a), k, data, np.packbits(repeated[a:b]).tobytes())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("hashes", pa.binary()), ("repeated", pa.binary())]))

    return send


def _answer(messages: pa.Table) -> pa.Table:
    """For every message of an owner, one bit per fingerprint: it occurs in another row too."""
    sizes = messages["n"].to_pylist()
    coded = zip(sizes, messages["k"].to_pylist(), messages["hashes"].to_pylist(), strict=True)
    values = np.concatenate([golomb_decode(n, k, data) for n, k, data in coded])
    flags = [np.unpackbits(np.frombuffer(x, np.uint8))[:n] for n, x in zip(sizes, messages["repeated"].to_pylist(), strict=True)]
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    hit = (count[place] > 1) | (np.concatenate(flags) > 0)
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    return pa.table({"block": messages["block"], "owner": messages["owner"], "bitmap": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _suspects(owners: int, bits: int):
    def suspects(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.drop_columns("block")
        values, place, _, owner = _block_hashes(rows["fp"], owners, bits)
        sizes = np.bincount(owner, minlength=owners)
        by_owner = dict(zip(bitmaps["owner"].to_pylist(), bitmaps["bitmap"].to_pylist(), strict=True))
        hit = np.concatenate([np.unpackbits(np.frombuffer(by_owner[o], np.uint8))[: sizes[o]] for o in np.flatnonzero(sizes)])
        return rows.drop_columns("block").filter(pa.array(hit[place] > 0))

    return suspects


def normalised(text_col: str) -> F.Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def fingerprint_suspects(rows: DataFrame) -> DataFrame:
    """Rows (with a long ``fp``) whose fingerprint may occur in another row, found by the exchange alone.

    No row whose ``fp`` occurs twice is missed; about one unique row in 2**SLACK_BITS is named in vain.
    """
    n = rows.count()
    bits = min(64, max(1, n).bit_length() + SLACK_BITS)
    parts = max(1, math.ceil(math.sqrt(n / MESSAGE)))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    sent = "block long, owner long, n int, k int, hashes binary, repeated binary"
    messages = blocks.groupBy("block").applyInArrow(_send(parts, bits), sent)
    answers = messages.groupBy("owner").applyInArrow(_answer, "block long, owner long, bitmap binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_suspects(parts, bits), rows.schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (hex, of the normalised text).

    Texts are equal when they are the same after each white-space run became one space; a null text counts as empty.
    The smallest id of equal texts stays (null ids come last; of rows with the same id and text one stays).  Other
    columns are ignored; an empty table gives an empty result.
    """
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    suspects = written(fingerprint_suspects(rows), "suspects")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first")
    groups = suspects.groupBy("sha").agg(first, F.count("*").alias("n"))
    ids = suspects.select(F.col("id").alias("_id")).distinct()
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["_id"]), "left_semi").select(text.alias("_text"))
    same = texts.groupBy("_text").agg(F.count("*").alias("same")).select(F.unhex(F.sha2("_text", 256)).alias("sha"), "same")
    equal = groups.where("n > 1").join(same, "sha").where("n = same").select("sha", "first", "n")
    found = rows.join(equal, "sha", "left")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep, all columns as they were.

    Of rows with the same id and the same normalised text any one stays.
    """
    found = written(exact_dedup(docs, id_col, text_col), "copies")
    key = [F.col(id_col).alias("_id"), F.col("text_sha256").alias("_text")]
    go, stay = found.where("NOT kept").select(*key).distinct(), found.where("kept").select(*key)
    sha = unused(docs, "_sha")
    marked = docs.withColumn(sha, F.sha2(normalised(text_col), 256))

    def same(left, left_sha, right):
        return left.eqNullSafe(right["_id"]) & (left_sha == right["_text"])

    twice = written(go.join(stay, same(go["_id"], go["_text"], stay), "left_semi"), "twice")
    once = marked.join(go, same(marked[id_col], marked[sha], go), "left_anti")
    again = marked.join(twice, same(marked[id_col], marked[sha], twice), "left_semi").dropDuplicates([id_col, sha])
    return once.unionByName(again).drop(sha)
