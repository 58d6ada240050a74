"""SentencePiece encoding and decoding (operator 9): a relational lattice and a Viterbi fold.

Texts are cut into units that no piece of the vocabulary crosses: at spaces, and between characters that no chain of pieces joins
(letters and marks, in most models).  Of the distinct units all substrings of bounded length are
exploded and equi-joined to the piece table; the matches of a unit are the edges of its lattice, grouped back and folded to
the best path, many units at once.  Longer units, which nothing cuts either, are folded one character after another with back
pointers, in time and memory that follow their length.  Documents travel as numbers of units in block dictionaries, not as text.

The path has the largest sum of piece scores; of equal sums the one whose last piece is longer, seen from every place.  A BPE
model's own merge order can choose other pieces; decoding gives the same text.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidegrid.llm.common import Scratch, setting

#: The symbol that stands for a space, and the longest unit whose lattice is exploded.
SYMBOL = "▁"
MAX_UNIT = 256
#: Distinct units of a block dictionary and their characters: a block ends with the document that reaches either.
BLOCK_UNITS = 1_000_000
BLOCK_CHARACTERS = 32_000_000
#: Units and characters of one row of a dictionary, unless a unit is longer.
ROW_UNITS, ROW_CHARACTERS = 2000, 1_000_000
#: Distinct units whose lattices are in one task, and edges that are folded at once, unless a unit has more.
TASK_UNITS, FOLD_EDGES = 50_000, 500_000
#: An edge is one long: its end from bit END, its length from bit LENGTH, below it its id plus CODES; a character that is no
#: piece has minus one minus its code point for an id.
END, LENGTH, CODES = 48, 32, 1 << 21
#: The piece table is broadcast; a model with more pieces is refused.
MAX_PIECES = 1_000_000


def _classes(words: list[str]) -> list[set[str]]:
    """Classes of the characters that stand together in words, directly or through others; the largest first."""
    of: dict[str, set[str]] = {}
    for word in words:
        joined = set(word).union(*(of.get(c, ()) for c in word))
        of.update(dict.fromkeys(joined, joined))
    classes = {id(c): c for c in of.values()}.values()
    return sorted(classes, key=lambda c: (-len(c), min(c)))


class Pieces:
    """Vocabulary of a model file: surface pieces with ids and scores, byte pieces, and the units' pattern."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        if len(ids) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.rows = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in plain]
        self.longest = max(len(r[0]) for r in self.rows)
        self.lowest = min(r[2] for r in self.rows) - 10
        in_bytes = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        self.byte_ids = [in_bytes.get(f"<0x{b:02X}>", m.unk_id()) for b in range(256)]
        self.surface = {i: p.replace(SYMBOL, " ").encode() for p, i, _ in self.rows} | {i: bytes([int(p[1:-1], 16)]) for p, i in in_bytes.items()}
        # characters that pieces join, directly or through others, are one class; no piece has characters of two classes
        classes = _classes([p.replace(SYMBOL, "") for p, _, _ in self.rows if len(p) > 1])
        groups = ["".join(map(re.escape, sorted(c))) for c in classes]
        group = "".join(groups)
        # a symbol behind another character starts a unit; so does a character of another class or of no longer piece
        runs = "|".join(f"[{g}]+" for g in groups)
        self.pattern = f"{SYMBOL}*(?:{runs})|{SYMBOL}+|[^{group}{SYMBOL}]" if group else f"{SYMBOL}+|[^{SYMBOL}]"
        self.alone = f"[^{group}{SYMBOL} ]"
        # the largest class and all others
        self.borders = (groups[0], "".join(groups[1:])) if len(groups) > 1 else None
        self.splits = not any(SYMBOL in p.lstrip(SYMBOL) for p, _, _ in self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, id int, score double")


class Cutter:
    """Cuts texts, with a symbol in front and for every space, into the parts that are encoded each on its own."""

    def __init__(self, pieces_pattern: str | None, alone: str | None, borders: tuple[str, str] | None = None):
        self.pattern = re.compile(pieces_pattern, re.DOTALL) if pieces_pattern else None
        self.alone = re.compile(alone) if alone else None
        self.before = self.behind = None
        if borders and self.pattern:
            main, other = borders
            # borders between the largest class and the others; both look for a character of the others first
            self.before, self.behind = re.compile(f"[{other}](?<=[{main}][{other}])"), re.compile(f"[{other}](?=[{main}])")

    def parts(self, text: str) -> list[str]:
        if not self.pattern:
            return [SYMBOL + text.replace(" ", SYMBOL)]
        if "  " in text or SYMBOL in text or "\0" in text or text[:1] == " " or text[-1:] == " ":
            return self.pattern.findall(SYMBOL + text.replace(" ", SYMBOL))
        # the usual case, without the pattern: single spaces between words; characters of no longer piece stand alone
        marked = self.alone.sub("\0\\g<0>\0", text)
        if self.before:
            marked = self.behind.sub("\\g<0>\0", self.before.sub("\0\\g<0>", marked))
        marked = marked.replace(" ", f"\0{SYMBOL}")
        if "\0" not in marked:
            return [SYMBOL + marked]
        return list(filter(None, (SYMBOL + marked).split("\0")))


class Numbers(dict):
    """Numbers strings as they come, and counts their characters."""

    characters = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.characters += len(unit)
        return n


def units(text: str, cutter: Cutter) -> list[str]:
    """The parts of a text, however long, that are encoded each on its own; an empty text has none."""
    return cutter.parts(text) if text else []


#: Numbers below it are one byte; the others have a first byte that tells what is above their two lower ones.
FIRST = 240


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, most of them small, in streams of first, middle, low and high bytes, compressed."""
    small = numbers < FIRST
    rest = numbers[~small].astype(np.uint32)
    high = rest >> 16
    first = numbers.astype(np.uint8)
    first[~small] = FIRST + np.minimum(high, 255 - FIRST)
    streams = (first, (rest >> 8).astype(np.uint8), rest.astype(np.uint8), high[high >= 255 - FIRST].astype("<u2"))
    return len(first).to_bytes(4, "little") + zlib.compress(b"".join(x.tobytes() for x in streams), 4)


def _unpacked(data: bytes) -> np.ndarray:
    n, streams = int.from_bytes(data[:4], "little"), np.frombuffer(zlib.decompress(data[4:]), np.uint8)
    numbers = streams[:n].astype(np.uint32)
    large = np.flatnonzero(numbers >= FIRST)
    m = len(large)
    high = numbers[large] - FIRST
    high[high == 255 - FIRST] = np.frombuffer(streams[n + 2 * m :].tobytes(), "<u2")
    numbers[large] = high << 16 | streams[n : n + m].astype(np.uint32) << 8 | streams[n + m : n + 2 * m]
    return numbers


PARTS = "kind int, block long, ids array<{id}>, at binary, base int, units array<string>"
DOCUMENTS, UNITS = 0, 1
#: Bits of a number within a block: block and number are one long.
AT_BITS = 31


class _Block:
    """Documents whose units share a dictionary."""

    def __init__(self, number: int):
        self.number, self.known, self.batches = number, Numbers(), []

    def rows(self, kind: pa.DataType):
        """The documents by batch, and the dictionary; the most frequent units get the smallest numbers."""

        def row(what, ids=None, at=None, base=None, words=None):
            columns = [pa.array([what], pa.int32()), pa.array([self.number]), pa.array([ids], pa.list_(kind)), pa.array([at], pa.binary()), pa.array([base], pa.int32()), pa.array([words], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "block", "ids", "at", "base", "units"])

        count = np.zeros(len(self.known), np.int64)
        for _, _, numbers in self.batches:
            count += np.bincount(numbers, minlength=len(count))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        for ids, sizes, numbers in self.batches:
            yield row(DOCUMENTS, ids=ids, at=_packed(np.concatenate([sizes, rank[numbers]])))
        words, held, size = list(self.known), [], 0
        for k, i in enumerate(order.tolist(), 1):
            held.append(words[i])
            size += len(words[i])
            if len(held) == ROW_UNITS or size >= ROW_CHARACTERS or k == len(words):
                yield row(UNITS, base=k - len(held), words=held)
                held, size = [], 0


def block_parts(docs: DataFrame, pieces: Pieces, id_col: str, text_col: str, block_units: int = BLOCK_UNITS) -> DataFrame:
    """Documents of an Arrow batch as numbers of units, and rows with the ``units`` of a block, numbered from ``base``.

    ``at`` holds the number of units of each of the documents ``ids``, then the numbers themselves.
    """
    cuts = (pieces.pattern, pieces.alone, pieces.borders) if pieces.splits else (None, None)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = PARTS.format(id=rows.schema["id"].dataType.simpleString())

    def run(batches):
        cutter, block, kind = Cutter(*cuts), None, None
        for batch in batches:
            kind = batch.column(0).type
            block = block or _Block(TaskContext.get().partitionId() << 12)
            numbers, sizes = [], []
            for text in batch.column(1):
                parts = units(text.as_py(), cutter)
                numbers += map(block.known.__getitem__, parts)
                sizes.append(len(parts))
            if sizes:
                block.batches.append((batch.column(0).to_pylist(), np.array(sizes, np.uint32), np.array(numbers, np.uint32)))
            if len(block.known) >= block_units or block.known.characters >= BLOCK_CHARACTERS:
                yield from block.rows(kind)
                block = _Block(block.number + 1)
        if block:
            yield from block.rows(kind)

    return rows.mapInArrow(run, schema)


def best_path(unit: str, table: dict[str, tuple[int, float]], longest: int, lowest: float, byte_ids: list[int]) -> list[int]:
    """Ids of the best path of a unit of any length: its score and last edge are kept for every place."""
    n = len(unit)
    best, size, code = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for e in range(1, n + 1):
        c = unit[e - 1]
        i, s = table.get(c) or (-1 - ord(c), lowest)
        top, l, at = best[e - 1] + s, 1, i
        for k in range(2, min(longest, e) + 1):
            edge = table.get(unit[e - k : e])
            # of equal sums the longer last piece
            if edge and (total := best[e - k] + edge[1]) >= top:
                top, l, at = total, k, edge[0]
        best[e], size[e], code[e] = top, l, at
    out = []
    while n:
        out += [code[n]] if code[n] >= 0 else [byte_ids[b] for b in reversed(chr(-1 - code[n]).encode())]
        n -= size[n]
    return out[::-1]


def long_unit_ids(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) as in ``unit_ids``, for units of any length."""
    table, longest, lowest, byte_ids = {p: (i, s) for p, i, s in pieces.rows}, pieces.longest, pieces.lowest, pieces.byte_ids

    def run(batches):
        for batch in batches:
            for unit in batch.column(0):
                ids = best_path(unit.as_py(), table, longest, lowest, byte_ids)
                yield pa.RecordBatch.from_arrays([pa.array([unit.as_py()], pa.string()), pa.array([ids], pa.list_(pa.int32()))], names=["unit", "ids"])

    return distinct.mapInArrow(run, "unit string, ids array<int>")


def lattices(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, edges): the edges of every distinct ``unit`` (not empty, MAX_UNIT at most) by end and length, by explode, equi-join and grouping."""
    table = F.broadcast(pieces.table(distinct.sparkSession))
    n = F.char_length("unit")
    ends = distinct.select("unit", F.explode(F.sequence(F.lit(1), n)).alias("e"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("e"))))
    parts = ends.select("unit", "e", size.alias("l")).withColumn("piece", F.substr("unit", F.col("e") - F.col("l") + 1, F.col("l")))
    # a character that is no piece has an edge too
    edges = parts.join(table, "piece", "left").where("id IS NOT NULL OR l = 1")
    code = F.coalesce("id", -1 - F.ascii("piece")) + CODES
    place = F.shiftleft(F.col("e").cast("long"), END).bitwiseOR(F.shiftleft(F.col("l").cast("long"), LENGTH))
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list(place.bitwiseOR(code.cast("long")))).alias("edges"))


def best_paths(edges: np.ndarray, counts: np.ndarray, scores: np.ndarray, lowest: float, byte_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of the best paths of units that have ``counts`` of the ``edges`` each, by end and length.

    Edges of one end and length belong to different units and are taken together; of equal sums the longer last piece stays.
    """
    place, code = edges >> LENGTH, (edges & ((1 << LENGTH) - 1)) - CODES
    end, length = place >> (END - LENGTH), place & ((1 << (END - LENGTH)) - 1)
    n = end[np.cumsum(counts) - 1]
    base = np.cumsum(n + 1) - (n + 1)
    order = np.argsort(place, kind="stable")
    to = (np.repeat(base, counts) + end)[order]
    score = np.where(code < 0, lowest, scores[np.maximum(code, 0)])[order]
    best, back = np.full(int((n + 1).sum()), -np.inf), np.zeros(int((n + 1).sum()), np.int64)
    best[base] = 0
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = to[a:b]
        total = best[at - length[order[a]]] + score[a:b]
        better = total >= best[at]
        best[at[better]], back[at[better]] = total[better], order[a:b][better]
    unit, at, steps, size = np.arange(len(n)), base + n, [], np.zeros(len(n), np.int64)
    while len(unit):
        edge = back[at]
        steps.append((unit, code[edge]))
        size[unit] += 1
        at = at - length[edge]
        more = at > base[unit]
        unit, at = unit[more], at[more]
    ends = np.cumsum(size)
    ids = np.empty(int(size.sum()), np.int64)
    for k, (unit, codes) in enumerate(steps, 1):
        ids[ends[unit] - k] = codes
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return size, ids
    # characters that are no pieces become their bytes
    characters, which = np.unique(ids[odd], return_inverse=True)
    spelled = [[byte_ids[b] for b in chr(-1 - c).encode()] for c in characters.tolist()]
    lengths = np.array([len(x) for x in spelled])
    sizes, starts = np.ones(len(ids), np.int64), np.arange(len(ids))
    sizes[odd], starts[odd] = lengths[which], len(ids) + (np.cumsum(lengths) - lengths)[which]
    return np.add.reduceat(sizes, ends - size), _ragged(np.concatenate([ids, *spelled]), starts, sizes)


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``starts``, one behind another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


def _by_block(key: np.ndarray, size: np.ndarray, first: np.ndarray, ids: np.ndarray):
    """Encoded units, packed by block: count, steps between their numbers, sizes, ids."""
    order = np.argsort(key, kind="stable")
    block, at = key >> AT_BITS, key & ((1 << AT_BITS) - 1)
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    for part in np.split(order, cuts[1:]):
        numbers = np.concatenate([[len(part)], np.diff(at[part], prepend=0), size[part], _ragged(ids, first[part], size[part])])
        yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]]), pa.array([_packed(numbers)])], names=["block", "answer"])


def _lists(batches: list, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists."""
    lists = [b.column(column) for b in batches]
    return np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64), np.concatenate([x.flatten().to_numpy() for x in lists]).astype(np.int64)


def _answers(batches):
    """Units of a partition that are encoded already, one row per key, packed by block."""
    held = list(batches)
    if held:
        size, ids = _lists(held, 1)
        yield from _by_block(np.concatenate([b.column(0).to_numpy() for b in held]), size, np.cumsum(size) - size, ids)


def _folded(pieces: Pieces):
    """Units of a partition with the keys that ask for them and their edges: encoded, and packed by block."""
    scores = np.zeros(1 + max(i for _, i, _ in pieces.rows))
    for _, i, s in pieces.rows:
        scores[i] = s
    lowest, byte_ids = pieces.lowest, pieces.byte_ids

    def run(batches):
        keys, sizes, ids, held, edges = [], [], [], [], 0

        def fold():
            count, flat = _lists(held, 1)
            size, found = best_paths(flat, count, scores, lowest, byte_ids)
            keys.append(_lists(held, 0))
            sizes.append(size)
            ids.append(found.astype(np.int32))
            held.clear()

        for batch in batches:
            held.append(batch)
            edges += len(batch.column(1).flatten())
            if edges >= FOLD_EDGES:
                fold()
                edges = 0
        if edges:
            fold()
        if keys:
            asked, key = (np.concatenate(x) for x in zip(*keys, strict=True))
            size = np.concatenate(sizes)
            yield from _by_block(key, np.repeat(size, asked), np.repeat(np.cumsum(size) - size, asked), np.concatenate(ids))

    return run


def _assembled(surface: dict[int, bytes], kind: pa.DataType):
    """Ids of a block's documents, and the digest of the text that they decode to."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        places, sizes, flat = [none], [none], [none]
        for data in answers["answer"].to_pylist():
            numbers = _unpacked(data).astype(np.int64)
            n = numbers[0]
            places.append(np.cumsum(numbers[1 : n + 1]))
            sizes.append(numbers[n + 1 : 2 * n + 1])
            flat.append(numbers[2 * n + 1 :])
        place, size, ids = (np.concatenate(x) for x in (places, sizes, flat))
        ids = ids.astype(np.int32)
        first, length = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        first[place], length[place] = np.cumsum(size) - size, size
        # every unit is decoded once, from its ids
        own = list(map(surface.get, ids.tolist()))
        texts = [b""] * len(place)
        for k, a, b in zip(place.tolist(), (np.cumsum(size) - size).tolist(), np.cumsum(size).tolist(), strict=True):
            texts[k] = b"".join(filter(None, own[a:b]))
        del own, places, sizes, flat
        names, counts, found, digests = [], [none], [none.astype(np.int32)], []
        for names_here, data in zip(docs["ids"].to_pylist(), docs["at"].to_pylist(), strict=True):
            numbers = _unpacked(data).astype(np.int64)
            borders, at = np.concatenate([[0], np.cumsum(numbers[: len(names_here)])]), numbers[len(names_here) :]
            decoded_units = list(map(texts.__getitem__, at.tolist()))
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(_without_first_space(b"".join(decoded_units[a:b]))).hexdigest())
            names += names_here
            counts.append(np.diff(np.concatenate([[0], np.cumsum(length[at])])[borders]))
            found.append(_ragged(ids, first[at], length[at]))
        n, flat = np.concatenate(counts), pa.array(np.concatenate(found))
        del found, texts
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
        return pa.table({"id": pa.array(names, kind), "n_pieces": pa.array(n, pa.int64()), "ids": lists, "decoded_sha256": pa.array(digests, pa.string())})

    return run


def _without_first_space(text: bytes) -> bytes:
    return text[1:] if text[:1] == b" " else text


def decoded(ids: list[int], surface: dict[int, bytes]) -> bytes:
    """UTF-8 text of ids: pieces with spaces for the symbol, without the first one; ids that have no text are left out."""
    return _without_first_space(b"".join([surface.get(i, b"") for i in ids]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_units: int = BLOCK_UNITS) -> DataFrame:
    """One row per input row: id, n_pieces, ids, decoded_sha256 (of the text that the ids decode to).

    Null and empty texts have no pieces.  Decoding gives the text back, except that the space symbol itself comes back as a
    space, as in the library.  Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces, scratch = Pieces(path), Scratch(spark)
    parts = scratch.write(block_parts(docs, pieces, id_col, text_col, block_units), "parts", "kind")
    words = parts.where(F.col("kind") == UNITS)
    number = F.shiftleft("block", AT_BITS).bitwiseOR((F.col("base") + F.col("p")).cast("long"))
    asked = words.select("block", "base", F.posexplode("units").alias("p", "unit")).select(number.alias("key"), "unit")
    # a long unit counts as the units that its characters could be
    weight = F.aggregate("units", F.lit(0).cast("long"), lambda n, u: n + 1 + F.floor(F.char_length(u) / MAX_UNIT))
    longer = F.exists("units", lambda u: F.char_length(u) > MAX_UNIT)
    total, any_long = words.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.bool_or(longer), F.lit(False))).first()
    dealt = asked.repartition(max(1, math.ceil(total / TASK_UNITS)), "unit")
    # the key is asked for too, so that this is the same exchange as the join's other side
    distinct = dealt.groupBy("unit").agg(F.min("key").alias("k")).where("k >= 0").select("unit")
    short = F.char_length("unit") <= MAX_UNIT
    keys = dealt.where(short).groupBy("unit").agg(F.collect_list("key").alias("keys"))
    asking = keys.join(lattices(distinct.where(short), pieces).hint("shuffle_hash"), "unit").select("keys", "edges")
    # a task has a bounded number of units, whose edges fit in memory: no sort; shuffle files go as soon as their table is written
    in_memory = setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * TASK_UNITS))
    with in_memory, setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        packed = scratch.write(asking.mapInArrow(_folded(pieces), "block long, answer binary"), "answers")
    if any_long:
        # few and long: their ids are gathered by their numbers from a shuffle of their own
        found = long_unit_ids(distinct.where(~short), pieces)
        rest = dealt.where(~short).join(found, "unit").select("key", "ids")
        packed = packed.unionByName(scratch.write(rest.mapInArrow(_answers, "block long, answer binary"), "answers"))
    if total:
        scratch.drop(words, f"kind={UNITS}")
    rows = parts.where(F.col("kind") == DOCUMENTS).select("block", "ids", "at")
    id_type = docs.schema[id_col].dataType
    run = _assembled(pieces.surface, to_arrow_type(id_type))
    found = rows.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(run, f"id {id_type.simpleString()}, n_pieces long, ids array<int>, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every row's ids; null ids give a null text."""
    surface = Pieces(path).surface
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decoded(x, surface).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
