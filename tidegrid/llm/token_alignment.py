"""Cross-tokenizer alignment (operator 11): two tokenizers over every distinct text, aligned by common byte ends.

Rows are shuffled by their full text, so each distinct text is tokenised and aligned once.  Texts are cut at single spaces that
no token of either vocabulary crosses; the cuts of a batch are encoded once each, and all that a text needs is a sum over its
cuts.  Texts of a task form blocks with one list of their distinct id pairs, so that the corpus-wide counts come back once per
block and pair, not once per text.  The measures are joined to the rows by the SHA-256 of the text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, packed_numbers, ragged, unpacked_numbers

#: Characters of text that are cut and aligned together (so fewer than 2**19 cuts); longer texts are taken in parts that end at a cut.
BATCH_CHARACTERS = 1_000_000
#: Cuts that a worker remembers, and their characters; beyond either it forgets all of them.
CACHE, CACHE_CHARACTERS = 200_000, 16_000_000
#: (text, pair) entries of a block; it ends with the batch that reaches them.
BLOCK_ENTRIES = 4_000_000
#: Pairs of one row of a block's list.
ROW_PAIRS = 50_000
#: A pair is one long: the A id above these bits, the B id below; a cut or text of a batch above twice as many.
SHIFT = 22
SPACE_SYMBOL = "▁"
#: A space that begins a token in both vocabularies: another character before it, no white space behind it.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: How byte-level files split a text before merging (fixed value).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Aligned:
    """What is known of every cut, by its number: sizes, the written groups, and links as pairs with their times."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.characters = 0
        none = np.zeros(0, np.int64)
        self.sums = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.first, self.size, self.pairs, self.times = none, none, none, none
        self.groups: list[str] = []


class Aligner:
    """Both tokenizers, and the alignment of the cuts that a worker has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = _byte_of_character()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(of.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SYMBOL, " ").encode() for i, p in enumerate(pieces)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        before = spec.get("pre_tokenizer") or {}
        words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        crossing = any(SPACE_SYMBOL in p.lstrip(SPACE_SYMBOL) for p in pieces)
        #: whether texts may be cut at all
        self.safe = words and not crossing
        self.joint = self._ranked(spec) if self.safe else None
        self.known = Aligned()

    def cuts(self, text: str) -> list[str]:
        if not self.safe:
            return [text]
        if "  " in text or text[:1] == " " or text[-1:] == " " or not text.isprintable():
            return CUT.split(text)
        # printable text has no white space but single spaces
        return text.split(" ")

    def _ranked(self, spec: dict):
        """A's vocabulary as ranks, which encodes many cuts in one call; None if its merges are not in the order of their ids."""
        import tiktoken

        vocabulary, merged = spec["model"]["vocab"], []
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            merged.append(vocabulary[left + right])
        special = {x["id"] for x in spec.get("added_tokens", [])}
        ranks = {b: i for i, b in enumerate(self.bytes_a) if i not in special}
        first = [i for i, b in enumerate(self.bytes_a) if len(b) == 1]
        ordered = merged == sorted(merged) and len(first) == 256 and len(ranks) == 256 + len(merged) and max(first) < min(merged, default=256)
        return tiktoken.Encoding("joint", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens and the tokens of every text, a space in front: of A, then of B."""
        flat = lambda x: np.fromiter(itertools.chain.from_iterable(x), np.int64)
        sizes = lambda x: np.fromiter(map(len, x), np.int64, len(x))
        n_a, a = self._joined(texts) if self.joint else (None, None)
        if n_a is None:
            ids = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
            n_a, a = sizes(ids), flat(ids)
        b = self.b.encode(texts, num_threads=1)
        return n_a, a, sizes(b), flat(b)

    def _joined(self, texts: list[str]):
        """A's tokens of cuts, in one call for those that neither begin nor end with white space: between them a token ends."""
        plain = np.fromiter((bool(t) and not t[0].isspace() and not t[-1].isspace() for t in texts), bool, len(texts))
        own = {i: self.a.encode(" " + texts[i], add_special_tokens=False).ids for i in np.flatnonzero(~plain).tolist()}
        regular = [" " + t for t, ok in zip(texts, plain.tolist(), strict=True) if ok]
        ids = np.array(self.joint.encode_ordinary("".join(regular)), np.int64)
        wanted = np.cumsum(np.fromiter((len(t.encode()) for t in regular), np.int64, len(regular)))
        ends = np.cumsum(self.length_a[ids])
        at = np.searchsorted(ends, wanted)
        if len(regular) and (at[-1] >= len(ends) or (ends[at] != wanted).any()):
            return None, None
        n_a = np.zeros(len(texts), np.int64)
        n_a[plain] = np.diff(at, prepend=-1)
        if not own:
            return n_a, ids
        parts = np.split(ids, np.cumsum(n_a)[:-1])
        for i, x in own.items():
            parts[i], n_a[i] = np.array(x, np.int64), len(x)
        return n_a, np.concatenate(parts)

    def learn(self, new: list[str]) -> None:
        """Align cuts that are not known yet."""
        known = self.known
        n_a, a, n_b, b = self.encoded(new)
        good = self._spelled(new, n_a, a, n_b, b)
        # cuts whose tokens do not spell them are left out of the alignment
        a, n_a = a[np.repeat(good, n_a)], np.where(good, n_a, 0)
        b, n_b = b[np.repeat(good, n_b)], np.where(good, n_b, 0)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        k, l = np.bincount(in_a, minlength=len(ends)), np.bincount(in_b, minlength=len(ends))
        first_a, first_b = np.cumsum(k) - k, np.cumsum(l) - l
        # the cut of every group: a cut's own tokens end where it ends
        owner = np.repeat(np.arange(len(new)), n_a)[first_a] if len(ends) else np.zeros(0, np.int64)
        links = np.bincount(owner, k * l, len(new)).astype(np.int64)
        sums = np.stack([n_a, n_b, np.bincount(owner, minlength=len(new)), links], 1).astype(np.int64)
        text = self._written(a, b, k, l, owner, len(new))
        pair, times, of = self._pairs(a, b, k, l, first_a, first_b, owner)
        size = np.bincount(of, minlength=len(new))
        known.first = np.concatenate([known.first, len(known.pairs) + np.cumsum(size) - size])
        known.size = np.concatenate([known.size, size])
        known.pairs = np.concatenate([known.pairs, pair])
        known.times = np.concatenate([known.times, times])
        known.sums = np.concatenate([known.sums, sums])
        known.good = np.concatenate([known.good, good])
        known.groups += text
        known.numbers.update(zip(new, range(len(known.numbers), len(known.numbers) + len(new)), strict=True))
        known.characters += sum(map(len, new))

    def _spelled(self, new: list[str], n_a, a, n_b, b) -> np.ndarray:
        """Which cuts the tokens of both vocabularies spell."""
        spell = lambda table, ids: b"".join(map(table.__getitem__, ids.tolist()))
        wanted = [b" " + t.encode() for t in new]
        all_wanted = b"".join(wanted)
        if spell(self.bytes_a, a) == all_wanted == spell(self.bytes_b, b):
            ends = np.cumsum(np.fromiter(map(len, wanted), np.int64, len(new)))
            reached = lambda length, ids, n: np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(n)]
            if (reached(self.length_a, a, n_a) == ends).all() and (reached(self.length_b, b, n_b) == ends).all():
                return np.ones(len(new), bool)
        a, b = np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])
        return np.array([spell(self.bytes_a, x) == w == spell(self.bytes_b, y) for w, x, y in zip(wanted, a, b, strict=True)])

    @staticmethod
    def _written(a, b, k, l, owner, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every cut."""
        a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        out, i, j = [[] for _ in range(n)], 0, 0
        for x, y, o in zip(k.tolist(), l.tolist(), owner.tolist(), strict=True):
            out[o].append(f"{a[i] if x == 1 else ','.join(a[i : i + x])}|{b[j] if y == 1 else ','.join(b[j : j + y])}")
            i, j = i + x, j + y
        return [";".join(x) for x in out]

    @staticmethod
    def _pairs(a, b, k, l, first_a, first_b, owner):
        """Pairs, how often each is linked in a cut, and that cut; a group of many tokens is counted by its distinct ids."""
        single = k * l <= 64
        group = np.repeat(np.flatnonzero(single), (k * l)[single])
        at = ragged(np.arange(int((k * l).max(initial=0))), np.zeros(int(single.sum()), np.int64), (k * l)[single])
        pair = (a[first_a[group] + at // l[group]] << SHIFT) | b[first_b[group] + at % l[group]]
        of, times = owner[group], np.ones(len(pair), np.int64)
        extra = []
        for g in np.flatnonzero(~single).tolist():
            ids_a = Counter(a[first_a[g] : first_a[g] + k[g]].tolist())
            ids_b = Counter(b[first_b[g] : first_b[g] + l[g]].tolist())
            extra += [((x << SHIFT) | y, n * m, owner[g]) for x, n in ids_a.items() for y, m in ids_b.items()]
        if extra:
            more = np.array(extra, np.int64)
            pair, times, of = np.concatenate([pair, more[:, 0]]), np.concatenate([times, more[:, 1]]), np.concatenate([of, more[:, 2]])
        return _summed(of, pair, times)

    def batch(self, texts: list[str]):
        """Sums (n_a, n_b, n_groups, n_links), whether all cuts are spelled, their written groups, and entries (text, pair, times)."""
        parts = [self.cuts(t) for t in texts]
        distinct = dict.fromkeys(itertools.chain.from_iterable(parts))
        new = [x for x in distinct if x not in self.known.numbers]
        if len(self.known.numbers) + len(new) > CACHE or self.known.characters > CACHE_CHARACTERS:
            self.known, new = Aligned(), list(distinct)
        if new:
            self.learn(new)
        known = self.known
        numbers = np.fromiter(map(known.numbers.__getitem__, itertools.chain.from_iterable(parts)), np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(known.sums[numbers], starts)
        good = np.logical_and.reduceat(known.good[numbers], starts)
        written = list(map(known.groups.__getitem__, numbers.tolist()))
        groups = [";".join(written[i : i + n]) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        text = np.repeat(np.arange(len(texts)), sizes)
        of = np.repeat(text, known.size[numbers])
        pair = ragged(known.pairs, known.first[numbers], known.size[numbers])
        times = ragged(known.times, known.first[numbers], known.size[numbers])
        return sums, good, groups, _summed(of, pair, times)


def _summed(of: np.ndarray, pair: np.ndarray, times: np.ndarray):
    """Distinct (of, pair) with their summed times, in order: (pair, times, of)."""
    key = of << (2 * SHIFT) | pair
    order = np.argsort(key)
    key, times = key[order], times[order]
    if not len(key):
        return pair, times, of
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[new]
    return key & ((1 << (2 * SHIFT)) - 1), np.add.reduceat(times, new), key >> (2 * SHIFT)


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a worker, which keeps it from task to task."""
    return Aligner(path_a, path_b)


def _parts(texts: list[str], safe: bool):
    """Lists of (number, text or part of it): each of about BATCH_CHARACTERS; long texts are parted at cuts."""
    held, size = [], 0
    for n, text in enumerate(texts):
        at = 0
        while safe and len(text) - at > BATCH_CHARACTERS and (cut := CUT.search(text, at + BATCH_CHARACTERS)):
            yield [*held, (n, text[at : cut.start()])]
            held, size, at = [], 0, cut.end()
        held.append((n, text[at:]))
        size += len(text) - at
        if size >= BATCH_CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def measured(model: Aligner, texts: list[str]):
    """Sums (text by measure), digests of the groups ('' without tokens), and entries (pair, times, text) of a list of texts."""
    total = np.zeros((len(texts), 4), np.int64)
    good = np.ones(len(texts), bool)
    digests = [hashlib.sha256() for _ in texts]
    begun = [False] * len(texts)
    entries = []
    for part in _parts(texts, model.safe):
        numbers = np.array([n for n, _ in part])
        sums, spelled, groups, (pair, times, of) = model.batch([t for _, t in part])
        np.add.at(total, numbers, sums)
        np.logical_and.at(good, numbers, spelled)
        for n, written in zip(numbers.tolist(), groups, strict=True):
            digests[n].update(f"{';' if begun[n] else ''}{written}".encode())
            begun[n] = True
        entries.append((numbers[of] if len(of) else of, pair, times))
    of, pair, times = (np.concatenate([e[i] for e in entries]) if entries else np.zeros(0, np.int64) for i in range(3))
    pair, times, of = _summed(of[good[of]], pair[good[of]], times[good[of]])
    total[~good] = 0
    return total, [d.hexdigest() if g else "" for d, g in zip(digests, good.tolist(), strict=True)], (pair, times, of)


BLOCK = "kind int, block long, shas array<binary>, sums array<long>, digests array<string>, links binary, base int, pairs array<long>, counts array<long>"
TEXTS, PAIRS = 0, 1
ANSWER = "sha binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Block:
    """Texts that share a list of pairs."""

    def __init__(self, number: int):
        self.number, self.texts, self.entries = number, [], 0

    def add(self, shas, copies, total, digests, found) -> None:
        self.texts.append((shas, copies, total, digests, *found))
        self.entries += len(found[0])

    def _row(self, **values):
        columns = [pa.array([values.get(f.name)], f.type) for f in _ARROW]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    def rows(self):
        """The texts by batch, with their links as numbers of pairs; the block's pairs with the documents that hold each."""
        pairs = np.unique(np.concatenate([t[4] for t in self.texts]))
        held = np.zeros(len(pairs), np.int64)
        for shas, copies, total, digests, pair, times, of in self.texts:
            at = np.searchsorted(pairs, pair)
            np.add.at(held, at, copies[of])
            n = np.bincount(of, minlength=len(shas))
            step = np.diff(at, prepend=0)
            step[(np.cumsum(n) - n)[n > 0]] = at[(np.cumsum(n) - n)[n > 0]]
            links = packed_numbers(np.concatenate([n, step, times]))
            yield self._row(kind=TEXTS, block=self.number, shas=shas, sums=total.ravel(), digests=digests, links=links)
        for i in range(0, len(pairs), ROW_PAIRS):
            part = slice(i, i + ROW_PAIRS)
            yield self._row(kind=PAIRS, block=self.number, base=i, pairs=pairs[part], counts=held[part])


_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shas", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("links", pa.binary()), ("base", pa.int32()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def aligned_blocks(distinct: DataFrame, path_a: str, path_b: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Blocks of the distinct ``text`` with their ``copies``: rows of texts and rows of pairs."""

    def run(batches):
        model, block = aligner(path_a, path_b), None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = block or _Block(TaskContext.get().partitionId() << 20)
            texts = batch.column(0).to_pylist()
            shas = [hashlib.sha256(t.encode()).digest() for t in texts]
            block.add(shas, batch.column(1).to_numpy(), *measured(model, texts))
            if block.entries >= block_entries:
                yield from block.rows()
                block = _Block(block.number + 1)
        if block and block.texts:
            yield from block.rows()

    return distinct.select("text", "copies").mapInArrow(run, BLOCK)


def _answered(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Best links and summed counts of a block's texts."""
    at = found["at"].to_numpy()
    count, best = np.zeros(int(at.max(initial=-1)) + 1, np.int64), np.zeros(int(at.max(initial=-1)) + 1, bool)
    count[at], best[at] = found["count"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
    shas, digests, sums = [], [], []
    for row in zip(texts["shas"].to_pylist(), texts["digests"].to_pylist(), texts["sums"].to_pylist(), texts["links"].to_pylist(), strict=True):
        names, written, total, links = row
        numbers = unpacked_numbers(links)
        n, rest = numbers[: len(names)], numbers[len(names) :]
        step, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        of, run = np.repeat(np.arange(len(names)), n), np.cumsum(step)
        # steps are counted from the start of each text
        before = np.concatenate([[0], run])[np.cumsum(n) - n]
        pair = run - np.repeat(before, n)
        whole = np.zeros((len(names), 2), np.int64)
        np.add.at(whole[:, 0], of, np.where(best[pair], times, 0))
        np.add.at(whole[:, 1], of, count[pair] * times)
        shas += names
        digests += written
        sums.append(np.concatenate([np.array(total, np.int64).reshape(-1, 4), whole], 1))
    table = np.concatenate(sums) if sums else np.zeros((0, 6), np.int64)
    columns = [pa.array(shas, pa.binary()), *[pa.array(table[:, i]) for i in range(6)], pa.array(digests, pa.string())]
    return pa.table(columns, names=["sha", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold a pair linked, and whether that is the most of its A id.

    The pairs of an A id are at most as many as B has ids.
    """
    held = blocks.where(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def align_tokens(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level ``tokenizers`` file) encodes a space and the text, B (a SentencePiece model) the text; special strings are
    plain text.  Null and empty texts, and texts that the tokens of A or B do not spell, have zeros and an empty digest.  Copies
    count as documents of their own, also whole copies of a row.  Null ids and other columns are no matter; an empty table
    gives no rows.  Memory follows the longest run of text without a cut, and the distinct pairs of a block.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = scratch.write(aligned_blocks(distinct, path_a, path_b, block_entries), "aligned")
    counts = scratch.write(pair_counts(blocks), "pair_counts")
    listed = blocks.where(F.col("kind") == PAIRS).select("block", "base", F.posexplode("pairs").alias("p", "pair"))
    asked = listed.select("block", (F.col("base") + F.col("p")).alias("at"), "pair")
    found = asked.join(counts, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    texts = blocks.where(F.col("kind") == TEXTS).select("block", "shas", "sums", "digests", "links")
    measures = scratch.write(texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_answered, ANSWER), "measures")
    scratch.drop(blocks)
    named = rows.select("id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("sha"))
    joined = named.join(measures, "sha", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select(F.col("id").alias(id_col), *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
