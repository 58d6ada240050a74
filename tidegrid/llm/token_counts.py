"""Token counts (operator 5): a library's tokenizer in Arrow functions that return lengths only.

Texts are cut at boundaries that no token of the vocabulary crosses; the distinct cuts of a byte-bounded batch are
encoded together and their lengths added up.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose cuts are encoded together.
BATCH_BYTES = 4_000_000
#: Lengths of cuts that a worker remembers; beyond that it forgets all of them.
CACHE = 300_000


class SentencePieceLengths:
    """Token counts of a SentencePiece BPE model.

    A space is safe to cut at if the character before it is neither a space nor the space symbol, provided that no piece
    holds the symbol after another character (checked when the model is loaded; if one does, texts stay whole).  The
    text behind the cut is encoded with the symbol that the model puts before every text.
    """

    SYMBOL = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(self.SYMBOL in p.lstrip(self.SYMBOL) for p in pieces)
        count = lambda x: len(self.model.encode(x))
        plain = all(count(f"a{' ' * i}b") == count("a") + count(" " * (i - 1) + "b") for i in (1, 2, 5))
        self.safe = not crossing and plain
        self.end = count("a ") - count("a")
        self.known: dict[str, int] = {}

    def cuts(self, text: str) -> list[str]:
        """Parts whose counts add up to the text's; an empty part behind the first stands for a space at the end."""
        if not self.safe:
            return [text]
        if "  " in text or self.SYMBOL in text or text[:1] == " ":
            return re.split(rf"(?<=[^ {self.SYMBOL}]) ", text)
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.cuts(x) for x in texts]
        new = [x for x in set().union(*parts) if x not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(set().union(*parts))
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        known = self.known
        return [sum(map(known.__getitem__, p)) + (self.end if len(p) > 1 and not p[-1] else 0) for p in parts]


class TokenizersLengths:
    """Token counts of a tokenizers file, texts whole; special strings are read as the library's default does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def lengths(path: str):
    return SentencePieceLengths(path) if path.endswith(".model") else TokenizersLengths(path)


def byte_batches(sizes: list[int], limit: int = BATCH_BYTES):
    """Slices (start, stop) of consecutive texts that hold at most ``limit`` bytes, or one text."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def long_parts(text: str, limit: int = BATCH_BYTES):
    """A text in parts of about ``limit`` characters, cut at single spaces between other characters."""
    at = 0
    while len(text) - at > limit:
        cut = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])").search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    No begin, end or added special tokens; null texts count as empty.  Other columns are ignored.
    """

    def run(batches):
        model = lengths(path)
        safe = getattr(model, "safe", False)
        for batch in batches:
            sizes, texts = batch.column(1).to_pylist(), batch.column(2)
            counted: list[int] = []
            for a, b in byte_batches(sizes):
                whole = texts.slice(a, b - a).to_pylist()
                if b - a == 1 and safe and sizes[a] > BATCH_BYTES:
                    counted.append(sum(model.counts([part])[0] for part in long_parts(whole[0])))
                else:
                    counted += model.counts(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counted, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
