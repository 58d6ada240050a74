"""Language identification (operator 6): rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import written

#: n-grams of a profile, of a language or of a document.
PROFILE = 300
#: Characters whose n-grams are counted at once; longer texts are cut at the next space (or there, if there is none).
CHUNK = 500_000
#: Distinct (n-gram, count) entries that a training task holds before it merges them.
BUFFER = 1_000_000
UNKNOWN = "und"
SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _chunks(text: str):
    at = 0
    while len(text) - at > CHUNK:
        cut = text.find(" ", at + CHUNK)
        cut = at + CHUNK if cut < 0 or cut > at + 2 * CHUNK else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def _grams(text: str) -> np.ndarray:
    """Code of every 1-, 2- and 3-gram of the lower-cased words, which stand between single spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes = np.where(_letters()[codes], codes, SPACE)
    codes = np.concatenate([[SPACE], codes, [SPACE]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)])]
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    shift = np.uint64(21)
    pairs = (codes[:-1] << shift) | codes[1:]
    triples = ((pairs[:-1] << shift) | codes[2:])[codes[1:-1] != SPACE]
    return np.concatenate([codes[codes != SPACE], pairs, triples])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text, ascending, and their counts."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for chunk in _chunks(text or ""):
        found, n = np.unique(_grams(chunk), return_counts=True)
        grams, counts = _merged([(grams, counts), (found, n)]) if len(grams) else (found, n)
    return grams, counts


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if not len(counts):
        return grams
    most = counts.max()
    keys = (most - counts).astype(np.uint16) if most < 2**16 else most - counts
    return grams[np.argsort(keys, kind="stable")[:size]]


def language_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the ``size`` most frequent n-grams of every language, counted over all labelled rows.

    Rows without text or language are left out.  A task counts per language and sends distinct n-grams only.
    """

    def count(batches):
        held: dict[str, list] = {}
        entries = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = gram_counts(text)
                held.setdefault(lang, []).append(found)
                entries += len(found[0])
                if entries > BUFFER:
                    held = {k: [_merged(v)] for k, v in held.items()}
                    entries = sum(len(v[0][0]) for v in held.values()) // 2
        for lang, parts in held.items():
            grams, counts = _merged(parts)
            for at in range(0, len(grams), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams[part])), pa.array(grams[part].view(np.int64)), pa.array(counts[part])], names=["lang", "gram", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "rank", "gram")


class Profiles:
    """Profiles as one table: the known n-grams and, for every language, the rank of each (absent: the penalty)."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[2] for r in rows], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), self.langs.index(lang)] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ties go to the first name; ``und`` and 0 without letters."""
        top = ranked(*gram_counts(text), self.size)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        place = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[place] == top, place, len(self.grams))]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (len(top) * self.size))


def predict_language(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), size: int = PROFILE) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), and the columns named in ``keep``.

    Null texts and texts without a letter give ``und`` and score 0, as does an empty set of profiles.  The profiles
    (``size`` rows per language) are the model and go through the driver.
    """
    model = Profiles([(r.lang, r["rank"], r.gram) for r in profiles.collect()], size)

    def run(batches):
        for batch in batches:
            found = [model.nearest(x.as_py()) for x in batch.column("_text")]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=out.names)

    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    out = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, out)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: the CRC-32 of its id as text is 2 modulo 4 (null id: empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: id, held_out, lang_pred, score."""
    marked = docs.select(F.col(id_col), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"), held_out(id_col).alias("held_out"))
    profiles = language_profiles(marked.where("NOT held_out"), "_t", "_l")
    return predict_language(marked, profiles, id_col, "_t", keep=("held_out",))


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents whose language is ``und`` (no text or no letter); all columns as they were."""
    found = identify(docs, id_col, text_col, lang_col)
    gone = written(found.where(F.col("lang_pred") == UNKNOWN).select(F.col(id_col).alias("_id")).distinct(), "unknown")
    odd = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & odd, "left_anti")
