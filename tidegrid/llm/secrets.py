"""Secret scans (operator 1): fixed patterns, and character Markov models compared by log-likelihood ratio.

Column functions only.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import row_key, written

# The base patterns and their order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_LENGTH = 8

#: What the models look at: runs of these characters, at least so many.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE_LENGTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}"
#: Log-likelihood ratio (natural logarithm, whole string) from which a candidate counts as random.
THRESHOLD = 10.0
#: Transitions that the plain character frequencies count for after each character.
BACKOFF = 10.0
#: Words of an identifier made for the model of ordinary strings.
JOINED_WORDS = 4
#: Documents whose words and secrets train the models.
SAMPLE_DOCUMENTS = 2000
SIZE = len(ALPHABET) + 1

SPAN = "struct<start:int,kind:int,end:int>"
#: Matches that are folded into one array.
PIECE = 128


def _codes(text: F.Column) -> F.Column:
    """Place of every character in the alphabet, from 1; others are 0."""
    return F.transform(F.slice(F.split(text, ""), F.lit(1), F.char_length(text)), lambda c: F.instr(F.lit(ALPHABET), c))


def train_markov(samples: DataFrame, text_col: str = "text", random_col: str = "random") -> list[float]:
    """First-order models of random and of ordinary strings, as one table of log-ratios of transition probabilities.

    ``samples`` has a string and a boolean label per row; rows with a null are left out, other columns are ignored.
    A model's transitions are counted and mixed with its plain character frequencies (weight BACKOFF), which start at one.
    Without samples neither side is favoured.  The table has a fixed size.
    """
    chars = samples.select(F.col(text_col).alias("s"), F.col(random_col).alias("random")).dropna().where("s <> ''")
    codes = chars.select("random", _codes(F.col("s")).alias("b"))
    before = F.concat(F.array(F.lit(0)), F.slice("b", F.lit(1), F.size("b") - 1))
    steps = codes.withColumn("a", before).select("random", F.explode(F.arrays_zip("a", "b")).alias("t"))
    counts = steps.groupBy("random", "t.a", "t.b").agg(F.count("*").alias("n")).collect()
    logs = {}
    for label in (True, False):
        seen = [[0.0] * SIZE for _ in range(SIZE)]
        for row in counts:
            if row.random == label:
                seen[row.a][row.b] += row.n
        plain = [1 + sum(r[b] for r in seen) for b in range(SIZE)]
        plain = [x / sum(plain) for x in plain]
        logs[label] = [math.log((r[b] + BACKOFF * plain[b]) / (sum(r) + BACKOFF)) for r in seen for b in range(SIZE)]
    return [round(a - b, 6) for a, b in zip(logs[True], logs[False], strict=True)]


def log_ratio(text: F.Column, model: list[float]) -> F.Column:
    """Log-likelihood ratio of a string: positive if it looks random."""
    # constants, which the optimizer folds to one value; a function of a text would be evaluated again for every character
    table = F.expr(f"array({', '.join(f'{x!r}D' for x in model)})")
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

    def step(a, c):
        return F.struct(c.alias("at"), (a["sum"] + F.get(table, a["at"] * SIZE + c)).alias("sum"))

    return F.aggregate(_codes(text), start, step, lambda a: a["sum"])


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(text, random): words of at most ``limit`` documents, drawn by hash of the id, and random strings.

    Ordinary strings are the words, and identifiers joined of neighbouring ones.  The random strings are digests of the documents
    in three spellings, and the values that the base patterns find there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    keyed = rows.select("text", *row_key("id", "text"))
    # the draw moves keys only; at most ``limit`` of them are broadcast
    keys = keyed.select("_d", "_h").orderBy(F.xxhash64("_d"), "_h").limit(limit).distinct()
    # of copies of a row one is drawn, so the sample does not depend on how the rows are dealt out
    drawn = written(keyed.join(F.broadcast(keys), ["_d", "_h"]).dropDuplicates(["_d", "_h"]).select("text"), "sample")
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    said = F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    # words of a text joined as identifiers are: with underscores, with hyphens, or by capitals
    starts = F.sequence(F.lit(1), F.greatest(F.size("said"), F.lit(1)), F.lit(JOINED_WORDS))
    runs = F.transform(starts, lambda i: F.slice("said", i, F.lit(JOINED_WORDS)))
    joined = F.flatten(F.transform(runs, lambda r: F.array(F.lower(F.array_join(r, "_")), F.lower(F.array_join(r, "-")), F.array_join(F.transform(r, F.initcap), ""))))
    words = drawn.select(said.alias("said")).select(F.explode(F.concat("said", joined)).alias("text"), F.lit(False).alias("random"))
    code = F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("text"), 256))), "=", "")
    digests = F.array(code, F.md5("text"), F.regexp_replace(F.upper(code), "[+/]", ""))
    found = F.concat(digests, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)))
    secrets = drawn.select(F.explode(found).alias("text"), F.lit(True).alias("random")).where(F.char_length("text") >= ASSIGN_LENGTH)
    return words.unionByName(secrets)


def _scan(column: str, state: F.Column, none: F.Column, step) -> F.Column:
    """The arrays that ``step(state, item)`` gives beside its next state over the items of an array column, one behind another.

    Pieces of PIECE items are folded to an array each, and these are joined at the end, so the time follows the number of items.
    The items must be a column of the table: an expression would be evaluated again for every piece.
    """
    items = F.col(column)
    last = F.greatest(F.size(items) - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last, F.lit(PIECE)), lambda i: F.slice(items, i + 1, F.lit(PIECE)))

    def one(a, item):
        now, found = step(a["state"], item)
        return F.struct(now.alias("state"), F.concat(a["out"], found).alias("out"))

    def piece(a, some):
        folded = F.aggregate(some, F.struct(a["state"].alias("state"), none.alias("out")), one)
        return F.struct(folded["state"].alias("state"), F.concat(a["out"], F.array(folded["out"])).alias("out"))

    begin = F.struct(state.alias("state"), F.filter(F.array(none), lambda x: F.lit(False)).alias("out"))
    return F.aggregate(pieces, begin, piece, lambda a: F.flatten(a["out"]))


def _no_spans() -> F.Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


def _parts(text: F.Column, found: F.Column, pattern: str, kept: F.Column) -> F.Column:
    """Every match of ``pattern`` in ``text``, given as ``found``, with the gap before it and its place in ``kept``."""
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"), kept.alias("keep"))


def _spans(parts: str, kind: str) -> F.Column:
    """Spans of the matches in the column ``parts`` that are kept."""

    def step(at, p):
        begin = at + F.char_length(p["gap"])
        end = begin + F.char_length(p["match"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return end, F.when(p["keep"], F.array(span)).otherwise(_no_spans())

    return F.when(F.size(parts) > 0, _scan(parts, F.lit(0), _no_spans(), step)).otherwise(_no_spans())


def _apart(spans: str, backwards: bool) -> F.Column:
    """The column ``spans``, in order of their starts or ``backwards``, without the markov ones that touch a base span met before them."""
    markov = F.lit(KINDS.index("markov"))

    def step(reached, s):
        if backwards:
            now, clear = F.when(s["kind"] == markov, reached).otherwise(F.least(reached, s["start"])), s["end"] <= reached
        else:
            now, clear = F.when(s["kind"] == markov, reached).otherwise(F.greatest(reached, s["end"])), s["start"] >= reached
        return now, F.when((s["kind"] != markov) | clear, F.array(s)).otherwise(_no_spans())

    return _scan(spans, F.lit(2**31 - 1 if backwards else 0), _no_spans(), step)


def find_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, text (null as empty), base and spans, arrays of (start, kind number, end) by start.

    ``base`` has the leftmost non-overlapping matches of every pattern.  ``spans`` adds the candidates whose
    log-likelihood ratio reaches ``threshold`` and that touch no base span, as kind ``markov``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"))
    t = F.col("text")
    rows = rows.select(
        id_col,
        "text",
        F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)).alias("assign"),
        F.when(t.contains("AKIA"), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)")).alias("access"),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)).alias("hex"),
        F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("candidates"),
    )
    rows = rows.withColumn("random", F.transform("candidates", lambda c: log_ratio(c, model) >= threshold))
    every = lambda found: F.transform(found, lambda m: F.lit(True))
    valued = F.transform("assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LENGTH)
    some = F.exists("random", lambda x: x)
    none = F.expr("CAST(array() AS array<struct<gap:string,match:string,keep:boolean>>)")
    # every step is a column of its own
    rows = rows.select(
        id_col,
        "text",
        _parts(t, F.col("assign"), ASSIGN, valued).alias("assign"),
        _parts(t, F.col("access"), ACCESS, every("access")).alias("access"),
        _parts(t, F.col("hex"), HEX, every("hex")).alias("hex"),
        F.when(some, _parts(t, F.col("candidates"), CANDIDATE, F.col("random"))).otherwise(none).alias("markov"),
    )
    rows = rows.select(id_col, "text", F.array_sort(F.concat(*[_spans(k, k) for k in KINDS[:3]])).alias("base"), _spans("markov", "markov").alias("markov"))
    rows = rows.select(id_col, "text", "base", F.size("markov").alias("more"), F.array_sort(F.concat("base", "markov")).alias("spans"))
    # a candidate is held against the base spans before it, then against those behind its start: two sweeps
    rows = rows.select(id_col, "text", "base", "more", F.when(F.col("more") > 0, F.reverse(_apart("spans", False))).otherwise(_no_spans()).alias("spans"))
    return rows.select(id_col, "text", "base", F.when(F.col("more") > 0, F.reverse(_apart("spans", True))).otherwise(F.col("base")).alias("spans"))


def listed(spans: str) -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, number of spans of each base kind, digest of the base spans, all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
