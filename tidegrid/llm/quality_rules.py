"""Quality rules (operator 12): a ledger of rule bits, policies applied to it, and ablations by bitwise aggregation.

Every rule is evaluated once per document; its result is one bit of a mask that is kept together with the measurements.  A policy
is a versioned set of rules: documents with none of its bits are kept.  Changing a policy, or asking what a rule alone removes,
reads the ledger and never the texts.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import row_key, unused, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window; windows found twice in a text mark their words as repeated.
WINDOW = 8
#: Bytes of a text whose words are numbered at once.
PART = 4_000_000

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_shouted", "n_echoed"]


@dataclasses.dataclass(frozen=True)
class Rule:
    """A named condition on the measurements under which a document fails."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


#: The rules by bit.  Bits are never given to another rule: old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("many_symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("few_letters", lambda m: 100 * m["n_alpha_words"] < 70 * m["n_words"]),
    Rule("shouting", lambda m: 100 * m["n_shouted"] > 60 * m["n_words"]),
    Rule("echoes", lambda m: 100 * m["n_echoed"] > 30 * m["n_words"]),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure removes a document.
POLICIES = {"base-1": BASE, "standard-1": (*BASE, "many_symbols", "duplicate_lines", "short_words", "long_words", "few_letters", "shouting", "echoes")}
STANDARD = "standard-1"


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """Bits of the named rules."""
    known = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(known[n] for n in dict.fromkeys(names))


def _parts(text: bytes):
    """A text in parts that end in white space, so that no word is cut; a longer word stays whole."""
    at = 0
    while len(text) - at > PART:
        cut = next((i for i in range(at + PART, len(text)) if text[i] in b" \t\n\v\f\r"), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows whose word sequence stands twice or more.

    Windows are numbered exactly: numbers of words, then of pairs, then of pairs of those, and so on.
    """
    if len(numbers) <= window:
        return 0
    size, ids = 1, numbers.astype(np.int64)
    while (often := np.bincount(ids)[ids] > 1).any() and size < window:
        step = min(size, window - size)
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1].ravel()
        size += step
    if not often.any():
        return 0
    edge = np.zeros(len(numbers) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def measures(text: str | None) -> tuple[int, ...]:
    """All MEASURES of a whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    known = _Numbers()
    numbers = np.concatenate([np.fromiter(map(known.__getitem__, part.split()), np.int64) for part in _parts(data)])
    n_alpha = n_shouted = 0
    if known:
        distinct = b"\n".join(known).decode("utf-8", "surrogatepass").split("\n")
        count = np.bincount(numbers, minlength=len(known))
        alpha = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
        shouted = np.fromiter((w.isupper() and len(w) > 1 for w in distinct), bool, len(distinct))
        n_alpha, n_shouted = int(count[alpha].sum()), int(count[shouted].sum())
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(numbers), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(numbers),
        len(lines), n_alpha, n_shouted, int((numbers[1:] == numbers[:-1]).sum()),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: id, text_hash, the MEASURES and ``fail_bits`` (bit i: rule i fails).

    A word is a run of characters other than ASCII white space; a line counts if it has a word, and is a duplicate if an earlier
    line is equal to it.  Null texts count as empty, whole copies of a row are rows of their own, other columns are ignored and an
    empty table gives no rows.
    """
    hidden = [f"_m{i}" for i in range(len(MEASURES))]
    rows = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col)[1].alias("_h"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            table = np.array([measures(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, len(MEASURES))
            columns = [batch.column(0), batch.column(1), *[pa.array(table[:, i]) for i in range(len(MEASURES))]]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_h", *hidden])

    found = rows.mapInArrow(run, f"_id {kind}, _h long, " + ", ".join(f"{h} long" for h in hidden))
    named = {n: F.col(h) for n, h in zip(MEASURES, hidden, strict=True)}
    bits = [F.when(r.fails(named), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return found.select(F.col("_id").alias(id_col), F.col("_h").alias("text_hash"), *[c.alias(n) for n, c in named.items()], mask.alias("fail_bits"))


def apply_policy(rows: DataFrame, names: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """A ledger with ``policy_bits`` (the failures that count) and ``kept`` (none of them)."""
    counted = F.col("fail_bits").bitwiseAND(F.lit(mask_of(names, rules)))
    return rows.withColumn("policy_bits", counted).withColumn("kept", F.col("policy_bits") == 0)


def ablations(rows: DataFrame, policies: dict[str, Sequence[str]] | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What every rule of every policy does: policy, rule, n_docs, n_kept, n_failed, n_only, n_kept_without.

    ``n_failed`` documents fail the rule, ``n_only`` fail no other rule of the policy; without the rule ``n_kept_without`` stay.
    The ledger is counted by its bits first, so the rest works on at most one row for each combination of failures.
    """
    policies = POLICIES if policies is None else policies
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    listed = [(p, n, mask_of(names, rules), bit[n]) for p, names in policies.items() for n in dict.fromkeys(names)]
    table = rows.sparkSession.createDataFrame(listed, "policy string, rule string, mask long, bit long")
    counted = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    # every combination meets every rule of every policy: both sides are bounded by the rules alone
    met = counted.select("n", "fail_bits", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in listed])).alias("x"))
    failed, hit = F.col("fail_bits").bitwiseAND(F.col("x.mask")), F.col("fail_bits").bitwiseAND(F.col("x.bit")) != 0
    some = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    sums = met.groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"), some(failed == 0, "n_kept"), some(hit, "n_failed"), some(hit & (failed == F.col("x.bit")), "n_only")
    )
    whole = table.select("policy", "rule").join(sums, ["policy", "rule"], "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_kept", "n_failed", "n_only")]
    return whole.select("policy", "rule", *numbers).withColumn("n_kept_without", F.col("n_kept") + F.col("n_only"))


def quality_digest(docs: DataFrame, policy: str = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger under a policy, with ``base_failed`` for the base rules; a document that fails these is never kept."""
    rows = apply_policy(ledger(docs, id_col, text_col), POLICIES[policy])
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE))) != 0
    out = rows.withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~base)
    return out.select(id_col, *MEASURES, "fail_bits", "policy_bits", "base_failed", "kept").withColumn("policy", F.lit(policy))


def drop_failed(docs: DataFrame, policy: str = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the policy removes; all columns as they were.

    Rows are told apart by id and a hash of their text; copies of a row share its fate.
    """
    rows = apply_policy(ledger(docs, id_col, text_col), POLICIES[policy])
    gone = written(rows.where("NOT kept").select(F.col(id_col).alias("_gone_id"), F.col("text_hash").alias("_gone_h")).distinct(), "failed")
    h = unused(docs, "_key_h")
    marked = docs.withColumn(h, row_key(id_col, text_col)[1])
    return marked.join(gone, marked[id_col].eqNullSafe(gone["_gone_id"]) & (marked[h] == gone["_gone_h"]), "left_anti").drop(h)


def rule_names(bits: int, rules: Sequence[Rule] = RULES) -> list[str]:
    """Names of the rules in a mask."""
    return [r.name for i, r in enumerate(rules) if bits >> i & 1]
