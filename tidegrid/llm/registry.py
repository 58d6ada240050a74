"""Queries of the numbered operators and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file on the machines that run the tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm import secrets

    docs = table(spark, sf_dir, "documents")
    model = secrets.train_markov(secrets.labelled_samples(docs))
    return secrets.secret_digest(secrets.find_secrets(docs, model))


OP2_SQL = r"""
WITH rows AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, text, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM rows),
z AS (SELECT DISTINCT least(len(ws), 5) AS size FROM w WHERE side = 1 AND len(ws) > 0),
s AS (
  SELECT DISTINCT side, id, text, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS g
  FROM w JOIN z ON len(ws) >= size AND (side = 0 OR size = least(len(ws), 5))),
b AS (SELECT id AS item_id, text, size, g, count(*) OVER (PARTITION BY id, text) AS n_item FROM s WHERE side = 1),
p AS (
  SELECT d.id AS doc_id, b.item_id, b.n_item, count(*) AS n_shared
  FROM s d JOIN b ON d.g = b.g AND d.size = b.size WHERE d.side = 0 GROUP BY d.id, d.text, b.item_id, b.text, b.n_item)
SELECT doc_id, item_id, max(n_item) AS n_item, max(n_shared) AS n_shared, max(n_shared / n_item) AS containment
FROM p WHERE n_shared / n_item >= 0.8 GROUP BY doc_id, item_id
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH r AS (
  SELECT DISTINCT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS part, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said
  FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM r WHERE who <> 'system'),
t AS (
  SELECT r.*, p.speaker, '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant'
    ELSE 'user name=' || who END || chr(10) AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, speaker
    ORDER BY turn NULLS LAST, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM t)
SELECT conv_id, speaker, part, count(*) AS n_turns, CAST(min(before) AS BIGINT) AS start,
  string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY turn, who, said) AS text,
  coalesce(string_agg(CAST(before + length(head) AS BIGINT) || ':' || CAST(before + length(head) + length(said) + 11 AS BIGINT), ','
    ORDER BY turn, who, said) FILTER (WHERE who = speaker), '') AS masks
FROM o GROUP BY conv_id, speaker, part
"""


@query("op4_chat_perspectives", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.chat_format import perspectives

    return perspectives(table(spark, sf_dir, "conversations"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op7_debruijn_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.debruijn_dedup import dedup_spans

    return dedup_spans(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.sentencepiece_lattice import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path())


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op10_exact_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


# A word is listed with its place; windows are compared as lists of words.
OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
g AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS words
  FROM w WHERE len(ws) > 8),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, words) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM k WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (
  SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_alpha_words,
    CAST(len(list_filter(ws, lambda x: length(x) > 1 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}]'))) AS BIGINT) AS n_shouted,
    CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_echoed
  FROM w JOIN l USING (r) LEFT JOIN p USING (r)),
b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (100 * n_alpha_words < 70 * n_words)::INT + 128 * (100 * n_shouted > 60 * n_words)::INT + 256 * (100 * n_echoed > 30 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_alpha_words, n_shouted, n_echoed, fail_bits,
  fail_bits AS policy_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'standard-1' AS policy
FROM b
"""


@query("op12_quality_rules", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.quality_rules import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"))


def _op13_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """The rounds written out: a table of centroids (c, d, x) and of assignments for each."""
    steps = [
        f"""e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        "v AS (SELECT r, unnest(range(1, len(embedding) + 1)) AS d, unnest(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM e)",
        "s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e)",
        f"c0 AS MATERIALIZED (SELECT s.c, v.d, v.x FROM s JOIN v USING (r) WHERE s.c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS away FROM v JOIN c{n} c ON v.d = c.d GROUP BY v.r, c.c)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(c) AS c, min(away) AS away FROM (SELECT *, min(away) OVER (PARTITION BY r) AS least FROM d{n}) WHERE away = least GROUP BY r)")
        if n < rounds:
            mean = "CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            new = f"SELECT a.c, v.d, {mean} AS x FROM a{n} a JOIN v ON a.r = v.r GROUP BY a.c, v.d"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, c.d, coalesce(n.x, c.x) AS x FROM c{n} c LEFT JOIN ({new}) n ON c.c = n.c AND c.d = n.d)")
    h = f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)"
    return (
        "WITH " + ",\n".join([*steps, h])
        + f"""
SELECT e.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.away AS BIGINT) AS distance, CAST(sum(a.away) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.away) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN e USING (r) JOIN h ON a.c = h.c"""
    )


@query("op13_centroid_clusters", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.llm.centroid_clusters import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))
