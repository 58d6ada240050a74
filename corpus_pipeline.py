"""Cleaning pipeline over ``documents``: every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontaminate, exact_dedup, language_id, sentencepiece_lattice, simhash
from tidegrid.llm.common import prepared, table, written
from tidegrid.llm.registry import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go: no language can be named for them."""
    prepared(spark)
    return language_id.drop_unknown(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    prepared(spark)
    return exact_dedup.drop_copies(docs)


def first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints linked at two or fewer bits (three-word shingles) the document with the smallest id stays."""
    prepared(spark)
    return simhash.drop_near_copies(docs, size=3, max_bits=2)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 of what is left."""
    prepared(spark)
    return sentencepiece_lattice.encode(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", first_copies),
    ("simhash_near_dedup", first_near_copies),
    ("benchmark_decontamination", uncontaminated),
    ("sentencepiece_encoding", encoded),
]

#: Groups of fingerprints and the lattice have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
