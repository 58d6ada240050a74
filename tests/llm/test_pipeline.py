from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from tidegrid.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    docs = [(r[0], r[1]) for r in read("documents")]
    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    first = {i for i, _, _, k, _ in brute.exact(kept) if k}
    kept = [(i, t) for i, t in kept if i in first]
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, brute.near(kept), strict=True) if i == c]
    leaks = {r[0] for r in brute.contaminated(kept, read("benchmark"))}
    want = sorted((i, brute.sha(t)) for i, t in kept if i not in leaks)
    assert leaks
    found = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.decoded_sha256) for r in found.collect()) == want


def test_stages_keep_the_columns(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "id", "fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns
        assert left.count() <= docs.count()
        docs = left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert list(corpus_pipeline.QUERIES) == ["pipeline"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    as_rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert as_rows(found) == as_rows(want)
