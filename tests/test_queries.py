"""The registered queries: shape of their plans, and agreement with DuckDB on the smallest data.

Every query with a DuckDB text is compared when TIDEGRID_ALL is set; otherwise one per family.
"""

import os
import re

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "temporal_features", "feature_table", "rolling_features", "gap_limited_interpolate", "days_to_holiday", "distribution_stats",
    "temporal_consistency", "acf", "grid_event_interval_flag", "compare_baselines", "tag_splits", "conformal_update", "residual_qq",
    "prequential_metrics", "top_contributions", "whatif", "nl_explanation", "drift_text", "ks_drift", "ab_significance", "rollback",
    "read_wide_meter", "parse_hourly_json", "stream_resample_hourly",
]
PLANNED = ("features", "profiling", "joining", "forecasting", "explaining", "monitoring")


@pytest.fixture(scope="session")
def con():
    return duck(SF)


ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TIDEGRID_ALL") else SAMPLE)
def test_agrees_with_duckdb(spark, con, name):
    problem, n = compare(entry.queries()[name](spark, SF), con, ORACLES[name])
    assert not problem and n > 0


def test_every_text_has_a_query():
    queries = entry.queries()
    assert set(ORACLES) <= set(queries)
    # numbered queries and the pipeline come from optional modules, which may be absent
    numbered = {fn.__module__ for n, fn in queries.items() if n == "pipeline" or re.match(r"op\d", n)}
    assert numbered in (set(), {"tidegrid.llm.registry", "corpus_pipeline"})


@pytest.mark.parametrize("module", PLANNED)
def test_plans_have_no_cross_joins_and_no_global_windows(spark, module):
    bad = {}
    mine = [n for n, fn in entry.queries().items() if fn.__module__ == f"tidegrid.registry.{module}"]
    skipped = ("log_runs", "reference_snapshot")  # these write a table when they are built
    for name in mine if os.environ.get("TIDEGRID_ALL") else mine[::3]:
        if name in skipped:
            continue
        fn = entry.queries()[name]
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            if word in plan:
                bad[name] = word
        for line in plan.splitlines():
            if re.search(r"\bWindow \[", line) and "windowspecdefinition(" in line:
                for spec in re.findall(r"windowspecdefinition\(([^()]*)", line):
                    # a constant key is folded away; only the one-row-per-bucket summary may then go without one
                    if re.match(r"\s*(?!_bucket#)\S+ (ASC|DESC)", spec.split(",")[0]):
                        bad[name] = "window without partition keys"
    assert not bad


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
