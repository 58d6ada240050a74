"""All registered queries and their DuckDB texts."""

from __future__ import annotations

import importlib

from tidegrid.registry.common import ORACLES, QUERIES, QueryFn

MODULES = ["features", "profiling", "joining", "forecasting", "explaining", "monitoring", "files", "learning", "streams"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidegrid.registry.{name}")


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
