"""All queries of the library's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

_MODULES: list[str] = ["quire.plans.chapter_queries", "quire.plans.text_queries", "quire.plans.record_queries", "quire.plans.flow_queries", "quire.plans.job_queries"]


def queries() -> dict[str, Callable]:
    """name -> callable(spark, sf_dir)."""
    import importlib

    out: dict[str, Callable] = {}
    for module in _MODULES:
        out.update(importlib.import_module(module).QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, for the queries that have one."""
    import importlib

    out: dict[str, str] = {}
    for module in _MODULES:
        out.update(importlib.import_module(module).ORACLES)
    return out
