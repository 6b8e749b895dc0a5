"""All queries outside the optional packages, by name."""

from __future__ import annotations

from collections.abc import Callable

from quillgraph.plans import extract, graph, memory, problems, resolution, retrieval, text

_MODULES = [problems, retrieval, graph, resolution, memory, text, extract]


def queries() -> dict[str, Callable]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
