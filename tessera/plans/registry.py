"""All registered queries of the engine and their SQL, gathered from the query modules."""

from __future__ import annotations

from tessera.plans import assessment, graphs, knowledge, learners, mastery, materials, pages, readiness, records, retrieval, search, streams

MODULES = (retrieval, search, pages, learners, graphs, readiness, mastery, assessment, knowledge, materials, records, streams)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
