"""Every registered query of the library outside ``llm``, with its SQL oracle."""

from __future__ import annotations

from cohortflow.plans import clinical, flow, process, searches, vectors

MODULES = (clinical, process, vectors, searches, flow)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
