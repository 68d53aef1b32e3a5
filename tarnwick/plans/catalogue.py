"""Every registered query of the library and its SQL."""

from __future__ import annotations

from . import building, citations, retrieval

FLAGSHIP = "eval_per_query"

PARTS = (retrieval, citations, building)


def queries() -> dict:
    return {f.__name__: f for part in PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
