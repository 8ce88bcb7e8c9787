"""Queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from corpusloom.queries import editing, language, lexical, live, notes, recurrent, retrieval, scalar, spelling, typing

FLAGSHIP = "predict_next"
MODULES = (language, scalar, retrieval, spelling, notes, live, lexical, editing, typing, recurrent)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
