"""Queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from panelspark.llm import encode, lines, mixture, nearest, personal, pieces, topn, turns

MODULES = (nearest, lines, topn, pieces, turns, encode, mixture, personal)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
