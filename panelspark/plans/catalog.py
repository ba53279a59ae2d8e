"""All queries of the core, with their SQL twins."""

from __future__ import annotations

from panelspark.plans import experiments, joins, market, panels, periods, selecting, storage, streams, texts, times

MODULES = (times, periods, market, joins, selecting, experiments, texts, panels, streams, storage)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
