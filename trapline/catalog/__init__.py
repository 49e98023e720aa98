"""All registered queries."""

from __future__ import annotations

from trapline.catalog import registry


def _load() -> None:
    from trapline.catalog import (  # noqa: F401
        ingest_queries,
        model_queries,
        plan_queries,
        report_queries,
        session_queries,
        stream_queries,
    )


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return {n: registry.comparison_sql(*o) for n, o in registry.ORACLES.items()}
