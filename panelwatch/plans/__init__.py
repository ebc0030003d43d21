"""Named queries over the given tables, grouped by topic."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, Query

GROUPS = (
    "parsing_queries", "report_queries", "text_queries", "quality_queries", "feature_queries", "metric_queries",
    "portfolio_queries", "model_queries",
)


def _load() -> None:
    for group in GROUPS:
        import_module(f"{__name__}.{group}")


def all_queries() -> dict[str, Query]:
    """Name -> function of (spark, folder)."""
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    """Name -> equivalent SQL."""
    _load()
    return dict(ORACLES)
