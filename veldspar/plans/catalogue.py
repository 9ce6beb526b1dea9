"""All queries of the library."""

from __future__ import annotations

from . import governance, io, manifests, ranking, rasters, selection, strata, vectors  # noqa: F401
from .base import CATALOGUE


def queries() -> dict:
    return {name: q.run for name, q in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOGUE.items() if q.sql}


def covered() -> dict[str, list[str]]:
    """Inventory id -> the queries that cover it."""
    out: dict[str, list[str]] = {}
    for name, q in CATALOGUE.items():
        for i in q.ids.split():
            out.setdefault(i, []).append(name)
    return out
