"""Registered queries: each runs an operator over whole tables, most with the same in SQL."""

from __future__ import annotations

from tidegrid.catalog import exports, flows, grids, history, parsing, streams
from tidegrid.catalog.base import Query

MODULES = (parsing, grids, exports, history, flows, streams)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name!r} registered twice")
            found[name] = query
    return found
