"""All registered queries with their check SQL."""

from __future__ import annotations

from pollweave.plans import (
    history_queries,
    join_queries,
    map_queries,
    scalar_queries,
    shape_queries,
    status_queries,
    stream_queries,
    war_queries,
)

MODULES = [
    scalar_queries, join_queries, history_queries, map_queries, shape_queries, status_queries,
    stream_queries, war_queries,
]


def registered() -> dict:
    """Query key -> (callable, SQL or None)."""
    found = {}
    for module in MODULES:
        for key, entry in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = entry
    return found
