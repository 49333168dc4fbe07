"""All registered queries and their SQL."""

from __future__ import annotations

from kgspark.plans import decode_queries, graph_queries, link_queries, link_sql, review_queries, scalar_queries, staging_queries, text_queries

MODULES = [graph_queries, scalar_queries, link_queries, text_queries, decode_queries, staging_queries, review_queries]


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        for key, value in getattr(m, name).items():
            if key in out:
                raise ValueError(f"{key} is registered twice")
            out[key] = value
    return out


QUERIES = _merged("QUERIES")
ORACLES = {**_merged("ORACLES"), **link_sql.ORACLES}
