"""All registered queries: name to (function, SQL or None)."""

from __future__ import annotations

from skein.plans import graph_queries, pass_queries, records, search_queries

QUERIES: dict[str, tuple] = {**records.QUERIES, **graph_queries.QUERIES, **search_queries.QUERIES, **pass_queries.QUERIES}


def flagship(spark, sf_dir):
    """Blast radius of what the newest snapshots changed, with its risk."""
    return graph_queries.g22_blast_radius(spark, sf_dir).orderBy("risk", "hop", "id")
