"""Registered queries: each operator applied to the test tables, with the SQL that checks it."""

from tessera.plans.registry import QUERIES, SQL
from tessera.plans import (  # noqa: F401  (importing registers)
    answering,
    embeddings,
    lakes,
    metrics,
    provenance,
    ranking,
    slicing,
    tiles,
)

__all__ = ["QUERIES", "SQL"]
