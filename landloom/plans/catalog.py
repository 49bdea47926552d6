"""All registered queries of the land-record engine and their SQL."""

from __future__ import annotations

from landloom.plans import attributes, formats, geometry, ingest, layers, serving  # noqa: F401  each module registers its queries
from landloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
