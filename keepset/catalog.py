"""All registered queries of the library with their SQL."""

from __future__ import annotations

from keepset.plans import documents, events, review, vectors  # noqa: F401  (they register themselves)
from keepset.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
