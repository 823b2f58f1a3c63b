"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from tallyforge.plans import q_aggregate, q_domain, q_join, q_scalar, q_scan  # noqa: F401
from tallyforge.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
