"""All queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from ledgerloom.plans import changes, extended, lifecycles, records, relational, stores, streams, strings  # noqa: F401  each registers its queries
from ledgerloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
