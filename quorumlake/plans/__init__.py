"""Queries over the driver's tables."""

from quorumlake.plans import audits, bridge, screens, streams  # noqa: F401  they register their queries
from quorumlake.plans.registry import oracle_sql, queries  # noqa: F401
