"""All registered queries and their SQL."""

from pagequarry.plans import discovery, imports, network, pages, parts, reports, runs  # noqa: F401
from pagequarry.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
