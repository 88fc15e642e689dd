"""All contract queries, imported for their registration side effect."""

from tablelens.plans import queries_profile, queries_results, queries_stats  # noqa: F401
from tablelens.plans.contract import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
