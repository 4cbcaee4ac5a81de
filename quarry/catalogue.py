"""The registered queries of the clustering engine and their SQL."""

from quarry.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
