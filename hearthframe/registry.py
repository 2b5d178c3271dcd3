"""All registered queries of the sales analytics and their SQL."""

from .plans import more  # noqa: F401  registers its queries
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
