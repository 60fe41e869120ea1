"""All queries of the library, and their SQL."""

from . import eval_queries, feed_queries, join_queries  # noqa: F401  they register their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
