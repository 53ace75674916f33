"""One query for each operator, over the driver's tables."""

from pactum.queries import collections, contracts, expressions, relationships, sessions
from pactum.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "collections", "contracts", "expressions", "relationships", "sessions"]
