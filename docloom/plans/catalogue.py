"""The registered queries of the analytics engine and their DuckDB counterparts."""

from docloom.plans import contents_queries, more_queries, search_queries, store_queries, structure_queries, table_queries, text_queries, wired_queries  # noqa: F401  they register themselves
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
