"""Registered queries over the engine's operators, with their SQL where SQL can say the same."""

from archiveloom.plans.registry import ORACLE, QUERIES
from archiveloom.plans import chunking_queries, evaluation_queries, graph_queries, text_queries  # noqa: E402,F401  (they register)

__all__ = ["ORACLE", "QUERIES"]
