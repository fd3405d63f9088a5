"""All queries of the library with their SQL."""

from . import activity, graph, knowledge, lifecycle, memory, pattern, search, text, workspace  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
