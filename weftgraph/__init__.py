"""A Spark-native knowledge-graph lookup and freshness engine."""

from .operators.search import QueryOptions
from .sources.store import Config, Snapshot, Store, Writer

__all__ = ["Config", "QueryOptions", "Snapshot", "Store", "Writer"]
