"""Due lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ttl import Freshness
from ..sources.tables import unsigned
from .fold import live


def due(nodes: DataFrame, now_ms: int, most: int, how: Freshness = Freshness()) -> DataFrame:
    """node_key, url, etag, content_hash, permille, overdue_ms of what is to be checked, most important first."""
    at = how.next_check_ms(F.col("fetched_at_ms"), F.greatest("interval_s", F.lit(1)), F.col("permille"))
    ripe = live(nodes).where(F.col("url") != "").withColumn("overdue_ms", F.lit(now_ms) - at).where("overdue_ms >= 0")
    first = ripe.orderBy(F.desc("permille"), F.desc("overdue_ms"), unsigned(F.col("node_key"))).limit(most)
    return first.select("node_key", "url", "etag", "content_hash", "permille", "overdue_ms")
