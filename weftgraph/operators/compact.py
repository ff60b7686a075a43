"""Compaction: the merged view becomes the tables of the next generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import searchable_url, tokens
from ..sources.tables import numbered, unsigned, written
from . import rank

NODE_COLUMNS = [
    "node_key", "url", "title", "snippet", "etag", "content_hash", "fetched_at_ms", "last_change_ms", "interval_s", "checks", "changes", "pinned", "is_stub", "is_tombstone",
]


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs that no edge names go (tombstones stay); targets that are no nodes become stubs."""
    named = edges.select(F.col("dst_key").alias("node_key")).distinct()
    kept = nodes.where("not is_stub").unionByName(nodes.where("is_stub").join(named, "node_key", "left_semi").select(*nodes.columns))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    none = lambda c: F.lit(None).cast("string").alias(c)
    minted = named.join(nodes.select("node_key"), "node_key", "left_anti").select(
        "node_key", F.lit("").alias("url"), none("title"), none("snippet"), none("etag"), zero("content_hash"), zero("fetched_at_ms"), zero("last_change_ms"), zero("interval_s"),
        F.lit(0).alias("checks"), F.lit(0).alias("changes"), F.lit(False).alias("pinned"), F.lit(True).alias("is_stub"), F.lit(False).alias("is_tombstone"),
    )
    return kept.select(*NODE_COLUMNS).unionByName(minted)


def postings(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """token, node_key of every token in a node's url (without scheme), title, snippet and segment labels."""
    own = nodes.select("node_key", F.concat_ws(" ", searchable_url(F.col("url")), "title", "snippet").alias("text"))
    texts = own.unionByName(segments.select("node_key", F.col("label").alias("text"))).repartition("node_key")  # texts move, as a file's words may not fit in its task
    return texts.select("node_key", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct().select("token", "node_key")


def lexicon(of: DataFrame) -> DataFrame:
    return of.groupBy("token").agg(F.count("*").alias("df"))


def compacted(nodes: DataFrame, edges: DataFrame, segments: DataFrame, with_communities: bool = True) -> dict[str, DataFrame]:
    """nodes, segments, edges, postings and ranks of the next generation, from the merged views.

    Edges and segments of keys that are no nodes vanish.
    """
    edges = edges.join(nodes.select(F.col("node_key").alias("src_key")), "src_key", "left_semi").select(*edges.columns)
    edges = written(edges, "edges")
    segments = segments.join(nodes.select("node_key"), "node_key", "left_semi").select(*segments.columns)
    kept = with_stubs(nodes.select(*NODE_COLUMNS), edges)
    degree = written(rank.degrees(kept, edges), "degree")
    kept = written(kept.join(degree.select("node_key", "in_degree"), "node_key"), "nodes")
    edges = edges.join(kept.select(F.col("node_key").alias("src_key")), "src_key", "left_semi").select(*edges.columns)
    ids = numbered(kept.select("node_key"), [unsigned(F.col("node_key"))], "node_id")
    ranks = rank.permille(rank.pagerank(kept, edges), degree)
    ranks = ids.join(ranks, "node_key")
    if with_communities:
        ranks = ranks.join(rank.communities(ids, edges), "node_key")
    else:
        ranks = ranks.withColumn("community", F.col("node_id")).withColumn("community_key", F.col("node_key"))
    return {"nodes": kept, "segments": segments, "edges": edges, "postings": postings(kept, segments), "ranks": ranks.select("node_key", "node_id", "permille", "community", "community_key")}
