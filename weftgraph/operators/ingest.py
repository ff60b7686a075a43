"""Bulk ingest: index exports, crawl reports, crawl seeds and due urls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import segment_prior
from ..functions.ttl import Freshness
from ..sources import schema as S
from ..sources.tables import unsigned
from . import mutate
from .fold import live


def _links(export: DataFrame) -> DataFrame:
    """Link edges of full weight from an export's edges array."""
    return export.select(F.col("url_key").alias("src_key"), F.posexplode("edges").alias("pos", "dst_key")).select("src_key", "pos", "dst_key", F.lit(S.LINK).alias("etype"), F.lit(S.FULL_WEIGHT).alias("weight"))


def _docs(export: DataFrame) -> DataFrame:
    return export.select("url", F.col("url_key").alias("node_key"), "content_hash", "fetched_at_ms", "title", F.nullif("snippet", F.lit("")).alias("snippet"), "etag", "pinned")


def absorb(export: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Every document with its links, no segments. edges: the committed ones."""
    keys = export.select(F.col("url_key").alias("node_key"))
    return [mutate.upsert_nodes(_docs(export)), mutate.set_edges(_links(export), edges, keys=keys)]


def report(pages: DataFrame, export: DataFrame, nodes: DataFrame, edges: DataFrame, segments: DataFrame, now_ms: int, how: Freshness = Freshness()) -> tuple[list[DataFrame], DataFrame]:
    """Operations of a crawl report, and its counters (one row).

    pages: url_key, change (added, updated, unchanged, removed, skipped), headings
    array<struct<depth, text>>, keywords. An added page whose committed hash differs has
    changed, whatever the crawl's own index knew.
    """
    wanted = pages.where(F.col("change").isin("added", "updated"))
    met = wanted.join(export, "url_key")
    known = nodes.select(F.col("node_key").alias("url_key"), F.col("content_hash").alias("own_hash"))
    keys = met.select(F.col("url_key").alias("node_key"))
    heads = met.select(F.col("url_key").alias("node_key"), "keywords", F.posexplode("headings").alias("ordinal", "h"))
    segs = heads.select(
        "node_key", "ordinal", F.col("h.text").alias("label"), F.lit(None).cast("long").alias("byte_start"), F.lit(None).cast("long").alias("byte_len"), F.col("h.depth").cast("int").alias("depth"),
        segment_prior(F.col("h.depth"), F.col("ordinal"), F.col("h.text"), F.col("keywords")).alias("importance"),
    )
    moved = met.join(known, "url_key", "left").where((F.col("change") == "updated") | (F.col("own_hash") != F.col("content_hash")))
    touches = moved.select(F.col("url_key").alias("node_key"), F.lit(S.CHANGED).alias("outcome"), "content_hash", "etag").unionByName(
        pages.where(F.col("change").isin("unchanged", "removed")).select(
            F.col("url_key").alias("node_key"), F.when(F.col("change") == "removed", S.GONE).otherwise(S.UNCHANGED).alias("outcome"),
            F.lit(None).cast("long").alias("content_hash"), F.lit(None).cast("string").alias("etag"),
        )
    ).withColumn("checked_at_ms", F.lit(now_ms).cast("long"))
    links = _links(met)
    touched = mutate.touch(touches, nodes, how)
    ops = [mutate.upsert_nodes(_docs(met)), mutate.set_segments(segs, segments, keys), mutate.set_edges(links, edges, keys=keys), touched]
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counters = n(met, "upserted")
    for part in (n(segs, "segments"), n(links, "edges"), n(touched.where("not touch.tombstone"), "touched"), n(touched.where("touch.tombstone"), "tombstoned")):
        counters = counters.join(part)  # single rows
    return ops, counters


def crawl_seed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_key, etag) of live nodes that have one; (node_key, urls) of their targets that have a url, in the order of keys."""
    alive = live(nodes)
    urls = nodes.where("in_base and url <> ''").select(F.col("node_key").alias("dst_key"), "url")
    out = edges.join(alive.select(F.col("node_key").alias("src_key")), "src_key", "left_semi").join(urls, "dst_key")
    lists = out.groupBy(F.col("src_key").alias("node_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(unsigned(F.col("dst_key")).alias("at"), "url"))), lambda x: x["url"]).alias("urls"))
    return alive.where("etag is not null").select("node_key", "etag"), lists


def enrichment_context(nodes: DataFrame, edges: DataFrame, segments: DataFrame) -> DataFrame:
    """What an enricher (a function over DataFrames) is given: each live node, its headings, its neighbours' titles."""
    heads = segments.groupBy("node_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "importance"))).alias("segments"))
    titles = nodes.where("title is not null").select(F.col("node_key").alias("dst_key"), "title")
    near = edges.join(titles, "dst_key").groupBy(F.col("src_key").alias("node_key")).agg(F.array_sort(F.collect_set("title")).alias("neighbor_titles"))
    return live(nodes).select("node_key", "url", "title", "snippet").join(heads, "node_key", "left").join(near, "node_key", "left")
