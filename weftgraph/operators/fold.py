"""Folding the operation log into per-key state, and merging it with the base tables.

The fold is an aggregation: everything before a key's last removal is dropped, then the
latest operation of each kind is taken by ``max_by``, which combines on the map side. The
pin alone depends on order: the last explicit state, or'ed with any pinning upsert after
it; without one, true if any upsert pinned, else unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ttl import Freshness


def fold(ops: DataFrame) -> DataFrame:
    """One row per key: core, segs, edges, touch (since the core), carried counters, pinned, scores, removed, severed."""
    last = ops.where("op = 'remove'").groupBy("node_key").agg(F.max("seq").alias("gone_at"))
    live = ops.join(last, "node_key", "left").where(F.col("gone_at").isNull() | (F.col("seq") > F.col("gone_at")))
    kind = lambda name: F.col("op") == name
    latest = lambda column, name: F.max_by(F.when(kind(name), F.col(column)), F.when(kind(name), F.col("seq")))
    at = lambda test: F.max(F.when(test, F.col("seq")))
    state = live.where(~kind("remove") & ~kind("scores")).groupBy("node_key").agg(
        latest("core", "upsert").alias("core"), at(kind("upsert")).alias("core_at"),
        latest("segs", "segments").alias("segs"), latest("edges", "edges").alias("edges"),
        latest("touch", "touch").alias("touch"), at(kind("touch")).alias("touch_at"),
        latest("pin", "pin").alias("pin"), at(kind("pin")).alias("pin_at"),
        at(kind("upsert") & F.col("core.pinned")).alias("pinned_at"),
    )
    scores = live.where(kind("scores")).select("node_key", "seq", F.explode("scores").alias("s"))
    scores = scores.groupBy("node_key", F.col("s.ordinal").alias("ordinal")).agg(F.max_by("s.importance", "seq").alias("importance"))
    scores = scores.groupBy("node_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "importance"))).alias("scores"))
    keys = ops.select("node_key").distinct()
    all_ = keys.join(state, "node_key", "left").join(scores, "node_key", "left").join(last, "node_key", "left")
    since = F.col("touch_at") > F.coalesce("core_at", F.lit(-1))
    pinned_after = F.coalesce(F.col("pinned_at") > F.col("pin_at"), F.lit(False))
    pinned = F.when(F.col("pin_at").isNotNull(), F.col("pin") | pinned_after).when(F.col("pinned_at").isNotNull(), True)
    return all_.select(
        "node_key", "core", "segs", "edges",
        F.when(since, F.col("touch")).alias("touch"),
        F.when(F.col("core_at").isNotNull() & ~since, F.col("touch")).alias("carried"),
        pinned.alias("pinned"), "scores",
        (F.col("gone_at").isNotNull() & F.col("core_at").isNull()).alias("removed"),
        F.col("gone_at").isNotNull().alias("severed"),
    )


def nodes_view(base: DataFrame, state: DataFrame, ranks: DataFrame | None = None, how: Freshness = Freshness()) -> DataFrame:
    """Every node as a reader sees it: the base under the folded state.

    Besides the node's columns: in_base, base_stub, base_tombstone (the flags before the
    state) and permille, community, community_key where ranks are given.
    """
    b = base.select("node_key", F.struct(*[c for c in base.columns if c != "node_key"]).alias("b"))
    both = b.join(state, "node_key", "full_outer").where(~F.coalesce("removed", F.lit(False)) & (F.col("b").isNotNull() | F.col("core").isNotNull()))
    core, old = F.col("core").isNotNull(), F.col("b").isNotNull()
    severed = F.coalesce("severed", F.lit(False))
    history = old & ~severed  # the base's history still counts
    pick = lambda name: F.when(core, F.col(f"core.{name}")).otherwise(F.col(f"b.{name}"))
    hash_ = F.coalesce("touch.content_hash", pick("content_hash"))
    pin = F.coalesce("pinned", F.when(core, F.col("core.pinned") | (history & F.coalesce("b.pinned", F.lit(False)))).otherwise(F.col("b.pinned")))

    def counter(name: str) -> Column:
        kept = F.when(core, F.coalesce(f"carried.{name}", F.when(history, F.col(f"b.{name}")), F.lit(0))).otherwise(F.col(f"b.{name}"))
        return F.coalesce(f"touch.{name}", kept)

    learned = F.when(history & (F.col("b.content_hash") == F.col("core.content_hash")), F.greatest(F.lit(1), F.col("b.interval_s")))
    interval = F.coalesce("touch.interval_s", F.when(core, F.coalesce(learned, F.lit(how.base_s))).otherwise(F.col("b.interval_s")))
    tomb = F.when(core, F.lit(False)).otherwise(F.col("b.is_tombstone")) | F.coalesce("touch.tombstone", F.lit(False))
    out = both.select(
        "node_key", F.coalesce(pick("url"), F.lit("")).alias("url"), pick("title").alias("title"), pick("snippet").alias("snippet"),
        F.coalesce("touch.etag", pick("etag")).alias("etag"), hash_.alias("content_hash"),
        F.coalesce("touch.fetched_at_ms", pick("fetched_at_ms")).alias("fetched_at_ms"), counter("last_change_ms").cast("long").alias("last_change_ms"),
        interval.cast("long").alias("interval_s"), counter("checks").cast("int").alias("checks"), counter("changes").cast("int").alias("changes"),
        F.coalesce(pin, F.lit(False)).alias("pinned"), F.when(core, F.lit(False)).otherwise(F.col("b.is_stub")).alias("is_stub"), tomb.alias("is_tombstone"),
        F.coalesce("b.in_degree", F.lit(0)).cast("long").alias("in_degree"), old.alias("in_base"),
        F.coalesce("b.is_stub", F.lit(False)).alias("base_stub"), F.coalesce("b.is_tombstone", F.lit(False)).alias("base_tombstone"),
    )
    if ranks is None:
        return out.withColumn("permille", F.lit(0))
    return out.join(ranks, "node_key", "left").withColumn("permille", F.coalesce("permille", F.lit(0)))


def edges_view(base_edges: DataFrame, state: DataFrame) -> DataFrame:
    """An edge set in the state replaces the base's; a removed or severed key has none of the base's."""
    own = state.where("not removed and edges is not null").select(F.col("node_key").alias("src_key"), F.explode("edges").alias("e")).select("src_key", "e.*")
    hidden = state.where("edges is not null or removed or severed").select(F.col("node_key").alias("src_key"))
    return base_edges.join(hidden, "src_key", "left_anti").select("src_key", "dst_key", "etype", "tier_enrich", "inferred", "weight").unionByName(own)


def segments_view(base_segments: DataFrame, state: DataFrame) -> DataFrame:
    """As edges_view; importance overrides apply by ordinal, also over a later segment set."""
    own = state.where("not removed and segs is not null").select("node_key", F.posexplode("segs").alias("ordinal", "s")).select("node_key", "ordinal", "s.*")
    hidden = state.where("segs is not null or removed or severed").select("node_key")
    names = ["node_key", "ordinal", "label", "byte_start", "byte_len", "depth", "importance", "llm_scored"]
    all_ = base_segments.join(hidden, "node_key", "left_anti").select(*names).unionByName(own.select(*names))
    over = state.where("not removed and scores is not null").select("node_key", F.explode("scores").alias("s")).select("node_key", "s.ordinal", F.col("s.importance").alias("given"))
    return all_.join(over, ["node_key", "ordinal"], "left").select(
        *names[:6], F.coalesce("given", "importance").alias("importance"), (F.col("llm_scored") | F.col("given").isNotNull()).alias("llm_scored")
    )


def of_keys(df: DataFrame, keys: DataFrame, column: str = "node_key") -> DataFrame:
    """The rows of df whose key is in keys (node_key, distinct)."""
    return df.join(keys.select(F.col("node_key").alias(column)), column, "left_semi")


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where("not is_stub and not is_tombstone")
