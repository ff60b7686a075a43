"""Mutations as set operations: each turns a DataFrame of records into operation rows.

The rows have every column of the log but `seq`; `pos` orders them within a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.text import label_fits, proposed_weight
from ..functions.ttl import Freshness
from ..sources import schema as S

_KINDS = {"core": S.CORE, "segs": S.SEGMENT_SET, "edges": S.EDGE_SET, "touch": S.TOUCH, "pin": "boolean", "scores": S.SCORES}


def operation(rows: DataFrame, op: str, pos: Column | None = None, **value: Column) -> DataFrame:
    columns = [value[k].cast(kind).alias(k) if k in value else F.lit(None).cast(kind).alias(k) for k, kind in _KINDS.items()]
    return rows.select((F.lit(0) if pos is None else pos).cast("long").alias("pos"), F.lit(op).alias("op"), F.col("node_key").cast("long").alias("node_key"), *columns)


def _refuse(rows: DataFrame, bad: Column, what: str) -> None:
    if not rows.where(bad).isEmpty():
        raise FormatError(what)


def upsert_nodes(docs: DataFrame, check: bool = True) -> DataFrame:
    """docs: url, node_key, content_hash, fetched_at_ms, title, snippet, etag, pinned."""
    if check:
        _refuse(docs, F.col("url").isNull() | (F.col("url") == ""), "url is empty")
        fits = label_fits(F.col("url")) & label_fits(F.col("title")) & label_fits(F.col("snippet")) & label_fits(F.col("etag"))
        _refuse(docs, ~fits, "a label has more than 2048 bytes")
    core = F.struct("url", "title", "snippet", "etag", "content_hash", "fetched_at_ms", F.coalesce("pinned", F.lit(False)).alias("pinned"))
    return operation(docs, "upsert", core=core)


def set_segments(segs: DataFrame, committed: DataFrame | None = None, keys: DataFrame | None = None, check: bool = True) -> DataFrame:
    """segs: node_key, ordinal, label, byte_start, byte_len, depth, importance. Replaces each key's set.

    Importance that was scored by a model stays with its heading (same key and label) if
    `committed`, the current segments, has it. keys: those whose set is empty, too.
    """
    if check:
        _refuse(segs, ~label_fits(F.col("label")), "a label has more than 2048 bytes")
        _refuse(segs.groupBy("node_key").count(), F.col("count") > S.MAX_SEGMENTS, "more than 128 segments")
    rows = segs.withColumn("depth", F.greatest("depth", F.lit(1)))
    if committed is not None:
        scored = committed.where("llm_scored").groupBy("node_key", "label").agg(F.min_by("importance", "ordinal").alias("given"))
        rows = rows.join(scored, ["node_key", "label"], "left")
    else:
        rows = rows.withColumn("given", F.lit(None).cast("int"))
    one = F.struct("ordinal", "label", "byte_start", "byte_len", "depth", F.coalesce("given", "importance").alias("importance"), F.col("given").isNotNull().alias("llm_scored"))
    sets = rows.groupBy("node_key").agg(F.array_sort(F.collect_list(one)).alias("all"))  # 128 at most
    if keys is not None:
        sets = keys.select("node_key").distinct().join(sets, "node_key", "left")
    bare = F.transform(F.coalesce("all", F.array().cast("array<struct<ordinal:int,label:string,byte_start:bigint,byte_len:bigint,depth:int,importance:int,llm_scored:boolean>>")), lambda s: s.dropFields("ordinal"))
    return operation(sets, "segments", segs=bare)


def capped_edges(edges: DataFrame, committed: DataFrame | None = None, enrich: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """The edges that each source keeps: EDGES columns. keys: sources that may have no new edges, too.

    edges: src_key, pos, dst_key, etype, weight. Self-loops go, the first of equal targets
    stays, at most 64 in document order; the other tier's committed edges follow while
    there is room.
    """
    first = edges.where("src_key <> dst_key").groupBy("src_key", "dst_key").agg(F.min_by(F.struct("pos", "etype", "weight"), "pos").alias("e"))
    new = first.select(
        "src_key", F.lit(0).alias("turn"), F.col("e.pos").alias("place"), "dst_key", F.col("e.etype").alias("etype"), F.lit(enrich).alias("tier_enrich"),
        (F.col("e.etype") == S.RELATED).alias("inferred"), F.col("e.weight").alias("weight"),
    )
    if committed is not None:
        sources = edges.select("src_key")
        if keys is not None:
            sources = sources.unionByName(keys.select(F.col("node_key").alias("src_key")))
        other = committed.where(F.col("tier_enrich") != F.lit(enrich)).join(sources.distinct(), "src_key", "left_semi").join(new, ["src_key", "dst_key"], "left_anti")
        new = new.unionByName(other.select("src_key", F.lit(1).alias("turn"), F.col("dst_key").bitwiseXOR(F.lit(-(1 << 63))).alias("place"), "dst_key", "etype", "tier_enrich", "inferred", "weight"))
    order = W.partitionBy("src_key").orderBy("turn", "place", "dst_key")
    return new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= S.MAX_EDGES).drop("turn", "place", "n")


def set_edges(edges: DataFrame, committed: DataFrame | None = None, enrich: bool = False, keys: DataFrame | None = None) -> DataFrame:
    one = F.struct(F.col("dst_key").bitwiseXOR(F.lit(-(1 << 63))).alias("o"), "dst_key", "etype", "tier_enrich", "inferred", "weight")
    sets = capped_edges(edges, committed, enrich, keys).groupBy(F.col("src_key").alias("node_key")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    if keys is not None:
        sets = keys.select("node_key").distinct().join(sets, "node_key", "left")
        empty = F.array().cast("array<struct<o:bigint,dst_key:bigint,etype:int,tier_enrich:boolean,inferred:boolean,weight:int>>")
        sets = sets.withColumn("all", F.coalesce("all", empty))
    return operation(sets, "edges", edges=F.transform("all", lambda e: e.dropFields("o")))


def touch(touches: DataFrame, nodes: DataFrame, how: Freshness = Freshness(), check: bool = True) -> DataFrame:
    """touches: node_key, checked_at_ms, outcome, content_hash, etag (pos, if a key comes twice: the last wins).

    Keys that are no committed nodes give nothing. Each row carries the full new state.
    """
    if check:
        _refuse(touches, ~label_fits(F.col("etag")), "an etag has more than 2048 bytes")
    t = touches if "pos" in touches.columns else touches.withColumn("pos", F.lit(0))
    t = t.select(F.col("node_key"), F.struct("pos", "checked_at_ms", "outcome", "content_hash", "etag").alias("t"))
    both = t.join(nodes.select("node_key", "interval_s", "checks", "changes", "last_change_ms", F.col("content_hash").alias("own_hash"), F.col("etag").alias("own_etag")), "node_key")
    more = lambda c: F.least(F.col(c) + 1, F.lit(S.COUNTER_MAX))
    changed = F.col("t.outcome") == S.CHANGED
    state = F.struct(
        F.col("t.checked_at_ms").alias("fetched_at_ms"), how.next_interval(F.greatest("interval_s", F.lit(1)), F.col("t.outcome")).alias("interval_s"),
        more("checks").alias("checks"), F.when(changed, more("changes")).otherwise(F.col("changes")).alias("changes"),
        F.when(changed, F.col("t.checked_at_ms")).otherwise(F.col("last_change_ms")).alias("last_change_ms"),
        F.coalesce("t.content_hash", "own_hash").alias("content_hash"), F.coalesce("t.etag", "own_etag").alias("etag"),
        (F.col("t.outcome") == S.GONE).alias("tombstone"),
    )
    return operation(both, "touch", F.col("t.pos"), touch=state)


def set_importance(scores: DataFrame, check: bool = True) -> DataFrame:
    """scores: node_key, scores array<struct<ordinal, importance>>."""
    if check:
        _refuse(scores, F.size("scores") > S.MAX_SCORES, "more than 128 importance overrides")
    return operation(scores, "scores", scores=F.col("scores"))


def set_pinned(pins: DataFrame, nodes: DataFrame, upserts: DataFrame | None = None) -> DataFrame:
    """pins: node_key, pinned. A key neither committed nor upserted in the batch gives nothing."""
    known = nodes.select("node_key")
    if upserts is not None:
        known = known.unionByName(upserts.select("node_key"))
    return operation(pins.join(known.distinct(), "node_key", "left_semi"), "pin", pin=F.col("pinned"))


def remove(keys: DataFrame) -> DataFrame:
    return operation(keys, "remove")


def enrichment(proposals: DataFrame, committed_edges: DataFrame) -> list[DataFrame]:
    """proposals: node_key, scores, related array<struct<dst_key, weight, confidence>>. Sure ones become edges."""
    scored = set_importance(proposals.where("scores is not null and size(scores) > 0"))
    sure = proposals.select(F.col("node_key").alias("src_key"), F.posexplode("related").alias("pos", "r")).where("r.confidence >= 0.5")
    edges = sure.select("src_key", "pos", "r.dst_key", F.lit(S.RELATED).alias("etype"), proposed_weight(F.col("r.weight"), F.col("r.confidence")).alias("weight"))
    return [scored, set_edges(edges, committed_edges, enrich=True)]
