"""Graph analytics of a compaction: degrees, PageRank, its thousandths, communities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import LINK
from ..sources.tables import freed, numbered, unsigned, written

DAMPING, ROUNDS, SWEEPS, MUTED = 0.85, 20, 10, 3
#: Up to so many links and nodes PageRank and communities run as one array program on the driver (16 bytes each).
LOCAL_LINKS = 200_000
#: Up to so many nodes PageRank keeps one number a node on the driver and in each worker, and the links in a table; beyond, its rounds are joins.
HELD_NODES = 50_000_000


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_key, out_degree, in_degree, degree over edges of all types."""
    ends = edges.select(F.col("src_key").alias("node_key"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst_key").alias("node_key"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    n = ends.groupBy("node_key").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("node_key").join(n, "node_key", "left").select("node_key", zero("out_degree"), zero("in_degree"), (F.coalesce("out_degree", F.lit(0)) + F.coalesce("in_degree", F.lit(0))).cast("long").alias("degree"))


def value_at(degree: DataFrame, share: int) -> int | None:
    """The degree at place min(n * share / 100, n - 1) of all in ascending order, from their histogram."""
    rows = sorted((r["degree"], r["count"]) for r in degree.groupBy("degree").count().collect())  # one row per distinct degree
    n = sum(c for _, c in rows)
    at, seen = min(n * share // 100, n - 1), 0
    for value, count in rows:
        seen += count
        if seen > at:
            return value
    return None


def hub_threshold(degree: DataFrame) -> int:
    """The degree from which on a node is a hub: the 99th hundredth, 8 at least; none in an empty graph."""
    found = value_at(degree, 99)
    return (1 << 63) - 1 if found is None else max(8, found)


def _lost(rank: DataFrame) -> float:
    """The rank of nodes without links, which all share."""
    return rank.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]


def pagerank(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_LINKS, held: int = HELD_NODES) -> DataFrame:
    """node_key, rank after 20 rounds over links alone, dangling mass spread evenly.

    Up to `local` links and nodes on the driver, up to `held` nodes with links in a table, else as joins.
    """
    links = edges.where(F.col("etype") == LINK).select("src_key", "dst_key")
    ids = nodes.select("node_key")
    spark = nodes.sparkSession
    n = ids.count()
    if not n:
        return ids.select("node_key", F.lit(0.0).alias("rank"))
    if n <= local and links.count() <= local:
        keys = np.sort(ids.toArrow()["node_key"].to_numpy().view(np.uint64))
        held = links.toArrow()
        src, dst = (np.searchsorted(keys, held[c].to_numpy().view(np.uint64)) for c in ("src_key", "dst_key"))
        out = np.bincount(src, minlength=n)
        rank = np.full(n, 1 / n)
        for _ in range(ROUNDS):
            share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
            rank = (1 - DAMPING) / n + DAMPING * (np.bincount(dst, share[src], n) + rank[out == 0].sum() / n)
        return spark.createDataFrame(pd.DataFrame({"node_key": keys.view(np.int64), "rank": rank}))
    if n <= held:
        return _ranked(ids, links, n)
    out = links.groupBy(F.col("src_key").alias("node_key")).agg(F.count("*").alias("out"))
    links = written(links.join(out, F.col("src_key") == F.col("node_key")).select("src_key", "dst_key", "out"), "links")
    rank = written(ids.join(out, "node_key", "left").select("node_key", "out", F.lit(1 / n).alias("rank")), "rank")
    lost = _lost(rank)
    for _ in range(ROUNDS):
        given = links.join(rank.select(F.col("node_key").alias("src_key"), "rank"), "src_key").groupBy(F.col("dst_key").alias("node_key")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        last = rank
        new = (1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + lost / n)
        rank = written(rank.select("node_key", "out").join(given, "node_key", "left").select("node_key", "out", new.alias("rank")), "rank")
        lost = _lost(rank)  # read from the written round, so that no join runs twice
        freed(last)
    return rank.select("node_key", "rank")


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked key among the sorted keys, -1 for one that isn't there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _given(u, row, v, share):
    return u, np.bincount(row, share[v], len(u))


def _ranked(ids: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """PageRank's rounds over one table of each node's incoming links, written once; only ranks travel."""
    keys = np.sort(ids.toArrow()["node_key"].to_numpy().view(np.uint64))
    sent = ids.sparkSession.sparkContext.broadcast(keys)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(sent.value, batch[c].to_numpy().view(np.uint64)), pa.int64()) for c in ("src_key", "dst_key")], names=["src", "dst"])

    pairs = written(links.mapInArrow(dense, "src bigint, dst bigint").where("src >= 0"), "links")
    counts = pairs.groupBy("src").count().toArrow()
    out = np.zeros(n, dtype=np.int64)
    out[counts["src"].to_numpy()] = counts["count"].to_numpy()
    near = written(pairs.where("dst >= 0").groupBy(F.col("dst").alias("u")).agg(F.collect_list(F.col("src").cast("int" if n < 1 << 31 else "bigint")).alias("near")), "near")
    freed(pairs)
    rank = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        share, got = np.divide(rank, out, out=np.zeros(n), where=out > 0), np.zeros(n)
        _round(near, [share], _given, got)
        rank = (1 - DAMPING) / n + DAMPING * (got + rank[out == 0].sum() / n)
    freed(near)
    last = ids.sparkSession.sparkContext.broadcast(rank)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["node_key"], pa.array(last.value[_places(sent.value, batch["node_key"].to_numpy().view(np.uint64))])], names=["node_key", "rank"])

    found = written(ids.mapInArrow(named, "node_key bigint, rank double"), "rank")
    sent.destroy()
    last.destroy()
    return found


def permille(rank: DataFrame, degree: DataFrame) -> DataFrame:
    """node_key, permille: the place by rank in thousandths; 0 below two edges."""
    n = rank.count()
    placed = numbered(rank.select("node_key", F.round("rank", 12).alias("rank")), [F.col("rank"), unsigned(F.col("node_key"))], "place")
    share = F.floor(F.col("place") * 1000 / F.lit(max(n - 1, 1))) if n > 1 else F.lit(1000)
    return placed.join(degree, "node_key").select("node_key", F.when(F.col("degree") < 2, 0).otherwise(share).cast("int").alias("permille"))


def _sweeps(group: pd.DataFrame) -> pd.DataFrame:
    """All sweeps of label propagation in one component, from edges (u, v, w, muted ends)."""
    ids = np.unique(np.concatenate([group["u"].to_numpy(), group["v"].to_numpy()]))
    near: list[list[tuple[int, float]]] = [[] for _ in ids]
    u, v = np.searchsorted(ids, group["u"].to_numpy()), np.searchsorted(ids, group["v"].to_numpy())
    muted = np.zeros(len(ids), dtype=bool)
    muted[u], muted[v] = group["u_hub"].to_numpy(), group["v_hub"].to_numpy()
    order = np.lexsort((v, u))
    for a, b, w in zip(u[order].tolist(), v[order].tolist(), group["w"].to_numpy()[order].tolist(), strict=True):
        near[a].append((b, w))
        near[b].append((a, w))
    label, rows = list(range(len(ids))), []
    for sweep in range(SWEEPS):
        changed = False
        for one, own in enumerate(near):
            votes: dict[int, float] = {}
            for other, w in own:
                if sweep >= MUTED or not muted[other]:
                    votes[label[other]] = votes.get(label[other], 0.0) + w
            if votes:
                best = min(votes, key=lambda k: (-votes[k], k))
                changed |= best != label[one]
                label[one] = best
        rows.append(pd.DataFrame({"id": ids, "sweep": sweep, "label": ids[label], "changed": changed}))
    return pd.concat(rows)


def communities(ids: DataFrame, edges: DataFrame, local: int = LOCAL_LINKS, depth: int = 16, fits: int = LOCAL_LINKS) -> DataFrame:
    """ids: node_key, node_id. Returns node_key, community (smallest member's id), community_key.

    Sweeps are sequential in id order by definition: a node's label depends on those that
    nodes before it got in the same sweep. Up to LOCAL_LINKS edges are swept as one graph on
    the driver. Beyond that by levels: nodes to which the longest chain of links that rises in
    ids has the same length are independent of each other. Links stay in a table of one row a
    node; the driver and every worker hold one label, level and flag a node (9 bytes), and no
    link. A graph of more than `depth` levels has its components of up to `fits` edges swept in
    a task each, and all others by levels; the first sweep in which nothing changed anywhere is
    the last for all.
    """
    pair = edges.join(ids.select(F.col("node_key").alias("src_key"), F.col("node_id").alias("u")), "src_key").join(ids.select(F.col("node_key").alias("dst_key"), F.col("node_id").alias("v")), "dst_key")
    exact = F.greatest("weight", F.lit(1)).cast("long") * F.when(F.col("inferred"), 6).otherwise(10)  # strength in whole numbers, whose sums have no order
    pair = written(pair.select("u", "v", exact.alias("w")), "pairs")
    n = ids.count()
    if n <= local and pair.count() <= local:
        held = pair.toPandas()
        deg = np.bincount(held["u"], minlength=n) + np.bincount(held["v"], minlength=n)
        cut = max(8, int(np.sort(deg)[min(n * 95 // 100, n - 1)])) if n else 8
        held["u_hub"], held["v_hub"] = deg[held["u"]] >= cut, deg[held["v"]] >= cut
        label = np.arange(n)
        if len(held):
            swept = _sweeps(held)
            moving = swept.groupby("sweep")["changed"].any()
            last = next((k for k in range(SWEEPS) if not moving[k]), SWEEPS - 1)
            swept = swept[swept["sweep"] == last]
            label[swept["id"]] = swept["label"]
        low = np.full(n, n)
        np.minimum.at(low, label, np.arange(n))
        found = ids.sparkSession.createDataFrame(pd.DataFrame({"node_id": np.arange(n), "community": low[label]}), "node_id bigint, community bigint")
        top = ids.select(F.col("node_id").alias("community"), F.col("node_key").alias("community_key"))
        return ids.join(found, "node_id").join(top, "community").select("node_key", "community", "community_key")
    degree = ids.select(F.col("node_id").alias("node_key")).join(pair.select(F.explode(F.array("u", "v")).alias("node_key")).groupBy("node_key").count(), "node_key", "left")
    degree = written(degree.select("node_key", F.coalesce("count", F.lit(0)).alias("degree")), "degree")
    cut = max(8, value_at(degree, 95) or 0)
    muted = np.zeros(n, dtype=bool)
    muted[degree.where(F.col("degree") >= cut).select("node_key").toArrow()["node_key"].to_numpy()] = True
    near = _near(pair, n)
    level, deep = _levels(near, n, depth)
    moving: dict[int, bool] = {}
    swept = None
    if deep:  # chains of links in the order of ids: components that fit in a task are swept there, the others by levels, however many
        part = connected(pair.select(F.col("u").alias("a"), F.col("v").alias("b")))
        rows = pair.join(part.select(F.col("node").alias("u"), "component"), "u")
        large = rows.groupBy("component").count().where(F.col("count") > fits).select("component")
        hub = degree.select("node_key", (F.col("degree") >= cut).alias("hub"))
        own = rows.join(large, "component", "left_anti")
        own = own.join(hub.select(F.col("node_key").alias("u"), F.col("hub").alias("u_hub")), "u").join(hub.select(F.col("node_key").alias("v"), F.col("hub").alias("v_hub")), "v")
        swept = written(own.select("component", "u", "v", "w", "u_hub", "v_hub").groupBy("component").applyInPandas(lambda g: _sweeps(g), "id bigint, sweep int, label bigint, changed boolean"), "sweeps")
        moving = {r["sweep"]: r["any"] for r in swept.groupBy("sweep").agg(F.max("changed").alias("any")).collect()}
        near = _near(rows.join(large, "component", "left_semi"), n)
        level, _ = _levels(near, n, n)
    label, last = _swept_by_levels(near, level, muted, moving)
    if swept is not None:
        held = swept.where(F.col("sweep") == last).select("id", "label").toArrow()
        label[held["id"].to_numpy()] = held["label"].to_numpy()
    low = np.full(n, n, dtype=label.dtype)
    np.minimum.at(low, label, np.arange(n, dtype=label.dtype))
    sent = ids.sparkSession.sparkContext.broadcast(low[label])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["node_key"], pa.array(sent.value[batch["node_id"].to_numpy()], pa.int64())], names=["node_key", "community"])

    found = written(ids.select("node_key", "node_id").mapInArrow(named, "node_key bigint, community bigint"), "communities")
    sent.destroy()
    top = ids.select(F.col("node_id").alias("community"), F.col("node_key").alias("community_key"))
    return found.join(top, "community").select("node_key", "community", "community_key")


def _near(pair: DataFrame, n: int) -> DataFrame:
    """u, near: each node's links in both directions, in one row. No row is longer than the links of one node."""
    kind = "int" if n < 1 << 31 else "bigint"
    both = pair.select("u", "v", "w").unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return written(both.groupBy("u").agg(F.collect_list(F.struct(F.col("v").cast(kind).alias("v"), F.col("w").cast("int").alias("w"))).alias("near")), "near")


def _links(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """u, and (row of u, v, w; or v alone) of each link, for runs of rows with about so many links."""
    lists = batch["near"]
    at, u = lists.offsets.to_numpy(), batch["u"].to_numpy()
    fields = [lists.values.field(c).to_numpy() for c in ("v", "w")] if pa.types.is_struct(lists.type.value_type) else [lists.values.to_numpy()]
    low = 0
    while low < len(u):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        part = slice(at[low], at[high])
        yield u[low:high], np.repeat(np.arange(high - low), np.diff(at[low : high + 1])), *[x[part] for x in fields]
        low = high


def _round(near: DataFrame, vectors: list[np.ndarray], step: Callable, into: np.ndarray) -> int:
    """Puts what `step` finds into the vector: (u, row, v, w, *vectors) gives the nodes that change, and their values. One job."""
    sent = near.sparkSession.sparkContext.broadcast(vectors)
    kind, name = (pa.float64(), "double") if into.dtype.kind == "f" else (pa.int64(), "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _links(batch):
                ids, values = step(*part, *sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, kind)], names=["id", "value"])

    got = near.select("u", "near").mapInArrow(run, f"id bigint, value {name}").toArrow()
    sent.destroy()
    into[got["id"].to_numpy()] = got["value"].to_numpy()
    return got.num_rows


def _higher(u, row, v, w, level):
    """Nodes whose level is not yet one above the highest of their smaller neighbours."""
    best = np.zeros(len(u), dtype=level.dtype)
    np.maximum.at(best, row, np.where(v < u[row], level[v] + 1, 0))
    moved = best != level[u]
    return u[moved], best[moved]


def _levels(near: DataFrame, n: int, most: int) -> tuple[np.ndarray, bool]:
    """Each node's level: the length of the longest chain of links that rises in ids up to it; and whether it is not known after `most` rounds."""
    level = np.zeros(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    for _ in range(most + 1):
        if not _round(near, [level], _higher, level):
            return level, False
    return level, True


def _voted(u, row, v, w, label, muted):
    """Nodes whose neighbours' labels give them another one: the most votes, then the smallest label."""
    if muted is not None:
        heard = ~muted[v]
        row, v, w = row[heard], v[heard], w[heard]
    if not len(row):
        return u[:0], u[:0]
    key = row.astype(np.int64) * len(label) + label[v]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    votes = np.add.reduceat(w[order].astype(np.int64), first)
    at, own = np.divmod(key[first], len(label))
    order = np.lexsort((own, -votes, at))
    at, own = at[order], own[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ids, own = u[at[first]], own[first]
    moved = own != label[ids]
    return ids[moved], own[moved]


def _swept_by_levels(near: DataFrame, level: np.ndarray, muted: np.ndarray, moving: dict[int, bool]) -> tuple[np.ndarray, int]:
    """Every node's label after the last sweep, and that sweep's number. moving: sweeps in which other components change.

    Nodes of a level have no links among each other, and all smaller neighbours in lower
    levels: one level after the other gives what going through all nodes by id gives.
    """
    sent = near.sparkSession.sparkContext.broadcast(level)

    def levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["u"], batch["near"], pa.array(sent.value[batch["u"].to_numpy()], pa.int64())], names=["u", "near", "level"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.schema)
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(near.mapInArrow(levelled, f"{kinds}, level bigint").repartitionByRange(parts, "level", "u").sortWithinPartitions("level"), "levels")
    sent.destroy()
    freed(near)
    label = np.arange(len(level), dtype=level.dtype)
    top = int(level.max(initial=0))
    for sweep in range(SWEEPS):
        heard = [label, muted if sweep < MUTED else None]
        moved = sum([_round(held.where(F.col("level") == k), heard, _voted, label) for k in range(top + 1)])
        if not moved and not moving.get(sweep):
            break
    freed(held)
    return label, sweep


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a, b): the smallest node of each component.

    Alternates large-star and small-star steps until nothing changes, which takes a number
    of rounds logarithmic in practice. Only edges move, never whole components; each step's
    result is a written table, so that lineage stays short and a hub's join can be split by
    adaptive execution, and goes when the next one is there.
    """

    def low(of: DataFrame, own: bool) -> DataFrame:
        """The smallest neighbour of each u, with u itself if own."""
        return written(of.groupBy("u").agg((F.least(F.min("v"), F.col("u")) if own else F.min("v")).alias("m")), "low")

    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    pairs = written(pairs.distinct(), "edges")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = low(both, True)
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        freed(pairs, least)
        least = low(large, False)
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "small")
        freed(large, least)
        n, starts = pairs.agg(F.count("*"), F.countDistinct("u")).first()
        if n == starts and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # every node hangs on the smallest one of its component
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
