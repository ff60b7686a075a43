"""Graph lookups: neighbours, related, paths, communities, surprises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strength
from ..sources.schema import LINK
from ..sources.tables import freed, shuffles_freed, unsigned, written


def neighbors(edges: DataFrame, nodes: DataFrame, key: int) -> DataFrame:
    """A key's edges with the target's url, in unsigned key order."""
    own = edges.where(F.col("src_key") == key)
    return own.join(nodes.select(F.col("node_key").alias("dst_key"), F.col("url").alias("dst_url")), "dst_key", "left").orderBy(unsigned(F.col("dst_key")))


def related(edges: DataFrame, nodes: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """For each node_key of keys its k strongest live targets: node_key, dst_key, score, place (from 1)."""
    own = edges.join(F.broadcast(keys.select(F.col("node_key").alias("src_key"))) if _few(keys) else keys.select(F.col("node_key").alias("src_key")), "src_key")
    score = strength(F.col("weight"), F.col("inferred"), 0) + F.when(F.col("etype") == LINK, 0.25).otherwise(0.0)
    own = own.select("src_key", "dst_key", score.alias("score"))
    alive = nodes.where("not is_stub and not is_tombstone").select(F.col("node_key").alias("dst_key"))
    place = F.row_number().over(W.partitionBy("src_key").orderBy(F.desc("score"), unsigned(F.col("dst_key"))))
    return own.join(alive, "dst_key").withColumn("place", place).where(F.col("place") <= k).select(F.col("src_key").alias("node_key"), "dst_key", "score", "place")


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether df has at most so many rows, looked at no further than that."""
    return df.limit(most + 1).count() <= most


def path(edges: DataFrame, pairs: DataFrame, max_depth: int, most: int = 10_000_000) -> DataFrame:
    """pairs: from_key, to_key. Returns from_key, to_key, path: of the shortest paths the one with the smallest keys.

    For all pairs at once, from both ends: links ahead of the start meet links behind the end,
    so that no end is followed further than half the depth. Each node keeps the smallest keys
    between the end and itself. A pair that has its path is followed no further.

    Where a hop would follow more links than the graph has, and more than `most`, the pairs are
    searched in parts, one after the other; each part's tables and shuffles go when it is done.
    """
    steps = edges.select("src_key", "dst_key")
    with shuffles_freed(edges.sparkSession):
        pairs = written(pairs.select("from_key", "to_key").distinct(), "pairs")
        left = pairs.where("from_key <> to_key")
        ahead, behind = (left.select(F.col(c).alias("end"), F.col(c).alias("node")).distinct() for c in ("from_key", "to_key"))
        found = _searched(left, ahead, behind, 0, steps, max_depth, most)
    return reduce(DataFrame.unionByName, found, pairs.where("from_key = to_key").select("from_key", "to_key", F.array("from_key").alias("path")))


def _searched(left: DataFrame, ahead: DataFrame, behind: DataFrame, depth: int, steps: DataFrame, max_depth: int, most: int, part: bool = False) -> list[DataFrame]:
    """Tables of the paths of left's pairs, whose ends have been followed along `depth` links. part: of pairs dealt for the next hop."""
    found: list[DataFrame] = []
    own: dict[bool, DataFrame] = {}  # the last front of each direction that was made here
    for depth in range(depth + 1, max_depth + 1):
        back = depth % 2 == 0
        end, front, followed = ("to_key", behind, depth // 2 - 1) if back else ("from_key", ahead, depth // 2)
        parts = 1 if part or not followed else _parts(front, left.select(F.col(end).alias("end")), steps, back, most)
        if parts > 1:
            deal = F.pmod(F.xxhash64(end, F.lit(depth)), F.lit(parts))
            for k in range(parts):
                found += _searched(left.where(deal == k), ahead, behind, depth - 1, steps, max_depth, most, True)
            break
        part = False
        front = written(_followed(front, left.select(F.col(end).alias("end")), steps, followed, back), "behind" if back else "ahead")
        freed(*[own.pop(back)] if back in own else [])
        own[back] = front
        ahead, behind = (ahead, front) if back else (front, behind)
        if front.isEmpty():
            break
        here = written(_met(left, ahead, behind, depth), "met")
        if here.isEmpty():
            continue
        found.append(here)
        left = written(left.join(here, ["from_key", "to_key"], "left_anti"), "left")
        if left.isEmpty():
            break
    freed(*own.values())
    return found


def _parts(front: DataFrame, ends: DataFrame, steps: DataFrame, back: bool, most: int, small: int = 10_000) -> int:
    """In how many parts a hop is made, so that each follows about as many links as the graph has, or as `most`."""
    if front.count() <= min(small, most):
        return 1
    nodes = front.join(ends.distinct(), "end", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    links = steps.groupBy(F.col("dst_key" if back else "src_key").alias("node")).agg(F.count("*").alias("d"))
    total, follows = links.join(nodes, "node", "left").agg(F.sum("d"), F.sum(F.col("n") * F.col("d"))).first()
    return max(1, round((follows or 0) / max(total or 0, most)))  # not ceil: a part a little above is not worth two


def _met(left: DataFrame, ahead: DataFrame, behind: DataFrame, depth: int) -> DataFrame:
    """from_key, to_key, path of the pairs of left whose fronts share a node, after `depth` links in all."""
    back = depth // 2
    first, last = [f"a{k}" for k in range(1, depth - back)], [f"b{k}" for k in range(1, back)]
    met = left.join(ahead.select(F.col("end").alias("from_key"), "node", *[F.col(f"k{c[1:]}").alias(c) for c in first]), "from_key")
    met = met.join(behind.select(F.col("end").alias("to_key"), "node", *[F.col(f"k{c[1:]}").alias(c) for c in last]), ["to_key", "node"])
    between = [*first, *(["node"] if back else []), *last]
    if between:
        met = met.groupBy("from_key", "to_key").agg(F.min(F.struct(*[unsigned(F.col(c)).alias(c) for c in between])).alias("m"))
    else:
        met = met.distinct()
    return met.select("from_key", "to_key", F.array("from_key", *[unsigned(F.col(f"m.{c}")) for c in between], "to_key").alias("path"))


def _followed(front: DataFrame, ends: DataFrame, steps: DataFrame, depth: int, back: bool) -> DataFrame:
    """front (end, node and the depth - 1 keys between them, in the order of links) one link further, for ends still asked for."""
    near, far = ("dst_key", "src_key") if back else ("src_key", "dst_key")
    keys = [f"k{n}" for n in range(1, depth)]
    front = front.join(ends.distinct(), "end", "left_semi")
    if not depth:
        return front.join(steps, F.col("node") == F.col(near)).select("end", F.col(far).alias("node"))
    own = ["node", *keys] if back else [*keys, "node"]
    held = [unsigned(F.col(c)).alias(f"k{n}") for n, c in enumerate(own, 1)]
    moved = front.join(steps, F.col("node") == F.col(near)).select("end", F.col(far).alias("to"), *held)
    best = moved.groupBy("end", "to").agg(F.min("k1" if depth == 1 else F.struct(*[f"k{n}" for n in range(1, depth + 1)])).alias("m"))  # a single key is aggregated by hash
    return best.select("end", F.col("to").alias("node"), *[unsigned(F.col("m" if depth == 1 else f"m.k{n}")).alias(f"k{n}") for n in range(1, depth + 1)])


def community_summary(ranks: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """community, size (of all members), name (of the first member), members: the first keys by rank."""
    held = ranks.join(nodes.select("node_key", "title", "url"), "node_key")
    size = held.groupBy("community").agg(F.count("*").alias("size"))
    place = F.row_number().over(W.partitionBy("community").orderBy(F.desc("permille"), "node_id"))
    best = held.withColumn("place", place).where(F.col("place") <= max(top, 1))
    best = best.groupBy("community").agg(
        F.min_by(F.coalesce("title", "url"), "place").alias("name"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "node_key"))), 1, top) if top else F.array().cast("array<struct<place:int,node_key:bigint>>"), lambda x: x["node_key"]).alias("members"),
    )
    return size.join(best, "community")


def surprises(edges: DataFrame, ranks: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """src_key, dst_key, score of the k strongest links between communities.

    Each pair of communities is stood for by its first edge in (source, target) order.
    """
    of = lambda end, c: ranks.select(F.col("node_key").alias(end), F.col("community").alias(c), F.col("node_id").alias(f"{c}_id"))
    cross = edges.join(of("src_key", "a"), "src_key").join(of("dst_key", "b"), "dst_key").where("a <> b")
    score = strength(F.col("weight"), F.col("inferred"), 0)
    cross = cross.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a_id", "b_id", "src_key", "dst_key", score.alias("score"))).alias("e")).select("e.*")
    best = cross.orderBy(F.desc("score"), "a_id", "b_id").limit(k)
    here = nodes.select("node_key")
    return best.join(here, F.col("src_key") == F.col("node_key"), "left_semi").join(here, F.col("dst_key") == F.col("node_key"), "left_semi").select("src_key", "dst_key", "score")
