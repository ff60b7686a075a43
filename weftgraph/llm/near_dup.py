"""MinHash near-duplicate groups by an LSH forest.

1. Each text becomes the set of its distinct word shingles (as 64-bit hashes), a digest
   of that set, and ``POOL`` minhashes. A tree of the forest is an order of ``DEPTH`` of them.
2. Texts with one digest have one set and are one node, so copies are never expanded
   into pairs.
3. Forest: the rows of every tree are dealt by range of their signature and sorted.
   Neighbours with a common prefix of at least ``SHALLOW`` minhashes form a region; where
   a region is larger than ``REGION``, it splits at the next minhash, and so on: depth
   adapts to each region. The rows of a region are compared pairwise. A region that is
   still larger at full depth is compared as a whole, in blocks if a border cuts it: rows
   meet the row nearest to the majority and the rows next to them, and what that leaves
   apart meets all others. Rows at borders of ranges meet once more, region by region.
   A comparison is of all ``POOL`` minhashes, one byte each, and passes from
   ``WIDE`` standard errors below the similarity asked for, so texts that merely share a
   template don't pass. What passes is joined into candidate clusters.
4. Nodes of a region that had to split stand in a crowd, where a deeper prefix is needed
   and so more trees: they run through as many further trees as the similarity asks for
   (``trees_in_crowds``), where nodes that are in one cluster already are not compared again.
5. Verification, on full sets: a cluster meets in groups of about ``BLOCK`` texts, each
   with the text that most others were joined to, and each text is shuffled once. Where that leaves
   a large cluster in several parts, the texts outside its largest part meet all of its
   texts, block by block. So every pair of a cluster is decided unless both are known to
   be connected, and no group is unbounded. A group returns a spanning set of links.
6. Components of the links give the smallest id that can be reached.

Two texts at 0.85 share two minhashes in front of one of ten trees with probability
1 - (1 - 0.85^2)^10, above 0.999997, at 0.8 above 0.99996; in a crowd they share as many as
it needs, eight at most, in front of one of its trees with 1 - ``MISS`` at least, and at
0.85 with 0.999997.

Defined cases: a text without words, empty or null, has no shingles and links with
nothing; fewer words than a shingle are one shingle. A null id links with nothing and
has a null component. Rows are judged one by one by their own text: rows that repeat an
id and a text get the same result, rows that repeat an id with another text may get
another component. Among equal texts the smallest id is kept. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

POOL, TREES, DEPTH, SHALLOW, REGION, NEXT, BLOCK = 192, 10, 8, 2, 256, 4, 120
#: Trees in a crowd at least, and the chance of missing a pair at the threshold there at the full depth.
CROWD_TREES, MISS = 40, 0.0007
#: Standard errors below the similarity asked for at which an estimate still passes.
WIDE = 4.5
_BUFFER, _DENSE_BLOCK = 40_000, 2048
LINK, BORDER, DENSE, CROWD = range(4)
_ROW = "tree int, key binary, node long, cluster long, signs binary"
_NEAR = "kind int, a long, b long, tree int, key binary, cluster long, signs binary"


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    mixed = np.full(len(own) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ own[k : len(own) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


_DICE = np.random.RandomState(20)
_TIMES = _DICE.randint(0, 2**32, size=(POOL, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = _DICE.randint(0, 2**32, size=(POOL, 1), dtype=np.uint32)
_FIRST = _DICE.permutation(POOL)[: TREES * DEPTH].reshape(TREES, DEPTH)


def order_of(tree: int) -> np.ndarray:
    """The minhashes of a tree, in order: those of the first trees don't overlap."""
    return _FIRST[tree] if tree < TREES else np.random.RandomState(1000 + tree).permutation(POOL)[:DEPTH]


def trees_in_crowds(over: int, under: int) -> int:
    """How many trees it takes that a pair at the threshold shares the full depth in one of them, but for MISS."""
    return max(CROWD_TREES, math.ceil(math.log(MISS) / math.log(1 - (over / under) ** DEPTH))) if over < under else TREES


def signature(held: np.ndarray) -> np.ndarray:
    """POOL minhashes of a set that isn't empty, the last 16 bits of each."""
    low, own = None, held.astype(np.uint32)
    for at in range(0, len(own), 1024):
        part = (own[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.uint16)


def passing(over: int, under: int) -> int:
    """How many minhashes must agree."""
    t = over / under
    return math.ceil(POOL * (t - WIDE * math.sqrt(t * (1 - t) / POOL)))


def _signed(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}  # what copies of a text need not compute again

        def of(text: bytes) -> tuple:
            key = xxhash.xxh3_128_digest(text)
            if key not in seen:
                if len(seen) >= 10_000:
                    seen.clear()
                held = shingles(text, size)
                seen[key] = (len(held), *((xxhash.xxh3_128_digest(held.tobytes()), signature(held).tobytes()) if len(held) else (None, None)))
            return seen[key]

        for batch in batches:
            found = [of(raw.as_py() or b"") for raw in batch.column(0).cast(pa.binary())]
            counts, digests, pools = zip(*found, strict=True) if found else ((), (), ())
            more = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(pools, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=[*batch.schema.names[1:], "n_shingles", "digest", "pool"])

    return sign


def _planted(first: int, n: int):
    """(node, pool, cluster) to a row for each of n trees: tree, key, node, cluster, signs."""

    def fixed(rows: np.ndarray) -> pa.Array:
        rows = np.ascontiguousarray(rows)
        width = rows.strides[0]
        return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pool = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POOL)
                signs = fixed((pool & 255).astype(np.uint8))
                for tree in range(first, first + n):
                    key = fixed(pool[:, order_of(tree)].astype(">u2"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pool), tree, np.int32)), key, batch.column(0), batch.column(2), signs], names=["tree", "key", "node", "cluster", "signs"])

    return plant


def _joined(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs (p, q)."""
    label = np.arange(n)
    while len(p):
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _alike(signs: np.ndarray, p: np.ndarray, q: np.ndarray, agree: int) -> np.ndarray:
    good = np.empty(len(p), dtype=bool)
    for a in range(0, len(p), 100_000):
        good[a : a + 100_000] = (signs[p[a : a + 100_000]] == signs[q[a : a + 100_000]]).sum(axis=1) >= agree
    return good


def together(signs: np.ndarray, agree: int, group: np.ndarray) -> np.ndarray:
    """For all rows of a dense region the first row that each is joined with, no pair left out.

    group: the first row that each is known to be joined with. Most others are joined by
    the row nearest to the majority and the rows next to them; only rows outside the
    largest part that this gives are compared with all.
    """
    n = len(signs)
    common = np.array([np.bincount(signs[:, c], minlength=256).argmax() for c in range(signs.shape[1])])
    hub = int((signs == common).sum(axis=1).argmax())
    at = np.arange(n)
    p = np.concatenate([np.full(n, hub), *(at[:-k] for k in range(1, NEXT + 1))])
    q = np.concatenate([at, *(at[k:] for k in range(1, NEXT + 1))])
    good = _alike(signs, p, q, agree)
    label = _joined(np.concatenate([p[good], at]), np.concatenate([q[good], group]), n)
    apart = np.flatnonzero(label != np.bincount(label).argmax())
    p, q = [at], [label]
    for one in apart:
        other = np.flatnonzero((signs == signs[one]).sum(axis=1) >= agree)
        p.append(np.full(len(other), one))
        q.append(other)
    return _joined(np.concatenate(p), np.concatenate(q), n)


def _first(values: np.ndarray) -> np.ndarray:
    """For each row the first row with its value."""
    _, first, at = np.unique(values, return_index=True, return_inverse=True)
    return first[at]


def candidates(tree: np.ndarray, keys: np.ndarray, signs: np.ndarray, group: np.ndarray, agree: int, most: int = REGION) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows of trees: the first row that each is joined with, which rows are crowded, and
    the numbers of the runs of equal keys and of equal shallowest prefixes. group: as for `together`."""
    n = len(tree)
    same = np.concatenate([[False], tree[1:] == tree[:-1]])
    prefix = np.zeros(n, dtype=np.int64)  # minhashes shared with the row before
    going = same.copy()
    for d in range(keys.shape[1]):
        going[1:] &= keys[1:, d] == keys[:-1, d]
        prefix += going
    region, left = np.arange(n), np.ones(n, dtype=bool)
    for depth in range(SHALLOW, keys.shape[1] + 1):
        number = np.cumsum(prefix < depth) - 1
        size = np.bincount(number)[number]
        fits = left & (size <= most)
        region[fits] = -1 - number[fits] - n * depth  # a name that no other region has
        left &= ~fits
        if depth == SHALLOW:
            crowd, wide = left.copy(), number
    at = np.arange(n)
    p, q = [at], [group]
    for k in range(1, most):
        near = (region[k:] == region[:-k]) & (region[k:] < 0)
        if not near.any():
            break
        near &= group[k:] != group[:-k]
        a, b = at[:-k][near], at[k:][near]
        good = _alike(signs, a, b, agree)
        p.append(a[good])
        q.append(b[good])
    for one in np.unique(number[left]):
        rows = np.flatnonzero(number == one)
        p.append(rows)
        q.append(rows[together(signs[rows], agree, _first(group[rows]))])
    return _joined(np.concatenate(p), np.concatenate(q), n), crowd, number, wide


def _forest(agree: int, most: int, crowds: bool = True):
    """Sorted rows of _ROW to rows of _NEAR: links that join clusters, crowded nodes, and what has to meet again.

    The ranges next to a partition may hold more of its first and its last region: of these
    the 2 * most rows at the border meet once more, and of a dense one all rows.
    """

    def raw(rows: pa.Table, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(rows.num_rows, -1)

    def out(kind: int, a, b=None, rows: pa.Table | None = None) -> pa.RecordBatch:
        n = len(a)
        kinds = {"tree": pa.int32(), "key": pa.binary(), "cluster": pa.int64(), "signs": pa.binary()}
        more = [pa.nulls(n, x) if rows is None else rows[c].combine_chunks().cast(x) for c, x in kinds.items()]
        b = pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), b, *more], names=["kind", "a", "b", *kinds])

    def found(rows: pa.Table, start: bool, stop: bool) -> Iterator[pa.RecordBatch]:
        n, nodes, group = rows.num_rows, rows["node"].to_numpy(), _first(rows["cluster"].to_numpy())
        to, crowd, run, wide = candidates(rows["tree"].to_numpy(), raw(rows, "key", ">u2"), raw(rows, "signs", np.uint8), group, agree, most)
        at = np.arange(n)
        linked = np.flatnonzero((group == at) & (to != at))  # a link for each cluster that is joined to another
        yield out(LINK, nodes[linked], nodes[to[linked]])
        if crowds:
            yield out(CROWD, np.unique(nodes[crowd]))
        border = (start & (wide == wide[0]) & (at < 2 * most)) | (stop & (wide == wide[-1]) & (at >= n - 2 * most))
        dense = np.zeros(n, dtype=bool)
        for one in (run[0], run[-1]):
            if (run == one).sum() > most:
                dense |= run == one
        for kind, some in ((BORDER, border), (DENSE, dense & ~border)):
            if some.any():
                yield out(kind, nodes[some], rows=rows.take(np.flatnonzero(some)))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        start = True
        for batch in batches:
            if sum(x.num_rows for x in held) >= _BUFFER:
                rows = pa.Table.from_batches(held)
                yield from found(rows, start, False)
                start = False
                held = rows.slice(rows.num_rows - 2 * most).to_batches()  # the last rows meet those that follow
            held.append(batch)
        if held and sum(x.num_rows for x in held):
            yield from found(pa.Table.from_batches(held), start, True)

    return forest


def _blocks(agree: int):
    """Rows of two blocks of a dense region to links."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, group = rows["node"].to_numpy(), _first(rows["cluster"].to_numpy())
        to = together(np.frombuffer(b"".join(map(bytes, rows["signs"])), np.uint8).reshape(len(nodes), -1), agree, group)
        linked = np.flatnonzero((group == np.arange(len(nodes))) & (to != np.arange(len(nodes))))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[to[linked]]})

    return meet


def _paired(rows: DataFrame, key: list[str], node: str, block: int) -> DataFrame:
    """rows of each key in blocks, each pair of blocks once: columns low and high are added."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "own", "other")


def forest_links(classes: DataFrame, first: int, n: int, agree: int, crowds: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candidate links (a, b) of n trees over (node, pool, cluster) between clusters, and, if asked for, the crowded nodes."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("node", "pool", "cluster").mapInArrow(_planted(first, n), _ROW)
    rows = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    near = stored(rows.mapInArrow(_forest(agree, REGION, crowds), _NEAR), "near")
    # regions that a border of ranges cuts: the rows at all borders meet by region
    again = near.where(F.col("kind").isin(BORDER, DENSE)).select("kind", "tree", "key", F.col("a").alias("node"), "cluster", "signs")
    cut = again.where(F.col("kind") == BORDER).drop("kind").repartition(parts, "tree", F.substring("key", 1, 2 * SHALLOW))
    across = stored(cut.sortWithinPartitions("tree", "key", "node").mapInArrow(_forest(agree, REGION, crowds), _NEAR), "across")
    dense = again.join(again.where(F.col("kind") == DENSE).select("tree", "key").distinct(), ["tree", "key"], "left_semi")
    dense = _paired(dense, ["tree", "key"], "node", _DENSE_BLOCK)
    dense = stored(dense.groupBy("tree", "key", "low", "high").applyInPandas(_blocks(agree), "a long, b long"), "dense")
    both = near.unionByName(across)
    links = both.where(F.col("kind") == LINK).select("a", "b").unionByName(dense)
    return links, both.where(F.col("kind") == CROWD).select(F.col("a").alias("node")).distinct()


def linked_rows(sets: list[np.ndarray], over: int, under: int) -> np.ndarray:
    """For each set the first one it reaches by links: under * intersection >= over * union."""
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], place[shared]
    both = np.zeros((n, n), dtype=np.int64)
    columns, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, len(columns), 8192):
        a, b = np.searchsorted(place, [at, at + 8192])
        held = np.zeros((n, min(8192, len(columns) - at)), dtype=np.float32)
        held[owner[a:b], place[a:b] - at] = 1
        both += (held @ held.T).astype(np.int64)
    links = under * both >= over * (size[:, None] + size[None, :] - both)
    p, q = np.nonzero(np.triu(links, 1))
    return _joined(p, q, n)


def _verified(size: int, over: int, under: int):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        for node, digest, text in zip(group["node"], group["digest"], group["text"], strict=True):
            if node not in sets:
                own = shingles((text or "").encode(), size)
                if len(own) and xxhash.xxh3_128_digest(own.tobytes()) == bytes(digest):
                    sets[node] = own
        if not sets:
            return pd.DataFrame({"a": [], "b": []})
        nodes = np.array(sorted(sets), dtype=np.int64)
        to = linked_rows([sets[k] for k in nodes.tolist()], over, under)
        linked = nodes[to] != nodes
        return pd.DataFrame({"a": nodes[linked], "b": nodes[to[linked]]})

    return verify


def marked(base: DataFrame, ids: DataFrame, own: str = "id") -> DataFrame:
    """base with a column `marked`: whether the row's id may be among ids, and false only if it isn't.

    By a bitmap of 2^26 bits, 16 MB at most, however many ids there are; no row of base is shuffled.
    """
    spot = F.pmod(F.xxhash64(own), F.lit(1 << 26))
    marks = ids.select(F.shiftright(spot, 6).alias("word"), F.expr(f"1L << cast(pmod(xxhash64({own}), 64) as int)").alias("bit"))
    marks = stored(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")
    held = base.select("*", F.shiftright(spot, 6).alias("word")).join(F.broadcast(marks), "word", "left")
    found = F.expr(f"coalesce((bits >> cast(pmod(xxhash64({own}), 64) as int)) & 1L = 1L, false)")
    return held.select(*base.columns, found.alias("marked"))


def confirmed(texts: Callable[[DataFrame], DataFrame], clusters: DataFrame, links: DataFrame, verify) -> DataFrame:
    """(node, component) over the links that full sets confirm. texts adds digest and text to rows with a node; clusters: node, component."""
    blocks = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(blocks, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stored(placed.select("node", "component", "blocks", "part"), "placed")
    large = placed.where("blocks > 1")
    # every group of a large cluster also has the text that most others were joined to
    ends = links.groupBy(F.col("b").alias("node")).count()
    hubs = large.join(ends, "node").groupBy("component", "blocks").agg(F.max_by("node", F.struct("count", "node")).alias("node"))
    hubs = hubs.select("node", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))

    def met(rows: DataFrame, key: list[str], label: str) -> DataFrame:
        return stored(texts(rows).select(*key, "node", "digest", "text").groupBy(*key).applyInPandas(verify, "a long, b long"), label)

    first = met(placed.select("node", "component", "part").unionByName(hubs.select("node", "component", "part")), ["component", "part"], "links")
    found = stored(components(first), "found")
    reach = large.join(found.select("node", F.col("component").alias("reached")), "node", "left").withColumn("reached", F.coalesce("reached", "node"))
    most = reach.groupBy("component", "reached").count().groupBy("component").agg(F.max_by("reached", F.struct("count", "reached")).alias("most"))
    apart = stored(reach.join(most, "component").where("reached <> most").select("node", "component", "blocks", "part"), "apart")
    if apart.isEmpty():
        return found
    rows = apart.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    rows = stored(rows, "rows")
    probes = apart.join(rows, "component").withColumn("row", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"))
    probes = probes.select("node", "component", "row", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    others = placed.join(rows, "component").select("node", "component", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "part")
    second = met(probes.unionByName(others.select("node", "component", "row", "part")), ["component", "row", "part"], "links")
    return stored(components(first.unionByName(second)), "found")


def candidate_clusters(classes: DataFrame, over: int, under: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the candidate clusters over (node, pool), and the links behind them."""
    agree, more = passing(over, under), trees_in_crowds(over, under) - TREES
    links, crowd = forest_links(classes.withColumn("cluster", F.col("node")), 0, TREES, agree)
    clusters, crowd = stored(components(links), "clusters"), stored(crowd, "crowd")
    if not more or crowd.isEmpty():
        return clusters, links
    known = classes.join(crowd, "node", "left_semi").join(clusters, "node", "left")
    links = links.unionByName(forest_links(known.withColumn("cluster", F.coalesce("component", "node")), TREES, more, agree, False)[0])
    return stored(components(links), "clusters"), links


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
           over: int = 80, under: int = 100, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, and the columns of `also`.

    Links documents with under * intersection >= over * union of their shingle sets.
    """
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    named = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"also_{c}") for c in also])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[1:])
    signed = stored(named.mapInArrow(_signed(shingle), f"{kept}, n_shingles long, digest binary, pool binary"), "signed")
    real = signed.where("doc_id is not null and digest is not null")
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("pool").alias("pool"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    clusters, links = candidate_clusters(classes, over, under)
    wanted = stored(clusters.select("node").join(classes.select("node", "id", "digest"), "node"), "wanted")

    def texts(rows: DataFrame) -> DataFrame:
        asked = stored(rows.join(wanted, "node"), "asked")
        return marked(base, asked).where("marked").select("id", "text").join(asked, "id")  # texts that nothing asks for aren't shuffled

    found = confirmed(texts, clusters, links, _verified(shingle, over, under))

    reach = classes.select("digest", "node", "id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    reach = stored(reach.select("digest", "id", "component"), "reach")
    lowest = reach.groupBy("component").agg(F.min("id").alias("reached"))
    reach = stored(reach.join(lowest, "component").select("digest", "reached"), "reached")
    out = signed.drop("pool").withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))).join(reach, "digest", "left")
    return out.select(
        "doc_id", *[F.col(f"also_{c}").alias(c) for c in also], "n_shingles", F.coalesce("reached", "doc_id").alias("component_id"),
        F.coalesce("reached", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )
