"""Expressions, folding and graph operators against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.functions.ttl import Freshness, interval_after, outcome_tag
from weftgraph.operators import compact, fold, graph, rank
from weftgraph.operators import search as lookup
from weftgraph.sources import schema as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_and_terms(spark):
    row = one(spark, text.tokens(F.lit("Install: FOO_bar v2.1 — LÖWE!")).alias("t"), text.terms(F.lit("a Foo x2 foo ö b")).alias("q"), text.tokens(F.lit(None).cast("string")).alias("n"), text.searchable_url(F.lit("https://a/b://c")).alias("u"))
    assert row["t"] == ["install", "foo", "bar", "v2", "1", "löwe"] and row["q"] == ["foo", "x2", "ö"] and row["n"] == [] and row["u"] == "a/b://c"


def test_keys_are_xxh3(spark):
    import xxhash

    row = one(spark, text.url_key(F.lit("https://a")).alias("k"), text.segment_key(F.lit(5), F.lit("Top")).alias("s"))
    assert row["k"] & (2**64 - 1) == xxhash.xxh3_64_intdigest("https://a")
    assert row["s"] & (2**64 - 1) == xxhash.xxh3_64_intdigest((5).to_bytes(8, "little") + b"\x00Top")


@pytest.mark.parametrize("interval, outcome, want", [(21_600, 0, 32_400), (21_600, 1, 5_400), (1_000, 1, 900), (2_500_000, 0, 2_592_000), (5_000, 2, 900), (5_000, 3, 5_000)])
def test_next_interval(spark, interval, outcome, want):
    assert one(spark, Freshness().next_interval(F.lit(interval), F.lit(outcome)).alias("x"))["x"] == want


def test_next_check_and_sequences(spark):
    how = Freshness()
    row = one(
        spark, how.next_check_ms(F.lit(1000), F.lit(100), F.lit(1000)).alias("top"), how.next_check_ms(F.lit(1000), F.lit(100), F.lit(None)).alias("low"),
        interval_after(F.array(*[F.struct(F.lit(k).alias("outcome")) for k in (0, 1, 2, 0)])).alias("s"), outcome_tag(F.lit("Gone")).alias("g"), outcome_tag(F.lit("?")).alias("e"),
    )
    assert (row["top"], row["low"], row["s"], row["g"], row["e"]) == (51_000, 101_000, 1350, 3, 2)


def _model(ops):
    """The fold, one operation after the other."""
    new = lambda **k: {"core": None, "touch": None, "carried": None, "pinned": None, "scores": {}, "removed": False, "severed": False} | k
    state = new()
    for op, value in ops:
        if op == "remove":
            state = new(removed=True, severed=True)
        elif op == "upsert":
            before = state["core"] is not None and state["core"][1]
            if state["pinned"] is not None:
                state["pinned"] = state["pinned"] or value[1]
            elif value[1] or before:
                state["pinned"] = True
            state["carried"] = state["touch"] or state["carried"]
            state |= {"core": value, "touch": None, "removed": False}
        elif op == "touch":
            state["touch"] = value
        elif op == "pin":
            state["pinned"] = value
        else:
            state["scores"][value[0]] = value[1]
    return state


def test_fold_equals_the_sequential_model(spark):
    dice, rows, want = random.Random(7), [], {}
    for key in range(400):
        own = []
        for _ in range(dice.randint(1, 9)):
            op = dice.choice(["upsert", "upsert", "touch", "pin", "scores", "remove"])
            n = len(rows) + 1
            value = {"upsert": (n, dice.random() < 0.3), "touch": n, "pin": dice.random() < 0.5, "scores": (dice.randint(0, 2), n), "remove": None}[op]
            own.append((op, value))
            core = ("u", None, None, None, n, n, value[1]) if op == "upsert" else None
            touch = (n, 900, 1, 1, n, None, None, False) if op == "touch" else None
            rows.append((n, op, key, core, None, None, touch, value if op == "pin" else None, [value] if op == "scores" else None))
        want[key] = _model(own)
    for r in fold.fold(spark.createDataFrame(rows, S.OPS).repartition(3)).collect():
        w = want[r["node_key"]]
        assert (r["core"] and r["core"]["content_hash"]) == (w["core"] and w["core"][0])
        assert (r["touch"] and r["touch"]["fetched_at_ms"]) == w["touch"]
        if w["core"] is not None:
            assert (r["carried"] and r["carried"]["fetched_at_ms"]) == (None if w["touch"] else w["carried"])
        assert (r["pinned"], r["removed"], r["severed"]) == (w["pinned"], w["removed"], w["severed"])
        assert {s["ordinal"]: s["importance"] for s in r["scores"] or []} == w["scores"]


def _graph(spark, n, rows):
    nodes = spark.range(n).select(F.col("id").alias("node_key"))
    return nodes, spark.createDataFrame([(a, b, t, False, t == 2, w) for a, b, t, w in rows], S.EDGES)


def test_pagerank_is_the_same_both_ways(spark):
    dice = random.Random(8)
    rows = sorted({(dice.randrange(30), dice.randrange(30), 0, 5) for _ in range(90)})
    nodes, edges = _graph(spark, 32, [r for r in rows if r[0] != r[1]])
    here, there = (dict(rank.pagerank(nodes, edges, local=k).collect()) for k in (10**6, 0))
    assert abs(sum(here.values()) - 1) < 1e-12 and all(abs(here[k] - there[k]) < 1e-12 for k in here)


def test_communities_are_the_same_both_ways(spark):
    dice, rows = random.Random(9), []
    for base in (0, 40, 80):
        rows += sorted({(base + dice.randrange(30), base + dice.randrange(30), dice.choice([0, 2]), dice.randint(1, 65535)) for _ in range(70)})
    seen, kept = set(), []
    for r in rows:
        if r[0] != r[1] and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            kept.append(r)
    nodes, edges = _graph(spark, 120, kept)
    ids = nodes.withColumn("node_id", F.col("node_key"))
    here, there = ({r["node_key"]: r["community"] for r in rank.communities(ids, edges, local=k).collect()} for k in (10**6, 0))
    assert here == there and len(set(here.values())) < 120


def test_shortest_paths_have_the_smallest_keys(spark):
    dice = random.Random(10)
    rows = sorted({(dice.randrange(12), dice.randrange(12), 0, 1) for _ in range(30)})
    near = {k: sorted(b for a, b, *_ in rows if a == k and b != k) for k in range(12)}
    _, edges = _graph(spark, 12, [r for r in rows if r[0] != r[1]])
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(12)], "from_key bigint, to_key bigint")
    got = {(r["from_key"], r["to_key"]): r["path"] for r in graph.path(edges, pairs, 4).collect()}
    for a in range(4):
        best, front = {a: [a]}, [[a]]
        for _ in range(4):
            step = {}
            for p in front:
                for b in near[p[-1]]:
                    if b not in best:
                        step[b] = min(step.get(b, [99]), [*p, b])
            best |= step
            front = list(step.values())
        assert {b: p for (x, b), p in got.items() if x == a} == {b: p for b, p in best.items()}


def test_hubs_are_reached_but_not_left(spark):
    nodes, edges = _graph(spark, 5, [(0, 1, 0, 65535), (1, 2, 0, 65535), (0, 3, 2, 65535), (3, 4, 0, 0)])
    start = spark.createDataFrame([(1, 0, 10.0)], "query_id bigint, node_key bigint, score double")
    hubs = nodes.where("node_key = 1")
    got = {r["node_key"]: (round(r["arrival"], 9), r["seed"]) for r in lookup.expand(start, edges, nodes, hubs, 3).collect()}
    assert got == {0: (10.0, True), 1: (5.0, False), 3: (3.0, False), 4: (round(1.5 / 65535, 9), False)}


def test_permille_and_hub_threshold(spark):
    nodes, edges = _graph(spark, 4, [(0, 3, 0, 1), (1, 3, 0, 1), (2, 3, 0, 1), (3, 2, 0, 1)])
    degree = rank.degrees(nodes, edges)
    got = dict(rank.permille(rank.pagerank(nodes, edges), degree).collect())
    assert got == {0: 0, 1: 0, 2: 666, 3: 1000}  # a single edge leaves a node at 0
    assert rank.hub_threshold(degree) == 8 and rank.hub_threshold(degree.limit(0)) == (1 << 63) - 1


def test_compaction_is_repeatable(spark):
    docs = [(k, f"http://{k}", "t", None, None, k, 5, 0, 900, 0, 0, False, False, False) for k in range(-3, 4)]
    nodes = spark.createDataFrame(docs, "node_key bigint, url string, title string, snippet string, etag string, content_hash bigint, fetched_at_ms bigint, last_change_ms bigint, interval_s bigint, checks int, changes int, pinned boolean, is_stub boolean, is_tombstone boolean")
    edges = spark.createDataFrame([(-1, 2, 0, False, False, 5), (2, 50, 0, False, False, 5)], S.EDGES)
    made = [compact.compacted(nodes, edges, spark.createDataFrame([], S.SEGMENTS)) for _ in range(2)]
    for name in made[0]:
        assert sorted(map(str, made[0][name].collect())) == sorted(map(str, made[1][name].collect()))
    ids = {r["node_key"]: r["node_id"] for r in made[0]["ranks"].collect()}
    assert [k for k, _ in sorted(ids.items(), key=lambda x: x[1])] == [0, 1, 2, 3, 50, -3, -2, -1]  # unsigned order
    assert np.array(sorted(ids.values())).tolist() == list(range(8))
