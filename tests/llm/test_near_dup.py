"""Near-duplicates among texts that share a template, in dense regions, in large clusters, and by row."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import near_dup


def templated(n: int, twins: int, shared: int, own: int, seed: int = 3):
    """n texts of which all share `shared` words, and twins (n + k) of some of them with 0.86 of their shingles in common."""
    dice = np.random.RandomState(seed)
    common = [f"t{k}" for k in range(shared)]
    rows = [(k, " ".join([*common, *(f"w{x}" for x in dice.randint(0, 10**9, own))])) for k in range(n)]
    size = shared + own - 2
    change = round(size * 0.14 / 1.86)  # one changed word at the end of each run of three costs three shingles
    for j, k in enumerate(dice.permutation(n)[:twins].tolist()):
        words = rows[k][1].split()
        words[-change:] = [f"x{j}y{i}" for i in range(change)]
        rows.append((n + j, " ".join(words)))
    return rows


def sets_of(rows, size=3):
    out = {}
    for k, text in rows:
        w = text.lower().split()
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return out


def brute(sets, over=85):
    low = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if low[a] != low[b] and 100 * len(x & y) >= over * len(x | y):
            one, two = sorted((low[a], low[b]))
            low = {k: one if v == two else v for k, v in low.items()}
    return low


def classes_of(spark, rows):
    signs = [(k, near_dup.signature(near_dup.shingles(t.encode(), 3)).tobytes()) for k, t in rows]
    return spark.createDataFrame(signs, "node long, pool binary")


@pytest.mark.parametrize(("shared", "own"), [(122, 60), (60, 60)])
def test_a_template_makes_no_cluster_and_hides_no_twin(spark, shared, own):
    """Texts of which a half or a third are one template (estimates of 0.5 and 0.33): clusters are the twins alone."""
    rows = templated(3000, 60, shared, own)
    clusters, _ = near_dup.candidate_clusters(classes_of(spark, rows), 85, 100)
    of = {r["node"]: r["component"] for r in clusters.collect()}
    by_size = {}
    for k, c in of.items():
        by_size.setdefault(c, set()).add(k)
    assert max(map(len, by_size.values())) <= 4
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, over=85).collect()}
    sets = sets_of(rows)
    dice = np.random.RandomState(3)
    dice.randint(0, 10**9, own * 3000)
    linked = [(k, c) for k, c in got.items() if k != c]
    assert len(linked) == 60 and all(100 * len(sets[k] & sets[c]) >= 85 * len(sets[k] | sets[c]) for k, c in linked)


def test_trees_follow_the_similarity():
    assert (near_dup.trees_in_crowds(85, 100), near_dup.trees_in_crowds(80, 100), near_dup.trees_in_crowds(100, 100)) == (40, 40, 10)


def test_dense_regions_are_compared_whole():
    """More equal keys than a region holds: pairs far from the majority and from each other in order are still met."""
    dice = np.random.RandomState(5)
    signs = dice.randint(0, 256, (700, near_dup.POOL)).astype(np.uint8)
    signs[50:500] = signs[49]
    signs[650] = signs[3]
    keys = np.zeros((700, near_dup.DEPTH), dtype=np.uint16)
    to, crowd, run, _ = near_dup.candidates(np.zeros(700, dtype=int), keys, signs, np.arange(700), 140)
    assert crowd.all() and (run == run[0]).all()
    want = np.arange(700)
    want[49:500], want[650] = 49, 3
    assert to.tolist() == want.tolist()
    known = np.arange(700)
    known[600] = 5  # of one cluster already
    to, _, _, _ = near_dup.candidates(np.zeros(700, dtype=int), keys, signs, known, 140)
    want[600] = 5
    assert to.tolist() == want.tolist()


def test_dense_regions_cut_by_borders_meet_in_blocks(spark, monkeypatch):
    """One key for all rows, in several ranges: only blocks of the region bring the pairs together."""
    monkeypatch.setattr(near_dup, "REGION", 4)
    monkeypatch.setattr(near_dup, "_DENSE_BLOCK", 16)
    dice = np.random.RandomState(6)
    pools = dice.randint(0, 65536, (200, near_dup.POOL)).astype(np.uint16)
    pools[:, near_dup.order_of(0)] = 7
    pools[170] = pools[20]
    rows = spark.createDataFrame([(k, p.tobytes()) for k, p in enumerate(pools)], "node long, pool binary").withColumn("cluster", F.col("node"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    links, crowd = near_dup.forest_links(rows, 0, 1, 140)
    assert {tuple(sorted(r)) for r in links.collect()} == {(20, 170)} and crowd.count() == 200
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Chains of near copies that fall into many blocks, confirmed in both rounds, as brute force finds them."""
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    dice = np.random.RandomState(8)
    rows = []
    for chain in range(2):
        words = [f"c{chain}w{k}" for k in range(150)]
        for step in range(40):
            rows.append((1000 * chain + step, " ".join(words)))
            at = int(dice.randint(0, 140))
            words[at : at + 2] = [f"s{chain}x{step}", f"s{chain}y{step}"]
            if step % 9 == 8:  # now and then a step just too far
                words[100:110] = [f"f{chain}x{step}y{k}" for k in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, over=85).collect()}
    want = brute(sets_of(rows))
    assert got == want and 2 < len(set(want.values())) < 40


def test_rows_are_judged_by_themselves(spark):
    """Repeated ids: no unique text goes, and of equal rows one stays, also without ids."""
    t, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "tuv")
    rows = [(1, t), (5, u), (5, t), (None, v), (None, v), (7, u), (7, u), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("x")).withColumn("row", F.lit("y"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, t), (5, u), (None, v), (9, None), (9, "")], "doc_id long, text string").collect()))
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.groups(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True), (9, 9, True)]
