import pytest
from graph_fixtures import doc, edges, site, touches

from weftgraph import Config, Store
from weftgraph.errors import CorruptError, FormatError, LockedError, ReadOnlyError, StoreIOError
from weftgraph.functions.ttl import Freshness


@pytest.fixture
def store(spark, tmp_path):
    with Store.create(spark, str(tmp_path / "s")) as s:
        yield s


def test_site_life_cycle(spark, store):
    site(spark, store)
    snap = store.snapshot()
    assert snap.nodes.count() == 3 and store.pending_ops == 3 + 2 + 3
    # nothing is indexed before a compaction, but fresh documents are found
    hits = store.query("setup loom").collect()
    assert hits[0]["node_key"] == 1 and all(h["seed"] for h in hits)
    stats = store.compact()
    assert (stats.generation, stats.nodes, stats.segments, stats.edges) == (2, 4, 4, 5)
    assert len(store) == 3 and store.pending_ops == 0
    store.snapshot().check()
    hits = store.query("setup upright").collect()
    assert (hits[0]["node_key"], hits[0]["anchor"], hits[0]["seed"]) == (1, "Setup > Upright frame", True)
    assert store.snapshot().path(2, 3) == [2, 1, 3] and store.snapshot().path(5, 5) == [5] and store.snapshot().path(2, 77) is None
    assert [r["dst_key"] for r in store.related(3, 5).collect()] == [1]  # the stub is no result
    assert [r["dst_url"] for r in store.snapshot().neighbors(3).collect()] == ["https://manual.loom.test/start", ""]
    # the snapshot taken before the compaction still reads what it read
    assert snap.nodes.count() == 3
    etags, links = store.crawl_seed()
    assert etags.count() == 3 and {r["node_key"]: r["urls"] for r in links.collect()}[3] == ["https://manual.loom.test/start"]


def test_handles(spark, store, tmp_path):
    with pytest.raises(LockedError):
        Store.open(spark, store.root)
    with pytest.raises(StoreIOError):
        Store.create(spark, store.root)
    with pytest.raises(StoreIOError):
        Store.open(spark, str(tmp_path / "none"))
    reader = Store.open_read_only(spark, store.root)
    assert not reader.reload_if_stale() and reader.is_empty()
    with pytest.raises(ReadOnlyError):
        reader.writer()
    with pytest.raises(ReadOnlyError):
        reader.compact()
    store.add(doc(spark, (1, "http://a", 1)))
    assert len(reader) == 0
    assert reader.reload_if_stale() and len(reader) == 1


def test_limits(spark, store):
    with pytest.raises(FormatError):
        store.writer().upsert_nodes(doc(spark, (1, "", 1)))
    with pytest.raises(FormatError):
        store.writer().upsert_nodes(doc(spark, (1, "http://a", 1, "é" * 1025)))
    segs = spark.createDataFrame([(1, k, f"h{k}", None, None, 1, 1) for k in range(129)], "node_key bigint, ordinal int, label string, byte_start bigint, byte_len bigint, depth int, importance int")
    with pytest.raises(FormatError):
        store.writer().set_segments(segs)
    assert store.manifest.last_seq == 0


def test_edges_keep_the_first_64_in_document_order(spark, store):
    rows = [(1, 1000 - k, 0, 5) for k in range(256)] + [(1, 1, 0, 5), (1, 1000, 0, 9)]
    store.writer().upsert_nodes(doc(spark, (1, "http://a", 1))).set_edges(edges(spark, *rows)).commit()
    got = store.snapshot().neighbors(1).collect()
    assert [r["dst_key"] for r in got] == list(range(1000 - 63, 1001)) and {r["weight"] for r in got} == {5}


def test_freshness_cycle(spark, tmp_path):
    with Store.create(spark, str(tmp_path / "t"), Config(ttl=Freshness(bias=0))) as store:
        store.add(doc(spark, (1, "http://a", 1)))
        assert store.snapshot().node(1)["interval_s"] == 21_600
        for outcome, interval, checks, changes in ((0, 32_400, 1, 0), (1, 8_100, 2, 1), (2, 900, 3, 1)):
            store.writer().touch(touches(spark, (1, 2_000_000, outcome))).commit()
            n = store.snapshot().node(1)
            assert (n["interval_s"], n["checks"], n["changes"], n["etag"], n["content_hash"]) == (interval, checks, changes, "v1", 1)
        assert store.due(now_ms=2_000_000 + 900_000).count() == 1 and store.due(now_ms=2_000_000 + 899_999).count() == 0
        assert store.touch(1, "gone", 3_000_000) and not store.touch(9, "gone", 1)
        with pytest.raises(ValueError):
            store.touch(1, "lost")
        assert store.snapshot().node(1)["is_tombstone"] and len(store) == 0
        store.compact()
        assert store.snapshot().nodes.count() == 1  # tombstones stay
        store.add(doc(spark, (1, "http://a", 1)))
        n = store.snapshot().node(1)
        assert not n["is_tombstone"] and (n["checks"], n["changes"]) == (4, 1)


def test_pins_and_removal(spark, store):
    assert not store.pin(1)
    store.add(doc(spark, (1, "http://a", 1)))
    assert store.pin(1)
    store.add(doc(spark, (1, "http://a", 2)))
    assert store.snapshot().node(1)["pinned"]
    store.compact()
    store.add(doc(spark, (1, "http://a", 3)))
    assert store.snapshot().node(1)["pinned"]
    store.unpin(1)
    assert not store.snapshot().node(1)["pinned"]
    store.writer().touch(touches(spark, (1, 5, 1))).commit()
    store.remove(1)
    assert store.snapshot().node(1) is None
    store.add(doc(spark, (1, "http://a", 3)))
    n = store.snapshot().node(1)
    assert (n["checks"], n["changes"], n["pinned"], n["interval_s"]) == (0, 0, False, 21_600)


def test_stubs_come_and_go(spark, store):
    store.writer().upsert_nodes(doc(spark, (1, "http://a", 1))).set_edges(edges(spark, (1, 7, 0, 65535))).commit()
    store.compact()
    assert store.snapshot().node(7)["is_stub"] and store.snapshot().node(7)["in_degree"] == 1
    store.add(doc(spark, (7, "http://b", 1)))
    store.compact()
    assert not store.snapshot().node(7)["is_stub"] and len(store) == 2
    store.writer().set_edges(edges(spark).limit(0), spark.createDataFrame([(1,)], "node_key bigint")).remove(spark.createDataFrame([(7,)], "node_key bigint")).commit()
    store.compact()
    assert store.snapshot().nodes.count() == 1


def test_two_cliques_make_two_communities_and_one_surprise(spark, store):
    a, b = (1, 2, 3), (11, 12, 13)
    store.add(doc(spark, *[(k, f"http://{k}", k, "Alpha" if k < 10 else "Beta") for k in a + b]))
    rows = [(x, y, 0, 65535) for g in (a, b) for x in g for y in g if x != y] + [(1, 11, 2, 200)]
    store.writer().set_edges(edges(spark, *rows)).commit()
    store.compact()
    snap = store.snapshot()
    assert snap.community_of(1) == snap.community_of(3) != snap.community_of(11) == snap.community_of(13)
    assert [(r["src_key"], r["dst_key"]) for r in snap.surprises(5).collect()] == [(1, 11)]
    found = snap.community_summary(snap.community_of(12), 2)
    assert (found["size"], found["name"], len(found["members"])) == (3, "Beta", 2)


def test_enrichment_keeps_both_tiers(spark, store):
    site(spark, store)
    store.compact()
    rows = [(1, [(0, 1234)], [(2, 10, 0.9), (3, 60000, 0.4), (99, 60000, 0.5)])]
    proposals = spark.createDataFrame(rows, "node_key bigint, scores array<struct<ordinal:int,importance:int>>, related array<struct<dst_key:bigint,weight:int,confidence:double>>")
    store.writer().apply_enrichment(proposals).commit()
    snap = store.snapshot()
    got = {r["dst_key"]: (r["tier_enrich"], r["weight"]) for r in snap.neighbors(1).collect()}
    assert got == {2: (True, 9), 99: (True, 30000), 3: (False, 65535)}
    assert [(r["importance"], r["llm_scored"]) for r in snap.segments_of(1).collect()] == [(1234, True), (31000, False)]


def test_ingest_decides_by_the_graphs_own_hash(spark, store):
    export = spark.createDataFrame(
        [(1, "http://a", 1, 10, "A", "", None, False, [2]), (2, "http://b", 2, 10, "B", "s", "e", False, [])],
        "url_key bigint, url string, content_hash bigint, fetched_at_ms bigint, title string, snippet string, etag string, pinned boolean, edges array<bigint>",
    )
    kind = "url_key bigint, change string, headings array<struct<depth:int,text:string>>, keywords array<string>"
    pages = lambda *changes: spark.createDataFrame([(k + 1, c, [(1, "Top words")], ["words"]) for k, c in enumerate(changes)], kind)
    assert store.ingest_update(pages("added", "added"), export, 50) == {"upserted": 2, "segments": 2, "edges": 1, "touched": 0, "tombstoned": 0}
    assert store.snapshot().segments_of(1).first()["importance"] == 49150
    assert store.snapshot().node(1)["snippet"] is None
    from pyspark.sql import functions as F

    moved = export.withColumn("content_hash", F.when(F.col("url_key") == 1, 9).otherwise(F.col("content_hash")))
    assert store.ingest_update(pages("added", "added"), moved, 60)["touched"] == 1
    assert [(store.snapshot().node(k)["checks"], store.snapshot().node(k)["changes"]) for k in (1, 2)] == [(1, 1), (0, 0)]
    assert store.ingest_refresh(pages("unchanged", "removed"), moved, 70) == {"upserted": 0, "segments": 0, "edges": 0, "touched": 1, "tombstoned": 1}
    assert len(store) == 1


def test_a_page_that_lost_its_links_keeps_enrichment(spark, store):
    site(spark, store)
    rows = [(1, None, [(99, 60000, 0.5)])]
    proposals = spark.createDataFrame(rows, "node_key bigint, scores array<struct<ordinal:int,importance:int>>, related array<struct<dst_key:bigint,weight:int,confidence:double>>")
    store.writer().apply_enrichment(proposals).commit()
    store.writer().set_edges(edges(spark, (1, 2, 0, 1)).limit(0), spark.createDataFrame([(1,)], "node_key bigint")).commit()
    assert [(r["dst_key"], r["tier_enrich"]) for r in store.snapshot().neighbors(1).collect()] == [(99, True)]


def test_lookups_push_their_key(spark, store):
    site(spark, store)
    store.compact()
    plan = store.snapshot().of_keys(1)._jdf.queryExecution().toString()
    assert "EqualTo(node_key,1)" in plan
    assert store.snapshot().node_by_id(0)["node_key"] == 1 and store.snapshot().node_by_id(77) is None


def test_broken_logs_and_manifests_are_refused(spark, store):
    import json
    from dataclasses import replace

    site(spark, store)
    good = store.manifest
    for bad in (replace(good, last_seq=good.last_seq + 1), replace(good, applied_seq=2)):
        store._put(bad)
        with pytest.raises(CorruptError):
            store.snapshot().ops.count()
    for bad in (replace(good, generation=7), replace(good, applied_seq=good.last_seq + 1), replace(good, nodes=-1)):
        store._put(bad)
        with pytest.raises(CorruptError):
            Store.open_read_only(spark, store.root)
    store.files.replace("manifest.json", json.dumps({"odd": 1}))
    with pytest.raises(CorruptError):
        Store.open_read_only(spark, store.root)
    store._put(good)
    assert Store.open_read_only(spark, store.root).pending_ops == good.last_seq


def test_etags_have_a_limit(spark, store):
    store.add(doc(spark, (1, "http://a", 1)))
    with pytest.raises(FormatError):
        store.touch(1, "changed", 5, None, "x" * 2049)
