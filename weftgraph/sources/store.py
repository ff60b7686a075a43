"""The store: immutable generations of Parquet tables, an operation log, and a manifest.

Layout: ``manifest.json``; ``gen=N/<table>``; ``ops/gen=N/batch=<first seq>``. A commit
writes one batch of the log, then replaces the manifest; a compaction writes the next
generation, then replaces the manifest. Readers see what the manifest named when their
snapshot was taken; nothing they read is ever rewritten.
"""

from __future__ import annotations

import fcntl
import json
import os
import time
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptError, LockedError, ReadOnlyError, StoreIOError
from ..functions.ttl import OUTCOMES, Freshness
from ..operators import compact, fold, fresh, graph, ingest, mutate, rank
from ..operators import search as lookup
from . import schema as S
from .tables import numbered, unsigned, written

TABLES = {"nodes": S.NODES, "segments": S.SEGMENTS, "edges": S.EDGES, "postings": S.POSTINGS, "ranks": S.RANKS}


@dataclass(frozen=True)
class Config:
    auto_compact_ops: int = S.AUTO_COMPACT_OPS
    auto_compact_bytes: int = S.AUTO_COMPACT_BYTES
    ttl: Freshness = field(default_factory=Freshness)
    communities: bool = True
    lock_lease_s: int = 86_400  # on remote folders: a lock that no commit has renewed for so long is void


@dataclass(frozen=True)
class Manifest:
    generation: int = 1
    applied_seq: int = 0
    last_seq: int = 0
    log_bytes: int = 0
    nodes: int = 0
    segments: int = 0
    edges: int = 0
    created_at_ms: int = 0


@dataclass(frozen=True)
class CompactStats:
    generation: int
    nodes: int
    segments: int
    edges: int
    bytes: int


class _Files:
    """Files beside the tables, through Hadoop's file systems, so that the path may be remote."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        new = self._path(f"{name}.new")
        stream = self.fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(new, self._path(name), options)

    def age_s(self, name: str) -> float:
        """Seconds since a file was last written; 0 if there is none."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000 if self.exists(name) else 0.0

    def touch(self, name: str) -> None:
        self.fs.setTimes(self._path(name), int(time.time() * 1000), -1)

    def create(self, name: str) -> None:
        self.fs.create(self._path(name), False).close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Store:
    """A handle on a store. Make one with create, open, open_read_only or open_or_create."""

    def __init__(self, spark: SparkSession, root: str, config: Config, read_only: bool):
        self.spark, self.root, self.config, self.read_only = spark, root.rstrip("/"), config, read_only
        self.files, self._lock = _Files(spark, root), None
        if not read_only:
            self._take_lock()
        self.manifest = Manifest()

    # -- opening ---------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, config: Config = Config()) -> Store:
        if _Files(spark, root).exists("manifest.json"):
            raise StoreIOError(f"{root} has a store")
        store = cls(spark, root, config, False)
        empty = {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()}
        store._write_generation(1, empty)
        store._put(Manifest())
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config = Config(), read_only: bool = False) -> Store:
        if not _Files(spark, root).exists("manifest.json"):
            raise StoreIOError(f"{root} has no store")
        store = cls(spark, root, config, read_only)
        store.manifest = store._manifest()
        return store

    @classmethod
    def open_read_only(cls, spark: SparkSession, root: str, config: Config = Config()) -> Store:
        return cls.open(spark, root, config, True)

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, config: Config = Config()) -> Store:
        there = _Files(spark, root).exists("manifest.json")
        return cls.open(spark, root, config) if there else cls.create(spark, root, config)

    def _take_lock(self) -> None:
        if self.files.local:
            path = self.files._path("").toUri().getPath()
            os.makedirs(path, exist_ok=True)
            self._lock = open(f"{path}/store.lock", "a")  # noqa: SIM115 - held as long as the handle
            try:
                fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                self._lock.close()
                raise LockedError(f"{self.root} is open for writing") from e
        else:
            if self.files.age_s("store.lock") > self.config.lock_lease_s:
                self.files.delete("store.lock")  # of a writer that ended without closing
            try:
                self.files.create("store.lock")
            except Exception as e:
                raise LockedError(f"{self.root} is open for writing") from e
            self._lock = True

    def close(self) -> None:
        if self._lock is True:
            self.files.delete("store.lock")
        elif self._lock:
            self._lock.close()
        self._lock = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _manifest(self) -> Manifest:
        try:
            found = Manifest(**json.loads(self.files.read("manifest.json")))
        except (ValueError, TypeError) as e:
            raise CorruptError(f"manifest of {self.root}: {e}") from e
        if not all(isinstance(x, int) and x >= 0 for x in asdict(found).values()):
            raise CorruptError(f"manifest of {self.root} has values that are no counts")
        if found.last_seq < found.applied_seq or found.generation < 1:
            raise CorruptError(f"the log of {self.root} ends at {found.last_seq}, before its base ({found.applied_seq})")
        missing = [name for name in TABLES if not self.files.exists(f"gen={found.generation}/{name}/_SUCCESS")]
        if missing:
            raise CorruptError(f"generation {found.generation} of {self.root} has no {', '.join(missing)}")
        return found

    def _put(self, manifest: Manifest) -> None:
        self.files.replace("manifest.json", json.dumps(asdict(manifest)))
        self.manifest = manifest
        if self._lock is True:
            self.files.touch("store.lock")

    def reload_if_stale(self) -> bool:
        """Whether anything was committed or compacted since this handle last looked."""
        now = self._manifest()
        stale = now != self.manifest
        self.manifest = now
        return stale

    # -- state -----------------------------------------------------------------------

    @property
    def generation(self) -> int:
        return self.manifest.generation

    @property
    def pending_ops(self) -> int:
        return self.manifest.last_seq - self.manifest.applied_seq

    def __len__(self) -> int:
        return self.snapshot().live_count

    def is_empty(self) -> bool:
        return len(self) == 0

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.manifest)

    def writer(self) -> Writer:
        if self.read_only:
            raise ReadOnlyError(self.root)
        return Writer(self)

    # -- writing ---------------------------------------------------------------------

    def _write_generation(self, generation: int, tables: dict[str, DataFrame]) -> None:
        for name, kind in TABLES.items():
            df = tables[name].select(*self.spark.createDataFrame([], kind).columns)
            key = df.columns[0]
            df.repartitionByRange(F.col(key)).sortWithinPartitions(*df.columns[:2]).write.mode("errorifexists").parquet(f"{self.root}/gen={generation}/{name}")

    def append(self, batches: list[DataFrame]) -> int:
        """Commits operation rows, in the order of the list, then of `pos`, then of the key. Returns the last seq."""
        if self.read_only:
            raise ReadOnlyError(self.root)
        names = [c for c in self.spark.createDataFrame([], S.OPS).columns if c != "seq"]
        rows = [b.withColumn("turn", F.lit(k)) for k, b in enumerate(batches)]
        if not rows:
            return self.manifest.last_seq
        all_ = rows[0]
        for more in rows[1:]:
            all_ = all_.unionByName(more)
        first = self.manifest.last_seq + 1
        seq = numbered(all_, [F.col("turn"), F.col("pos"), unsigned(F.col("node_key"))], "seq")
        out = f"ops/gen={self.manifest.generation}/batch={first}"
        if self.files.exists(out):
            self.files.delete(out)  # of a commit that ended before its manifest
        seq.withColumn("seq", F.col("seq") + first).select("seq", *names).write.parquet(f"{self.root}/{out}")
        n = self.spark.read.parquet(f"{self.root}/{out}").count()
        held = asdict(self.manifest)
        self._put(Manifest(**held | {"last_seq": first + n - 1, "log_bytes": held["log_bytes"] + self.files.size(out)}))
        if self.pending_ops >= self.config.auto_compact_ops or self.manifest.log_bytes >= self.config.auto_compact_bytes:
            self.compact()
        return first + n - 1

    def compact(self) -> CompactStats:
        if self.read_only:
            raise ReadOnlyError(self.root)
        snap, new = self.snapshot(), self.manifest.generation + 1
        if self.files.exists(f"gen={new}"):
            self.files.delete(f"gen={new}")  # of a compaction that ended before its manifest
        tables = compact.compacted(snap.nodes, snap.edges, snap.segments, self.config.communities)
        self._write_generation(new, tables)
        at = lambda name: self.spark.read.parquet(f"{self.root}/gen={new}/{name}")
        nodes, top = at("nodes").agg(F.count("*"), F.coalesce(F.max("fetched_at_ms"), F.lit(0))).first()
        stats = CompactStats(new, nodes, at("segments").count(), at("edges").count(), self.files.size(f"gen={new}"))
        self._put(Manifest(new, snap.manifest.last_seq, snap.manifest.last_seq, 0, nodes, stats.segments, stats.edges, top))
        return stats

    # -- calls that commit by themselves ------------------------------------------------

    def add(self, docs: DataFrame, segments: DataFrame | None = None, links: DataFrame | None = None) -> int:
        """Upserts docs with their segments and links (src_key, pos, dst_key) in one commit."""
        w = self.writer().upsert_nodes(docs)
        if segments is not None:
            w.set_segments(segments)
        if links is not None:
            w.set_edges(links.select("src_key", "pos", "dst_key", F.lit(S.LINK).alias("etype"), F.lit(S.FULL_WEIGHT).alias("weight")))
        return w.commit()

    def touch(self, key: int, outcome: str, checked_at_ms: int | None = None, content_hash: int | None = None, etag: str | None = None) -> bool:
        if outcome not in OUTCOMES:
            raise ValueError(f"unknown outcome {outcome!r}")
        at = int(time.time() * 1000) if checked_at_ms is None else checked_at_ms
        row = self.spark.createDataFrame([(key, at, OUTCOMES[outcome], content_hash, etag)], "node_key bigint, checked_at_ms bigint, outcome int, content_hash bigint, etag string")
        before = self.manifest.last_seq
        return self.writer().touch(row).commit() > before

    def pin(self, key: int, pinned: bool = True) -> bool:
        before = self.manifest.last_seq
        return self.writer().set_pinned(self.spark.createDataFrame([(key, pinned)], "node_key bigint, pinned boolean")).commit() > before

    def unpin(self, key: int) -> bool:
        return self.pin(key, False)

    def remove(self, key: int) -> int:
        return self.writer().remove(self.spark.createDataFrame([(key,)], "node_key bigint")).commit()

    def query(self, text: str, k: int = 20, depth: int = 3, budget_tokens: int = 2000) -> DataFrame:
        return self.snapshot().query(text, lookup.QueryOptions(limit=k, depth=depth, budget=budget_tokens))

    def related(self, key: int, k: int = 10) -> DataFrame:
        return self.snapshot().related(key, k)

    def due(self, limit: int = 64, now_ms: int | None = None) -> DataFrame:
        return self.snapshot().due(int(time.time() * 1000) if now_ms is None else now_ms, limit)

    # -- ingest ----------------------------------------------------------------------

    def absorb(self, export: DataFrame) -> CompactStats:
        self.append(ingest.absorb(export, self.snapshot().edges))
        return self.compact()

    def ingest_update(self, pages: DataFrame, export: DataFrame, now_ms: int | None = None) -> dict[str, int]:
        """Commits a crawl report and compacts; returns its counters. sync and refresh are the same path."""
        snap = self.snapshot()
        at = int(time.time() * 1000) if now_ms is None else now_ms
        ops, counters = ingest.report(pages, export, snap.nodes, snap.edges, snap.segments, at, self.config.ttl)
        found = counters.first().asDict()
        if not pages.isEmpty():
            self.append(ops)
            self.compact()
        return found

    ingest_refresh = ingest_update

    def sync_from(self, pages: DataFrame, export: DataFrame, now_ms: int | None = None, max_due: int | None = None) -> dict[str, int]:
        """ingest_update with the counters of the whole round: those of pages by change, the due ones, and the store's size.

        max_due: at most so many due urls are counted (all of them if None); not negative.
        """
        if max_due is not None and max_due < 0:
            raise ValueError("max_due is negative")
        at = int(time.time() * 1000) if now_ms is None else now_ms
        by = {r["change"]: r["count"] for r in pages.groupBy("change").count().collect()}
        odd = set(by) - {"added", "updated", "unchanged", "removed", "skipped"}
        if odd:
            raise ValueError(f"unknown changes: {sorted(map(str, odd))}")
        due = self.due_urls(at, (1 << 31) - 1 if max_due is None else max_due).count()
        found = self.ingest_update(pages, export, at)
        return found | {k: by.get(k, 0) for k in ("added", "updated", "unchanged", "removed", "skipped")} | {"due": due, "nodes": len(self), "generation": self.generation}

    def crawl_seed(self) -> tuple[DataFrame, DataFrame]:
        snap = self.snapshot()
        return ingest.crawl_seed(snap.nodes, snap.edges)

    def due_urls(self, now_ms: int, most: int) -> DataFrame:
        return self.snapshot().due(now_ms, most).select("url")

    def enrich(self, enricher) -> int:
        """enricher: a function from ingest.enrichment_context's rows to proposals (see mutate.enrichment)."""
        snap = self.snapshot()
        proposals = written(enricher(ingest.enrichment_context(snap.nodes, snap.edges, snap.segments)), "proposals")
        return self.append(mutate.enrichment(proposals, snap.edges))


class Snapshot:
    """What a manifest names, as DataFrames; each is made once, and never changes."""

    def __init__(self, store: Store, manifest: Manifest):
        self.store, self.spark, self.manifest, self.ttl = store, store.spark, manifest, store.config.ttl

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.store.root}/gen={self.manifest.generation}/{name}")

    @cached_property
    def ops(self) -> DataFrame:
        """The log's operations that the base doesn't hold. Refuses a log whose numbers are not those of the manifest."""
        path, m = f"{self.store.root}/ops/gen={self.manifest.generation}", self.manifest
        if m.last_seq == m.applied_seq:
            return self.spark.createDataFrame([], S.OPS)
        seq = F.col("seq")
        log = self.spark.read.schema(S.OPS).option("recursiveFileLookup", "true").parquet(path)
        own = log.where((seq > m.applied_seq) & (seq <= m.last_seq))
        n, low, high, before = log.agg(F.count_if((seq > m.applied_seq) & (seq <= m.last_seq)), F.min("seq"), F.max("seq"), F.count_if(seq <= m.applied_seq)).first()
        if before:
            raise CorruptError(f"the log starts at {low}, before what the base holds ({m.applied_seq})")
        if n != m.last_seq - m.applied_seq or own.select("seq").distinct().count() != n:
            raise CorruptError(f"the log has {n} operations up to {high}, the manifest names {m.last_seq - m.applied_seq} up to {m.last_seq}")
        return own

    @cached_property
    def state(self) -> DataFrame:
        return fold.fold(self.ops) if self.manifest.last_seq == self.manifest.applied_seq else written(fold.fold(self.ops), "state")

    @cached_property
    def nodes(self) -> DataFrame:
        return fold.nodes_view(self.base("nodes"), self.state, self.base("ranks"), self.ttl)

    def of_keys(self, keys: DataFrame | int) -> DataFrame:
        """The nodes of some keys: base and state are filtered before they meet. One key reaches the scan as a filter."""
        if isinstance(keys, int):
            some = lambda df: df.where(F.col("node_key") == keys)
        else:
            named = keys.select("node_key").distinct()
            some = lambda df: fold.of_keys(df, named)
        return fold.nodes_view(some(self.base("nodes")), some(self.state), some(self.base("ranks")), self.ttl)

    @cached_property
    def edges(self) -> DataFrame:
        return fold.edges_view(self.base("edges"), self.state)

    @cached_property
    def segments(self) -> DataFrame:
        return fold.segments_view(self.base("segments"), self.state)

    @cached_property
    def live_count(self) -> int:
        return fold.live(self.nodes).count()

    @cached_property
    def degree(self) -> DataFrame:
        return rank.degrees(self.base("nodes"), self.base("edges"))

    @cached_property
    def hub_threshold(self) -> int:
        return rank.hub_threshold(self.degree)

    def node(self, key: int):
        return self.of_keys(key).first()

    def node_by_id(self, node_id: int):
        row = self.base("ranks").where(F.col("node_id") == node_id).first()
        return row and self.node(row["node_key"])

    def neighbors(self, key: int) -> DataFrame:
        one = lambda df, c: df.where(F.col(c) == key)
        own = written(fold.edges_view(one(self.base("edges"), "src_key"), one(self.state, "node_key")), "own")
        return graph.neighbors(own, self.of_keys(own.select(F.col("dst_key").alias("node_key"))), key)

    def segments_of(self, key: int) -> DataFrame:
        one = lambda df: df.where(F.col("node_key") == key)
        return fold.segments_view(one(self.base("segments")), one(self.state)).orderBy("ordinal")

    def community_of(self, key: int):
        row = self.base("ranks").where(F.col("node_key") == key).first()
        return row and row["community"]

    def rank_permille_of(self, key: int) -> int:
        row = self.base("ranks").where(F.col("node_key") == key).first()
        return row["permille"] if row else 0

    def queries(self, queries: DataFrame, how: lookup.QueryOptions = lookup.QueryOptions()) -> DataFrame:
        """Hits of many queries (query_id, text) in one job."""
        return lookup.search(queries, self.nodes, self.edges, self.segments, self.base("postings"), self.degree, self.hub_threshold, self.manifest.nodes, how)

    def query(self, text: str, how: lookup.QueryOptions = lookup.QueryOptions()) -> DataFrame:
        return self.queries(self.spark.createDataFrame([(0, text)], "query_id bigint, text string"), how).drop("query_id").orderBy("place")

    def related(self, key: int, k: int = 10) -> DataFrame:
        return graph.related(self.edges, self.nodes, self.spark.createDataFrame([(key,)], "node_key bigint"), k).orderBy("place")

    def path(self, start: int, end: int, max_depth: int = 6) -> list[int] | None:
        row = graph.path(self.edges, self.spark.createDataFrame([(start, end)], "from_key bigint, to_key bigint"), max_depth).first()
        return row and row["path"]

    def community_summary(self, community: int, top: int = 5):
        return graph.community_summary(self.base("ranks").where(F.col("community") == community), self.base("nodes"), top).first()

    def surprises(self, k: int = 10) -> DataFrame:
        return graph.surprises(self.edges, self.base("ranks"), self.nodes, k)

    def due(self, now_ms: int, most: int = 64) -> DataFrame:
        return fresh.due(self.nodes, now_ms, most, self.ttl)

    def check(self) -> None:
        """Raises CorruptError if tables contradict each other."""
        nodes, m = self.base("nodes"), self.manifest
        if nodes.count() != m.nodes or nodes.select("node_key").distinct().count() != m.nodes:
            raise CorruptError("nodes are not those of the manifest")
        for name, key in (("edges", "src_key"), ("edges", "dst_key"), ("segments", "node_key"), ("postings", "node_key"), ("ranks", "node_key")):
            if not self.base(name).select(F.col(key).alias("named")).join(nodes, F.col("named") == F.col("node_key"), "left_anti").isEmpty():
                raise CorruptError(f"{name}.{key} names no node")
        n, low, high = self.ops.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        if n and (n != high - low + 1 or n != m.last_seq - m.applied_seq):
            raise CorruptError("the operation log has gaps")


class Writer:
    """Stages operations against the committed state and commits them as one batch."""

    def __init__(self, store: Store):
        self.store, self.view, self.staged = store, store.snapshot(), []
        self._upserts: DataFrame | None = None

    def _stage(self, *ops: DataFrame) -> Writer:
        self.staged += ops
        return self

    def upsert_nodes(self, docs: DataFrame) -> Writer:
        keys = docs.select("node_key")
        self._upserts = keys if self._upserts is None else self._upserts.unionByName(keys)
        return self._stage(mutate.upsert_nodes(docs))

    def set_segments(self, segs: DataFrame, keys: DataFrame | None = None) -> Writer:
        return self._stage(mutate.set_segments(segs, self.view.segments, keys))

    def set_edges(self, edges: DataFrame, keys: DataFrame | None = None) -> Writer:
        return self._stage(mutate.set_edges(edges, self.view.edges, keys=keys))

    def touch(self, touches: DataFrame) -> Writer:
        return self._stage(mutate.touch(touches, self.view.of_keys(touches), self.view.ttl))

    def set_importance(self, scores: DataFrame) -> Writer:
        return self._stage(mutate.set_importance(scores))

    def set_pinned(self, pins: DataFrame) -> Writer:
        return self._stage(mutate.set_pinned(pins, self.view.of_keys(pins), self._upserts))

    def remove(self, keys: DataFrame) -> Writer:
        return self._stage(mutate.remove(keys))

    def apply_enrichment(self, proposals: DataFrame) -> Writer:
        return self._stage(*mutate.enrichment(proposals, self.view.edges))

    def commit(self) -> int:
        staged, self.staged = self.staged, []
        out = self.store.append(staged)
        self.view, self._upserts = self.store.snapshot(), None
        return out
