"""Embedding near-duplicates by collision counting on sorted one-dimensional projections.

1. Usable vectors (right label, finite, not zero) are scaled to length one. Equal vectors
   of one label are one class; the smallest id stands for it, with its number of copies.
2. Cells: in each of several tables, ``axes`` random projections are cut into windows;
   vectors of one label in the same window on all axes share a cell. The axes rise with
   the logarithm of the largest label, so that cells stay small, and the tables are as
   many as bring the chance that a pair at the threshold shares a cell to ``RECALL``.
   A label of a few dozen vectors is one cell.
3. Counting: in a cell, ``LINES`` further projections are sorted; each vector is the
   centre of a window on each of them, and for each pair the windows that it collides in
   are counted. The count to pass is calibrated: a pair at the threshold reaches it with
   probability ``RECALL``.
4. Pairs that pass are verified by their cosine in double precision. A pair that shares
   cells in several tables is counted in the first alone. Vectors travel as they are
   stored (single precision, if the column has that), with one cell; their other cells
   are computed again where a pair passes.

A cell of more than ``BLOCK`` vectors is met in pairs of blocks, each pair of blocks once,
so no task holds an unbounded cell and nothing is capped. Only counts and a spanning set
of links leave a cell, never its pairs.

Defined cases: a null label, a null, empty or zero vector, and one with a null or
non-finite component link with nothing. A null id links with nothing and has a null
component. Vectors of different lengths don't link. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .near_dup import _joined

COSINE, RECALL, LINES, CELL, BLOCK = 0.93, 0.995, 64, 50, 120


def _inside(ratio: float) -> float:
    """P(|Z| <= ratio) of a standard normal Z."""
    return math.erf(ratio / math.sqrt(2))


def _same_window(ratio: float) -> float:
    """Chance that two points share a window, for the window's width over their distance."""
    fall = (1 - math.exp(-ratio * ratio / 2)) * 2 / (math.sqrt(2 * math.pi) * ratio)
    return _inside(ratio) - fall


def calibrated(largest: int, cosine: float = COSINE, recall: float = RECALL) -> dict:
    """Axes, tables, widths and the count to pass, for labels of `largest` vectors at most."""
    near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2)
    width = 4 * near
    hit, stray = _same_window(4.0), _same_window(width / far)
    axes = max(0, round(math.log(max(largest, 1) / CELL) / -math.log(stray))) if largest > CELL else 0
    tables = math.ceil(math.log(1 - recall) / math.log(1 - hit**axes)) if axes else 1
    p = _inside(1.0)  # the counting window reaches as far as a pair at the threshold is apart
    below, passing = 0.0, 0
    while True:  # the largest count that such a pair reaches with probability `recall`
        below += math.comb(LINES, passing) * p**passing * (1 - p) ** (LINES - passing)
        if below > 1 - recall:
            break
        passing += 1
    return {"axes": axes, "tables": tables, "width": width, "near": near, "passing": passing, "cosine": cosine}


_LINES: dict = {}


def _directions(size: int, how: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell axes, their offsets, and counting lines for vectors of a length; the same everywhere."""
    key = (size, how["axes"], how["tables"])
    if key not in _LINES:
        random = np.random.RandomState(size)
        n = how["axes"] * how["tables"]
        _LINES[key] = (random.standard_normal((size, n)), random.uniform(0, how["width"], n), np.random.RandomState(size + 1).standard_normal((size, LINES)))
    return _LINES[key]


def unit(vector: np.ndarray) -> np.ndarray:
    vector = vector.astype(np.float64)
    return vector / np.sqrt((vector * vector).sum(axis=-1, keepdims=True))


def _classed(kind: str):
    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, label, embedding) to (vec_id, label, digest, vector bytes); null digest if unusable."""
        for batch in batches:
            digests, raws = [], []
            for label, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = own.values
                good = label is not None and values is not None and len(values) > 0 and values.null_count == 0
                vector = values.to_numpy(zero_copy_only=False).astype(np.float64) if good else np.zeros(1)
                with np.errstate(over="ignore", invalid="ignore"):
                    square = float((vector * vector).sum())
                good = good and np.isfinite(vector).all() and 0 < square < math.inf
                raw = (vector + 0.0).astype(kind).tobytes() if good else None
                raws.append(raw)
                digests.append(xxhash.xxh3_128_digest(raw) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "digest", "raw"])

    return classed


def cells_of(vectors: np.ndarray, how: dict) -> np.ndarray:
    """The cell of each unit vector in each table."""
    along, shift, _ = _directions(vectors.shape[1], how)
    window = np.floor((vectors @ along + shift) / how["width"]).astype(np.int64).reshape(len(vectors), how["tables"], how["axes"])
    cells = np.full(window.shape[:2], vectors.shape[1], dtype=np.uint64)
    for k in range(how["axes"]):
        cells = (cells ^ window[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        cells ^= cells >> np.uint64(29)
    return cells.astype(np.int64)


def _celled(how: dict):
    """(id, label, copies, raw) to one row for each table: which cell."""

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(3).to_pylist()
            sizes = np.array([len(x) for x in raws], dtype=np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                cells = cells_of(unit(np.frombuffer(b"".join(raws[k] for k in at), how["kind"]).reshape(len(at), -1)), how)
                rows = batch.take(pa.array(at))
                for t in range(how["tables"]):
                    table = pa.array(np.full(len(at), t, np.int32))
                    yield pa.RecordBatch.from_arrays([*rows.columns, table, pa.array(cells[:, t])], names=[*batch.schema.names, "table", "cell"])

    return celled


def collisions(lines: np.ndarray, reach: float) -> np.ndarray:
    """For each pair of rows, the lines on which one lies in the window around the other."""
    n = len(lines)
    order = np.argsort(lines, axis=0)
    place = np.take_along_axis(lines, order, axis=0)
    count = np.zeros(n * n, dtype=np.int64)
    for step in range(1, n):
        within = place[step:] - place[:-step] <= reach
        if not within.any():
            break
        count += np.bincount((order[:-step] * n + order[step:])[within], minlength=n * n)
    count = count.reshape(n, n)
    return count + count.T


def met(ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, table: int, own: np.ndarray, how: dict) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row in one group (a cell, or two blocks of one), and the row it is joined to."""
    n = len(ids)
    _, _, lines = _directions(vectors.shape[1], how)
    passing = collisions(vectors @ lines, how["near"]) >= how["passing"]
    if (own != own[0]).any():
        passing &= own[:, None] != own[None, :]  # pairs within a block are met elsewhere
    p, q = np.nonzero(np.triu(passing, 1))
    if table and len(p):
        cells = cells_of(vectors, how)
        new = (cells[p, :table] != cells[q, :table]).all(axis=1)
        p, q = p[new], q[new]
    linked = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= how["cosine"]
    p, q = p[linked], q[linked]
    links = np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)
    return links.astype(np.int64), _joined(p, q, n)


def _grouped(how: dict):
    """Sorted rows of cells to (id, links, to)."""
    keys = ["label", "size", "table", "cell", "low", "high"]

    def runs(rows: pa.Table) -> Iterator[tuple[int, int]]:
        change = np.zeros(rows.num_rows, dtype=bool)
        change[:1] = True
        for key in keys:
            column = rows[key].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        at = [*np.flatnonzero(change).tolist(), rows.num_rows]
        return zip(at, at[1:], strict=False)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            ids, copies, own = (rows[c].to_numpy() for c in ("id", "copies", "own"))
            table, raw = rows["table"].to_numpy(), rows["raw"].to_pylist()
            found = []
            for a, b in spans:
                if b - a > 1:
                    vectors = unit(np.frombuffer(b"".join(raw[a:b]), how["kind"]).reshape(b - a, -1))
                    links, to = met(ids[a:b], copies[a:b], vectors, int(table[a]), own[a:b], how)
                    some = np.flatnonzero(links)
                    found.append((ids[a:b][some], links[some], ids[a:b][to][some]))
            parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["id", "links", "to"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            *spans, last = runs(rows)
            yield out(rows, spans)
            held = rows.slice(last[0])  # the last run may go on in the next batch
        if held is not None:
            yield out(held, list(runs(held)))

    return grouped


def groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
           cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a label is compared for equality alone, so its hash stands for it; a null stays one
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    rows = stored(base.mapInArrow(_classed(kind), "vec_id long, label long, digest binary, raw binary"), "vectors")
    usable = rows.where("vec_id is not null and digest is not null")
    classes = usable.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = stored(classes, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    how = calibrated(largest, cosine, recall) | {"kind": kind}

    celled = classes.select("id", "label", "copies", "raw").mapInArrow(_celled(how), "id long, label long, copies long, raw binary, table int, cell long")
    celled = celled.withColumn("size", F.length("raw"))
    key = ["label", "size", "table", "cell"]
    many = stored(celled.groupBy(*key).count().where("count > 1"), "cells")
    met_in = celled.join(many, key).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    met_in = met_in.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met_in = met_in.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met_in = met_in.select(*key, "id", "copies", "raw", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    order = [*key, "low", "high"]
    met_in = met_in.repartition(parts, *order).sortWithinPartitions(*order, "id")
    found = stored(met_in.mapInArrow(_grouped(how), "id long, links long, to long"), "links")

    reach = stored(components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))), "reached")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("label", "digest", "id", "copies").join(links, "id", "left").join(reach, F.col("id") == F.col("node"), "left")
    known = stored(known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "known")
    out = rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, ["label", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
