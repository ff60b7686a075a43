"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item
of fewer words is one shorter pattern). Patterns of one length form one searcher:

* a shift table, keyed by blocks of two words, says how far the search may jump
  from a position whose block ends no pattern;
* where the shift is zero, the block's bucket lists patterns that end in it,
  sub-divided by their first block;
* a direct comparison of the words confirms each occurrence.

The benchmark reaches the executors in blocks of at most ``block_bytes`` of text,
so what is broadcast never grows with it. With one block (the usual case) documents
are read once, in place, without any shuffle; with more, each block is one further
pass, and what it found is stored before the next.

Defined cases: a null or empty text has no words and no hits. A null item id is
reported as the empty string. Repeated documents are judged row by row; repeated
items count once in n_items. An empty benchmark hits nothing. Columns besides the
named ones are not looked at, so clashing names do no harm.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, stored

WINDOW = 10
BLOCK_BYTES = 2 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    """UTF-8 bytes to words: ASCII letters and digits, and everything beyond ASCII."""
    return _WORD.findall(text.lower())


class Searcher:
    """Wu-Manber tables for the patterns of one length, counted in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length = length
        self.block = block = 2 if length > 1 else 1
        self.far = length - block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(block, length + 1):
                key = words[end - block : end]
                jump = length - end
                if jump < self.shift.get(key, self.far):
                    self.shift[key] = jump
            last = words[length - block :]
            self.buckets.setdefault(last, {}).setdefault(words[:block], []).append((words, items))

    def scan(self, words: list[bytes]):
        """Yield (start, items) of each occurrence, in order."""
        length, block, far = self.length, self.block, self.far
        jump, total, end = self.shift.get, len(words), self.length
        while end <= total:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            by = jump(key, far)
            if by:
                end += by
                continue
            start = end - length
            for pattern, items in self.buckets[key].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def searchers(items: list[tuple[str, bytes]], window: int) -> list[Searcher]:
    """One searcher for each pattern length; patterns name items by their place in the list."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for place, (_, text) in enumerate(items):
        words = words_of(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1) if size else ():
            found = by_length.setdefault(size, {}).setdefault(tuple(words[start : start + size]), [])
            if not found or found[-1] != place:
                found.append(place)
    return [Searcher(size, patterns) for size, patterns in by_length.items()]


def search(words: list[bytes], tables: list[Searcher]) -> tuple[list[tuple[int, int]], set[int]]:
    """Disjoint ascending spans of hit words, and the places of the items found."""
    hits, found = [], set()
    for one in tables:
        for start, items in one.scan(words):
            hits.append((start, start + one.length))
            found.update(items)
    return merged(hits), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _tables(shared, window: int):
    """The searchers of a broadcast block, built once in each Python worker."""
    return held((shared.value["id"], window), lambda: searchers(shared.value["items"], window))


def _finder(shared, window: int):
    @F.arrow_udf(_FOUND)
    def find(text: pa.Array) -> pa.Array:
        tables, items = _tables(shared, window), shared.value["items"]
        counts, spans, names = [], [], []
        for raw in text.cast(pa.binary()):
            words = words_of(raw.as_py() or b"")
            hit, found = search(words, tables)
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in hit])
            names.append(sorted({items[i][0] for i in found}))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))],
            ["n_words", "spans", "items"],
        )

    return find


def _together(a: pa.Array, b: pa.Array) -> pa.Array:
    """What two blocks of the benchmark found in the same rows."""
    counts, spans, names = [], [], []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        counts.append(x["n_words"])
        both = merged([(s["start"], s["end"]) for s in x["spans"] + y["spans"]])
        spans.append([{"start": s, "end": e} for s, e in both])
        names.append(sorted({*x["items"], *y["items"]}))
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))],
        ["n_words", "spans", "items"],
    )


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Yield lists of (item id, text) of about block_bytes each; the driver holds one at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"),
    ).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield [(r["id"], bytes(r["text"])) for r in part.distinct().collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "found",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with one more column: struct of n_words, spans (hit words, half open) and items."""
    spark, out = docs.sparkSession, docs
    for k, items in enumerate(benchmark_blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "items": items})
        found = _finder(shared, window)(F.col(text))
        if k == 0:
            out = out.withColumn(into, found)
        else:
            out = stored(out, "decontaminate").withColumn("__more", found)
            out = out.withColumn(into, F.arrow_udf(_together, _FOUND)(F.col(into), F.col("__more"))).drop("__more")
    return out


def verdict(found: Column) -> list[Column]:
    """The columns of the digest, from contamination()'s struct."""
    hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return [
        found["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found["items"]), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    ]


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns they came with."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    found = contamination(row, benchmark, "text", "found", window)
    return found.where(F.size("found.spans") == 0).select("row.*")
