"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

1. Each text becomes token ids, then an end id; only what is longer than a sequence is
   cut, into pieces of the full length and one last piece.
2. Lengths are between 1 and ``capacity``, so the instance is a histogram of at most
   ``capacity`` counts, however many documents there are. The driver packs that.
3. Reduction: for the longest length left, a set of at most three pieces that provably
   dominates every other set with that piece is fixed, as often as the counts allow.
   Where no dominating set of that size exists, the length stays for the next step.
4. The rest is packed by best fit, longest first, again on counts: equal bins are one
   group with a number of copies, so the work follows the number of lengths.
5. Pieces are dealt out by range of (length, hash), numbered within each length, and
   looked up in the plan by that number. The plan, of at most a few entries per length,
   is what is broadcast.

Ids are those of the tokenizers library. White space never joins two tokens of this
tokenizer, so a text is read word by word, and the ids of a word are remembered. Plain
words (ASCII and Latin letters) are encoded by a second library from the same file's
merges, which is faster; ``agrees`` checks the file for what that needs, and everything
else goes through the tokenizers library.

Defined cases: a null or empty text is its end id alone. Repeated documents are packed
as often as they stand there. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, stored

CAPACITY, END_ID, MEMORY = 4096, 1, 150_000

# -- token ids ------------------------------------------------------------------------

_CLEAN = re.compile(r"[ !-~À-ÖØ-öø-ÿ]+")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_FENCE = "\x00"  # marks a word's end for the second library; no plain word has it
#: Characters that only some engines take for white space.
_ODD = "\x1c\x1d\x1e\x1f\x85\u180e"


def _byte_names() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class WordIds:
    """Text -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.fast = self._second(model)
        self.gap = model["vocab"].get(_byte_names()[0])  # the fence alone, between two words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words used last stay, at most twice MEMORY

    @staticmethod
    def agrees(model: dict) -> bool:
        """Ids rise in the order of the merges, and each word end has a lower id than all merges."""
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        ends = [model["vocab"].get(f"{n}</w>", 1 << 40) for n in _byte_names()]
        return model.get("end_of_word_suffix") == "</w>" and bool(ids) and ids == sorted(set(ids)) and max(ends) < ids[0]

    def _second(self, model: dict):
        if not self.agrees(model):
            return None
        import tiktoken

        byte = {name: b for b, name in enumerate(_byte_names())}
        ranks = {}
        for token, i in model["vocab"].items():
            ended = token.endswith("</w>")
            raw = [byte.get(c) for c in (token[:-4] if ended else token)]
            if None not in raw:
                ranks[bytes(raw) + (_FENCE.encode() if ended else b"")] = i
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00|\x00", mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered, all plain ones at once."""
        out = {w: self.older[w] for w in words if w in self.older}
        plain = [w for w in words if w not in out]
        if plain and (not self.fast or not _CLEAN.fullmatch(text := " ".join(plain)) or "<|" in text):
            odd = [w for w in plain if not self.fast or not _CLEAN.fullmatch(w) or "<|" in w]
            out |= {w: self._by_library(w) for w in odd}
            plain = [w for w in plain if w not in out]
        if plain:
            fenced = _PART.sub(rf"\g<0>{_FENCE}", " ".join(plain).lower()).replace(" ", _FENCE)
            ids = np.array(self.fast.encode_ordinary(fenced), dtype="<u4")
            raw, at = ids.tobytes(), 0
            for word, end in zip(plain, [*np.flatnonzero(ids == self.gap).tolist(), len(ids)], strict=True):
                out[word] = raw[4 * at : 4 * end]
                at = end + 1
        return out

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return self._by_library(text)
        if self.fast and _latin(text):
            text = text.lower()  # so that a word has one form; the tokenizer does the same
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            new = self._new(list({w for w, x in zip(words, found, strict=True) if x is None}))
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(self.words) >= MEMORY:
                self.older, self.words = self.words, {}
            self.words.update((w, x) for w, x in new.items() if len(w) <= 64)
        return b"".join(found)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def word_ids(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids, of every piece."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, of, wide = [], [], 4 * capacity
            for k, raw in enumerate(batch.column(1)):
                ids = own.encode(raw.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None))
                    of.append(k)
            piece, start, length, crc, held = zip(*rows, strict=True) if rows else [()] * 5
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return kept.mapInArrow(cut, schema)


# -- the plan -------------------------------------------------------------------------

#: A kind of bin: ((length, pieces of that length), ...) and the number of such bins.
Bins = list[tuple[tuple[tuple[int, int], ...], int]]


class _Lengths:
    """Counts by length, with the lengths that are left in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.order[bisect.bisect_left(self.order, length)]

    def largest(self, most: int, used: Counter) -> int:
        """The longest length of at most `most` of which a piece besides `used` is left; 0 if none."""
        k = bisect.bisect_right(self.order, most) - 1
        while k >= 0 and self.count[self.order[k]] <= used[self.order[k]]:
            k -= 1
        return self.order[k] if k >= 0 else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces, one piece of the length `without` set aside."""
        out: list[int] = []
        for length in self.order:
            out += [length] * min(n, self.count[length] - (length == without))
            if len(out) >= n:
                return out[:n]
        return out


def dominating(left: _Lengths, first: int, capacity: int) -> tuple[int, ...] | None:
    """The set of at most three pieces with `first` that dominates all other sets with it, if there is one.

    A set dominates another if each piece of the other can be assigned to a piece of it
    so that no piece of it is exceeded. Then some optimal packing has the set as a bin.
    """
    room = capacity - first
    best = left.largest(room, Counter([first]))
    if not best:
        return (first,)  # nothing else fits
    if best == room:
        return (first, best)  # every other set fits into the one piece
    small = left.smallest(3, first)
    if len(small) < 2 or small[0] + small[1] > room:
        return (first, best)  # at most one other piece fits, and this is the longest
    if len(small) == 3 and sum(small) <= room:
        return None  # sets of four pieces exist; they are not compared
    # At most two others fit. Single pieces are dominated by `best`; a pair x >= y is if its
    # sum is at most `best`, or, for the set (first, best, second), if also y <= second.
    used = Counter([first, best])
    second = left.largest(room - best, used)
    widest = 0  # the largest sum of a fitting pair with y > second
    for y in left.order:
        if 2 * y > room:
            break
        if second and y <= second:
            continue
        x = left.largest(room - y, Counter([first, y]))
        if x >= y:
            widest = max(widest, x + y)
    if widest <= best:
        return (first, best, second) if second else (first, best)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """Bins that some optimal packing has, and the counts that remain."""
    left, bins = _Lengths(counts), []
    for first in sorted(counts, reverse=True):
        while left.count.get(first):
            chosen = dominating(left, first, capacity)
            if chosen is None:
                break  # stays for best fit, and for the sets of shorter lengths
            need = Counter(chosen)
            times = min(left.count[k] // n for k, n in need.items())
            # the grounds of the choice hold for each copy while all of its lengths are left
            bins.append((tuple(sorted(need.items(), reverse=True)), times))
            for k, n in need.items():
                left.take(k, n * times)
    return bins, dict(left.count)


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first; equal bins are handled together."""
    open_bins: dict[int, list[tuple]] = {}  # room -> (contents, copies)
    rooms: list[int] = []
    done: Bins = []

    def put(contents: tuple, copies: int, room: int) -> None:
        if not copies:
            return
        if not room:
            done.append((contents, copies))
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
        open_bins.setdefault(room, []).append((contents, copies))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                contents, copies = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[k]
            else:
                room, contents, copies = capacity, (), n
            each = room // length  # a bin stays the best fit until no further piece fits
            full = min(copies, n // each)
            used, some = (full, each) if full else (1, n)
            put((*contents, (length, some)), used, room - some * length)
            if contents:
                put(contents, copies - used, room)
            n -= used * some
    return done + [(c, m) for room in open_bins.values() for c, m in room]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(bins: Bins) -> dict[str, np.ndarray]:
    """For each length, ranges of the numbers of its pieces: where each range starts, which
    bins it fills, how many pieces a bin takes, and at which offset."""
    rows, first = [], 0
    for contents, copies in bins:
        at = 0
        for length, n in contents:
            rows.append((length, n * copies, first, n, at))
            at += length * n
        first += copies
    rows.sort(key=lambda r: r[0])
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    begin, seen = np.zeros(len(table), dtype=np.int64), Counter()
    for k, (length, n) in enumerate(table[:, :2].tolist()):
        begin[k] = seen[length]
        seen[length] += n
    return {"key": (table[:, 0] << 40) + begin, "begin": begin, "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def place(slot: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, by their length and number within it."""
    low = np.searchsorted(slot["key"], (length << 40) + number, "right") - 1
    within = number - slot["begin"][low]
    each = slot["each"][low]
    return slot["sequence"][low] + within // each, slot["offset"][low] + within % each * length


# -- over a DataFrame -----------------------------------------------------------------


def _numbered(of: DataFrame) -> DataFrame:
    """Pieces with their part and their number within (part, length); parts are ranges of length."""
    names = of.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            out = np.empty(len(length), dtype=np.int64)
            kinds, at = np.unique(length, return_inverse=True)
            for k, one in enumerate(kinds.tolist()):
                own = np.flatnonzero(at == k)
                out[own] = seen[one] + np.arange(len(own))
                seen[one] += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(out), part), pa.int32()), pa.array(out)], names=[*names, "part", "number"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in of.schema), "part int", "number long"])
    return of.mapInArrow(number, schema)


def pack(of: DataFrame, capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """Pieces (any columns, with a `length` from 1 to capacity), each with sequence_id and offset.

    Runs two small jobs: the counts by length, and the pieces per part and length.
    """
    spark = of.sparkSession
    names = of.columns
    of = stored(of, "pieces")
    counts = {r["length"]: r["n"] for r in of.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return of.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(*[c for c in names if c != "ids"])
    dealt = of.withColumn("__spread", spread).repartitionByRange(parts, "length", "__spread").drop("__spread")
    dealt = stored(_numbered(dealt), "numbered")
    # each part is a range of lengths, so there are at most parts + capacity rows here
    per = dealt.groupBy("part", "length").agg(F.count("*").alias("n")).collect()
    before, seen = {}, Counter()
    for r in sorted(per, key=lambda r: (r["length"], r["part"])):
        before[r["part"], r["length"]] = seen[r["length"]]
        seen[r["length"]] += r["n"]
    keys = np.array(sorted(p * (capacity + 1) + n for p, n in before), dtype=np.int64)
    base = np.array([before[divmod(int(k), capacity + 1)] for k in keys], dtype=np.int64)
    shared = spark.sparkContext.broadcast((slots(plan(counts, capacity)), keys, base))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def placed(part: pa.Array, length: pa.Array, number: pa.Array) -> pa.Array:
        slot, keys, base = shared.value
        part, length, number = part.to_numpy().astype(np.int64), length.to_numpy(), number.to_numpy()
        number = number + base[np.searchsorted(keys, part * (capacity + 1) + length)]
        sequence, offset = place(slot, length, number)
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    out = dealt.withColumn("__at", placed("part", "length", "number"))
    return out.select(*[F.col(f"`{c}`") for c in names], "__at.sequence_id", "__at.offset")
