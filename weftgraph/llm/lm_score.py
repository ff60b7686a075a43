"""Language-model scores by subword lattice likelihood.

The probability of a word is the sum over all ways to segment it into pieces of an
existing subword vocabulary, each weighted by the product of its pieces' unigram
probabilities; a forward recursion in log space sums them. A text is its words and one
end, and its score is log10 of the product of their marginal probabilities.

The scores in the vocabulary's file are ranks of merges, not log probabilities. They are
turned into them by Zipf's law: a piece of rank r, counted from 0 in the order of falling
scores, weighs 1 / (``SHIFT`` + r). Training texts reweight the pieces and nothing else:
expected counts over all segmentations (forward-backward), with ``PRIOR`` counts spread
as the vocabulary's scores say, give new probabilities, ``ROUNDS`` times.

1. One pass counts the words of all documents, partial sums first.
2. Each distinct training word meets the lattice once in each round, weighted by its
   count. Only sums per piece reach the driver: their number is bounded by the vocabulary.
3. Each distinct word gets its log probability, distributed.
4. Scoring reads the texts once more. The most frequent words, at most ``HOT``, are
   broadcast; all other words of a text are joined to the table of words by shuffle, so
   the corpus vocabulary may be of any size and no frequent word makes a hot key.

`base` is a smoothed word unigram from the same counts. Words of more than ``LONG``
characters are summed one by one, with memory in proportion to their length.

Defined cases: a null or empty text is its end alone. A null id falls where the caller's
test puts it. Repeated rows count and score as often as they stand there. Without any
training document the vocabulary's own scores are the model. A character outside the
vocabulary is an unknown piece of probability shared among ``CHARACTERS`` characters.
Other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, stored

ROUNDS, HOT, CHARACTERS, LONG, START = 2, 100_000, 1 << 16, 4096, "▁"
SHIFT, PRIOR, SMOOTH = 10.0, 2000.0, 0.1
_FLUSH, _CELLS = 300_000, 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


# -- the lattice ----------------------------------------------------------------------


class Lattice:
    """Segmentations of words into the pieces of a vocabulary file, and their probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        use = [i for i in range(own.get_piece_size()) if not (own.is_unknown(i) or own.is_control(i) or own.is_byte(i) or own.is_unused(i))]
        pieces = {own.id_to_piece(i): k for k, i in enumerate(use)}
        order = np.argsort(np.argsort([-own.get_score(i) for i in use], kind="stable"))
        self.unknown, self.end = len(pieces), len(pieces) + 1
        self.size = len(pieces) + 2
        weight = 1 / (SHIFT + np.concatenate([order, [order.size, order.size]]))  # the unknown piece and the end come last
        self.prior = weight / weight.sum()
        self.known = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | pieces  # -1: only the start of a piece

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Word, start, end and piece of every edge of the words' lattices."""
        word, start, end, piece = [], [], [], []
        known, unknown = self.known.get, self.unknown
        for w, text in enumerate(words):
            text = START + text
            n = len(text)
            for i in range(n):
                alone = True
                for j in range(i + 1, n + 1):
                    k = known(text[i:j])
                    if k is None:
                        break
                    if k >= 0:
                        word.append(w)
                        start.append(i)
                        end.append(j)
                        piece.append(k)
                        alone &= j > i + 1
                if alone:  # no piece is this one character
                    word.append(w)
                    start.append(i)
                    end.append(i + 1)
                    piece.append(unknown)
        return tuple(np.array(x, dtype=np.int64) for x in (word, start, end, piece))


def _spread(at: np.ndarray, to: np.ndarray, weight: np.ndarray, by: np.ndarray, value: np.ndarray) -> None:
    """value[to] = log-sum-exp over edges of value[at] + weight, edges taken in steps of `by`."""
    order = np.lexsort((to, by))
    at, to, weight, by = at[order], to[order], weight[order], by[order]
    cuts = np.flatnonzero(np.diff(by, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
        heads = np.flatnonzero(np.diff(to[a:b], prepend=-1))
        value[to[a:b][heads]] = np.logaddexp.reduceat(value[at[a:b]] + weight[a:b], heads)


def batches_of(words: list[str]) -> Iterator[list[int]]:
    """Places of words of about equal length, so many that their lattices fit together."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    own: list[int] = []
    for k in order:
        if own and (len(own) + 1) * (len(words[k]) + 2) > _CELLS:
            yield own
            own = []
        own.append(k)
    if own:
        yield own


def forward(words: list[str], lattice: Lattice, log_p: np.ndarray, edges=None) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word, and the forward table behind it."""
    word, start, end, piece = edges or lattice.edges(words)
    lengths = np.array([len(w) + 1 for w in words])
    wide = int(lengths.max()) + 1
    table = np.full(len(words) * wide, -np.inf)
    table[np.arange(len(words)) * wide] = 0
    _spread(word * wide + start, word * wide + end, log_p[piece], end, table)
    return table[np.arange(len(words)) * wide + lengths], table


def expected(words: list[str], counts: np.ndarray, lattice: Lattice, log_p: np.ndarray) -> np.ndarray:
    """Expected number of each piece in words with counts."""
    edges = word, start, end, piece = lattice.edges(words)
    total, ahead = forward(words, lattice, log_p, edges)
    wide = len(ahead) // len(words)
    back = np.full_like(ahead, -np.inf)
    back[np.arange(len(words)) * wide + [len(w) + 1 for w in words]] = 0
    _spread(word * wide + end, word * wide + start, log_p[piece], wide - start, back)
    share = np.exp(ahead[word * wide + start] + log_p[piece] + back[word * wide + end] - total[word]) * counts[word]
    return np.bincount(piece, share, lattice.size)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _pieces_at(text: str, i: int, lattice: Lattice) -> Iterator[tuple[int, int]]:
    """End and piece of every edge from i."""
    known, alone = lattice.known.get, True
    for j in range(i + 1, len(text) + 1):
        k = known(text[i:j])
        if k is None:
            break
        if k >= 0:
            yield j, k
            alone &= j > i + 1
    if alone:
        yield i + 1, lattice.unknown


def long_word(word: str, lattice: Lattice, log_p: np.ndarray, counts: np.ndarray | None = None, times: float = 0.0) -> float:
    """Log probability of one word of any length; adds its expected pieces to counts, if given."""
    text, p = START + word, log_p.tolist()
    n = len(text)
    ahead = [0.0] + [-math.inf] * n
    for i in range(n):
        if ahead[i] > -math.inf:
            for j, k in _pieces_at(text, i, lattice):
                ahead[j] = _add(ahead[j], ahead[i] + p[k])
    if counts is not None:
        back = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            for j, k in _pieces_at(text, i, lattice):
                through = p[k] + back[j]
                back[i] = _add(back[i], through)
                counts[k] += times * math.exp(ahead[i] + through - ahead[n])
    return ahead[n]


def estimated(found: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Log probabilities of the pieces from expected counts and the vocabulary's own scores."""
    own = found + PRIOR * lattice.prior
    out = np.log(own / own.sum())
    out[lattice.unknown] -= math.log(CHARACTERS)
    return out


def lattice_of(path: str) -> Lattice:
    return held(("lattice", path), lambda: Lattice(path))


# -- over DataFrames ------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) to (word, a, c): how often in all texts and in training texts; the end is the empty word."""
    seen: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        other, trained = seen
        words = list(other.keys() | trained.keys())
        c = np.array([trained[w] for w in words], dtype=np.int64)
        a = c + np.array([other[w] for w in words], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(a), pa.array(c)], names=["word", "a", "c"])

    for batch in batches:
        for raw, train in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            own = seen[bool(train)]
            own.update(words_of(raw.as_py() or b""))
            own[b""] += 1
        if len(seen[0]) + len(seen[1]) > _FLUSH:
            yield out()
            seen[0].clear()
            seen[1].clear()
    yield out()


def _read(batch: pa.RecordBatch) -> tuple[list[str], list[int], list[int]]:
    """The batch's words, and the places of the short and of the long ones."""
    words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
    return words, [k for k, w in enumerate(words) if len(w) <= LONG], [k for k, w in enumerate(words) if len(w) > LONG]


def _expecting(path: str, shared):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_p = lattice_of(path), shared.value
        total = np.zeros(lattice.size)
        for batch in batches:
            (words, short, long), counts = _read(batch), batch.column("c").to_numpy().astype(np.float64)
            for own in batches_of([words[k] for k in short]):
                own = [short[k] for k in own]
                total += expected([words[k] for k in own], counts[own], lattice, log_p)
            for k in long:
                long_word(words[k], lattice, log_p, total, counts[k])
        piece = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(total[piece])], names=["piece", "n"])

    return expect


def _likely(path: str, shared):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_p = lattice_of(path), shared.value
        for batch in batches:
            words, short, long = _read(batch)
            out = np.zeros(len(words))
            for own in batches_of([words[k] for k in short]):
                own = [short[k] for k in own]
                out[own] = forward([words[k] for k in own], lattice, log_p)[0]
            for k in long:
                out[k] = long_word(words[k], lattice, log_p)
            out[[k for k, w in enumerate(words) if not w]] = log_p[lattice.end]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("a"), pa.array(out / math.log(10))], names=["word", "c", "a", "p"])

    return likely


def _scored(shared):
    """(row, text) to partial sums over the broadcast words, and the other words with their counts."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held(shared.value["key"], lambda: {w: k for k, w in enumerate(shared.value["words"])})
        base, known, p = shared.value["base"], shared.value["known"], shared.value["p"]
        for batch in batches:
            tokens, n_known, bases, sums, rest, rest_n = [], [], [], [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                words = [*words_of(raw.as_py() or b""), b""]
                at = list(map(place.get, words))
                cold = Counter(w for w, k in zip(words, at, strict=True) if k is None)
                hot = np.array([k for k in at if k is not None], dtype=np.int64)
                tokens.append(len(words))
                n_known.append(int(known[hot].sum()))
                bases.append(float(base[hot].sum()))
                sums.append(float(p[hot].sum()))
                rest.append(list(cold))
                rest_n.append(list(cold.values()))
            columns = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(sums, pa.float64()), pa.array(rest, pa.list_(pa.binary())), pa.array(rest_n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "known", "base", "own", "words", "times"])

    return scored


def score(docs: DataFrame, train: Column, path: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    train: which rows to learn from.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), train.alias("train"), F.col(text).alias("text"))
    counted = named.select("text", "train").mapInArrow(_counted, "word binary, a long, c long")
    words = stored(counted.groupBy("word").agg(F.sum("a").alias("a"), F.sum("c").alias("c")), "words")
    ended = words.where(F.length("word") == 0).first()
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    lattice = lattice_of(path)
    log_p = estimated(np.zeros(lattice.size), lattice)
    for _ in range(ROUNDS if n else 0):
        seen = words.where((F.length("word") > 0) & (F.col("c") > 0)).mapInArrow(_expecting(path, spark.sparkContext.broadcast(log_p)), "piece int, n double")
        seen = seen.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece of the vocabulary at most
        found = np.zeros(lattice.size)
        found[seen["piece"].to_numpy()] = seen["n"].to_numpy()
        found[lattice.end] = ended["c"]
        log_p = estimated(found, lattice)
    table = stored(words.mapInArrow(_likely(path, spark.sparkContext.broadcast(log_p)), "word binary, c long, a long, p double"), "likely")

    # frequent words: all those from the lowest power of two on from which there are at most `hot`
    power = F.floor(F.log2("a")).cast("int")
    steps = table.where(F.length("word") <= LONG).groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
    least, n_held = 63, 0
    for r in steps:
        n_held += r["count"]
        if n_held > hot:
            break
        least = r["power"]
    common = table.where((power >= least) & (F.length("word") <= LONG)).toArrow()
    divisor = n + SMOOTH * (v + 1)
    counts = common["c"].to_numpy().astype(np.float64)
    frequent = spark.sparkContext.broadcast({
        "key": uuid.uuid4().hex, "words": common["word"].to_pylist(), "known": counts > 0, "base": np.log10((counts + SMOOTH) / divisor), "p": common["p"].to_numpy(),
    })
    scored = named.select(F.struct("doc_id", "train").alias("row"), "text")
    field = f"row {scored.schema['row'].dataType.simpleString()}"
    partial = scored.mapInArrow(_scored(frequent), f"{field}, n_tokens long, known long, base double, own double, words array<binary>, times array<long>")
    partial = stored(partial.withColumn("id", F.monotonically_increasing_id()), "partial")
    cold = partial.select("id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("id", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    cold = cold.join(table.select("word", "c", "p"), "word")
    more = cold.groupBy("id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + SMOOTH) / F.lit(float(divisor)))).alias("more_base"),
        F.sum(F.col("times") * F.col("p")).alias("more_own"),
    )
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return partial.drop("words", "times").join(more, "id", "left").select(
        "row.doc_id", "row.train", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + none("more_base")).alias("base_score"), (F.col("own") + none("more_own")).alias("score"),
    )
