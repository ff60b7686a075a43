"""Language identification by words first, character n-grams next.

A word seen in training scores each language by the logarithm of its smoothed frequency
there. A word never seen falls back to its character n-grams: the longest order, from
``LONGEST`` down to one, of which the model knows any, scores by the mean logarithm of
its known n-grams. A text's languages are compared by the sums over all its words.

The model is fitted on a bounded sample of labelled rows: about ``FIT_ROWS`` rows, and of
each language at least about ``FIT_EACH`` (all, if it has no more), so that none is missed,
picked by a hash of their id, however many there are. Words and n-grams seen fewer than
``LEAST`` times in the sample are left to the fallback. Prediction reads nothing but the
text, and all of it.

Defined cases: a null or empty text, and a text without a letter, is ``und`` with score
0. With no labelled rows at all every text is ``und``. Equal sums go to the language
first in alphabetical order. Repeated rows are judged row by row; an empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, held

FIT_ROWS, FIT_EACH, LEAST, LONGEST, UNKNOWN = 3000, 750, 3, 4, "und"
_WORD = re.compile(r"[^\W\d_]+")
_SMOOTH = 0.5


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (kind, lang, gram, n): kind 0 for words, else the order."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        kind, lang, gram = zip(*seen, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(lang), pa.array(gram), pa.array(seen.values(), pa.int64())],
            names=["kind", "lang", "gram", "n"],
        )

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                seen[0, lang, word] += n
                for order in range(1, LONGEST + 1):
                    for gram in grams(word, order):
                        seen[order, lang, gram] += n
        if len(seen) > 150_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS, each: int = FIT_EACH) -> dict:
    """{languages, tables}; tables[0] has words, tables[n] n-grams, each gram with a log frequency per language."""
    known = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().collect()  # as many as languages, which the model holds anyway
    n = sum(r["count"] for r in sizes)
    cuts = [(r["lang"], max(1, int(1_000_000 * max(rows / n, each / r["count"])))) for r in sizes]
    cuts = labelled.sparkSession.createDataFrame(cuts, "lang string, cut long")
    spot = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    known = known.join(F.broadcast(cuts), "lang").where(spot < F.col("cut"))
    counted = known.select("text", "lang").mapInArrow(_counted, "kind int, lang string, gram string, n long")
    summed = counted.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")).groupBy("kind", "gram").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    )
    found = summed.where((F.col("total") >= LEAST) | (F.col("kind") == 1)).toArrow().to_pylist()
    languages = sorted({x for r in found for x, _ in r["by"]})
    place = {x: k for k, x in enumerate(languages)}
    tables: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in found:
        row = np.full(len(languages), _SMOOTH)
        for x, n in r["by"]:
            row[place[x]] += n
        tables[r["kind"]][r["gram"]] = row
    for one in tables:
        if one:
            total = np.log(sum(one.values()))
            for gram in one:
                one[gram] = tuple((np.log(one[gram]) - total).tolist())
    return {"languages": languages, "tables": tables}


class Scorer:
    def __init__(self, model: dict):
        self.languages, (words, *self.orders) = model["languages"], model["tables"]
        width = len(self.languages)
        self.known = len(words)
        self.fallback = Memory(self._by_grams, 50_000)
        self.place = {w: k for k, w in enumerate(words)}
        self.rows = np.array([*words.values(), (0.0,) * width]).reshape(-1, width)

    def _by_grams(self, word: str) -> tuple[float, ...]:
        for order in range(len(self.orders), 0, -1):
            near = [x for g in grams(word, order) if (x := self.orders[order - 1].get(g))]
            if near:
                return tuple(sum(x) / len(near) for x in zip(*near, strict=True))
        return (0.0,) * len(self.languages)

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not self.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        at = list(map(self.place.get, words))
        total = np.zeros(len(self.languages))
        if None in at:
            for word, k in zip(words, at, strict=True):
                if k is None:
                    total += self.fallback[word]
            at = [k for k in at if k is not None]
        if at:
            total += self.rows[at].sum(axis=0)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def language(text: Column, spark, model: dict) -> Column:
    """struct<lang_pred, score> of each text."""
    shared = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "model": model})

    def predict(texts: pa.Array) -> pa.Array:
        own = held(shared.value["key"], lambda: Scorer(shared.value["model"]))
        found = [own.predict(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays(
            [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["lang_pred", "score"]
        )

    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(text)
