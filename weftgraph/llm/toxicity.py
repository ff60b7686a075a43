"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence scores by a logistic function of the features of its words: the word and its
first three to ten letters. A document is toxic if any sentence is: the sentence
scores combine by noisy-or, with a small leak for documents of which no sentence says
anything. Only document labels train it: the likelihood of the noisy-or is maximised over
the weights, which also tells the offending sentences apart.

The model is fitted on a bounded sample of labelled rows: about ``FIT_ROWS`` / 2 rows of
each label, picked by a hash of their id. Features are those that stand in many more
toxic than other documents of the sample (``LEAST`` at least, and by more than ``STRENGTH``
standard errors), the ``MOST_FEATURES`` strongest. Scoring reads
the whole text and nothing else.

Defined cases: a null or empty text has the leak as its score. Labels other than 0 and 1
and null ids don't train. With no row of either label every score is 0. Repeated rows
are scored row by row. An empty table gives no rows. Other columns are not looked at.
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

from .common import Memory, held, sampled, stored

FIT_ROWS, MOST_FEATURES, LEAST, STRENGTH, THRESHOLD = 8000, 4000, 7, 6.0, 0.7
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
_OUT = "struct<score:double,offending:array<struct<sentence:int,score:double>>>"


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in range(3, 11) if len(word) >= n)]


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence that has any."""
    own: list[str] = []
    for token in _TOKEN.findall(text.lower()):
        if token not in _ENDS:
            own.append(token)
        elif own:
            yield own
            own = []
    if own:
        yield own


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (feature, label, documents that have it)."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        feature, label = zip(*seen, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(feature), pa.array(label, pa.int32()), pa.array(seen.values(), pa.int64())], names=["feature", "label", "n"]
        )

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for s in sentences(text or "") for w in s}
            seen.update((f, label) for f in {f for w in words for f in features(w)})
        if len(seen) > 150_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _bags(place: dict[str, int]):
    """(text, label) to (label, per sentence with any: its features' places)."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_bags = []
            for text in batch.column(0).to_pylist():
                own = ({place[f] for w in s for f in features(w) if f in place} for s in sentences(text or ""))
                all_bags.append([sorted(x) for x in own if x])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(all_bags, pa.list_(pa.list_(pa.int32())))], names=["label", "bags"])

    return bag


def train(labels: np.ndarray, bags: list[list[list[int]]], n: int, steps: int = 300) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the noisy-or likelihood (Adam on all of it)."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], dtype=np.int64)
    flat = [s for bag in bags for s in bag]
    of = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    what = np.array([f for s in flat for f in s], dtype=np.int64)
    x = np.concatenate([np.full(n, 0.5), [-2.0, -4.0]])  # weights, bias, logit of the leak
    m, v = np.zeros_like(x), np.zeros_like(x)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p = squash(np.bincount(of, x[what], len(flat)) + x[n])
        leak = squash(x[n + 1])
        silent = np.log1p(-leak) + np.bincount(doc, np.log1p(-p + 1e-12), len(labels))  # log P(not toxic)
        none = np.exp(silent)
        pull = np.where(labels == 1, none / np.maximum(1 - none, 1e-6), -1.0)  # d log-likelihood / d(-silent)
        by_sentence = pull[doc] * p
        g = np.concatenate([np.bincount(what, by_sentence[of], n), [by_sentence.sum(), (pull * leak).sum()]])
        g[:n] -= 0.01 * x[:n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x[:n], float(x[n]), float(squash(x[n + 1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> dict:
    """{weights by feature, bias, leak}, from the labels of documents."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    picked = sampled(known.where("label = 1"), "id", rows // 2, "toxic").unionByName(sampled(known.where("label = 0"), "id", rows // 2, "toxic"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    joined = stored(texts.join(F.broadcast(picked), "id").select("text", "label"), "sample")  # about `rows` small rows are broadcast
    n = {r["label"]: r["count"] for r in joined.groupBy("label").count().collect()}
    if len(n) < 2:
        return {"weights": {}, "bias": 0.0, "leak": 0.0}
    seen = joined.mapInArrow(_present, "feature string, label int, n long").groupBy("feature").agg(
        F.sum(F.col("n") * F.col("label")).alias("a"), F.sum(F.col("n") * (1 - F.col("label"))).alias("b")
    )
    rate_1, rate_0 = (F.col("a") + 0.5) / (n[1] + 1), (F.col("b") + 0.5) / (n[0] + 1)
    both = (F.col("a") + F.col("b") + 1) / (n[0] + n[1] + 2)
    strength = (rate_1 - rate_0) / F.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    chosen = seen.where((F.col("a") >= LEAST) & (rate_1 > 4 * rate_0)).withColumn("strength", strength).where(F.col("strength") > STRENGTH)
    chosen = [r["feature"] for r in chosen.orderBy(F.desc("strength"), "feature").limit(MOST_FEATURES).select("feature").collect()]
    place = {f: k for k, f in enumerate(chosen)}
    bags = joined.mapInArrow(_bags(place), "label int, bags array<array<int>>").toArrow()
    if not chosen:
        return {"weights": {}, "bias": 0.0, "leak": 0.0}
    weights, bias, leak = train(bags["label"].to_numpy(), bags["bags"].to_pylist(), len(chosen))
    return {"weights": dict(zip(chosen, weights.tolist(), strict=True)), "bias": bias, "leak": leak}


class Scorer:
    def __init__(self, model: dict):
        self.weights, self.bias, self.leak = model["weights"], model["bias"], model["leak"]
        self.words = Memory(self._of)

    def _of(self, token: str) -> bool:
        return any(f in self.weights for f in features(token))

    def score(self, text: str) -> tuple[float, list[dict]]:
        """The document's score, and the sentences (numbered from 0) that are toxic by themselves."""
        tokens = _TOKEN.findall(text.lower())
        says = list(map(self.words.__getitem__, tokens))
        if not any(says):
            return self.leak, []
        clean, offending = 1 - self.leak, []
        for k, words in enumerate(sentences(text)):
            own = {f for w in words if self.words[w] for f in features(w) if f in self.weights}
            if own:
                p = 1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in own))))
                clean *= 1 - p
                if p >= 0.5:
                    offending.append({"sentence": k, "score": float(p)})
        return float(1 - clean), offending


def toxicity(text: Column, spark, model: dict) -> Column:
    """struct<score, offending sentences> of each text."""
    shared = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "model": model})

    def score(texts: pa.Array) -> pa.Array:
        own = held(shared.value["key"], lambda: Scorer(shared.value["model"]))
        found = [own.score(x.as_py() or "") for x in texts]
        kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], kind)], ["score", "offending"])

    return F.arrow_udf(score, _OUT)(text)
