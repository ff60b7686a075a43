"""Corpus pipeline: five stages over documents, each on all that the one before it kept.

Language ID and toxicity reject documents, near-duplicate detection keeps one document of
each group, decontamination rejects what holds a benchmark passage, and packing lays the
rest out in sequences. All stages but the last return the columns of documents. Each
stage's rows are written as Parquet to the folder that the session shares between driver
and executors, and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, lang_id, near_dup, packing, toxicity
from weftgraph.llm.common import stored, table

LEAST_SURE = 0.5
ORACLE_SQL = None  # models and tokenizers are no SQL; tests hold the stages against brute force


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as one column `row`, beside its doc_id and text, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a score of LEAST_SURE; `und` goes."""
    model = lang_id.fit(docs)
    found = _rows(docs).withColumn("found", lang_id.language(F.col("text"), spark, model))
    kept = (F.col("found.lang_pred") != lang_id.UNKNOWN) & (F.col("found.score") >= LEAST_SURE)
    return found.where(kept).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below the operator's threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = _rows(docs).withColumn("found", toxicity.toxicity(F.col("text"), spark, model))
    return found.where(F.col("found.score") < toxicity.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar rows the one with the smallest id.

    Rows are judged one by one, whatever their ids: of equal rows one stays, and rows that
    share an id but no text both stay. A null id comes after all others.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_dup.groups(rows, doc_id=key, also=("doc_id",)).toDF("id", "doc_id", "n", "group", "kept")
    found = stored(found.select("id", "doc_id", "group"), "found")
    least = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "id"))
    first = found.groupBy("group").agg(least.alias("first")).select("first.id")
    gone = stored(found.join(first, "id", "left_anti").select("id"), "gone")
    # only rows that may go are shuffled
    perhaps = near_dup.marked(rows.select(F.col(key).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), gone)
    stay = perhaps.where("marked").join(gone, "id", "left_anti").select("row")
    return perhaps.where("not marked").select("row").union(stay).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
