"""The operation log as a stream: tail a store's log, or commit a stream of operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import schema as S
from ..sources.store import Store


def tail(spark: SparkSession, root: str, generation: int) -> DataFrame:
    """A streaming DataFrame of a generation's committed operations, each batch's files once."""
    return spark.readStream.schema(S.OPS).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/ops/gen={generation}")


def commit_stream(records: DataFrame, store: Store, to_ops: Callable[[DataFrame], list[DataFrame]], checkpoint: str) -> StreamingQuery:
    """Commits every micro-batch of a stream as one batch of the log.

    to_ops turns a micro-batch into operation rows (see operators.mutate). All of them are
    last-writer-wins by key, so a micro-batch that is replayed after a failure is harmless.
    """

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(to_ops(batch))

    return records.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
