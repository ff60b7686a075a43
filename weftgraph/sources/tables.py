"""Writing intermediate tables once, and numbering rows without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreIOError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. A local one only if none is named and
    driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise StoreIOError("spark.checkpoint.dir names no folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a job's shuffle files go when it ends, not when the driver's JVM happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def unsigned(key: Column) -> Column:
    """Orders signed 64-bit keys as unsigned ones."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number from 0 in the given total order.

    Ranges are sorted and numbered in parallel; only one count per range meets.
    """
    spark = df.sparkSession
    names = df.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"__{k}") for k, c in enumerate(order)]
    by = [f"__{k}" for k in range(len(order))]
    dealt = df.select("*", *keys).repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*[F.col(f"`{c}`") for c in names])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(range(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), at], names=[*names, "__part", "__at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    held = written(dealt.mapInArrow(number, f"{schema}, __part int, __at bigint"), "numbered")
    sizes = sorted((r["__part"], r["count"]) for r in held.groupBy("__part").count().collect())
    before, rows = 0, []
    for part, count in sizes:
        rows.append((part, before))
        before += count
    starts = spark.createDataFrame(rows, "__part int, __before bigint")  # one row per range
    return held.join(F.broadcast(starts), "__part").select(*[F.col(f"`{c}`") for c in names], (F.col("__at") + F.col("__before")).alias(name))
