"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import connected as components
from ..sources.tables import shared_dir
from ..sources.tables import written as stored

__all__ = ["Memory", "components", "held", "lower_ascii", "remainder", "sampled", "shared_dir", "stored", "table"]


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What `make` gives for a key, kept in this Python worker until another key is asked for.

    Workers outlive stages; models and tables of operators that are done must not add up.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; null becomes empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


class Memory(dict):
    """Remembers what `make` gives for a key; the keys used last stay, at most 2 * most of them."""

    def __init__(self, make, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def sampled(rows: DataFrame, doc_id: str, most: int, salt: str) -> DataFrame:
    """About `most` rows at most, picked by a hash of doc_id; all of them if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * most / n))
