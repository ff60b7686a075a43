"""Text functions as column expressions: tokens, terms, tiers, costs and weights."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ((1000.0, "equal"), (100.0, "prefix"), (1.0, "within"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda x: x != "")


def terms(text: Column) -> Column:
    """Query terms: tokens of two bytes at least, each at its first place."""
    return F.array_distinct(F.filter(tokens(text), lambda x: F.octet_length(x) >= 2))


def searchable_url(url: Column) -> Column:
    """The url behind its scheme."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)


def tier(token: Column, term: Column) -> Column:
    """1000 for the term itself, 100 for a token that starts with it, 1 for one that holds it, else null."""
    return F.when(token == term, 1000.0).when(F.startswith(token, term), 100.0).when(F.contains(token, term), 1.0)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.1), F.log(1 + n / (1 + df)))


def token_cost(url: Column, title: Column, snippet: Column, anchor: Column) -> Column:
    """Estimated tokens of a rendered hit: a quarter of its bytes, rounded up."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    total = size(url) + size(title) + size(snippet) + F.when(anchor.isNotNull(), F.octet_length(anchor) + 12).otherwise(0) + 16
    return F.floor((total + 3) / 4).cast("long")


def strength(weight: Column, inferred: Column, floor: int = 1) -> Column:
    """An edge's weight as a share, 0.6 of it if inferred."""
    return F.greatest(weight, F.lit(floor)) / F.lit(65535.0) * F.when(inferred, 0.6).otherwise(1.0)


def proposed_weight(weight: Column, confidence: Column) -> Column:
    """The weight that an enrichment's edge gets."""
    return F.greatest(F.lit(1), F.floor(weight * confidence).cast("int"))


def segment_prior(depth: Column, ordinal: Column, label: Column, keywords: Column) -> Column:
    """Importance of a heading from its depth, place and share of keywords among its words."""
    base = F.when(depth <= 1, 1.0).when(depth == 2, 0.72).otherwise(0.5)
    words = tokens(label)
    known = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda x: F.lower(x))
    hits = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    share = F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)
    value = base / (1 + 0.15 * ordinal) * (1 + share) * 32767
    return F.floor(F.least(F.greatest(value, F.lit(1.0)), F.lit(65535.0))).cast("int")


def label_fits(label: Column, most: int = 2048) -> Column:
    return label.isNull() | (F.octet_length(label) <= most)


def url_key(url: Column) -> Column:
    """xxh3-64 of a url as a signed 64-bit key. Spark has another xxHash only, hence a pandas UDF."""
    import xxhash

    @F.pandas_udf("bigint")
    def key(values: pd.Series) -> pd.Series:
        signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
        return values.map(lambda x: None if x is None else signed(xxhash.xxh3_64_intdigest(x))).astype("Int64")

    return key(url)


def segment_key(node_key: Column, label: Column) -> Column:
    """xxh3-64 of the owner's key (eight bytes, little endian), a zero byte and the label."""
    import xxhash

    @F.pandas_udf("bigint")
    def key(owners: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for owner, own in zip(owners, labels, strict=True):
            n = xxhash.xxh3_64_intdigest(int(owner).to_bytes(8, "little", signed=True) + b"\x00" + (own or "").encode())
            out.append(n - (1 << 64) if n >= 1 << 63 else n)
        return pd.Series(out, dtype="int64")

    return key(node_key, label)


def split_terms(text: str) -> list[str]:
    """The query terms of a text on the driver, by the same rule."""
    parts = re.split(r"[\W_]+", text.lower())
    return list(dict.fromkeys(x for x in parts if len(x.encode()) >= 2))
