"""Raw web pages (page_id, url, html) as documents, segments and links, by expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(html) -> F.Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def documents(pages: DataFrame) -> DataFrame:
    """url_key (the page's id), url, title, h1 headings, hrefs as absolute urls in order."""
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    title = _plain(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<h1[^>]*>(.*?)</h1>"), 1), _plain)
    hrefs = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"#]+)"'), 1)
    full = F.transform(hrefs, lambda h: F.when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(h))
    return pages.select(F.col("page_id").alias("url_key"), "url", F.nullif(title, F.lit("")).alias("title"), heads.alias("headings"), full.alias("hrefs"))


def links(docs: DataFrame) -> DataFrame:
    """src_key, pos, url of every link."""
    return docs.select(F.col("url_key").alias("src_key"), F.posexplode("hrefs").alias("pos", "url"))
