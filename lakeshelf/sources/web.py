"""Titles, links and label anchors of stored web pages, by SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url) of every link in page order."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("url"))


def anchors(pages: DataFrame, part: str = "/label/") -> DataFrame:
    """(page_id, url, text, number): distinct links whose address has a part, with their text and the id in the address."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r'(<a\s[^>]*href="[^"]*"[^>]*>[^<]*)'), 1))
    rows = pages.select("page_id", found.alias("a")).select("page_id", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_extract("a", r">([^<]*)$", 1)).alias("text"))
    return rows.where(F.col("url").contains(part)).withColumn("number", F.regexp_extract("url", r"/(\d+)(?:[/?#].*)?$", 1).try_cast("long")).dropDuplicates(["page_id", "url"])
