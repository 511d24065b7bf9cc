"""Registry of links: check, deduplicate, add and remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import parse_link


def checked(links: DataFrame) -> DataFrame:
    """``links`` (ord, url) with the parsed struct ``link``."""
    return links.withColumn("link", parse_link(F.col("url")))


def valid(links: DataFrame) -> DataFrame:
    return checked(links).where("link.error is null").select("ord", F.col("link.canonical_url").alias("url"))


def invalid(links: DataFrame) -> DataFrame:
    return checked(links).where("link.error is not null").select("ord", "url", F.col("link.error").alias("error"))


def deduplicated(links: DataFrame) -> DataFrame:
    """Canonical links, each at its first place; invalid ones are left out."""
    return valid(links).groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url")


def added(links: DataFrame, new: DataFrame) -> DataFrame:
    """``links`` and those of ``new`` that are not there yet, after them."""
    fresh = deduplicated(new).join(links.select("url"), "url", "left_anti").crossJoin(F.broadcast(links.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))))
    return links.select("ord", "url").unionByName(fresh.select((F.col("ord") + F.col("top") + 1).alias("ord"), "url"))


def removed(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(valid(gone).select("url"), "url", "left_anti").select("ord", "url")
