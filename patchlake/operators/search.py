"""Search and look-ups over published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import coerced_file_id

TRUNCATED = "\n... [Diff truncated due to size limit]"


def search_files(index: DataFrame, path: str | None = None, language: str | None = None, status: str | None = None, change_kind: str | None = None, risk_tag: str | None = None, limit: int | None = 50) -> DataFrame:
    """Rows that meet every given filter, the first ``limit`` in file order, each with the total before the limit."""
    d = index
    if path:
        d = d.where(F.contains(F.lower("path"), F.lit(path.lower())))
    for name, value in (("language", language), ("status", status), ("change_kind", change_kind)):
        if value:
            d = d.where(F.lower(name) == value.lower())
    if risk_tag:
        d = d.where(F.array_contains("risk_tags", risk_tag))
    at = F.row_number().over(Window.partitionBy("pr").orderBy("ord"))
    total = F.count("*").over(Window.partitionBy("pr"))
    return d.withColumns({"total": total, "_at": at}).where(F.col("_at") <= (limit or 50)).drop("_at")


def file_change(changes: DataFrame, patches: DataFrame, pr, file, include_patch: bool = True, most: int = 16000) -> DataFrame:
    """The change document of one file, with its patch cut to ``most`` characters; ``file`` may be a number."""
    d = changes.where((F.col("pr") == pr) & (F.col("file_id") == coerced_file_id(F.lit(file))))
    if not include_patch:
        return d.withColumn("truncated", F.lit(False))
    d = d.join(patches.select("pr", "file_id", "patch"), ["pr", "file_id"], "left")
    return d.withColumn("truncated", F.coalesce(F.length("patch") > most, F.lit(False))).withColumn("patch", truncated(F.col("patch"), most))


def file_changes(changes: DataFrame, patches: DataFrame, most: int = 16000) -> DataFrame:
    """Change documents of many files with their patches cut to ``most`` characters; rows of both are found by (pr, file_id)."""
    d = changes.join(patches.select("pr", "file_id", "patch"), ["pr", "file_id"], "left")
    return d.withColumn("truncated", F.coalesce(F.length("patch") > most, F.lit(False))).withColumn("patch", truncated(F.col("patch"), most))


def truncated(patch: Column, most: int = 16000) -> Column:
    return F.when(F.length(patch) > most, F.concat(F.substring(patch, 1, most), F.lit(TRUNCATED))).otherwise(patch)


def sync_status(pointers: DataFrame, manifests: DataFrame, prs: DataFrame) -> DataFrame:
    """For each asked pr whether a revision is active, and its statistics."""
    d = prs.select("pr").join(pointers.select("pr", "active_revision", "source_commit", "target_commit"), "pr", "left").join(manifests.select("pr", "stats"), "pr", "left")
    return d.withColumn("synced", F.col("active_revision").isNotNull())


def cached(inserts: DataFrame, now: Column, capacity: int = 30, ttl_seconds: int = 30 * 86400) -> DataFrame:
    """What a cache holds at ``now`` after ``inserts`` (key, inserted_at): the newest insertion of each key, the last ``capacity`` of those, none older than the time to live.

    Reading an entry does not keep it: the oldest insertion goes first.
    """
    last = inserts.groupBy("key").agg(F.max("inserted_at").alias("inserted_at"))
    kept = last.orderBy(F.desc("inserted_at"), F.desc("key")).limit(capacity)
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("inserted_at").cast("timestamp"))
    return kept.where(age < ttl_seconds)
