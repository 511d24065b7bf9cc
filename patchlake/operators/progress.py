"""Run summaries and progress: latest state by key and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last event of each key by ``order``."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("x")).select(key, "x.*")


def overview(events: DataFrame, key: str = "url", order: str = "time") -> DataFrame:
    """One row (overall_percent, done, total): floor of the mean of the latest percents."""
    now = latest(events, key, order, "percent")
    return now.agg(F.coalesce(F.floor(F.avg("percent")), F.lit(0)).cast("long").alias("overall_percent"), F.count_if(F.col("percent") == 100).alias("done"), F.count("*").alias("total"))


def batch_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    """One row of counters over jobs; percent is 100 without jobs, rounded half up."""
    is_ = lambda s: F.count_if(F.col(status) == s)
    finished = F.count_if(F.col(status).isin("completed", "cached", "failed"))
    percent = F.when(F.count("*") > 0, F.floor(100 * finished / F.count("*") + 0.5)).otherwise(100)
    return jobs.agg(F.count("*").alias("total"), is_("completed").alias("completed"), is_("cached").alias("cached"), is_("failed").alias("failed"), is_("running").alias("running"), percent.cast("long").alias("overall_percent"))


def run_summary(jobs: DataFrame, run: str = "run_id") -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return jobs.groupBy(run).agg(is_("succeeded").alias("succeeded"), is_("cached").alias("cached"), is_("failed").alias("failed"), is_("cancelled").alias("cancelled"), F.count("*").alias("total"))


def latest_summary(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.max_by(F.struct(*summaries.columns), F.col("finished_at")).alias("x")).select("x.*")


def status_tag(percent: Column, stage: Column) -> Column:
    return F.when(percent == 100, "[DONE]").when(stage == "failed", "[ERR ]").otherwise("[RUN ]")


def run_id(now: Column, suffix: Column) -> Column:
    return F.concat(F.date_format(now, "yyyyMMdd'T'HHmmss"), F.lit("_"), suffix)


def retention_victims(revisions: DataFrame, now: Column, keep: int = 3, days: int = 30) -> DataFrame:
    """Revisions (pr, revision, mtime, is_active) to remove: ranked ``keep`` or later by recency, or older than ``days``.

    Ranks count every folder; active revisions and staging folders never go.
    """
    rank = F.row_number().over(Window.partitionBy("pr").orderBy(F.desc("mtime"), "revision")) - 1
    old = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp")) > days * 86400
    return revisions.withColumn("rank", rank).where(~F.col("is_active") & ~F.col("revision").startswith(".tmp-") & ((F.col("rank") >= keep) | old))


def expired_logs(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return logs.where(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp")) > days * 86400)


def is_expired(age_minutes: Column, ttl: int = 30) -> Column:
    return (age_minutes < 0) | (age_minutes >= ttl)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest row of each key of two tables of one shape."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*key, "x.*")
