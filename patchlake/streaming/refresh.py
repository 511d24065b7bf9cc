"""Incremental refresh: landed raw revisions as a stream, of which only missing or outdated change sets are analysed.

Each micro-batch is compared with the store's active revisions, what is not cached is
analysed and published as one batch, and the commit carries a token made of the stream's
name and the micro-batch's number. A replayed micro-batch finds its token in the log and
changes nothing, so every micro-batch is published exactly once, whenever the driver or
an executor is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import discovery
from ..plans.revision import analyze
from ..sources import store

#: Publishes rows as one batch made from a version, under a token.
Put = Callable[[DataFrame, int, str], None]


def facts_of_metadata() -> list[Column]:
    """Commits and update time of raw revisions in the provider's shape."""
    m = lambda path: F.col(f"metadata.{path}")
    return [m("source.commit.hash").alias("source_commit"), m("destination.commit.hash").alias("target_commit"), m("updated_on").alias("updated_on")]


def outdated(raw: DataFrame, at: store.Snapshot, facts: list[Column]) -> DataFrame:
    """The rows of ``raw`` that the store's active revisions do not cover, one a change set, with ``generated_at``.

    Cached is what has both commits of the active revision, or was updated no later than
    it. Of several rows of a change set that are not, the last by update time counts
    (times that cannot be read first, then by commits and content). Rows without a pr
    are no change set's. ``generated_at`` is the row's own update time: it says what an
    analysis knows, not when it ran, so rows that were landed before and read later are
    not taken for known, and a second run gives the same.
    """
    stale = raw.where("pr is not null").select(F.col("pr").alias("id"), *facts, F.struct(*raw.columns).alias("row"))
    active = at.pointers()
    if active is not None:
        known = active.select(F.col("pr").alias("id"), F.col("source_commit").alias("have_source"), F.col("target_commit").alias("have_target"), "generated_at")
        stale = discovery.outdated(discovery.cache_status(stale, known))
    order = F.struct(F.col("updated_on").try_cast("timestamp"), "source_commit", "target_commit", F.xxhash64("row"))
    last = stale.groupBy("id").agg(F.max_by(F.struct("row", "updated_on"), order).alias("x"))
    return last.select("x.row.*", F.col("x.updated_on").alias("generated_at"))


def refresh(stream: DataFrame, root: str, put: Put, checkpoint: str, name: str, facts: list[Column] | None = None, tries: int = 20) -> StreamingQuery:
    """Brings the store at ``root`` up to date with all rows landed so far, then ends.

    ``stream`` has pr and what ``facts`` (source_commit, target_commit, updated_on) are
    read from. ``name`` belongs to one checkpoint: together with the number of the
    micro-batch it is the token of what is published. Where another publisher gets to a
    change set first, the rows are compared with the store anew, up to ``tries`` times.
    The rows to analyse are written beside the store once and removed after.
    """
    facts = facts_of_metadata() if facts is None else facts

    def each(batch: DataFrame, number: int) -> None:
        spark, token = batch.sparkSession, f"{name}-{number}"
        for turn in range(tries):
            at = store.snapshot(spark, root)
            if store.applied(spark, root, token):
                return
            staging = f"{root}/.tmp-refresh-{uuid.uuid4().hex}"
            try:
                found = outdated(batch, at, facts)
                found.write.parquet(staging)
                rows = spark.read.schema(found.schema).parquet(staging)
                if not rows.isEmpty():
                    put(rows, at.version, token)
                return
            except store.Conflict:
                if turn + 1 == tries:
                    raise
            finally:
                store.remove(spark, staging)

    return stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_analysis(root: str, ticket_prefixes: list[str] | None = None) -> Put:
    """The whole analysis of raw revisions in the provider's shape, checked by the gate and published."""

    def put(rows: DataFrame, base: int, token: str) -> None:
        spark, staging = rows.sparkSession, f"{root}/.tmp-analysis-{uuid.uuid4().hex}"

        def keep(d: DataFrame) -> DataFrame:
            path = f"{staging}/{uuid.uuid4().hex}"
            d.write.parquet(path)
            return spark.read.schema(d.schema).parquet(path)

        try:
            times = rows.select("pr", F.coalesce("generated_at", F.lit("")).alias("generated_at"))
            rev = analyze(rows, F.lit(""), ticket_prefixes, keep=keep)
            dated = rev.tables["manifest"].join(times, "pr")
            rev.tables["manifest"] = dated.withColumn("provenance", F.col("provenance").withField("generated_at", F.col("generated_at"))).drop("generated_at")
            store.publish(root, rev.tables, rev.rolled, rev.details, F.col("provenance.generated_at"), base=base, token=token)
        finally:
            store.remove(spark, staging)

    return put
