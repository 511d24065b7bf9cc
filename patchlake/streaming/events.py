"""Progress as a stream: latest state by key, upserts of pointers, and redacted logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sanitize import redact_columns

EVENT = "run_id string, url string, stage string, percent int, message string, time timestamp"


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def latest_state(stream: DataFrame, key: str = "url", order: str = "time") -> DataFrame:
    """Latest event of each key; state is one row a key, for update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by stage in windows of event time; events later than ``late`` are dropped with their state."""
    return stream.withWatermark("time", late).groupBy(F.window("time", width), "stage").count().select(F.col("window.start").alias("start"), "stage", "count")


def append_redacted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return redact_columns(stream).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stream: DataFrame, put: Callable[[DataFrame], None], checkpoint: str, key: str = "url", order: str = "time") -> StreamingQuery:
    """Each micro-batch reduced to its latest row by key and handed to ``put``, which replaces older rows; replays are harmless."""

    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        put(batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
