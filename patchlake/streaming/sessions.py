"""Keyed sessions with expiry: the state of a key lapses a time to live after its last event.

Event time decides, never the clock of a worker. State is one entry a session that has not
lapsed, kept in RocksDB, and one timer a key wakes it when the watermark passes an end, so
keys that never come back leave nothing behind. Rows may arrive in any order: one that
falls within a time to live of two sessions joins them. A row at or before the watermark
of the earlier batches is late and takes no part; neither does one without key or time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: first, last, events, tie and stage of a session; times in microseconds, the stage is that of its last event.
Session = tuple[int, int, int, int, str | None]


def joined(a: Session, b: Session) -> Session:
    """One session of two: the later stage stays, of equal times that with the larger tie."""
    late = max(a, b, key=lambda s: (s[1], s[3], s[4] is not None, s[4] or ""))
    return min(a[0], b[0]), late[1], a[2] + b[2], late[3], late[4]


def add(sessions: list[Session], new: Session, ttl: int) -> None:
    """Puts a session among others, sorted by time, and joins those less than ``ttl`` apart."""
    at = bisect_right(sessions, new[0], key=lambda s: s[0])
    if at > 0 and new[0] - sessions[at - 1][1] < ttl:
        at -= 1
        new = joined(sessions.pop(at), new)
    while at < len(sessions) and sessions[at][0] - new[1] < ttl:
        new = joined(new, sessions.pop(at))
    sessions.insert(at, new)


class Sessions(StatefulProcessor):
    def __init__(self, key: str, ttl: int) -> None:
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, events long, tie long, stage string")

    def _end(self, s: Session) -> int:
        """The millisecond at which a session has lapsed, never before its microsecond."""
        return -(-(s[1] + self.ttl) // 1000)

    def _keep(self, sessions: list[Session]) -> None:
        """Keeps the open sessions and one timer, at the first end among them."""
        first = min(map(self._end, sessions), default=None)
        there = set(self.handle.listTimers())
        for t in there - {first}:
            self.handle.deleteTimer(t)
        if first is None:
            self.open.clear()
            return
        if first not in there:
            self.handle.registerTimer(first)
        self.open.put(sessions)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        sessions = sorted((tuple(s) for s in self.open.get()), key=lambda s: s[0])
        for r in rows:
            add(sessions, (r["at"], r["at"], 1, r["tie"], r["stage"]), self.ttl)
        self._keep(sessions)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        sessions = sorted((tuple(s) for s in self.open.get()), key=lambda s: s[0])
        self._keep([s for s in sessions if self._end(s) > now])
        for first, last, n, _, stage in sessions:
            if self._end((first, last, n, 0, stage)) <= now:
                yield Row(**{self.key: key[0], "first": first, "last": last, "events": n, "stage": stage})


def lapsed(stream: DataFrame, key: str = "url", time: str = "time", tie: str = "tie", stage: str = "stage", minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Rows (key, started, ended, events, stage) of the sessions that have lapsed, each once, in append mode.

    A session is the events of a key less than ``minutes`` apart; ``stage`` is its last
    one, of equal times that with the larger ``tie`` (a long).
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(key, time, F.unix_micros(time).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.col(stage).cast("string").alias("stage"))
    out = rows.groupBy(key).transformWithState(Sessions(key, minutes * 60_000_000), f"`{key}` {kind}, first long, last long, events long, stage string", "Append", "EventTime")
    return out.select(key, F.timestamp_micros("first").alias("started"), F.timestamp_micros("last").alias("ended"), "events", "stage")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_lapsed(sessions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends lapsed sessions to a Parquet folder; a restart from ``checkpoint`` goes on where it was and writes none twice."""
    with rocksdb(sessions.sparkSession):
        return sessions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
