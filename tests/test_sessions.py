"""Keyed sessions on a stream against a plain reading of the same events."""

import datetime
import random

from pyspark.sql import functions as F

from patchlake.streaming import sessions

SCHEMA = "who string, time timestamp, tie long, stage string"
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(minutes):
    return ZERO + datetime.timedelta(minutes=minutes)


def plain(events, ttl=30):
    """Sessions of (who, minute, tie, stage): sorted, cut where ``ttl`` minutes pass."""
    out = []
    for who, minute, tie, stage in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if out and out[-1][0] == who and minute - out[-1][2] < ttl:
            out[-1][2:] = [minute, out[-1][3] + 1, stage]
        else:
            out.append([who, minute, minute, 1, stage])
    return out


def run(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = sessions.write_lapsed(sessions.lapsed(stream, "who"), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert q.awaitTermination(300) and q.exception() is None
    minute = lambda c: ((F.unix_seconds(c) - int(ZERO.timestamp())) / 60).cast("int")
    rows = spark.read.parquet(f"file://{tmp_path}/out").select("who", minute(F.col("started")).alias("a"), minute(F.col("ended")).alias("b"), "events", "stage").collect()
    return sorted([r["who"], r["a"], r["b"], r["events"], r["stage"]] for r in rows)


def put(spark, tmp_path, events):
    rows = [(who, None if m is None else at(m), tie, stage) for who, m, tie, stage in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")


def test_sessions_lapse_over_late_rows_and_restarts(spark, tmp_path):
    first = [("a", 0, 1, "x"), ("a", 29, 2, "y"), ("b", 29, 3, "x"), ("b", 59, 4, "y"), ("c", 100, 5, "x"), ("c", 100, 6, "z"), ("d", 70, 7, "q"), (None, 5, 8, "x"), ("a", None, 9, "x")]
    put(spark, tmp_path, first)
    # the watermark is at 90: what ended by 60 has lapsed, both sides of exactly 30 minutes included
    assert run(spark, tmp_path) == [["a", 0, 29, 2, "y"], ["b", 29, 29, 1, "x"], ["b", 59, 59, 1, "y"]]
    # restarted: 89 and 90 are late, 91 is not and joins the open session of d; old sessions stay as written
    put(spark, tmp_path, [("a", 89, 10, "late"), ("d", 90, 11, "late"), ("d", 91, 12, "r"), ("e", 95, 13, None), ("c", 300, 14, "x")])
    want = [["a", 0, 29, 2, "y"], ["b", 29, 29, 1, "x"], ["b", 59, 59, 1, "y"], ["c", 100, 100, 2, "z"], ["d", 70, 91, 2, "r"], ["e", 95, 95, 1, None]]
    assert run(spark, tmp_path) == want
    # nothing new: nothing is written twice
    assert run(spark, tmp_path) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != sessions.PROVIDER


def test_sessions_join_in_any_order():
    dice = random.Random(5)
    for _ in range(300):
        events = [("k", dice.randrange(400), n, dice.choice("xyz")) for n in range(dice.randrange(1, 30))]
        got = []
        for _, minute, tie, stage in events:
            sessions.add(got, (minute, minute, 1, tie, stage), 30)
        assert [["k", s[0], s[1], s[2], s[4]] for s in got] == plain(events)
