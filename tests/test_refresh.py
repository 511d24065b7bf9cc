"""The refresh stream: what is analysed, replays, failures in between, and other publishers."""

import os

import pytest
from pyspark.sql import functions as F

from patchlake.sources import commits, landed, store
from patchlake.streaming import refresh

FLAT = "pr long, source_commit string, target_commit string, updated_on string, note string"
FACTS = ("source_commit", "target_commit", "updated_on")


def land(spark, folder, rows, schema=FLAT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(day):
    return f"2024-05-{day:02d}T00:00:00Z"


def putting(root, before=None):
    def put(rows, base, token):
        if before:
            before()
        store.publish_batch(root, {"notes": rows.select("pr", "note")}, rows.select("pr", "generated_at", "source_commit", "target_commit"), base=base, token=token)

    return put


def run(spark, tmp_path, put=None, schema=FLAT):
    root = f"file://{tmp_path}/store"
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"file://{tmp_path}/in")
    return refresh.refresh(stream, root, put or putting(root), f"file://{tmp_path}/check", "r", [F.col(c) for c in FACTS]).awaitTermination()


def notes(spark, tmp_path):
    d = store.read_table(spark, f"file://{tmp_path}/store", "notes")
    return {} if d is None else {r["pr"]: r["note"] for r in d.collect()}


def test_only_missing_and_outdated_change_sets_are_analysed(spark, tmp_path):
    folder, root = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    land(spark, folder, [(1, "a", "m", at(2), "one"), (2, "b", "m", at(2), "two"), (2, "c", "m", at(3), "later"), (2, "c", "m", at(3), "later"), (None, "x", "m", at(3), "no change set"), (3, None, None, None, "bare")])
    run(spark, tmp_path)
    assert notes(spark, tmp_path) == {1: "one", 2: "later", 3: "bare"}
    # same commits, updated before, newer, and again without anything to tell by
    land(spark, folder, [(1, "a", "m", at(9), "same"), (2, "d", "m", at(1), "late"), (3, "e", "m", at(1), "known now"), (4, "f", "m", "never", "unread")])
    run(spark, tmp_path)
    assert notes(spark, tmp_path) == {1: "one", 2: "later", 3: "known now", 4: "unread"}
    run(spark, tmp_path)  # nothing new
    land(spark, folder, [(1, "a", "m", at(9), "same")])
    run(spark, tmp_path)  # nothing outdated
    assert commits.latest(spark, root) == 2 and [c["token"] for c in commits.since(spark, root, 0)] == ["r-0", "r-1"]
    assert not [n for n in commits.names(spark, root) if n.startswith(".tmp")]


def test_an_empty_landing_folder_is_no_error(spark, tmp_path):
    land(spark, f"file://{tmp_path}/in", [])
    run(spark, tmp_path)
    assert notes(spark, tmp_path) == {} and commits.latest(spark, f"file://{tmp_path}/store") == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    land(spark, f"file://{tmp_path}/in", [(1, "a", "m", at(2), "one"), (2, "b", "m", at(2), "two")])
    run(spark, tmp_path)
    # the driver was lost after the commit of the store and before that of the stream
    for name in ("0", ".0.crc"):
        os.remove(f"{tmp_path}/check/commits/{name}")
    # meanwhile another publisher went on: the replay must not bring the old revision back
    d = spark.createDataFrame([(1, "z", "m", at(1), "theirs")], FLAT)
    store.publish_batch(root, {"notes": d.select("pr", "note")}, d.selectExpr("pr", "updated_on as generated_at", "source_commit", "target_commit"), "theirs")
    calls = []
    run(spark, tmp_path, putting(root, lambda: calls.append(1)))
    assert not calls and notes(spark, tmp_path) == {1: "theirs", 2: "two"} and commits.latest(spark, root) == 2


def test_a_failure_before_the_commit_is_made_good(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    land(spark, f"file://{tmp_path}/in", [(1, "a", "m", at(2), "one")])

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lost)
        with pytest.raises(Exception, match="driver lost"):
            run(spark, tmp_path)
    assert notes(spark, tmp_path) == {} and commits.names(spark, f"{root}/tables/notes") == []
    run(spark, tmp_path)
    assert notes(spark, tmp_path) == {1: "one"}


def test_another_publisher_in_between_is_compared_anew(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    land(spark, f"file://{tmp_path}/in", [(1, "a", "m", at(2), "one"), (2, "b", "m", at(2), "two")])
    turns = []

    def theirs():
        turns.append(1)
        if len(turns) == 1:
            d = spark.createDataFrame([(1, "z", "m", at(8), "newer")], FLAT)
            store.publish_batch(root, {"notes": d.select("pr", "note")}, d.selectExpr("pr", "updated_on as generated_at", "source_commit", "target_commit"))

    run(spark, tmp_path, putting(root, theirs))
    assert len(turns) == 2 and notes(spark, tmp_path) == {1: "newer", 2: "two"}
    assert commits.latest(spark, root) == 2


def test_a_token_is_committed_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    d = spark.createDataFrame([(1, "a", "m", at(2), "one")], FLAT)
    put = putting(root)
    put(d.withColumnRenamed("updated_on", "generated_at"), 0, "t-0")
    with pytest.raises(store.Conflict, match="t-0"):
        put(d.withColumn("pr", F.lit(5).cast("long")).withColumnRenamed("updated_on", "generated_at"), 0, "t-0")
    with pytest.raises(store.Conflict, match="t-0"):
        put(d.withColumn("pr", F.lit(5).cast("long")).withColumnRenamed("updated_on", "generated_at"), 1, "t-0")
    assert notes(spark, tmp_path) == {1: "one"} and len(commits.names(spark, f"{root}/revisions")) == 1


def test_whole_analysis_through_the_gate(spark, tmp_path):
    from test_revision import DIFF, SCHEMA

    def raw(title, commit, day):
        meta = (1, title, "", "OPEN", None, None, (("feature/x",), (commit,)), (("main",), ("b" * 40,)), at(day))
        stats = [("modified", 1, 0, ("src/HomeController.cs",), ("src/HomeController.cs",)), ("modified", 1, 1, ("README.md",), ("README.md",))]
        return ("7", meta, [("c" * 40, "first line\nmore")], stats, DIFF)

    assert landed.METADATA in SCHEMA
    root, folder = f"file://{tmp_path}/store", f"file://{tmp_path}/in"
    for title, commit, day in (("first", "a" * 40, 2), ("same commit", "a" * 40, 9), ("second", "e" * 40, 3), ("late", "f" * 40, 1)):
        land(spark, folder, [raw(title, commit, day)], SCHEMA)
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(folder)
        refresh.refresh(stream, root, refresh.publish_analysis(root), f"file://{tmp_path}/check", "r").awaitTermination()
    m = store.read_table(spark, root, "manifest").collect()
    assert [(r["title"], r["provenance"]["generated_at"], r["change_summary"]["total_files"]) for r in m] == [("second", at(3), 2)]
    assert [c["token"] for c in commits.since(spark, root, 0)] == ["r-0", "r-2"]
    assert not [n for n in commits.names(spark, root) if n.startswith(".tmp")]
