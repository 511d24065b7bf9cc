"""The commit log, snapshots, conflicts and collection of the revisioned store."""

import threading

import pytest
from pyspark.sql import functions as F

from patchlake.sources import commits, store

NOW = "2024-06-01 00:00:00"


def put(spark, root, batch, rows, base=None):
    """Publishes (pr, generated_at, text) as one batch of one table, two rows a change set."""
    d = spark.createDataFrame(rows, "pr long, generated_at string, text string").coalesce(1)
    texts = d.select("pr", "text").unionByName(d.select("pr", F.concat("text", F.lit("!")).alias("text")))
    return store.publish_batch(root, {"texts": texts}, d.select("pr", "generated_at"), batch, base)


def texts(spark, root, version=None):
    d = store.read_table(spark, root, "texts", version)
    return sorted((r["pr"], r["text"]) for r in d.collect() if not r["text"].endswith("!"))


def day(k):
    return f"2024-05-{k:02d} 00:00:00"


def test_a_number_is_given_once(spark, tmp_path):
    root, won = f"file://{tmp_path}/s", []
    each = [threading.Thread(target=lambda k=k: won.append((commits.put_if_absent(spark, f"{root}/log/one.json", str(k)), k))) for k in range(6)]
    [t.start() for t in each]
    [t.join() for t in each]
    assert [ok for ok, _ in won].count(True) == 1
    assert commits.read_text(spark, f"{root}/log/one.json") == str(next(k for ok, k in won if ok))
    assert commits.names(spark, f"{root}/log") == ["one.json"]
    # the way of other file systems
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log/draft")
    commits.put_if_absent(spark, f"{root}/log/draft", "x")
    with pytest.raises(FileExistsError):
        commits._rename_new(spark, draft, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log/one.json"))
    commits._rename_new(spark, draft, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log/two.json"))
    assert commits.names(spark, f"{root}/log") == ["one.json", "two.json"]


def test_versions_decide_and_not_clocks(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    put(spark, root, "late", [(1, day(30), "late"), (2, day(30), "two")])
    put(spark, root, "early", [(1, day(1), "early"), (3, day(1), "three")])
    assert texts(spark, root) == [(1, "early"), (2, "two"), (3, "three")]
    assert texts(spark, root, 1) == [(1, "late"), (2, "two")]
    assert store.read_table(spark, root, "texts", 0) is None and store.snapshot(spark, root).version == 2


def test_of_two_publishers_of_one_change_set_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    put(spark, root, "first", [(1, day(1), "a"), (2, day(1), "b")])
    base = commits.latest(spark, root)
    put(spark, root, "winner", [(1, day(2), "winner")], base)
    with pytest.raises(store.Conflict, match="since version 1: 1"):
        put(spark, root, "loser", [(1, day(9), "loser"), (4, day(9), "x")], base)
    assert not commits.names(spark, f"{root}/revisions").count("loser") and "batch=b-loser" not in commits.names(spark, f"{root}/tables/texts")
    put(spark, root, "other", [(2, day(2), "other")], base)  # another change set: no conflict, the next number
    assert texts(spark, root) == [(1, "winner"), (2, "other")] and commits.latest(spark, root) == 3
    with pytest.raises(store.Conflict):
        put(spark, root, "other", [(7, day(2), "again")])
    assert texts(spark, root) == [(1, "winner"), (2, "other")]


def test_publishers_at_once_all_get_a_version(spark, tmp_path):
    root, failed = f"file://{tmp_path}/s", []

    def one(k):
        try:
            put(spark, root, f"b{k}", [(k, day(1), str(k)), (100, day(1), str(k))] if k < 2 else [(k, day(1), str(k))], 0)
        except store.Conflict:
            failed.append(k)

    each = [threading.Thread(target=one, args=(k,)) for k in range(4)]
    [t.start() for t in each]
    [t.join() for t in each]
    assert len(failed) == 1 and failed[0] < 2  # both have change set 100
    assert [r[0] for r in texts(spark, root)] == sorted([k for k in range(4) if k not in failed] + [100])


def test_collection_drops_copies_and_repoints(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    put(spark, root, "a", [(k, day(1), f"a{k}") for k in range(10)])
    put(spark, root, "b", [(k, day(2), f"b{k}") for k in range(9)])
    put(spark, root, "c", [(k, day(3), f"c{k}") for k in range(8)])
    put(spark, root, "d", [(k, day(4), f"d{k}") for k in range(4)])
    before, old = texts(spark, root), store.snapshot(spark, root)
    told = store.collect(spark, root, F.lit(day(5)), keep=2, days=30, batch="new")
    # a: 9 only (8 and 9 rank 0 and 1 of two); b: 4-8; c: all; d: all
    assert told == {"version": 5, "removed": ["a"], "copied": ["a"], "batch": "new"}
    assert store.snapshot(spark, root).sizes == {"b": 9, "c": 8, "d": 4, "new": 2}
    assert texts(spark, root) == before
    assert sorted((r["pr"], r["text"]) for r in old.table("texts").collect() if not r["text"].endswith("!")) == before  # not swept yet
    assert store.sweep(spark, root, F.lit(day(5))) == [] and store.sweep(spark, root, F.lit(day(7))) == ["a"]
    assert commits.names(spark, f"{root}/tables/texts") == ["batch=b-b", "batch=b-c", "batch=b-d", "batch=b-new"]
    assert texts(spark, root) == before and store.sweep(spark, root, F.lit(day(7))) == []
    # again, by age: only active ones are left, from all batches
    told = store.collect(spark, root, F.lit(NOW), keep=2, days=1, least_live=1.0, batch="newer")
    assert told["removed"] == told["copied"] == ["b", "c", "new"]
    store.sweep(spark, root, F.lit(NOW), 0)
    assert texts(spark, root) == before and commits.names(spark, f"{root}/tables/texts") == ["batch=b-d", "batch=b-newer"]
    kept = {(r["pr"], r["origin"]) for r in store.snapshot(spark, root).revisions().collect()}
    assert kept == {(k, "d" if k < 4 else "c" if k < 8 else "b" if k == 8 else "a") for k in range(10)}
    put(spark, root, "e", [(9, day(5), "e9")])
    assert texts(spark, root) == [*before[:9], (9, "e9")]


def test_a_reader_during_collection_sees_every_active_revision(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    for b in "abc":
        put(spark, root, b, [(k, day(1), f"{b}{k}") for k in range(20) if b == "a" or k % 2])
    want, seen, stop = texts(spark, root), [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append(texts(spark, root))

    t = threading.Thread(target=reader)
    t.start()
    try:
        for k in range(3):
            store.collect(spark, root, F.lit(NOW), keep=1, days=99, least_live=1.1)
            put(spark, root, f"more{k}", [(100 + k, day(1), "x")])
    finally:
        stop.set()
        t.join()
    assert len(seen) > 1 and all([r for r in x if r[0] < 100] == want for x in seen)


def test_collections_at_once_conflict_and_publishers_do_not(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    put(spark, root, "a", [(1, day(1), "a1"), (2, day(1), "a2")])
    put(spark, root, "b", [(1, day(2), "b1")])
    real = store._commit_state

    def slow(*args, **more):
        monkeypatch.setattr(store, "_commit_state", real)
        put(spark, root, "c", [(2, day(3), "c2")])  # published between the snapshot and the commit
        store.collect(spark, root, F.lit(NOW), keep=1, days=99, least_live=0.1)
        return real(*args, **more)

    monkeypatch.setattr(store, "_commit_state", slow)
    with pytest.raises(store.Conflict, match="collected by another"):
        store.collect(spark, root, F.lit(NOW), keep=1, days=99, least_live=1.0, batch="lost")
    assert texts(spark, root) == [(1, "b1"), (2, "c2")]
    assert "batch=b-lost" not in commits.names(spark, f"{root}/tables/texts")
    monkeypatch.setattr(store, "_commit_state", lambda *a, **m: (monkeypatch.setattr(store, "_commit_state", real), put(spark, root, "d", [(2, day(4), "d2")]), real(*a, **m))[-1])
    store.collect(spark, root, F.lit(NOW), keep=1, days=99)
    assert texts(spark, root) == [(1, "b1"), (2, "d2")]


def test_states_are_written_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "STATE_EVERY", 2)
    root = f"file://{tmp_path}/s"
    for k in range(4):
        put(spark, root, f"b{k}", [(k % 3, day(1), f"t{k}")])
    assert [c["kind"] for c in commits.since(spark, root, 0)].count("state") >= 1
    assert texts(spark, root) == [(0, "t3"), (1, "t1"), (2, "t2")] and len(store.snapshot(spark, root).published) <= 2


def test_an_empty_store(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert store.pointers(spark, root) is None and store.read_table(spark, root, "texts") is None
    assert store.collect(spark, root, F.lit(NOW))["version"] == 0 and store.sweep(spark, root, F.lit(NOW)) == []
