"""Keyed tables: merges against a plain map, untouched files, two writers, old versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from patchlake.sources import commits, keyed

SCHEMA = "k long, name string, n long"
NEW = "k long, name string, n long, at int, gone boolean, extra string"


def files(folder):
    return {os.path.join(a, f) for a, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def held(table):
    rows = [tuple(r) for r in table.rows().collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] for r in rows}


def test_merges_equal_a_plain_map(spark, tmp_path):
    root, dice, want = f"file://{tmp_path}/t", random.Random(3), {}
    keyed.create(spark, root, SCHEMA, ["k", "name"], 8)
    assert held(keyed.snapshot(spark, root)) == {} and keyed.snapshot(spark, root).find(spark.createDataFrame([(1, "a")], "k long, name string")).count() == 0
    for turn in range(3):
        rows = [(dice.choice([None, *range(12)]), dice.choice(["a", "b", None]), dice.randrange(99), at, dice.random() < 0.3, "x") for at in range(40)]
        rows.append((*rows[-1][:2], 7, None, False, "first of all"))
        keyed.merge(spark, root, spark.createDataFrame(rows, NEW), ["at"], "gone")
        for k, name, n, _, gone, _ in [rows[-1], *rows[:-1]]:
            want.pop((k, name), None)
            if not gone:
                want[(k, name)] = n
        assert held(keyed.snapshot(spark, root)) == want, turn
    asked = spark.createDataFrame([(None, None), (3, "a"), (3, "a"), (77, "a")], "k long, name string")
    assert {tuple(r)[:2] for r in keyed.snapshot(spark, root).find(asked).collect()} == {(None, None), (3, "a")} & set(want)
    version = keyed.snapshot(spark, root).version
    assert keyed.merge(spark, root, spark.createDataFrame([], NEW), ["at"]) == version == commits.latest(spark, root)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        keyed.snapshot(spark, root)
    keyed.create(spark, root, "k long, v string", ["k"], 8)
    with pytest.raises(keyed.Conflict):
        keyed.create(spark, root, "k long, v string", ["k"], 4)
    first = keyed.merge(spark, root, spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["v"])
    before = files(tmp_path)
    table = keyed.snapshot(spark, root)
    one = spark.createDataFrame([(5, "new")], "k long, v string")
    bucket = one.select(table.bucket()).first()[0]
    keyed.merge(spark, root, one, ["v"])
    now = keyed.snapshot(spark, root)
    assert {b for b in range(8) if table.folders[b] != now.folders[b]} == {bucket}
    assert before < files(tmp_path) and len(files(tmp_path)) == len(before) + 1
    # a look-up opens its own bucket only, an older version reads what it read
    assert {f.rsplit("/", 2)[-2] for f in now.find(one).inputFiles()} == {f"{keyed.DEALT}={bucket}"}
    assert now.find(one).first()["v"] == "new" and keyed.snapshot(spark, root, first).find(one).first()["v"] == "old"
    assert keyed.sweep(spark, root, 2) == 0 and keyed.sweep(spark, root, 1) == 1
    assert len(files(tmp_path)) == len(before) and keyed.snapshot(spark, root).rows().count() == 200


def test_second_writer_of_a_bucket_merges_anew(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    keyed.create(spark, root, "k long, v string", ["k"], 1)
    row = lambda k, v: spark.createDataFrame([(k, v)], "k long, v string")
    plain, calls = commits.commit, []

    def interrupted(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1:  # another writer is faster, once
            keyed.merge(spark, root, row(2, "other").union(row(1, "other")), ["v"])
        return plain(*args, **kwargs)

    monkeypatch.setattr(commits, "commit", interrupted)
    keyed.merge(spark, root, row(1, "mine"), ["v"])
    assert len(calls) == 3
    assert sorted(tuple(r) for r in keyed.snapshot(spark, root).rows().collect()) == [(1, "mine"), (2, "other")]


def test_many_merges_are_read_from_the_last_whole_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "STATE_EVERY", 2)
    root = f"file://{tmp_path}/t"
    keyed.create(spark, root, "k long, v string", ["k"], 4)
    for n in range(4):
        keyed.merge(spark, root, spark.createDataFrame([(n, "x")], "k long, v string"), ["v"])
    assert "state" in [c["kind"] for c in commits.since(spark, root, 0)]
    assert sorted(r["k"] for r in keyed.snapshot(spark, root).rows().collect()) == [0, 1, 2, 3]
