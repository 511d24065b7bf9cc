"""Clustered look-ups and trigram search against full scans: equal rows, little read."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from patchlake.operators import search, trigrams
from patchlake.sources import clustered


def scanned(d):
    """Rows of ``d``, and the files and rows its scans of tables read."""
    rows = d.collect()
    plan, files, read = d._jdf.queryExecution().executedPlan(), 0, 0
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        metrics = leaves.apply(k).metrics()
        if metrics.contains("numFiles"):
            files += metrics.apply("numFiles").value()
            read += metrics.apply("numOutputRows").value()
    return rows, files, read


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "t")
    # change set 0 is hot: a third of all rows
    d = spark.range(12000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).cast("string").alias("pr"), F.format_string("file_%05d", "id").alias("file_id"), F.repeat(F.col("id").cast("string"), 20).alias("patch"))
    clustered.write(d, f"file://{path}", "pr", ["file_id"], buckets=8, files=24, group_bytes=1 << 14)
    return path, d.cache()


def test_a_look_up_reads_few_row_groups(spark, table):
    path, d = table
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/bucket=*/*.parquet")]
    assert sum(groups) > 40
    for pr, file in (("7", "file_00007"), ("0", "file_06000"), ("499", "file_00499")):
        rows, files, read = scanned(clustered.lookup(spark, f"file://{path}", pr, file))
        assert [(r["pr"], r["file_id"]) for r in rows] == [(pr, file)]
        assert files <= 12 and read <= 12000 / 20, (files, read)
    rows, _, read = scanned(spark.read.parquet(f"file://{path}").where("patch like '%z%'"))
    assert rows == [] and read == 12000  # what a scan without the layout's columns reads


def test_the_rows_of_a_hot_key_fill_several_files(spark, table):
    path, _ = table
    hot = [pq.read_table(f, columns=["pr"], partitioning=None).to_pydict()["pr"].count("0") for f in glob.glob(f"{path}/bucket=*/*.parquet")]
    assert sum(hot) > 4000 and max(hot) < 1500


def test_look_ups_equal_a_scan(spark, table):
    path, d = table
    assert sorted(map(tuple, clustered.lookup(spark, f"file://{path}", "12").collect())) == sorted(map(tuple, d.where("pr = '12'").collect()))
    assert clustered.lookup(spark, f"file://{path}", "nobody").collect() == [] and clustered.lookup(spark, f"file://{path}", "12", "file_00000").collect() == []
    asked = d.where("file_id like '%77'").select("pr", "file_id").unionByName(spark.createDataFrame([("x", "y"), (None, None)], "pr string, file_id string"))
    got = clustered.lookup_all(spark, f"file://{path}", asked.unionByName(asked))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.where("file_id like '%77'").collect()))
    assert clustered.lookup_all(spark, f"file://{path}", asked.select("pr").where("pr = '77'")).count() == d.where("pr = '77'").count()


def test_changes_of_many_files_equal_those_of_one(spark):
    changes = spark.createDataFrame([("a", "file_0001", "p"), ("a", "file_0002", "q")], "pr string, file_id string, path string")
    patches = spark.createDataFrame([("a", "file_0001", "x" * 30)], "pr string, file_id string, patch string")
    many = {r["file_id"]: r for r in search.file_changes(changes, patches, 20).collect()}
    for k in (1, 2):
        one = search.file_change(changes, patches, "a", k, most=20).first()
        assert (one["patch"], one["truncated"]) == (many[f"file_000{k}"]["patch"], many[f"file_000{k}"]["truncated"])
    assert many["file_0002"]["patch"] is None and many["file_0001"]["truncated"]


PATHS = ["src/Home/Controller.cs", "SRC/home/controller.ts", "aaaa", "aa", "a", "", None, "docs/ünïcode/日本.md", "x" * 300 + "needle", "ababab/bababa", "src/home/controller.ts", "a b", "100%_\\done"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    files = spark.createDataFrame([(str(k % 2), k, p, "clash") for k, p in enumerate(PATHS)], "pr string, ord int, path string, low string")
    return trigrams.build(files, f"file://{tmp_path_factory.mktemp('trigrams')}/i", files=3, buckets=2), files


def test_search_equals_a_scan_for_every_pattern(spark, index):
    found, files = index
    lows = [p.lower() for p in PATHS if p]
    patterns = sorted({p[k : k + n] for p in lows for k in range(0, len(p), 1 if len(p) < 40 else 37) for n in (1, 2, 3, 4, 7, 40)} | {p.upper() for p in lows} | {"zzz", "q!", "ababa", "aaaaa", "abab/", "~", "b a"})
    assert len(patterns) > 150
    want = sorted((p, x) for p in patterns for x in set(lows) if p.lower() in x)
    assert sorted(map(tuple, trigrams.search_paths(found, patterns).collect())) == want


@pytest.mark.parametrize("rounds", [1, 3])
def test_any_number_of_rounds_finds_the_same(index, rounds):
    found, _ = index
    some = ["controller", "home", "needle", "abab", "aa", "日本"]
    assert sorted(map(tuple, trigrams.search_paths(found, some, rounds).collect())) == sorted(map(tuple, trigrams.search_paths(found, some).collect()))


def test_search_in_the_index_equals_search_files(spark, index):
    found, files = index
    files = files.drop("low").withColumns({"language": F.lit("t"), "status": F.lit("modified"), "change_kind": F.lit("k"), "risk_tags": F.array(F.lit("r"))})
    for pattern in ("HOME", "a", "controller.ts", "none"):
        want = sorted((r["pr"], r["ord"], r["path"]) for r in search.search_files(files, path=pattern).collect())
        got = trigrams.search_index(found, files, [pattern], 50).collect()
        assert sorted((r["pr"], r["ord"], r["path"]) for r in got) == want and {r["total"] for r in got} <= {len(want)}
    assert sorted(r["rank"] for r in trigrams.search_index(found, files, ["a"], 2).collect()) == [1, 2]
    with pytest.raises(ValueError):
        trigrams.search_paths(found, [str(k) for k in range(1001)])


def test_an_empty_index_finds_nothing(spark, tmp_path):
    none = trigrams.build(spark.createDataFrame([(None,)], "path string"), f"file://{tmp_path}/i")
    assert trigrams.search_paths(none, ["a", "abc", ""]).collect() == []
    assert trigrams.search_paths(none, []).collect() == []
