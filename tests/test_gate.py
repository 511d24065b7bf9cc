"""The gate's one pass against its checks one by one, and how often it reads each part."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from patchlake.operators import gate

INDEX = "pr long, id string, path string, language string, status string, additions long, deletions long, change_kind string, risk_tags array<string>, risk_level string, detail_ref string"
ROLLED = "pr long, overall_level string, primary_kind string, total_files long, total_additions long, total_deletions long, important_file_ids array<string>, kind_counts array<struct<change_kind:string,n:long>>"
COVERAGE = "pr long, section string, status string, truncated boolean, items_fetched long"


def parts(spark, seed, folder=None):
    """Change sets in which everything that can be wrong is, nulls and repeated rows included."""
    r = random.Random(seed)
    pick = r.choice
    prs = [None, *range(1, 9)]
    refs = ["files/a/change.json", "files/b/change.json", "files/c/x/change.json", "/etc/x", "../out", None]
    ids = ["file_0001", "file_0002", "file_0003", None]
    index = [(pick(prs), pick(ids), pick(["p", None]), "ts", pick(["added", "odd", None]), pick([1, 2, None]), 1, pick(["k1", "k2", "unknown", None]), [], "low", pick(refs)) for _ in range(40)]
    rolled = [(p, pick(["low", "odd", None]), pick(["k", None]), pick([0, 3, 4, None]), pick([0, 5]), pick([0, 4]), pick([None, [], ["file_0001", "file_0001", "file_0009"], [None]]), pick([None, [], [("k1", 1), ("k2", 2)], [("unknown", 1)]])) for p in prs]
    details = [(pick(prs), pick(refs), pick(["patch.diff", "../patch.diff", "none.diff", None]), pick(ids)) for _ in range(25)]
    patches = [(pick(prs), f"files/{pick('abc')}/patch.diff") for _ in range(12)]
    coverage = [(pick(prs), "diff", pick(["complete", "odd", None]), pick([True, None]), pick([1, None])) for _ in range(12)]
    rows = {"rolled": (rolled, ROLLED), "index": (index, INDEX), "details": (details, "pr long, ref string, patch_ref string, folder string"), "patches": (patches, "pr long, ref string"), "coverage": (coverage, COVERAGE)}
    made = {n: spark.createDataFrame(x, s).coalesce(1) for n, (x, s) in rows.items()}
    if folder:
        for n, d in made.items():
            d.write.parquet(f"{folder}/{n}")
        made = {n: spark.read.parquet(f"{folder}/{n}") for n in made}
    return made


def one_by_one(rolled, index, details, patches, coverage, required=None):
    checks = [gate.manifest_schema(rolled), gate.index_schema(index), gate.duplicate_ids(index), gate.references(index, details, patches), gate.totals(rolled, index), gate.important_ids(rolled, index), gate.kind_mismatch(rolled, index), gate.orphans(details, index), gate.coverage_schema(coverage)]
    found = reduce(DataFrame.unionByName, checks)
    if not required:
        return found
    missing = gate.missing_parts(rolled.select("pr"), required)
    return missing.unionByName(found.join(missing.select("pr").distinct(), "pr", "left_anti"))


def rows(d):
    return sorted(map(tuple, d.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_finds_what_the_checks_find(spark, seed):
    p = parts(spark, seed)
    got, want = rows(gate.violations(**p)), rows(one_by_one(**p))
    assert got == want and len({r[1] for r in got}) >= 10


def test_a_change_set_without_a_part_has_that_violation_only(spark):
    p = parts(spark, 7)
    p = {n: d.where("pr is not null") for n, d in p.items()}
    required = {"manifest": p["rolled"].select("pr").where("pr % 3 <> 0"), "coverage": p["rolled"].select("pr", "total_files").where("pr <> 4 and pr <> 6")}
    got = rows(gate.violations(**p, required=required))
    assert got == rows(one_by_one(**p, required=required))
    assert [r[1:4:2] for r in got if r[0] == 6] == [("missing", "coverage"), ("missing", "manifest")]


def test_empty_parts(spark):
    p = {n: d.limit(0) for n, d in parts(spark, 1).items()}
    assert gate.violations(**p).count() == 0 and gate.violations(**p, required={"manifest": p["rolled"]}).count() == 0


def test_each_part_is_read_once(spark, tmp_path):
    p = parts(spark, 2, f"file://{tmp_path}")
    found = gate.violations(**p, required={"coverage": p["coverage"]})
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaves.size() == len(p) + 1  # coverage a second time, as a required part
    assert rows(found) == rows(one_by_one(**p, required={"coverage": p["coverage"]}))
