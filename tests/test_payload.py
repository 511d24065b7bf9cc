"""Payload queries: one shuffle for a whole change set, and the rules on odd paths."""

import duckdb
import pytest
from pyspark.sql import functions as F

from patchlake import catalog
from patchlake.operators import payload


def _line_items(spark, folder):
    rows = [(k % 40, 1 + k * 7 % 50, k % 9, 1 + k % 7, 1.0, float(k % 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    df.withColumn("l_shipdate", F.timestamp_seconds(F.lit(0) + F.monotonically_increasing_id())).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("name", ["payload_notes", "payload_modules", "payload_fallbacks"])
def test_change_sets_are_shuffled_once(spark, tmp_path, name):
    _line_items(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, f"file://{tmp_path}")
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_equal_basenames_and_odd_paths(spark):
    files = [("a/x.sql", ["one"]), ("b/api/x.sql", ["two"]), ("c/client/x.sql/", ["lost"]), ("c/client/y", []), ("", ["none"]), ("d/OrderService.cs", None)]
    rows = [(7, k, path, (e or [],), ([],), ["S"] if e is None else None) for k, (path, e) in enumerate(files)]
    df = spark.createDataFrame(rows, "pr long, file_ord long, path string, classification struct<evidence:array<string>>, risk struct<evidence:array<string>>, said array<string>")
    (got,) = payload.with_notes(payload.change_sets(df), F.array(F.lit("c"))).collect()
    assert [tuple(m) for m in got["changes_by_module"]] == [
        ("Database & Entity Models", ["x.sql"], ["two"]),
        ("Services & Business Logic", ["OrderService.cs"], ["S"]),
        ("gRPC & External Integrations", ["x.sql", "y"], ["two"]),
        ("Infrastructure & Unit Tests", [""], ["Bổ sung Unit Tests & Helper Extensions trong: "]),
    ]
    assert got["summary_insights"] == ["[Database & Entity Models] two", "[Services & Business Logic] S", "[gRPC & External Integrations] two", "[Infrastructure & Unit Tests] Bổ sung Unit Tests & Helper Extensions trong: "]
    assert got["deployment_and_migration_notes"] == [payload.NOTE_SQL + "x.sql"] * 2 and got["key_impacted_components"] == ["OrderService.cs"]
