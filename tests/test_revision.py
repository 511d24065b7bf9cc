import pytest
from pyspark.sql import functions as F

from patchlake.operators import gate, search
from patchlake.plans.revision import analyze
from patchlake.sources import landed, store

DIFF = """diff --git a/src/HomeController.cs b/src/HomeController.cs
--- a/src/HomeController.cs
+++ b/src/HomeController.cs
@@ -1,1 +1,2 @@
 ctx
+[HttpPost("submit")] password
diff --git a/README.md b/README.md
--- a/README.md
+++ b/README.md
@@ -1 +1 @@
-a
+b"""
SCHEMA = f"pr string, metadata {landed.METADATA}, commits array<{landed.COMMIT}>, diffstat array<{landed.DIFFSTAT}>, raw_diff string"


def raw(spark, additions=1):
    meta = (1, " Fix WCE-12 ", "mail a@b.co", "OPEN", None, None, (("feature/WCE-12",), ("a" * 40,)), (("main",), ("b" * 40,)), None)
    stats = [("modified", additions, 0, ("src/HomeController.cs",), ("src/HomeController.cs",)), ("modified", 1, 1, ("README.md",), ("README.md",)), ("added", 3, 0, None, ("config/.env",)), ("added", 2, 0, None, ("src/gone.ts",))]
    return spark.createDataFrame([("7", meta, [("c" * 40, "first line\nmore"), ("d" * 40, "two")], stats, DIFF)], SCHEMA)


def test_revision_is_published_and_read(spark, tmp_path):
    rev = analyze(raw(spark), F.lit("2024-01-01T00:00:00Z"), ["WCE-"])
    root = f"file://{tmp_path}/store"
    store.publish(root, rev.tables, rev.rolled, rev.details, F.lit("2024-01-01T00:00:00Z"))
    index = {r["id"]: r for r in store.read_table(spark, root, "files_index").collect()}
    assert index["file_0001"]["change_kind"] == "functional_logic" and index["file_0001"]["risk_tags"] == ["public_api", "auth_security", "secret_config"]
    assert index["file_0002"]["change_kind"] == "documentation_only"
    # no parsed lines: all of them are blank
    assert index["file_0004"]["change_kind"] == "whitespace_only"
    # a sensitive file is high risk, whatever its kind
    assert index["file_0003"]["risk_level"] == "high" and index["file_0003"]["risk_tags"][-1] == "sensitive_configuration"
    m = store.read_table(spark, root, "manifest").first()
    assert m["title"] == "Fix WCE-12" and m["description"] == "mail [REDACTED:EMAIL]" and m["ticket_id"] == "WCE-12"
    assert m["change_summary"]["total_files"] == 4 and m["change_summary"]["total_additions"] == 7
    assert m["risk_summary"]["overall_level"] == "high" and m["ai_reading"]["mode"] == "deep_review"
    assert m["important_file_ids"] == ["file_0001", "file_0003"] and m["redaction_summary"]["redacted_items_count"] == 1
    text = store.read_table(spark, root, "context").first()["context"]
    assert text.startswith("# PR Context Pack: Fix WCE-12\n\n## Read Strategy\nMode: deep_review\nReason: High risk (high)")
    assert text.endswith("- ccccccc: first line\n- ddddddd: two")
    found = search.search_files(store.read_table(spark, root, "files_index"), path="HOME", risk_tag="public_api").collect()
    assert [r["id"] for r in found] == ["file_0001"] and found[0]["total"] == 1
    one = search.file_change(store.read_table(spark, root, "file_changes"), store.read_table(spark, root, "patches"), "7", 1, most=20).first()
    assert one["truncated"] and one["patch"].endswith(search.TRUNCATED)
    assert [s["name"] for s in one["symbols"]] == ["POST /submit"]


def test_a_bad_revision_leaves_the_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = analyze(raw(spark), F.lit("t"))
    store.publish(root, first.tables, first.rolled, first.details, F.lit("t"), "one")
    bad = analyze(raw(spark, 5), F.lit("t"))
    with pytest.raises(gate.InvalidRevision, match="total_additions"):
        store.publish(root, bad.tables, first.rolled, bad.details, F.lit("t"), "two")
    assert store.pointers(spark, root).first()["batch"] == "one"
    assert not store._exists(spark, f"{root}/.tmp-two")


def test_gate_names_each_violation(spark):
    rev = analyze(raw(spark), F.lit("t"))
    index = rev.tables["files_index"].cache()
    patches = rev.tables["patches"].select("pr", F.concat(F.lit("files/"), "file_id", F.lit("/patch.diff")).alias("ref"))
    assert gate.violations(rev.rolled, index, rev.details, patches, rev.tables["coverage"]).count() == 0
    evil = index.withColumn("detail_ref", F.when(F.col("ord") == 1, "../../outside.json").otherwise(F.col("detail_ref")))
    rules = {r["rule"] for r in gate.references(evil, rev.details, patches).collect()}
    assert rules == {"path_traversal"}
    gone = rev.details.where("folder <> 'file_0002'")
    assert {r["rule"] for r in gate.references(index, gone, patches).collect()} == {"missing_detail"}
    assert {r["subject"] for r in gate.important_ids(rev.rolled, index.where("ord > 1")).collect()} == {"file_0001"}
    assert gate.orphans(rev.details, index.where("ord > 1")).first()["severity"] == "warning"
    assert gate.duplicate_ids(index.union(index)).count() == 4
