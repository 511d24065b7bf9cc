import datetime
import json

from pyspark.sql import functions as F

from patchlake.operators import discovery, progress, registry
from patchlake.sources import landed
from patchlake.streaming import events


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [{"run_id": "r", "url": f"u{k % 3}", "stage": "failed" if k == 4 else "fetch", "percent": 100 if k == 5 else k * 10, "message": "token Bearer abcdef1", "time": f"2024-01-01T00:{k:02d}:00Z"} for k in range(6)]
    (tmp_path / "in").mkdir()
    for k in (0, 3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k : k + 3])))
    path = f"file://{tmp_path}/in"
    q = events.latest_state(events.events(spark, path)).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = spark.read.schema(events.EVENT).json(path)
    want = progress.latest(batch, "url", "time", "stage", "percent").orderBy("url").collect()
    assert spark.table("latest").select("url", "stage", "percent").orderBy("url").collect() == want
    o = progress.overview(batch).first()
    assert (o["overall_percent"], o["done"], o["total"]) == (56, 1, 3)
    kept = []
    q = events.upsert(events.events(spark, path), lambda d: kept.extend(d.collect()), f"file://{tmp_path}/c2")
    assert q.awaitTermination(120) and {r["url"] for r in kept} == {"u0", "u1", "u2"}
    q = events.append_redacted(events.events(spark, path), f"file://{tmp_path}/log", f"file://{tmp_path}/c3")
    assert q.awaitTermination(120) and "abcdef1" not in "".join(r[0] for r in spark.read.text(f"file://{tmp_path}/log").collect())


def test_landed_parts_degrade(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return f"file://{tmp_path}/{name}"

    meta = landed.metadata(spark, put("m.json", [{"pr": "1", "metadata": {"id": 1, "title": "t"}}, {"pr": "2", "metadata": {"id": 2}}]))
    commits = landed.pages(spark, put("c.json", [{"pr": "1", "page": 1, "values": [{"hash": "a", "message": "m"}], "next": "x"}, {"pr": "1", "page": 2, "values": [{"hash": "b", "message": "n"}]}]), landed.COMMIT)
    stats = landed.pages(spark, put("d.json", [{"pr": "1", "page": 1, "values": [{"status": "modified"}], "next": "x"}, {"pr": "1", "page": 2, "error": "HTTP 500"}]), landed.DIFFSTAT)
    (tmp_path / "diffs").mkdir()
    (tmp_path / "diffs" / "1.diff").write_text("diff --git a/x b/x\n")
    raw = {r["pr"]: r for r in landed.collect(meta, commits, stats, landed.raw_diffs(spark, f"file://{tmp_path}/diffs")).collect()}
    assert [c["hash"] for c in raw["1"]["commits"]] == ["a", "b"] and raw["1"]["coverage"]["commits"] == "complete"
    assert len(raw["1"]["diffstat"]) == 1 and raw["1"]["coverage"]["diffstat"] == "partial" and raw["1"]["warnings"] == ["HTTP 500"]
    assert raw["2"]["coverage"]["diff"] == "failed" and raw["2"]["raw_diff"] == "" and raw["2"]["commits"] == []
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "good.jsonl").write_text('{"a": 1}\n{"a": 2}')
    (tmp_path / "lines" / "bad.jsonl").write_text('{"a": 3}\n{nope')
    assert sorted(r["a"] for r in landed.json_lines(spark, f"file://{tmp_path}/lines", "a int").collect()) == [1, 2]


def test_ownership_view(spark):
    rows = [(1, "own ready", "open", False, "{U-1}"), (2, "own draft", "OPEN", True, "u-1"), (3, "foreign", "OPEN", False, "u-2"), (4, "merged", "MERGED", False, "u-1"), (5, "nobody", "OPEN", False, None)]
    prs = spark.createDataFrame(rows, "id long, title string, state string, is_draft boolean, author_uuid string")
    found = lambda readiness: sorted(r["id"] for r in discovery.view(prs, "{U-1}", readiness).collect())
    assert (found("ready"), found("draft"), found("all")) == ([1], [2], [1, 2])
    assert discovery.view(prs, "", "all").count() == 0


def test_retention_and_registry(spark):
    day = lambda k: datetime.datetime(2024, 5, 1) + datetime.timedelta(days=k)
    revs = spark.createDataFrame([("p", f"r{k}", day(k), k == 0) for k in range(6)] + [("p", ".tmp-x", day(9), False), ("q", "old", day(-60), False)], "pr string, revision string, mtime timestamp, is_active boolean")
    gone = {r["revision"] for r in progress.retention_victims(revs, F.lit("2024-05-10 00:00:00")).collect()}
    # the staging folder takes a rank; the active revision never goes
    assert gone == {"r1", "r2", "r3", "old"}
    links = spark.createDataFrame([(0, "https://bitbucket.org/a/b/pull-requests/1"), (1, "bad"), (2, "https://bitbucket.org/A/b/pull-requests/1/")], "ord int, url string")
    assert registry.deduplicated(links).count() == 1 and registry.invalid(links).first()["error"] == "invalid url"
    more = registry.added(registry.deduplicated(links), spark.createDataFrame([(0, "https://bitbucket.org/a/c/pull-requests/2")], "ord int, url string"))
    assert more.count() == 2 and registry.removed(more, links).count() == 1


def test_page_chains(spark):
    page = "pr string, link string, values array<int>, next string, error string"
    rows = [
        ("whole", "a", [1, 2], "b", None), ("whole", "b", None, "c", None), ("whole", "c", [3], "", None), ("whole", "lost", [9], "a", None),
        ("loop", "a", [1], "b", None), ("loop", "b", [2], "a", None),
        ("gap", "a", [1], "b", None), ("gap", "c", [3], None, None),
        ("bad", "a", [1], "b", None), ("bad", "b", [2], "c", "HTTP 500"), ("bad", "c", [3], None, None),
        ("twice", "a", [1], "b", "timeout"), ("twice", "a", [1], "b", None), ("twice", "a", [1], "b", None), ("twice", "b", [2], None, None),
        ("first bad", "a", None, None, "HTTP 404"), (None, "a", [1], None, None), ("whole", None, [1], None, None),
    ]
    heads = [(pr, "a") for pr in ("whole", "loop", "gap", "bad", "twice", "first bad", "never")] + [("whole", "a"), (None, "a")]
    got = landed.chains(spark.createDataFrame(heads, "pr string, link string"), spark.createDataFrame(rows, page), 5)
    assert {r["pr"]: (r["pages"], r["values"], r["complete"], r["warning"]) for r in got.collect()} == {
        "whole": (3, [1, 2, 3], True, None), "loop": (5, [1, 2, 1, 2, 1], False, "page limit reached"), "gap": (1, [1], False, "page not landed"),
        "bad": (1, [1], False, "HTTP 500"), "twice": (2, [1, 2], True, None), "first bad": (0, [], False, "HTTP 404"), "never": (0, [], False, "page not landed"),
    }
    exact = [("p", str(k), [k], str(k + 1) if k < 5 else None, None) for k in range(1, 6)]
    five = landed.chains(spark.createDataFrame([("p", "1")], "pr string, link string"), spark.createDataFrame(exact, page), 5).first()
    assert (five["pages"], five["complete"]) == (5, True)
    assert landed.chains(spark.createDataFrame([], "pr string, link string"), spark.createDataFrame([], page)).count() == 0
