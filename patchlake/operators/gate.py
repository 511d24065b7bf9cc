"""Integrity gate: every check adds rows (pr, rule, severity, subject, detail) to one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("added", "modified", "removed", "renamed")
COVERAGE_STATUSES = ("complete", "partial", "truncated", "failed", "not_fetched", "not_supported")
LEVELS = ("none", "low", "medium", "high", "critical")


def _row(d: DataFrame, rule: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return d.select("pr", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _text(*parts) -> Column:
    return F.concat_ws("", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def escapes(ref: Column) -> Column:
    """Whether a reference leaves its folder."""
    return ref.startswith("/") | F.exists(F.split(ref, "/"), lambda x: x == "..")


def _bad_columns() -> Column:
    return F.array_compact(
        F.array(
            *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("id", "path", "language", "additions", "deletions", "change_kind", "risk_tags", "detail_ref")),
            F.when(F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True)), F.lit("status")),
        )
    )


def _manifest_ok() -> Column:
    return F.col("overall_level").isin(*LEVELS) & F.col("primary_kind").isNotNull() & F.col("total_files").isNotNull() & F.col("total_additions").isNotNull() & F.col("total_deletions").isNotNull()


def _coverage_bad() -> Column:
    return F.coalesce(~F.col("status").isin(*COVERAGE_STATUSES), F.lit(True)) | F.col("items_fetched").isNull() | F.col("truncated").isNull()


def index_schema(index: DataFrame) -> DataFrame:
    bad = _bad_columns()
    return _row(index.withColumn("bad", bad).where(F.size("bad") > 0), "index_schema", "error", F.col("id"), F.array_join("bad", ","))


def manifest_schema(rolled: DataFrame) -> DataFrame:
    return _row(rolled.where(~F.coalesce(_manifest_ok(), F.lit(False))), "manifest_schema", "error", F.col("pr"), F.lit("manifest"))


def coverage_schema(coverage: DataFrame) -> DataFrame:
    return _row(coverage.where(_coverage_bad()), "coverage_schema", "error", F.col("section"), F.col("status"))


def missing_parts(prs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Prs without a row in one of the required tables."""
    return reduce(DataFrame.unionByName, (_row(prs.join(d.select("pr").distinct(), "pr", "left_anti"), "missing", "error", F.lit(name), F.lit("not found")) for name, d in parts.items()))


def duplicate_ids(index: DataFrame) -> DataFrame:
    d = index.groupBy("pr", "id").count().where("count > 1")
    return _row(d, "duplicate_id", "error", F.col("id"), _text("seen ", F.col("count"), " times"))


def references(index: DataFrame, details: DataFrame, patches: DataFrame) -> DataFrame:
    """detail_ref and patch_ref that leave the folder, or name nothing: ``details`` has (pr, ref, patch_ref), ``patches`` (pr, ref)."""
    out = escapes(F.col("detail_ref"))
    first = _row(index.where(out), "path_traversal", "error", F.col("id"), F.col("detail_ref"))
    known = details.select("pr", F.col("ref").alias("detail_ref"))
    second = _row(index.where(~out).join(known, ["pr", "detail_ref"], "left_anti"), "missing_detail", "error", F.col("id"), F.col("detail_ref"))
    refs = index.where(~out).select("pr", "id", "detail_ref").join(details.select("pr", F.col("ref").alias("detail_ref"), "patch_ref"), ["pr", "detail_ref"])
    third = _row(refs.where(escapes(F.col("patch_ref"))), "path_traversal", "error", F.col("id"), F.col("patch_ref"))
    whole = _text(F.regexp_replace("detail_ref", r"[^/]*\z", ""), F.col("patch_ref"))
    fourth = _row(refs.where(~escapes(F.col("patch_ref"))).withColumn("ref", whole).join(patches.select("pr", "ref"), ["pr", "ref"], "left_anti"), "missing_patch", "error", F.col("id"), F.col("patch_ref"))
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def totals(rolled: DataFrame, index: DataFrame) -> DataFrame:
    """Totals of the manifest against sums over the index."""
    sums = index.groupBy("pr").agg(F.count("*").alias("s_total_files"), F.sum("additions").alias("s_total_additions"), F.sum("deletions").alias("s_total_deletions"))
    d = rolled.join(sums, "pr", "left")
    names = ("total_files", "total_additions", "total_deletions")
    found = F.array_compact(F.array(*(F.when(F.col(n) != F.coalesce(F.col(f"s_{n}"), F.lit(0)), F.struct(F.lit(n).alias("n"), _text(F.col(n), " <> ", F.coalesce(F.col(f"s_{n}"), F.lit(0))).alias("d"))) for n in names)))
    return _row(d.select("pr", F.inline(found)), "totals", "error", F.col("n"), F.col("d"))


def important_ids(rolled: DataFrame, index: DataFrame) -> DataFrame:
    d = rolled.select("pr", F.explode("important_file_ids").alias("id")).join(index.select("pr", "id"), ["pr", "id"], "left_anti")
    return _row(d, "important_file_id", "error", F.col("id"), F.lit("not in the index"))


def kind_mismatch(rolled: DataFrame, index: DataFrame) -> DataFrame:
    """Kinds in the index whose count the manifest does not have; kinds only in the manifest pass."""
    told = rolled.select("pr", F.inline("kind_counts")).select("pr", "change_kind", F.col("n").alias("told"))
    d = index.groupBy("pr", F.coalesce("change_kind", F.lit("unknown")).alias("change_kind")).count().join(told, ["pr", "change_kind"], "left")
    return _row(d.where(F.coalesce("told", F.lit(0)) != F.col("count")), "kind_counts", "warning", F.col("change_kind"), _text(F.coalesce("told", F.lit(0)), " <> ", F.col("count")))


def orphans(details: DataFrame, index: DataFrame) -> DataFrame:
    """Detail folders that no index row names: ``details`` has (pr, folder)."""
    d = details.select("pr", F.col("folder").alias("id")).distinct().join(index.select("pr", "id"), ["pr", "id"], "left_anti")
    return _row(d, "orphan", "warning", F.col("id"), F.lit("not in the index"))


#: What a row brings to the one pass: its tag and key, the part it is from, an index id, a finding, and numbers told or counted.
_FACTS = "array<struct<tag:string,key:string,part:string,item:string,rule:string,detail:string,told:array<bigint>,counted:array<bigint>>>"


def _fact(tag: str, key: Column, part: str, item=None, rule=None, detail=None, told=None, counted=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    numbers = lambda c: F.lit(None).cast("array<bigint>") if c is None else F.array(*(x.cast("bigint") for x in c))
    cols = {"tag": F.lit(tag), "key": key.cast("string"), "part": F.lit(part), "item": text(item), "rule": text(rule), "detail": text(detail), "told": numbers(told), "counted": numbers(counted)}
    return F.struct(*(c.alias(n) for n, c in cols.items()))


def _facts(rolled: DataFrame, index: DataFrame, details: DataFrame, patches: DataFrame, coverage: DataFrame | None, required: dict[str, DataFrame]) -> DataFrame:
    """Every part read once, as rows (pr, tag, key, part, ...): what belongs together has the same tag and key."""
    spread = lambda d, *facts: d.select("pr", F.inline(F.flatten(F.array(*facts))))
    one = lambda f, when=None: F.array(f) if when is None else F.when(when, F.array(f)).otherwise(F.array().cast(_FACTS))
    found = lambda rule, subject, detail: _fact("found", F.lit(None), "found", subject, F.lit(rule), detail)

    ref, out = F.col("detail_ref"), escapes(F.col("detail_ref"))
    bad = _bad_columns()
    from_index = spread(
        index,
        one(_fact("id", F.col("id"), "index")),
        one(_fact("ref", ref, "index", F.col("id")), ~out),
        one(_fact("kind", F.coalesce("change_kind", F.lit("unknown")), "index")),
        one(_fact("totals", F.lit(None), "index", counted=[F.lit(1), F.col("additions"), F.col("deletions")])),
        one(found("path_traversal", F.col("id"), ref), out),
        one(found("index_schema", F.col("id"), F.array_join(bad, ",")), F.size(bad) > 0),
    )
    names = ("total_files", "total_additions", "total_deletions")
    from_rolled = spread(
        rolled,
        one(_fact("totals", F.lit(None), "rolled", told=[F.col(n) for n in names])),
        F.transform(F.coalesce("important_file_ids", F.expr("cast(array() as array<string>)")), lambda i: _fact("id", i, "important")),
        F.coalesce(F.transform("kind_counts", lambda k: _fact("kind", k["change_kind"], "rolled", told=[k["n"]])), F.array().cast(_FACTS)),
        one(found("manifest_schema", F.col("pr"), F.lit("manifest")), ~F.coalesce(_manifest_ok(), F.lit(False))),
    )
    # whether a detail's patch is there depends on the detail alone
    outside = escapes(F.col("patch_ref"))
    whole = _text(F.regexp_replace("ref", r"[^/]*\z", ""), F.col("patch_ref"))
    there = patches.select("pr", F.col("ref").alias("whole")).distinct().withColumn("there", F.lit(True))
    checked = details.select("pr", "ref", "patch_ref", "folder", F.when(~outside, whole).alias("whole")).join(there, ["pr", "whole"], "left")
    fault = F.when(outside, "path_traversal").when(~outside & F.col("there").isNull(), "missing_patch")
    from_details = spread(checked, one(_fact("ref", F.col("ref"), "details", rule=fault, detail=F.when(fault.isNotNull(), F.col("patch_ref")))), one(_fact("id", F.col("folder"), "folder")))
    parts = [from_index, from_rolled, from_details]
    if coverage is not None:
        parts.append(spread(coverage.where(_coverage_bad()), one(found("coverage_schema", F.col("section"), F.col("status")))))
    for name, d in required.items():
        parts.append(spread(d, one(_fact("totals", F.lit(None), name))))
    return reduce(DataFrame.unionByName, parts)


def violations(rolled: DataFrame, index: DataFrame, details: DataFrame, patches: DataFrame, coverage: DataFrame | None = None, required: dict[str, DataFrame] | None = None) -> DataFrame:
    """All checks over the revisions of ``rolled`` (a row a change set), each part read once.

    The rows are those of the checks above together. All parts become rows tagged by what
    they are looked up by (an id, a reference, a kind, the change set); equal ones are
    counted before they are shuffled, so a change set of any size is many small groups.
    Patches meet details first, by their path. A reference that many details share, which
    no folder of files has, brings all their findings to one row.

    ``required`` are the tables of which every change set must have a row; one that
    lacks a part gets that violation only, as nothing else can be said of it. Rows without
    a pr match nothing, so a manifest without one lacks every part.
    """
    required = required or {}
    groups = ["pr", "tag", "key", "part", "item", "rule", "detail"]
    total = lambda k: F.sum(F.get("counted", F.lit(k)))
    facts = _facts(rolled, index, details, patches, coverage, required)
    d = facts.groupBy(*groups).agg(F.count("*").alias("n"), F.max("told").alias("told"), F.array(total(0), total(1), total(2)).alias("counted"))
    same = Window.partitionBy("pr", "tag", "key")
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("n")).otherwise(0)).over(same)
    finding = F.struct("rule", "detail", "n")
    d = d.withColumns({
        "of_index": of("index"), "of_details": of("details"), "of_rolled": of("rolled"),
        "all_told": F.max(F.when(F.col("part") == "rolled", F.col("told"))).over(same),
        "all_counted": F.max(F.when(F.col("part") == "index", F.col("counted"))).over(same),
        "faults": F.collect_list(F.when((F.col("part") == "details") & F.col("rule").isNotNull(), finding)).over(same),
        "parts": F.collect_set(F.when(F.col("tag") == "totals", F.col("part"))).over(same),
    })
    # joins meet no null, groups do
    known = F.col("pr").isNotNull() & F.col("key").isNotNull()
    row = lambda rule, severity, subject, detail, n=1: F.struct(F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.alias("n"))
    when = lambda cond, r: F.array_compact(F.array(F.when(cond, r)))
    tag, part, key, n = F.col("tag"), F.col("part"), F.col("key"), F.col("n")
    names = ("total_files", "total_additions", "total_deletions")

    def total_of(k: int) -> Column:
        told, have = F.get("told", F.lit(k)), F.when(F.col("pr").isNotNull(), F.coalesce(F.get("all_counted", F.lit(k)), F.lit(0))).otherwise(0)
        return F.when(told != have, row("totals", "error", F.lit(names[k]), _text(told, " <> ", have)))

    told = F.when(known, F.coalesce(F.get("all_told", F.lit(0)), F.lit(0))).otherwise(0)
    by_ref = F.when((F.col("of_details") == 0) | ~known, F.array(row("missing_detail", "error", F.col("item"), key, n))).otherwise(
        F.transform("faults", lambda f: row(f["rule"], "error", F.col("item"), f["detail"], f["n"] * n))
    )
    found = (
        F.when(tag == "found", F.array(row(F.col("rule"), "error", F.col("item"), F.col("detail"), n)))
        .when((tag == "id") & (part == "index"), when(n > 1, row("duplicate_id", "error", key, _text("seen ", n, " times"))))
        .when((tag == "id") & (part == "important"), when((F.col("of_index") == 0) | ~known, row("important_file_id", "error", key, F.lit("not in the index"), n)))
        .when((tag == "id") & (part == "folder"), when((F.col("of_index") == 0) | ~known, row("orphan", "warning", key, F.lit("not in the index"))))
        .when((tag == "ref") & (part == "index"), by_ref)
        .when((tag == "kind") & (part == "index"), when(told != n, row("kind_counts", "warning", key, _text(told, " <> ", n))))
        .when((tag == "totals") & (part == "rolled"), F.array_compact(F.array(*(total_of(k) for k in range(3)), *(F.when(~F.array_contains("parts", name) | F.col("pr").isNull(), row("missing", "error", F.lit(name), F.lit("not found"))) for name in required))))
    )
    rows = d.select("pr", F.inline(found))
    if required:
        lacks = F.max(F.col("rule") == "missing").over(Window.partitionBy("pr"))
        rows = rows.withColumn("lacks", lacks).where(~F.col("lacks") | (F.col("rule") == "missing") | F.col("pr").isNull()).drop("lacks")
    again = F.sequence(F.lit(1).cast("long"), "n")
    return rows.select("pr", "rule", "severity", "subject", "detail", F.explode(again).alias("_")).drop("_")


class InvalidRevision(ValueError):
    """A revision has errors; the message shows some of them."""


def require_valid(found: DataFrame, shown: int = 20) -> None:
    """Raise if there is an error row; warnings pass."""
    errors = found.where("severity = 'error'").limit(shown).collect()
    if errors:
        raise InvalidRevision("Revision validation failed:\n - " + "\n - ".join(f"{r['pr']}: {r['rule']} {r['subject']}: {r['detail']}" for r in errors))
