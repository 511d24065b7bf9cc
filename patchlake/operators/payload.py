"""Description payloads: tickets, titles, modules, highlights and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, filled, first_filled, in_order, wide_trim
from .classify import MODULES, module_of
from .diff import FILE

# fixed values: texts of the payload
NOTE_MIGRATION = "Cần chạy EF Database Migration: "
NOTE_SQL = "Cần thực thi SQL Migration Script: "
NOTE_PROTO = ("Có thay đổi contract gRPC Proto (", "), cần re-generate gRPC Client/Server code.")
NOTE_SETTINGS = ("Cấu hình môi trường bị thay đổi ở ", ", cần kiểm tra App Settings/Env Keys.")
NO_NOTES = "Không có yêu cầu migration đặc biệt"
NO_INSIGHTS = "Cập nhật và tối ưu hóa tính năng"
FALLBACK_PREFIX = "Cập nhật các file"
FALLBACKS = (
    ("Database", "Cập nhật cấu hình DbContext / Schema Migration liên quan đến: "),
    ("APIs", "Thêm mới / Cập nhật Controller và các API Endpoints trong: "),
    ("Services", "Triển khai Business Logic, DTO Request/Response và Services: "),
    ("gRPC", "Cập nhật Proto schema và gRPC Client/Service integration: "),
    ("Tests", "Bổ sung Unit Tests & Helper Extensions trong: "),
    ("", "Cập nhật các file cấu hình và tài nguyên: "),
)


def ticket_id(branch: Column, commits: Column, prefixes: list[str]) -> Column:
    """The first ticket in the branch, prefix by prefix, else in the commits, commit by commit; ``N/A`` without one.

    Prefixes are patterns, as they are configured.
    """
    find = lambda c, p: filled(F.regexp_extract(c, f"(?i)({p}\\d+)", 1))
    in_branch = [find(F.coalesce(branch, F.lit("")), p) for p in prefixes]
    each = F.transform(commits, lambda c: F.coalesce(*(find(c, p) for p in prefixes), F.lit(None).cast("string"))) if prefixes else F.lit(None)
    in_commits = F.get(F.array_compact(each), F.lit(0)) if prefixes else F.lit(None).cast("string")
    return F.coalesce(*(F.upper(c) for c in in_branch), F.upper(in_commits), F.lit("N/A"))


def commit_summary(messages: Column) -> Column:
    """First lines of commit messages, trimmed, without empty ones."""
    firsts = F.transform(messages, lambda m: wide_trim(F.get(F.split(F.coalesce(m, F.lit("")), "\n"), F.lit(0))))
    return F.filter(firsts, lambda x: x != "")


def title(branch: Column, ticket: Column, commits: Column) -> Column:
    first = F.get(commits, F.lit(0))
    clean = F.regexp_replace(F.regexp_replace(first, r"\A\[.*?\]\s*", ""), r"(?i)\Awce-\d+:\s*", "")
    name = filled(F.element_at(F.split(branch, "/"), -1))
    from_branch = F.regexp_replace(F.coalesce(name, branch), "[-_]", " ")
    body = F.when(F.size(commits) > 0, clean).otherwise(from_branch)
    return F.when(ticket != "N/A", F.concat(F.lit("["), ticket, F.lit("] "), body)).otherwise(body)


def title_ticket(text: Column) -> Column:
    return filled(F.regexp_extract(text, r"([A-Z]+-\d+)", 1))


def shortstat(text: Column) -> Column:
    """Struct (files, additions, deletions) of a one-line diff statistic; what is missing is 0."""
    number = lambda p: F.coalesce(filled(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)).try_cast("long"), F.lit(0))
    return F.struct(number(r"(\d+)\s+file").alias("files"), number(r"(\d+)\s+insertion").alias("additions"), number(r"(\d+)\s+deletion").alias("deletions"))


def branch_identifier(branch: Column) -> Column:
    return F.regexp_replace(branch, "[^a-zA-Z0-9_-]", "_")


def modules(paths: DataFrame) -> DataFrame:
    """Rows (pr, module_ord, module, files) from (pr, ord, path): deduplicated basenames in file order, modules in fixed order."""
    rank = F.array_position(F.array(*(F.lit(m) for m in MODULES)), F.col("module"))
    d = paths.select("pr", "ord", basename(F.col("path")).alias("name"), module_of(F.col("path")).alias("module"))
    return d.groupBy("pr", "module").agg(F.array_distinct(in_order(F.col("name"), F.col("ord"))).alias("files")).withColumn("module_ord", rank)


def symbols_said(symbols: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, said): the symbols of each file in words, in order."""
    return symbols.groupBy(*FILE).agg(in_order(symbol_said(F.col("kind"), F.col("name"), F.col("change")), F.col("symbol_ord")).alias("said"))


def symbol_said(kind: Column, name: Column, change: Column) -> Column:
    return F.concat(F.upper(kind), F.lit(": "), name, F.lit(" ("), change, F.lit(")"))


def fallback_highlight(module: Column, files: Column) -> Column:
    out = F.lit(FALLBACKS[-1][1])
    for word, text in reversed(FALLBACKS[:-1]):
        out = F.when(module.contains(word), F.lit(text)).otherwise(out)
    return F.concat(out, F.array_join(F.slice(files, 1, 3), ", "))


def change_sets(files: DataFrame, fallback: bool = True, most: int = 8) -> DataFrame:
    """Rows (pr, changes_by_module): per change set an array of (module, files, highlights), modules in fixed order.

    ``files`` has (pr, file_ord, path, classification, risk, said). A module has the
    deduplicated basenames of its files in file order and the union of their highlights:
    evidence, risk evidence and symbols, the first ``most`` of each file; of equal
    basenames, whatever their module, the last file counts. A module without any gets a
    text by its name. Both groupings hold the rows of a change set together, so files
    that are dealt by ``pr`` are not shuffled again.
    """
    empty, rank = F.expr("cast(array() as array<string>)"), F.array_position(F.array(*(F.lit(m) for m in MODULES)), F.col("module"))
    whole = F.slice(F.array_distinct(F.concat("classification.evidence", "risk.evidence", F.coalesce("said", empty))), 1, most)
    d = files.select("pr", "file_ord", basename(F.col("path")).alias("name"), (F.element_at(F.split("path", "/"), -1) != "").alias("named"), module_of(F.col("path")).alias("module"), whole.alias("h"))
    d = d.withColumn("rank", rank)
    first = F.array(*(F.struct(F.lit(k).alias("rank"), F.min(F.when(F.col("rank") == k, F.col("file_ord"))).alias("ord")) for k in range(1, len(MODULES) + 1)))
    names = d.groupBy("pr", "name").agg(F.max_by("h", F.when(F.col("named"), F.col("file_ord"))).alias("h"), first.alias("places"))
    placed = names.select("pr", "name", "h", F.inline(F.filter("places", lambda x: x["ord"].isNotNull())))
    sets = placed.groupBy("pr").agg(F.array_sort(F.collect_list(F.struct("rank", "ord", "name", "h"))).alias("x"))

    def of(k: int, module: str) -> Column:
        own = F.filter("x", lambda x: x["rank"] == k)
        said = F.array_distinct(F.flatten(F.filter(F.transform(own, lambda x: x["h"]), lambda h: h.isNotNull())))
        return F.struct(F.lit(module).alias("module"), F.transform(own, lambda x: x["name"]).alias("files"), said.alias("highlights"))

    mods = F.filter(F.array(*(of(k, m) for k, m in enumerate(MODULES, 1))), lambda m: F.size(m["files"]) > 0)
    out = sets.select("pr", mods.alias("changes_by_module"))
    if fallback:
        text = lambda m: F.when(F.size(m["highlights"]) > 0, m["highlights"]).otherwise(F.array(fallback_highlight(m["module"], m["files"])))
        out = out.withColumn("changes_by_module", F.transform("changes_by_module", lambda m: F.struct(m["module"].alias("module"), m["files"].alias("files"), text(m).alias("highlights"))))
    return out


def totals(diffstat: DataFrame) -> DataFrame:
    """Rows (pr, total_files_changed, total_additions, total_deletions): files that have a path, sums over all rows."""
    return diffstat.groupBy("pr").agg(
        F.count(first_filled(F.col("new_path"), F.col("old_path"))).alias("total_files_changed"), F.sum(F.coalesce("lines_added", F.lit(0))).alias("total_additions"), F.sum(F.coalesce("lines_removed", F.lit(0))).alias("total_deletions")
    )


def detail_stats(prs: DataFrame, manifests: DataFrame, diffstat: DataFrame) -> DataFrame:
    """Rows (pr, files, additions, deletions, commits): the manifest's numbers, else sums of the diffstat with one commit."""
    told = manifests.select("pr", F.struct(F.col("total_files").alias("files"), F.col("total_additions").alias("additions"), F.col("total_deletions").alias("deletions"), F.col("commits_count").alias("commits")).alias("told"))
    own = diffstat.groupBy("pr").agg(F.count("*").alias("files"), F.sum("lines_added").alias("additions"), F.sum("lines_removed").alias("deletions"))
    own = own.select("pr", F.struct("files", "additions", "deletions", F.lit(1).cast("long").alias("commits")).alias("own"))
    return prs.select("pr").join(told, "pr", "left").join(own, "pr", "left").select("pr", F.coalesce("told", "own").alias("s")).select("pr", "s.*")


def pr_info(meta: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows (pr, ticket_id, title, source_branch, target_branch, author, commit_summary) from (pr, title, source_branch, target_branch, author_name, author_user, messages).

    A title that is missing is made from the ticket, commits and branch; without
    commits the title stands for them. The author is shown as given.
    """
    d = meta.withColumn("commits", commit_summary(F.col("messages"))).withColumn("ticket_id", ticket_id(F.col("source_branch"), F.col("commits"), prefixes))
    d = d.withColumn("title", F.coalesce(filled(F.col("title")), title(F.col("source_branch"), F.col("ticket_id"), F.col("commits"))))
    author = F.coalesce(first_filled(F.col("author_name"), F.col("author_user")), F.lit("unknown"))
    return d.select("pr", "ticket_id", "title", "source_branch", "target_branch", author.alias("author"), F.when(F.size("commits") > 0, F.col("commits")).otherwise(F.array("title")).alias("commit_summary"))


def documents(info: DataFrame, stats: DataFrame, sets: DataFrame) -> DataFrame:
    """One payload a change set: rows (pr, payload) with the JSON text, as it is saved; ``sets`` as made by ``change_sets``."""
    d = with_notes(info.join(stats, "pr", "left").join(sets, "pr", "left"), F.col("commit_summary"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty = F.expr("cast(array() as array<struct<module:string,files:array<string>,highlights:array<string>>>)")
    whole = F.struct(
        F.struct("ticket_id", "title", "source_branch", "target_branch", "author").alias("pr_info"), "commit_summary", F.struct(*(zero(c) for c in ("total_files_changed", "total_additions", "total_deletions"))).alias("diff_stat"),
        F.coalesce("changes_by_module", empty).alias("changes_by_module"), "summary_insights", "deployment_and_migration_notes", "key_impacted_components",
    )
    return d.select("pr", F.to_json(whole).alias("payload"))


def with_notes(sets: DataFrame, commits: Column) -> DataFrame:
    """``sets`` with summary_insights, deployment_and_migration_notes and key_impacted_components, read off changes_by_module inside the row."""
    empty = F.expr("cast(array() as array<string>)")

    def notes(f: Column) -> Column:
        migration = f.endswith(".cs") & (f.contains("Migration") | f.contains("Add_Table") | f.contains("Add_Column"))
        around = lambda two: F.concat(F.lit(two[0]), f, F.lit(two[1]))
        return F.array_compact(F.array(F.when(migration, F.concat(F.lit(NOTE_MIGRATION), F.regexp_replace(f, r"\.cs", ""))), F.when(f.endswith(".sql"), F.concat(F.lit(NOTE_SQL), f)), F.when(f.endswith(".proto"), around(NOTE_PROTO)), F.when(f.contains("appsettings") | f.endswith(".env"), around(NOTE_SETTINGS))))

    each = lambda f: F.flatten(F.transform("changes_by_module", f))
    tagged = lambda m: F.transform(F.filter(F.coalesce(m["highlights"], empty), lambda h: ~h.startswith(FALLBACK_PREFIX)), lambda h: F.concat(F.lit("["), m["module"], F.lit("] "), h))
    d = sets.withColumns({"_files": F.coalesce(each(lambda m: F.coalesce(m["files"], empty)), empty), "_said": F.coalesce(F.slice(each(tagged), 1, 8), empty)})
    components = F.filter("_files", lambda f: f.contains("Controller") | f.contains("Service") | f.contains("Repository"))
    plain = F.filter(F.slice(F.coalesce(commits, empty), 1, 5), lambda c: ~c.startswith("Merge branch"))
    some = lambda c, text: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(text)))
    d = d.withColumn("_notes", F.flatten(F.transform("_files", notes))).withColumn("_said", F.when(F.size("_said") > 0, F.col("_said")).otherwise(plain))
    found = {"summary_insights": some(F.col("_said"), NO_INSIGHTS), "deployment_and_migration_notes": some(F.col("_notes"), NO_NOTES), "key_impacted_components": F.slice(components, 1, 10)}
    return d.withColumns(found).drop("_files", "_said", "_notes")
