"""Change sets rolled up: allow-list projections, diffstat joined to parsed files, file index and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sanitize import is_sensitive_file, pii_hits, sanitize_path, sanitize_text, scan_secrets, secret_labels
from ..functions.text import file_id, filled, first_filled, in_order, wide_trim
from . import classify, symbols
from .diff import FILE

SECTIONS = ("metadata", "commits", "diffstat", "diff", "file_analysis", "symbols", "comments", "ci", "related_context")


def project_metadata(raw: DataFrame, remove_author: bool = True) -> DataFrame:
    """Allow-listed fields of ``metadata`` (a struct in the provider's shape) by pr, with defaults for what is missing."""
    m = lambda path: F.col(f"metadata.{path}")
    text = lambda c: F.coalesce(c, F.lit(""))
    shape = raw.schema["metadata"].dataType
    names = set(shape.fieldNames())
    draft = F.coalesce(m("draft"), F.lit(False)) if "draft" in names else F.lit(False)
    author = F.lit(None).cast("string")
    if not remove_author and "author" in names:
        author = first_filled(m("author.display_name"), m("author.username"))
    return raw.select(
        "pr", F.coalesce(m("id"), F.lit(0)).cast("long").alias("id"), wide_trim(text(m("title"))).alias("title"),
        wide_trim(F.substring(text(m("description")), 1, 1000)).alias("description"), F.coalesce(filled(m("state")), F.lit("open")).alias("state"), draft.alias("draft"),
        text(m("source.branch.name")).alias("source_branch"), text(m("source.commit.hash")).alias("source_commit"),
        text(m("destination.branch.name")).alias("target_branch"), text(m("destination.commit.hash")).alias("target_commit"), author.alias("author"),
    )


def project_commits(raw: DataFrame, most: int = 10) -> DataFrame:
    """Rows (pr, ord, hash, subject): the first ``most`` commits, first line of each message."""
    d = raw.select("pr", F.posexplode(F.slice("commits", 1, most)).alias("ord", "c"))
    subject = wide_trim(F.get(F.split(F.coalesce(F.col("c.message"), F.lit("")), "\n"), F.lit(0)))
    return d.select("pr", "ord", F.coalesce(F.col("c.hash"), F.lit("")).alias("hash"), subject.alias("subject"))


def project_diffstat(raw: DataFrame) -> DataFrame:
    """Rows (pr, ord, status, lines_added, lines_removed, old_path, new_path), numbered from 1."""
    d = raw.select("pr", F.posexplode("diffstat").alias("pos", "s"))
    return d.select(
        "pr", (F.col("pos") + 1).alias("ord"), F.coalesce(filled(F.col("s.status")), F.lit("modified")).alias("status"),
        F.coalesce(F.col("s.lines_added"), F.lit(0)).cast("long").alias("lines_added"), F.coalesce(F.col("s.lines_removed"), F.lit(0)).cast("long").alias("lines_removed"),
        F.col("s.old.path").alias("old_path"), F.col("s.new.path").alias("new_path"),
    )


def effective_path() -> Column:
    return F.coalesce(first_filled(F.col("new_path"), F.col("old_path")), F.concat(F.lit("file_"), F.col("ord").cast("string")))


def match_files(stats: DataFrame, files: DataFrame) -> DataFrame:
    """Every diffstat row beside the first parsed file whose new or old path is its path; an unmatched one keeps its own counts.

    The test on either path is an equality on candidate paths: each parsed file
    offers both, and the smallest file_ord wins.
    """
    candidates = files.select("pr", "file_ord", F.explode(F.array_distinct(F.array_compact(F.array("new_path", "old_path")))).alias("path"))
    first = candidates.groupBy("pr", "path").agg(F.min("file_ord").alias("file_ord"))
    parsed = files.select("pr", "file_ord", F.struct("old_path", "new_path", "status", "is_binary", "additions", "deletions", "header_lines").alias("f"))
    own = F.struct(
        filled(F.col("old_path")).alias("old_path"), F.coalesce(filled(F.col("new_path")), F.col("path")).alias("new_path"), F.col("status"), F.lit(False).alias("is_binary"),
        F.col("lines_added").alias("additions"), F.col("lines_removed").alias("deletions"), F.expr("cast(array() as array<string>)").alias("header_lines"),
    )
    d = stats.withColumn("path", effective_path()).join(first, ["pr", "path"], "left").join(parsed, ["pr", "file_ord"], "left")
    return d.withColumn("f", F.coalesce("f", own))


def analyze_files(stats: DataFrame, files: DataFrame, lines: DataFrame, path_mode: str = "sanitized") -> DataFrame:
    """One row for each diffstat row: classification, risk, language, sanitized paths and the file id."""
    matched = match_files(stats, files).select("pr", "ord", "path", "status", "lines_added", "lines_removed", "old_path", "file_ord", "f")
    # facts are computed once for each diffstat row; lines follow their file_ord
    facts_in = matched.select("pr", F.col("ord").alias("file_ord"), F.col("file_ord").alias("diff_ord"), "f.*")
    own_lines = lines.join(matched.where("file_ord is not null").select("pr", "file_ord", F.col("ord").alias("to_ord")), FILE).drop("file_ord").withColumnRenamed("to_ord", "file_ord")
    facts = classify.file_facts(facts_in, own_lines)
    facts = facts.withColumn("classification", classify.change_kind(facts))
    shown = matched.select("pr", F.col("ord").alias("file_ord"), F.col("path").alias("original_path"), F.col("status").alias("index_status"), "lines_added", "lines_removed", F.col("old_path").alias("stat_old_path"))
    d = facts.join(shown, FILE)
    d = d.withColumn("sensitive", is_sensitive_file(F.col("original_path")))
    d = classify.with_risk(d, F.col("sensitive"))
    fid = file_id(F.col("file_ord"))
    return d.select(
        "pr", F.col("file_ord").alias("ord"), "diff_ord", fid.alias("id"), sanitize_path(F.col("original_path"), fid, path_mode).alias("path"),
        F.when(filled(F.col("stat_old_path")).isNotNull(), sanitize_path(F.col("stat_old_path"), fid, path_mode)).alias("old_path"),
        classify.language(F.col("original_path")).alias("language"), F.col("index_status").alias("status"), F.col("lines_added").alias("additions"), F.col("lines_removed").alias("deletions"),
        "classification", "risk", "sensitive", "original_path", F.col("new_path").alias("diff_new_path"), F.concat(F.lit("files/"), fid, F.lit("/change.json")).alias("detail_ref"),
    )


def analyzed_symbols(analyzed: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols of ``analyzed`` files, by (pr, file_ord = ord)."""
    d = analyzed.where("diff_ord is not null").select("pr", F.col("diff_ord").alias("file_ord"), F.col("ord").alias("to_ord"))
    own = lines.join(d, FILE).drop("file_ord").withColumnRenamed("to_ord", "file_ord")
    return symbols.symbols(own, analyzed.select("pr", F.col("ord").alias("file_ord"), F.col("diff_new_path").alias("new_path"), F.col("classification.kind").alias("kind")))


def file_index(analyzed: DataFrame) -> DataFrame:
    return analyzed.select("pr", "ord", "id", "path", "old_path", "language", "status", "additions", "deletions", F.col("classification.kind").alias("change_kind"), F.col("risk.tags").alias("risk_tags"), F.col("risk.level").alias("risk_level"), "detail_ref")


def file_changes(analyzed: DataFrame, syms: DataFrame) -> DataFrame:
    """File-change documents; ``content_modified`` tells of a sensitive file, not of what a scanner changed."""
    packed = syms.groupBy("pr", F.col("file_ord").alias("ord")).agg(in_order(F.struct("kind", "name", "change", "signature", "line", "confidence", "relationship"), F.col("symbol_ord")).alias("symbols"))
    d = analyzed.join(packed, ["pr", "ord"], "left")
    empty = F.expr("cast(array() as array<struct<kind:string,name:string,change:string,signature:string,line:bigint,confidence:double,relationship:string>>)")
    return d.select(
        "pr", "ord", F.lit("4.0").alias("schema_version"), F.col("id").alias("file_id"), "classification", F.coalesce("symbols", empty).alias("symbols"), "risk",
        F.lit("patch.diff").alias("patch_ref"), F.lit(None).cast("string").alias("context_ref"), F.struct(F.lit(True).alias("scanned"), F.col("sensitive").alias("content_modified")).alias("redaction_result"),
    )


def kind_counts(index: DataFrame) -> DataFrame:
    """Rows (pr, change_kind, n, first_ord)."""
    return index.groupBy("pr", "change_kind").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def primary_kinds(index: DataFrame) -> DataFrame:
    """Rows (pr, primary_kind): the most frequent kind, of equal ones the one seen first."""
    return kind_counts(index).groupBy("pr").agg(F.min_by("change_kind", F.struct(-F.col("n"), F.col("first_ord"))).alias("primary_kind"))


def overall_level(tags: Column) -> Column:
    """Level of a change set from its tags alone, which is not the highest level of its files."""
    has = lambda *names: F.arrays_overlap(tags, F.array(*(F.lit(n) for n in names)))
    return F.when(has("auth_security", "database_schema"), "high").when(has("public_api", "secret_config"), "medium").when(F.size(tags) > 0, "low").otherwise("none")


def rollup(index: DataFrame) -> DataFrame:
    """One row a pr: totals, kind counts in first-seen order, primary kind, tag set in first-seen order, risky files."""
    risky = F.col("risk_level").isin("high", "critical")
    sums = index.groupBy("pr").agg(
        F.count("*").alias("total_files"), F.sum("additions").alias("total_additions"), F.sum("deletions").alias("total_deletions"),
        F.array_distinct(F.flatten(in_order(F.col("risk_tags"), F.col("ord")))).alias("total_risk_tags"),
        F.count_if(risky).alias("risky_files_count"), F.filter(in_order(F.when(risky, F.col("id")), F.col("ord")), lambda x: x.isNotNull()).alias("important_file_ids"),
    )
    kinds = kind_counts(index).groupBy("pr").agg(
        in_order(F.struct("change_kind", "n"), F.col("first_ord")).alias("kind_counts"), F.min_by("change_kind", F.struct(-F.col("n"), F.col("first_ord"))).alias("primary_kind")
    )
    return sums.join(kinds, "pr").withColumn("overall_level", overall_level(F.col("total_risk_tags")))


def redaction_tally(texts: DataFrame) -> DataFrame:
    """Rows (pr, redacted_values, categories) from (pr, text): a category counts once for every text it is found in."""
    hits = F.concat(pii_hits(F.col("text")), F.transform(F.coalesce(secret_labels(F.col("text")), F.expr("cast(array() as array<string>)")), lambda x: F.lower(x)))
    return texts.groupBy("pr").agg(F.sum(F.size(hits)).alias("redacted_values"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(hits)))).alias("categories"))


def redaction_report(texts: DataFrame, authors: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Rows (pr, redacted_values, categories, omitted_files): ``redaction_tally`` with identities and sensitive files.

    ``authors`` has (pr, author), a struct of which any of raw, account_id, uuid,
    nickname or email counts once as ``pii_user_identity``; ``files`` has (pr, path).
    """
    out = redaction_tally(texts)
    if authors is not None:
        names = set(authors.schema["author"].dataType.fieldNames())
        known = [F.coalesce(filled(F.col(f"author.{n}").cast("string")).isNotNull(), F.lit(False)) for n in ("raw", "account_id", "uuid", "nickname", "email") if n in names]
        told = authors.groupBy("pr").agg(F.count_if(F.greatest(F.lit(False), F.lit(False), *known)).alias("identities"))
        empty = F.expr("cast(array() as array<string>)")
        both = out.join(told, "pr", "full")
        more = F.when(F.col("identities") > 0, F.array(F.lit("pii_user_identity"))).otherwise(empty)
        out = both.select("pr", (F.coalesce("redacted_values", F.lit(0)) + F.coalesce("identities", F.lit(0))).alias("redacted_values"), F.array_sort(F.array_union(F.coalesce("categories", empty), more)).alias("categories"))
    if files is None:
        return out.withColumn("omitted_files", F.lit(0).cast("long"))
    omitted = files.groupBy("pr").agg(F.count_if(is_sensitive_file(F.col("path"))).alias("omitted_files"))
    return out.join(omitted, "pr", "left").withColumn("omitted_files", F.coalesce("omitted_files", F.lit(0)))


def manifests(meta: DataFrame, commits: DataFrame, rolled: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """Manifest rows; title and description are scanned for secrets and personal data, ``is_draft`` is always false."""
    counts = commits.groupBy("pr").agg(F.count("*").alias("commits_count"))
    clean = lambda c: sanitize_text(scan_secrets(F.col(c)))
    texts = meta.select("pr", F.explode(F.array("title", "description")).alias("text"))
    d = meta.join(rolled, "pr", "left").join(counts, "pr", "left").join(redaction_tally(texts), "pr", "left")
    d = d.join(tickets, "pr", "left") if tickets is not None else d.withColumn("ticket_id", F.lit(None).cast("string"))
    zero, none = (lambda c: F.coalesce(c, F.lit(0)).cast("long")), F.expr("cast(array() as array<string>)")
    return d.select(
        "pr", clean("title").alias("title"), clean("description").alias("description"), F.coalesce(filled(F.col("state")), F.lit("OPEN")).alias("state"), F.lit(False).alias("is_draft"),
        "source_branch", "target_branch", "source_commit", "target_commit", F.when(F.col("ticket_id") != "N/A", F.col("ticket_id")).alias("ticket_id"),
        F.struct(zero("total_files").alias("total_files"), zero("total_additions").alias("total_additions"), zero("total_deletions").alias("total_deletions"), F.coalesce("primary_kind", F.lit("functional_logic")).alias("primary_kind"), "kind_counts").alias("change_summary"),
        F.struct(F.coalesce("overall_level", F.lit("none")).alias("overall_level"), F.coalesce("total_risk_tags", none).alias("total_risk_tags"), zero("risky_files_count").alias("risky_files_count")).alias("risk_summary"),
        F.struct(zero("total_files").alias("files_changed"), zero("commits_count").alias("commits_count")).alias("stats"), F.coalesce("important_file_ids", none).alias("important_file_ids"),
        F.struct(F.lit("files.index.jsonl").alias("files_index"), F.lit("commits.jsonl").alias("commits"), F.lit("coverage.json").alias("coverage")).alias("index_refs"),
        F.struct(F.lit(True).alias("scanned"), zero("redacted_values").alias("redacted_items_count")).alias("redaction_summary"), F.lit("4.0.0").alias("analyzer_version"),
    )


def coverage(counts: DataFrame) -> DataFrame:
    """Rows (pr, section_ord, section, status, truncated, items_fetched, warning) from one row of counts a pr: commits, diffstat, diff, files, symbols."""
    fetched = {"metadata": F.lit(1), "commits": F.col("commits"), "diffstat": F.col("diffstat"), "diff": F.col("diff"), "file_analysis": F.col("files"), "symbols": F.col("symbols")}
    rows = [
        F.struct(F.lit(i).alias("section_ord"), F.lit(s).alias("section"), F.lit("complete" if s in fetched else "not_fetched").alias("status"), F.lit(False).alias("truncated"), F.coalesce(fetched.get(s, F.lit(0)), F.lit(0)).cast("long").alias("items_fetched"), F.lit(None).cast("string").alias("warning"))
        for i, s in enumerate(SECTIONS)
    ]
    return counts.select("pr", F.inline(F.array(*rows)))


def enrich(manifest: DataFrame, reading: DataFrame, provider: str, repository: Column, generated_at: Column) -> DataFrame:
    """Manifests with schema version, reading metadata and provenance."""
    d = manifest.join(reading.select("pr", F.struct("mode", "reason", "required_next_files", "optional_next_files", "skip_categories", "token_budget").alias("ai_reading")), "pr", "left")
    prov = F.struct(generated_at.alias("generated_at"), F.lit(provider).alias("provider"), repository.alias("repository"), F.col("pr").cast("string").alias("pull_request_id"))
    return d.withColumn("schema_version", F.lit("4.0")).withColumn("provenance", prov)


def row_number_over(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("pr").orderBy(*order))
