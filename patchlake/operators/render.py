"""Markdown documents of a change set as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, in_order


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _line(*parts) -> Column:
    return F.concat_ws("", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def tags_text(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise("none")


def context_pack(manifest: DataFrame, commits: DataFrame, reading: DataFrame, repository: Column) -> DataFrame:
    """Rows (pr, context); a line without text is left out only where the mode has no reason."""
    line = F.concat(F.lit("- "), F.substring(F.coalesce("hash", F.lit("")), 1, 7), F.lit(": "), F.coalesce("subject", F.lit("")))
    said = commits.groupBy("pr").agg(F.array_join(in_order(line, F.col("ord")), "\n").alias("commit_lines"))
    d = manifest.join(said, "pr", "left").join(reading.select("pr", "mode", "reason"), "pr", "left")
    c, r = "change_summary.", "risk_summary."
    text = _lines(
        _line("# PR Context Pack: ", F.col("title")), "", "## Read Strategy", _line("Mode: ", F.col("mode")), F.when(filled(F.col("reason")).isNotNull(), _line("Reason: ", F.col("reason"))), "",
        "## Overview", _line("- **Repository**: ", repository), _line("- **Branches**: `", F.col("source_branch"), "` -> `", F.col("target_branch"), "`"), _line("- **State**: ", F.col("state")),
        _line("- **Ticket**: ", F.coalesce(filled(F.col("ticket_id")), F.lit("N/A"))), _line("- **Overall Risk**: ", F.col(r + "overall_level")), "",
        "## Change Summary", _line("- Files Changed: ", F.col(c + "total_files").cast("string")), _line("- Additions: +", F.col(c + "total_additions").cast("string")), _line("- Deletions: -", F.col(c + "total_deletions").cast("string")), _line("- Primary Kind: ", F.col(c + "primary_kind")), "",
        "## Description", F.coalesce(filled(F.col("description")), F.lit("_No description provided._")), "", "## Commits", F.col("commit_lines"),
    )
    return d.select("pr", text.alias("context"))


def files_summary(index: DataFrame) -> DataFrame:
    """Rows (pr, summary): a table of files, those with tags first, else in file order."""
    row = _line("| ", F.col("id"), " | ", F.col("path"), " | ", F.col("change_kind"), " | ", F.col("status"), " | +", F.col("additions").cast("string"), "/-", F.col("deletions").cast("string"), " | ", tags_text(F.col("risk_tags")), " |")
    rows = index.groupBy("pr").agg(F.array_join(in_order(row, (F.size("risk_tags") == 0), F.col("ord")), "\n").alias("rows"))
    head = ["# Files", "", "## Read First", "| File ID | Path | Kind | Status | +/- | Risk Tags |", "| --- | --- | --- | --- | --- | --- |"]
    return rows.select("pr", _lines(*head, F.col("rows")).alias("summary"))


def actions_summary(coverage: DataFrame, status: str = "complete", provider: str = "bitbucket") -> DataFrame:
    line = _line("- **", F.col("section"), "**: ", F.col("status"), " (", F.col("items_fetched").cast("string"), " items)")
    rows = coverage.groupBy("pr").agg(F.array_join(in_order(line, F.col("section_ord")), "\n").alias("rows"))
    return rows.select("pr", _lines("# Actions & Coverage", "", f"- **Provider**: {provider}", f"- **Collection Status**: {status}", "", "## Coverage Overview", F.col("rows")).alias("actions"))


def file_detail(index: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows (pr, id, detail) from index rows and (pr, ord, patch)."""
    text = _lines(
        _line("# ", F.col("id")), "", _line("- **Path**: `", F.col("path"), "`"), _line("- **Status**: ", F.col("status")), _line("- **Language**: ", F.col("language")), _line("- **Change Kind**: ", F.col("change_kind")),
        _line("- **Additions**: +", F.col("additions").cast("string")), _line("- **Deletions**: -", F.col("deletions").cast("string")), _line("- **Risk Tags**: ", tags_text(F.col("risk_tags"))), "",
        "## Diff Patch", "```diff", F.coalesce("patch", F.lit("")), "```",
    )
    return index.join(patches, ["pr", "ord"], "left").select("pr", "id", text.alias("detail"))


def with_detail_level(contexts: DataFrame, summaries: DataFrame, level: str | None = None) -> DataFrame:
    """Contexts; level deep appends the files table."""
    if level != "deep":
        return contexts
    d = contexts.join(summaries, "pr", "left")
    return d.select("pr", F.when(F.col("summary").isNotNull(), F.concat("context", F.lit("\n\n---\n\n"), "summary")).otherwise(F.col("context")).alias("context"))
