"""From raw revisions to every published table, as one lazy graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sanitize import scan_secrets
from ..functions.text import in_order
from ..operators import diff, manifest, payload, reading, render


@dataclass
class Revision:
    tables: dict[str, DataFrame]
    rolled: DataFrame
    details: DataFrame


def analyze(raw: DataFrame, generated_at: Column, ticket_prefixes: list[str] | None = None, path_mode: str = "sanitized", repository: Column | None = None, provider: str = "bitbucket", keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> Revision:
    """``raw`` has (pr, metadata, commits, diffstat, raw_diff) in the provider's shape.

    ``keep`` holds on to the tables that many documents are made from, so each is
    computed once: in executors' memory and disk by default; a large batch passes a
    function that writes them to the staging folder and reads them again.
    """
    repository = F.lit("") if repository is None else repository
    meta, commits, stats = manifest.project_metadata(raw), manifest.project_commits(raw), manifest.project_diffstat(raw)
    marked = keep(diff.marked_lines(raw.select("pr", "raw_diff")))
    files, lines = keep(diff.diff_files(marked)), keep(diff.diff_lines(marked))
    analyzed = keep(manifest.analyze_files(stats, files, lines, path_mode))
    syms = keep(manifest.analyzed_symbols(analyzed, lines))
    index, changes = manifest.file_index(analyzed), manifest.file_changes(analyzed, syms)
    rolled = keep(manifest.rollup(index))
    subjects = commits.groupBy("pr").agg(in_order(F.col("subject"), F.col("ord")).alias("subjects"))
    empty = F.expr("cast(array() as array<string>)")
    tickets = meta.join(subjects, "pr", "left").select("pr", payload.ticket_id(F.col("source_branch"), F.coalesce("subjects", empty), ticket_prefixes or []).alias("ticket_id"))
    modes = keep(reading.reading_modes(rolled, index))
    man = manifest.enrich(manifest.manifests(meta, commits, rolled, tickets), modes, provider, repository, generated_at)
    body = diff.patch_text(marked, files).withColumnRenamed("file_ord", "diff_ord")
    patches = analyzed.select("pr", "ord", F.col("id").alias("file_id"), "diff_ord").join(body, ["pr", "diff_ord"], "left").select("pr", "ord", "file_id", scan_secrets(F.coalesce("patch", F.lit("\n"))).alias("patch"))
    count = lambda d, name: d.groupBy("pr").agg(F.count("*").alias(name))
    counts = meta.select("pr")
    for d, name in ((commits, "commits"), (stats, "diffstat"), (files, "diff"), (index, "files"), (syms, "symbols")):
        counts = counts.join(count(d, name), "pr", "left")
    cover = manifest.coverage(counts)
    summary = render.files_summary(index)
    tables = {
        "manifest": man, "files_index": index, "commits": commits, "coverage": cover, "file_changes": changes, "patches": patches,
        "context": render.context_pack(man, commits, modes, repository), "files_summary": summary, "actions": render.actions_summary(cover, provider=provider), "file_details": render.file_detail(index, patches.select("pr", "ord", "patch")),
    }
    details = changes.select("pr", F.concat(F.lit("files/"), F.col("file_id"), F.lit("/change.json")).alias("ref"), "patch_ref", F.col("file_id").alias("folder"))
    return Revision(tables, rolled, details)
