"""How to read a change set: mode, reason, priority files and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_order
from .manifest import row_number_over

HIGH_RISK_TAGS = ("public_api", "auth_security", "database_schema", "secret_config")
SKIM_KINDS = ("comment_only", "documentation_only", "whitespace_only", "formatting_only", "test_only", "unit_test")
#: The ranks any mode can ask for: three risky files and five others, or ten.
RANKS = 10


def _has(tags: Column, *names: str) -> Column:
    return F.arrays_overlap(tags, F.array(*(F.lit(n) for n in names)))


def priority(index: DataFrame) -> DataFrame:
    """``index`` with weight, rank (from 1) and risky_rank: heavier first, then in file order."""
    tags = F.col("risk_tags")
    weight = F.when(_has(tags, "auth_security", "public_api"), 100).when(_has(tags, "database_schema", "secret_config"), 80).otherwise(10) + F.col("additions") + F.col("deletions")
    d = index.withColumn("weight", weight.cast("long"))
    order = [F.desc("weight"), F.col("ord")]
    risky = F.size("risk_tags") > 0
    return d.withColumn("rank", row_number_over(order)).withColumn("risky_rank", F.when(risky, row_number_over([F.desc(risky), *order])))


def reading_modes(rolled: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (pr, mode, reason, required_next_files, optional_next_files, skip_categories, token_budget)."""
    ranked = priority(index).where((F.col("rank") <= RANKS) | (F.col("risky_rank") <= 3))
    ref = F.concat(F.lit("files/"), F.col("id"), F.lit(".md"))
    lists = ranked.groupBy("pr").agg(
        in_order(F.when(F.col("rank") <= RANKS, ref), F.col("rank")).alias("all"), in_order(F.when(F.col("risky_rank") <= 3, ref), F.coalesce("risky_rank", F.lit(1 << 30))).alias("risky")
    )
    present = lambda c: F.filter(c, lambda x: x.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    d = rolled.join(lists, "pr", "left").withColumns({"all": F.coalesce(present("all"), none), "risky": F.coalesce(present("risky"), none)})
    high, level, files, risky = _has(F.col("total_risk_tags"), *HIGH_RISK_TAGS), F.col("overall_level"), F.col("total_files"), F.col("risky_files_count")
    skim = (files <= 3) & level.isin("none", "low") & F.col("primary_kind").isin(*SKIM_KINDS) & ~high
    deep = level.isin("high", "critical") | (files > 30)
    inspect = high | (risky > 0) | (files > 10)
    mode = F.when(skim, "skim").when(deep, "deep_review").when(inspect, "inspect_priority_files").otherwise("standard")
    d = d.withColumn("mode", mode)
    case = lambda **by: F.coalesce(*(F.when(F.col("mode") == m, v) for m, v in by.items()))
    n = files.cast("string")
    reasons = F.array_compact(F.array(F.when(high, F.concat(F.lit("risk tags: "), F.array_join("total_risk_tags", ", "))), F.when(risky > 0, F.concat(risky.cast("string"), F.lit(" risky file(s)"))), F.when(files > 10, F.concat(n, F.lit(" files changed")))))
    reason = case(
        skim=F.concat(F.col("primary_kind"), F.lit(", risk "), level, F.lit(", "), n, F.lit(" file(s) changed")),
        deep_review=F.concat(F.lit("High risk ("), level, F.lit(") or large file count ("), n, F.lit(" files)")),
        inspect_priority_files=F.array_join(reasons, "; "),
        standard=F.concat(F.lit("Standard changes in "), n, F.lit(" file(s), primary kind: "), F.col("primary_kind")),
    )
    inspected = F.slice(F.when(F.size("risky") > 0, F.col("risky")).otherwise(F.col("all")), 1, 3)
    required = case(skim=none, deep_review=F.slice("all", 1, 5), inspect_priority_files=inspected, standard=F.slice("all", 1, 2))
    optional = case(skim=F.slice("all", 1, 1), deep_review=F.slice("all", 6, 5), inspect_priority_files=F.slice(F.array_except("all", inspected), 1, 5), standard=F.slice("all", 3, 3))
    words = lambda *x: F.array(*(F.lit(w) for w in x)) if x else none
    skip = case(skim=words("full_patch_review", "security_review", "test_impact_review"), deep_review=none, inspect_priority_files=words("generated_files"), standard=words("unmodified_vendor_files"))
    budget = case(skim=F.lit("small"), deep_review=F.lit("extensive"), inspect_priority_files=F.lit("large"), standard=F.lit("medium"))
    return d.select("pr", "mode", reason.alias("reason"), required.alias("required_next_files"), optional.alias("optional_next_files"), skip.alias("skip_categories"), budget.alias("token_budget"))
