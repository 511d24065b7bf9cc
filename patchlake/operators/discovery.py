"""Open change sets of a user: normalised listing, ownership and view filters, cache status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sanitize import normalize_uuid, redact_auth, sanitize_text
from ..functions.text import filled


def provider_query(uuid: str) -> str:
    """The filter pushed to a provider that can evaluate it; the same filter is applied again to what it returns."""
    if not (uuid or "").strip():
        raise ValueError("a user id is needed")
    return f'state = "OPEN" AND author.uuid = "{uuid}"'


def normalize(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Listing rows from flat columns (id, title, state, draft, is_draft, source_branch, target_branch, source_commit, target_commit, updated_on, author_uuid)."""
    t = F.lower(F.coalesce("title", F.lit("")))
    now = F.current_timestamp().cast("string") if now is None else now
    return raw.select(
        "id", F.when(filled(F.col("title")).isNotNull(), redact_auth(sanitize_text(F.col("title")))).otherwise("Untitled PR").alias("title"), F.coalesce(filled(F.col("state")), F.lit("OPEN")).alias("state"),
        F.coalesce("draft", "is_draft", t.contains("[draft]") | t.startswith("draft:")).alias("is_draft"),
        F.coalesce(filled(F.col("source_branch")), F.lit("unknown")).alias("source_branch"), F.coalesce(filled(F.col("target_branch")), F.lit("unknown")).alias("target_branch"),
        "source_commit", "target_commit", F.coalesce(filled(F.col("updated_on")), now).alias("updated_on"), filled(normalize_uuid(F.col("author_uuid"))).alias("author_uuid"),
    )


def belongs_to(author: Column, user: Column) -> Column:
    a, u = normalize_uuid(author), normalize_uuid(user)
    return (a == u) & (a != "")


def view(prs: DataFrame, user: str, readiness: str = "all") -> DataFrame:
    """Open rows of the user; readiness is ready, draft or all."""
    keep = belongs_to(F.col("author_uuid"), F.lit(user)) & (F.upper("state") == "OPEN")
    if readiness in ("ready", "draft"):
        keep = keep & (F.col("is_draft") == F.lit(readiness == "draft"))
    return prs.where(keep)


def newest(prs: DataFrame, page: int = 50) -> DataFrame:
    return prs.orderBy(F.desc("updated_on"), "id").limit(page)


def discovered(listing: DataFrame, user: str, page: int = 50) -> DataFrame:
    """The newest page of the user's open rows; of all open rows where the user has none.

    What the provider would be asked twice for is one plan: whether the first answer is
    empty is a single row beside the second.
    """
    first = listing.where((F.upper("state") == "OPEN") & belongs_to(F.col("author_uuid"), F.lit(user)))
    some = F.broadcast(first.limit(1).agg((F.count("*") > 0).alias("_some")))
    second = listing.where(F.upper("state") == "OPEN").join(some, F.lit(True)).where("not _some").drop("_some")
    return newest(first.unionByName(second), page)


def replaced_scope(cache: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """A discovery cache (scope, id, ...) in which the rows of ``scope`` are ``new``; no rows clear it."""
    return cache.where(F.col("scope") != scope).unionByName(new.withColumn("scope", F.lit(scope)).select(cache.columns))


def cache_status(prs: DataFrame, active: DataFrame) -> DataFrame:
    """``prs`` (id, source_commit, target_commit, updated_on) with cache_status against ``active`` (id, have_source, have_target, generated_at).

    Equal commits are cached; else what was generated no earlier than the update;
    dates that cannot be read are outdated.
    """
    d = prs.join(active.withColumn("known", F.lit(True)), "id", "left")
    same = (filled(F.col("source_commit")) == F.col("have_source")) & (filled(F.col("target_commit")) == F.col("have_target"))
    fresh = F.coalesce(F.col("generated_at").try_cast("timestamp"), F.timestamp_seconds(F.lit(0))) >= F.col("updated_on").try_cast("timestamp")
    status = F.when(F.col("known").isNull(), "Missing").when(F.coalesce(same, F.lit(False)) | F.coalesce(fresh, F.lit(False)), "Cached").otherwise("Outdated")
    return d.withColumn("cache_status", status).drop("known")


def outdated(prs: DataFrame) -> DataFrame:
    return prs.where("cache_status <> 'Cached'")


def without_revision(prs: DataFrame, revisions: DataFrame) -> DataFrame:
    return prs.join(revisions.select("id"), "id", "left_anti")


def with_revision(prs: DataFrame, revisions: DataFrame) -> DataFrame:
    return prs.join(revisions.select("id"), "id", "left_semi")


def selected(prs: DataFrame, ids: DataFrame) -> DataFrame:
    return prs.join(ids.select("id"), "id", "left_semi")


def date_span(prs: DataFrame, now: Column) -> DataFrame:
    """One row (oldest, days): days since the oldest update, at least 1; unreadable dates are dropped."""
    when = F.col("updated_on").try_cast("timestamp")
    oldest = F.min(when)
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(oldest)
    return prs.agg(oldest.alias("oldest"), F.greatest(F.lit(1), F.ceil(seconds / 86400)).cast("long").alias("days"))
