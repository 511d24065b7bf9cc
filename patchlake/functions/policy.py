"""Policies of the control plane as Column expressions: write guard, retries, basic authentication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def can_execute_write(enabled: Column, deny: Column, allow: Column, action: Column) -> Column:
    """Struct (allowed, reason) of an action under a write profile: disabled, denied, not listed, in that order."""
    # fixed values: reasons
    reason = (
        F.when(~F.coalesce(enabled, F.lit(False)), "Write profile is disabled in config/write.json.")
        .when(F.array_contains(deny, action), F.concat(F.lit("Action '"), action, F.lit("' is explicitly denied in write profile.")))
        .when(~F.array_contains(allow, action), F.concat(F.lit("Action '"), action, F.lit("' is not listed in allowed capabilities.")))
    )
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def should_retry(status: Column) -> Column:
    """No status (a failed connection), too many requests, or an error of the server."""
    return F.coalesce(status, F.lit(0)).isin(0, 429) | F.coalesce(status.between(500, 599), F.lit(False))


def backoff_ms(attempt: Column, jitter: Column, retry_after: Column | None = None) -> Column:
    """Milliseconds before the next attempt: 1, 2, 4, ... seconds and ``jitter``; leading digits of a Retry-After header decide where it has them."""
    own = F.pow(F.lit(2.0), attempt - 1) * 1000 + jitter
    if retry_after is None:
        return own.cast("long")
    told = F.regexp_extract(F.coalesce(retry_after, F.lit("")), r"\A\s*([+-]?\d+)", 1).try_cast("long")
    return F.coalesce(told * 1000, own.cast("long"))


def basic_auth(user: Column, token: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat(user, F.lit(":"), token).cast("binary")))
