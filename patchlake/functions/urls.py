"""Links to pull requests: parse, check, build, and the names typed for repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "bitbucket.org"
_SLUG = r"\A[a-zA-Z0-9_\-.]+\z"


def parse_link(url: Column) -> Column:
    """Struct (workspace, repo_slug, pr_id, canonical_url, error); ``error`` names the first check that fails."""
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, r"\A([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    rest = r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)"
    host = F.lower(F.regexp_extract(text, rest, 1))
    path = F.regexp_replace(F.regexp_extract(text, rest, 2), r"/\z", "")
    shape = r"(?i)\A/([^/]+)/([^/]+)/pull-requests/(\d+)\z"
    ws, repo, number = (F.regexp_extract(path, shape, k) for k in (1, 2, 3))
    pr = number.try_cast("long")
    error = (
        F.when(F.coalesce(url, F.lit("")) == "", "empty")
        .when(url.contains(".."), "path traversal")
        .when(host == "", "invalid url")
        .when(scheme != "https", "insecure protocol")
        .when(host != HOST, "invalid host")
        .when(~path.rlike(shape), "invalid path")
        .when(~ws.rlike(_SLUG) | ~repo.rlike(_SLUG), "invalid name")
        .when(F.coalesce(pr, F.lit(0)) <= 0, "invalid id")
    )
    canonical = F.concat(F.lit(f"https://{HOST}/"), F.lower(ws), F.lit("/"), F.lower(repo), F.lit("/pull-requests/"), pr.cast("string"))
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(ws).alias("workspace"), good(repo).alias("repo_slug"), good(pr).alias("pr_id"), good(canonical).alias("canonical_url"), error.alias("error"))


def build_link(workspace: Column, repo: Column, pr: Column) -> Column:
    name = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\A/+|/+\z", ""))
    number = F.regexp_replace(F.trim(pr.cast("string")), r"\A#", "")
    return F.concat(F.lit(f"https://{HOST}/"), name(workspace), F.lit("/"), name(repo), F.lit("/pull-requests/"), number)


def workspace_slug(c: Column) -> Column:
    """Struct (slug, extracted_from_url) of what was typed as a workspace."""
    t = F.trim(F.coalesce(c, F.lit("")))
    is_url = t.contains(HOST) | t.startswith("http://") | t.startswith("https://")
    whole = F.when(t.startswith("http"), t).otherwise(F.concat(F.lit("https://"), t))
    first = F.regexp_extract(whole, r"\A[a-zA-Z]+://[^/?#]*/+([^/?#]+)", 1)
    found = is_url & (first != "")
    return F.struct(F.lower(F.when(found, first).otherwise(F.regexp_replace(t, r"\A/+|/+\z", ""))).alias("slug"), found.alias("extracted_from_url"))


def repository_input(c: Column, default_workspace: str | None = None) -> Column:
    """Struct (valid, workspace, repo_slug, error, suggestion) of ``workspace/repository`` or a bare repository."""
    t = F.trim(F.coalesce(c, F.lit("")))
    parts = F.split(t, "/")
    one, two = F.size(parts) == 1, F.size(parts) == 2
    a, b = F.lower(F.trim(F.get(parts, F.lit(0)))), F.lower(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    error = (
        F.when(t == "", "empty")
        .when(t.contains(","), "comma")
        .when(two & ((a == "") | (b == "")), "empty part")
        .when(one & F.lit(default_workspace is None), "no default workspace")
        .when(~one & ~two, "invalid format")
    )
    ok = error.isNull()
    ws = F.when(two, a).otherwise(F.lit(default_workspace.lower() if default_workspace else None).cast("string"))
    return F.struct(ok.alias("valid"), F.when(ok, ws).alias("workspace"), F.when(ok, F.when(two, b).otherwise(a)).alias("repo_slug"), error.alias("error"), F.when(error == "comma", F.replace(t, F.lit(","), F.lit("."))).alias("suggestion"))
