"""Identifiers, hashes and stable JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import file_id


def repository_id(workspace: Column, repo: Column, salt: str) -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.sha2(F.concat(F.lower(workspace), F.lit("/"), F.lower(repo), F.lit(f":{salt}")), 256), 1, 8))


def hashed_revision_id(source: Column, target: Column, version: str = "3.0") -> Column:
    return F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat(source, F.lit(":"), target, F.lit(f":{version}")), 256), 1, 12))


def revision_id(source: Column, target: Column) -> Column:
    """``rev_`` and seven characters of either hash; for display, as full hashes tell revisions apart."""
    return F.concat(F.lit("rev_"), F.substring(source, 1, 7), F.lit("_"), F.substring(target, 1, 7))


def cache_key(workspace: Column, repo: Column, pr: Column, source: Column, target: Column, rules_json: str = "{}") -> Column:
    rules = F.substring(F.md5(F.lit(rules_json).cast("binary")), 1, 8)
    return F.concat_ws(":", F.lit("bitbucket"), F.lower(workspace), F.lower(repo), pr.cast("string"), source, target, F.lit("v2"), rules)


def scope_key(user: Column, workspace: Column, repo: Column) -> Column:
    from .sanitize import normalize_uuid

    return F.concat_ws(":", normalize_uuid(user), F.lower(F.trim(workspace)), F.lower(F.trim(repo)))


def coerced_file_id(c: Column, keep_zeros: bool = False) -> Column:
    """Digits become ``file_NNNN``; leading zeros are dropped first unless ``keep_zeros``."""
    text = c.cast("string")
    digits = text if keep_zeros else F.regexp_replace(text, r"\A0+(?=\d)", "")
    return F.when(text.rlike(r"\A\d+\z"), file_id(digits)).otherwise(text)


def sorted_struct(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of every struct in name order and the entries of every map in key order, decided from the type."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(sorted_struct(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_struct(x, kind.elementType))
    if isinstance(kind, T.MapType):
        # by key alone: keys are unique and can be ordered, values may hold maps
        by_key = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
        entries = F.array_sort(F.map_entries(c), by_key)
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], sorted_struct(e["value"], kind.valueType))))
    return c


def stable_json(df: DataFrame, drop: tuple[str, ...] = ("generated_at",)) -> Column:
    """JSON of a row of ``df`` with sorted keys, without the volatile top-level columns."""
    fields = sorted((f for f in df.schema.fields if f.name not in drop), key=lambda f: f.name)
    return F.to_json(F.struct(*(sorted_struct(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def content_hash(df: DataFrame) -> Column:
    return F.sha2(stable_json(df), 256)
