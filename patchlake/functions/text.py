"""Text and path primitives as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, for use inside a character class.
WIDE_SPACE = r"\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def wide_trim(c: Column) -> Column:
    """Both ends without any Unicode white space (Spark's trim removes spaces only)."""
    return F.regexp_replace(c, rf"\A[{WIDE_SPACE}]+|[{WIDE_SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"\A[{WIDE_SPACE}]*\z")


def filled(c: Column) -> Column:
    """The value, with an empty string as null."""
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*(filled(c) for c in cs))


def basename(path: Column) -> Column:
    """The last non-empty segment; trailing slashes do not count."""
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extname(path: Column) -> Column:
    """From the last dot of the basename, lower-cased; empty for a name that only begins with a dot."""
    name = basename(path)
    tail = F.regexp_extract(name, r"\A.+(\.[^.]*)\z", 1)
    return F.when(name == "..", F.lit("")).otherwise(F.lower(tail))


def file_id(ordinal: Column) -> Column:
    """``file_0001`` from 1 on; numbers beyond four digits are kept whole."""
    digits = ordinal.cast("string")
    return F.concat(F.lit("file_"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def ends_with_any(c: Column, *tails: str) -> Column:
    out = F.lit(False)
    for t in tails:
        out = out | c.endswith(t)
    return out


def contains_any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value beside the first condition that holds: an ordered rule table as one CASE."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return otherwise if out is None else out.otherwise(otherwise)


def compact_tags(rules: list[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in rule order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in rules)))


def in_order(value: Column, *order: Column) -> Column:
    """Aggregate: values collected in the order of the keys."""
    packed = F.array_sort(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.transform(packed, lambda x: x["v"])
