"""Changed symbols found by line patterns, in line order, each named once a file and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import wide_trim
from .diff import FILE

# fixed values: patterns and stop names
ROUTE = r"(?i)\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch)\s*\(?\"?([^\"\)]*)\"?\)?\]"
CONSTRUCTOR = r"public\s+([A-Z]\w+)\s*\("
CLASS = r"public\s+(?:partial\s+)?(?:class|interface|enum|struct)\s+([A-Z]\w+)"
METHOD = r"public\s+(?:async\s+)?(?:Task<[^>]+>|Task|void|[\w<>]+)\s+([A-Z]\w+)\s*\("
RPC, MESSAGE = r"rpc\s+(\w+)", r"message\s+(\w+)"
NOT_CONSTRUCTORS = ("Task", "void", "string", "int", "bool", "var")
NOT_METHODS = ("Task", "void", "string", "int", "bool", "Guid")


def symbols(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, symbol_ord, kind, name, change, relationship, confidence, line, signature).

    ``files`` has (pr, file_ord, new_path, kind): in a comment-only file every symbol
    is one near a comment. Context lines count as well.
    """
    text = wide_trim(F.col("content"))
    d = lines.join(files.select(*FILE, F.coalesce(F.col("new_path").endswith(".proto"), F.lit(False)).alias("proto"), (F.col("kind") == "comment_only").alias("near")), FILE)
    d = d.select(*FILE, "n", "type", "symbol_line", "proto", "near", text.alias("t"))
    t = F.col("t")
    # one cheap test spares most lines the patterns
    d = d.where(t.contains("public") | t.rlike(r"(?i)\[Http") | (F.col("proto") & (t.contains("rpc") | t.contains("message"))))
    get = lambda p, k=1: F.regexp_extract(t, p, k)
    verb = F.regexp_replace(F.upper(get(ROUTE)), "HTTP", "")
    found = [
        (t.rlike(ROUTE), "route", F.concat(verb, F.lit(" /"), get(ROUTE, 2))),
        (t.rlike(CONSTRUCTOR) & ~get(CONSTRUCTOR).isin(*NOT_CONSTRUCTORS), "constructor", get(CONSTRUCTOR)),
        (t.rlike(CLASS), "class", get(CLASS)),
        (t.rlike(METHOD) & ~get(METHOD).isin(*NOT_METHODS), "method", get(METHOD)),
        (F.col("proto") & t.rlike(RPC), "route", get(RPC)),
        (F.col("proto") & t.rlike(MESSAGE), "schema", get(MESSAGE)),
    ]
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), name.alias("name"))) for i, (c, kind, name) in enumerate(found))))
    d = d.select(*FILE, "n", "type", "symbol_line", "near", "t", F.inline(hits)).where("name <> ''")
    first = d.groupBy(*FILE, "kind", "name").agg(F.min_by(F.struct("n", "rule", "type", "symbol_line", "near", "t"), F.struct("n", "rule")).alias("x"))
    change = F.when(F.col("x.near"), "comment_near_symbol").when(F.col("x.type") == "add", "added_symbol").when(F.col("x.type") == "delete", "deleted_symbol").otherwise("modified_symbol")
    return first.select(
        *FILE, F.struct("x.n", "x.rule").alias("symbol_ord"), "kind", "name", change.alias("change"), F.when(F.col("x.near"), "nearest_symbol").otherwise("changed_symbol").alias("relationship"),
        F.lit(0.95).alias("confidence"), F.col("x.symbol_line").alias("line"), F.nullif(F.col("x.t"), F.lit("")).alias("signature"),
    )
