"""Diffs that reach every rule of the parser, the classifiers and the symbol patterns, one by document.

A document takes the case of its id modulo the number of cases, with # as its id. What is
expected of each file and symbol is written beside the case, by the rule tables, and is
the SQL counterpart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .operators import classify, diff
from .operators import symbols as symbol_ops
from .registering import query, read

NO_RISK = (classify.NO_RISK,)
E = classify.EVIDENCE
API, SIGNATURE, AUTH, DATABASE, PROTO, SECRET, DEPENDENCY, LOCKS = (text for _, text in classify.RISK_EVIDENCE)


@dataclass
class File:
    """A file as it should be read: paths, status, whether binary, lines; kind, functional, confidence, why; level, tags, why; language."""

    old: str | None
    new: str
    status: str
    binary: bool
    added: int
    deleted: int
    kind: str
    functional: bool
    confidence: float
    evidence: str
    level: str
    tags: tuple[str, ...]
    risk: tuple[str, ...]
    language: str
    #: kind, name, change, line
    symbols: list[tuple[str, str, str, int]] = field(default_factory=list)


def _edit(path: str, *lines: str, at: str = "@@ -1,9 +1,9 @@") -> str:
    return "\n".join([f"diff --git a/{path} b/{path}", "index 1..2 100644", f"--- a/{path}", f"+++ b/{path}", at, *lines])


def _quiet(path: str, added: int, deleted: int, kind: str, confidence: float, evidence: str, language: str, **more) -> File:
    """A modified file that carries no risk because nothing functional changed."""
    return File(path, path, "modified", False, added, deleted, kind, False, confidence, evidence, "none", (), NO_RISK, language, **more)


LOGIC = ("functional_logic", True, 0.85, E["logic"])

#: The raw diff of each case, and its files.
CASES: list[tuple[str | None, list[File]]] = [
    (
        "a line before the first file\n" + _edit("src/Run#.cs", " using X;", "-int a = 1;", "+int a = 2;", "+int b = 3;", " end", "@@ -10 +11,2 @@ class", "+public class Tail#", " rest") + "\ndiff --git a/old#.txt b/new#.ts\nsimilarity index 100%\nrename from old#.txt\nrename to new#.ts",
        [
            File("src/Run#.cs", "src/Run#.cs", "modified", False, 3, 1, *LOGIC, "low", (), (), "csharp", [("class", "Tail#", "added_symbol", 11)]),
            File("old#.txt", "new#.ts", "renamed", False, 0, 0, "formatting_only", False, 1.0, "File renamed with 0 line changes", "none", (), NO_RISK, "typescript"),
        ],
    ),
    ("diff --git a/img#.png b/img#.png\nindex 1..2\nBinary files a/img#.png and b/img#.png differ", [File("img#.png", "img#.png", "binary", True, 0, 0, "unknown", True, 0.9, E["binary"], "none", (), (), "text")]),
    (
        "diff --git a/db/migrations/m#.sql b/db/migrations/m#.sql\ndeleted file mode 100644\n--- a/db/migrations/m#.sql\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-CREATE TABLE t (id int);\n-SELECT 1;",
        [File("db/migrations/m#.sql", "db/migrations/m#.sql", "deleted", False, 0, 2, "database_migration", True, 0.95, E["migration"], "high", ("database_schema",), (DATABASE,), "sql")],
    ),
    ("diff --git a/src/a#.go b/src/a#.go\nold mode 100644\nnew mode 100755", [_quiet("src/a#.go", 0, 0, "whitespace_only", 1.0, E["no_lines"], "go")]),
    (_edit("out/x#.min.js", "+x=1"), [File("out/x#.min.js", "out/x#.min.js", "modified", False, 1, 0, "generated_only", True, 0.95, E["generated"], "none", (), (), "javascript")]),
    ('diff --git "a/docs/a b#.md" "b/docs/a b#.md"\nindex 1..2\n--- "a/docs/a b#.md"\n+++ "b/docs/a b#.md"\n@@ -1 +1 @@\n-x\n+y', [File('"a/docs/a b#.md"', '"b/docs/a b#.md"', "modified", False, 1, 1, *LOGIC, "low", (), (), "text")]),
    (_edit("docs/n#.md", "-x", "+public class No#"), [_quiet("docs/n#.md", 1, 1, "documentation_only", 1.0, E["documentation"], "markdown", symbols=[("class", "No#", "added_symbol", 1)])]),
    (
        _edit("p#/package.json", '+"x": "1"') + "\n" + _edit("App#.csproj", "+<Item/>"),
        [
            File("p#/package.json", "p#/package.json", "modified", False, 1, 0, "dependency_change", True, 0.95, "Project configuration or dependency manifest modified: package.json", "low", ("dependency",), (DEPENDENCY,), "json"),
            File("App#.csproj", "App#.csproj", "modified", False, 1, 0, "configuration", True, 0.95, "Project configuration or dependency manifest modified: App#.csproj", "medium", ("secret_config",), (SECRET,), "text"),
        ],
    ),
    (_edit("conf#.yaml", "+a: 1"), [File("conf#.yaml", "conf#.yaml", "modified", False, 1, 0, "configuration", True, 0.9, "Configuration file modified: .yaml", "medium", ("secret_config",), (SECRET,), "yaml")]),
    (_edit("src/b#.py", "+   ", "-", " x"), [_quiet("src/b#.py", 1, 1, "whitespace_only", 1.0, E["blank"], "python")]),
    (_edit("src/c#.cs", "+// public class Foo#", "-/* x", "- * y */"), [_quiet("src/c#.cs", 1, 2, "comment_only", 1.0, E["comments"], "csharp", symbols=[("class", "Foo#", "comment_near_symbol", 1)])]),
    (_edit("src/d#.py", "+# one", "-x = 1"), [File("src/d#.py", "src/d#.py", "modified", False, 1, 1, *LOGIC, "low", (), (), "python")]),
    (_edit("src/tests/d#.ts", "+// one", "+"), [_quiet("src/tests/d#.ts", 2, 0, "test_only", 1.0, E["test_comments"], "typescript")]),
    (_edit("src/e#.spec.ts", "+expect(1)"), [_quiet("src/e#.spec.ts", 1, 0, "test_only", 0.95, E["test"], "typescript")]),
    (
        _edit("api/s#.proto", "+rpc Get#(A) returns (B);", "+message M# {"),
        [File("api/s#.proto", "api/s#.proto", "modified", False, 2, 0, "api_contract", True, 0.95, E["proto"], "medium", ("public_api", "proto_contract"), (API, PROTO), "protobuf", [("route", "Get#", "added_symbol", 1), ("schema", "M#", "added_symbol", 2)])],
    ),
    (
        _edit("src/PayController.cs", '+[HttpGet("a/#")]', "+[Authorize]", "+lock (x) {", at="@@ -5,2 +7,5 @@"),
        [File("src/PayController.cs", "src/PayController.cs", "modified", False, 3, 0, *LOGIC, "high", ("public_api", "auth_security", "concurrency_transaction"), (API, AUTH, LOCKS), "csharp", [("route", "GET /a/#", "added_symbol", 7)])],
    ),
    (
        _edit("src/ListController.cs", "-public int Count#(int x)", " public void Keep#(int y)", "+public Void#(", "+public Task(", at="@@ -3,2 +3,3 @@"),
        [File("src/ListController.cs", "src/ListController.cs", "modified", False, 2, 1, *LOGIC, "medium", ("public_api",), (SIGNATURE,), "csharp", [("method", "Count#", "deleted_symbol", 3), ("method", "Keep#", "modified_symbol", 3), ("constructor", "Void#", "added_symbol", 4)])],
    ),
    (_edit("src/opt#.js", "+const apiKey = 1"), [File("src/opt#.js", "src/opt#.js", "modified", False, 1, 0, *LOGIC, "medium", ("secret_config",), (SECRET,), "javascript")]),
    (_edit("src/identity/o#.js", "+x"), [File("src/identity/o#.js", "src/identity/o#.js", "modified", False, 1, 0, *LOGIC, "high", ("auth_security",), (AUTH,), "javascript")]),
    (
        "diff --git a/lib/u#.kt b/lib/v#.kt\nsimilarity index 90%\nrename from lib/u#.kt\nrename to lib/v#.kt\n--- a/lib/u#.kt\n+++ b/lib/v#.kt\n@@ -2,2 +2,2 @@\n-a\n+b\n\\ No newline at end of file",
        [File("lib/u#.kt", "lib/v#.kt", "renamed", False, 1, 1, *LOGIC, "low", (), (), "text")],
    ),
    (
        "diff --git a/src/n#.ts b/src/n#.ts\n--- /dev/null\n+++ b/src/n#.ts\n@@ -0,0 +1,2 @@\n+a\n@@ bad @@\n+public enum E#",
        [File(None, "src/n#.ts", "added", False, 2, 0, *LOGIC, "low", (), (), "typescript", [("class", "E#", "added_symbol", 2)])],
    ),
    ("diff --git a/k#.h b/j#.h\ncopy from k#.h\ncopy to j#.h", [File("k#.h", "j#.h", "copied", False, 0, 0, "formatting_only", False, 1.0, "File copied with 0 line changes", "none", (), NO_RISK, "text")]),
    ("", []),
    ("no file here", []),
    (None, []),
]


def cases(spark, d):
    """(pr, raw_diff): every document's case."""
    at = (F.col("doc_id") % len(CASES) + 1).cast("int")
    text = F.element_at(F.array(*(F.lit(raw).cast("string") for raw, _ in CASES)), at)
    return read(spark, d, "documents").select(F.col("doc_id").alias("pr"), F.replace(text, F.lit("#"), F.col("doc_id").cast("string")).alias("raw_diff"))


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "replace('" + value.replace("'", "''") + "', '#', cast(doc_id as varchar))"
    return f"cast({value} as double)" if isinstance(value, float) else str(value).lower() if isinstance(value, bool) else f"cast({value} as bigint)"


def _expected(rows: list[tuple[int, dict]]) -> str:
    return " union all ".join("select doc_id as pr, " + ", ".join(f"{_sql(v)} as {k}" for k, v in row.items()) + f" from documents where doc_id % {len(CASES)} = {at}" for at, row in rows)


def _each():
    for at, (_, files) in enumerate(CASES):
        for n, file in enumerate(files, 1):
            yield at, n, file


@query(_expected([(at, {"file_ord": n, "old_path": f.old, "new_path": f.new, "status": f.status, "is_binary": f.binary, "additions": f.added, "deletions": f.deleted}) for at, n, f in _each()]))
def rule_files(spark, d):
    """Files of diffs with several files and hunks, renames, copies, deletions, binaries and malformed headers."""
    return diff.parsed_files(cases(spark, d)).select("pr", F.col("file_ord").cast("long").alias("file_ord"), "old_path", "new_path", "status", "is_binary", "additions", "deletions")


@query(_expected([(at, {"file_ord": n, "kind": f.kind, "functional_change": f.functional, "confidence": f.confidence, "evidence": f.evidence, "level": f.level, "tags": ",".join(f.tags), "risk_evidence": "|".join(f.risk), "language": f.language}) for at, n, f in _each()]))
def rule_kinds(spark, d):
    """Every rule of change kinds and of risk."""
    facts = classify.parsed_facts(diff.parsed_files(cases(spark, d)))
    facts = classify.with_risk(facts.withColumn("classification", classify.change_kind(facts)))
    c = F.col("classification")
    return facts.select("pr", F.col("file_ord").cast("long").alias("file_ord"), c["kind"].alias("kind"), c["functional_change"].alias("functional_change"), c["confidence"].cast("double").alias("confidence"), F.array_join(c["evidence"], "|").alias("evidence"), "risk.level", F.array_join("risk.tags", ",").alias("tags"), F.array_join("risk.evidence", "|").alias("risk_evidence"), classify.language(F.col("path")).alias("language"))


@query(_expected([(at, {"file_ord": n, "kind": kind, "name": name, "change": change, "line": line}) for at, n, f in _each() for kind, name, change, line in f.symbols]))
def rule_symbols(spark, d):
    """Every symbol pattern, on added, deleted, unchanged and commented lines."""
    marked = diff.marked_lines(cases(spark, d))
    files, lines = diff.diff_files(marked), diff.diff_lines(marked)
    facts = classify.file_facts(files, lines)
    kinds = files.join(facts.select(*diff.FILE, classify.change_kind(facts)["kind"].alias("kind")), diff.FILE)
    found = symbol_ops.symbols(lines, kinds)
    return found.select("pr", F.col("file_ord").cast("long").alias("file_ord"), "kind", "name", "change", F.col("line").cast("long").alias("line"))
