"""Kind, risk, language and module of changed files: ordered rules, each compiled into one conditional expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, compact_tags, contains_any, ends_with_any, extname, first_filled, first_match, in_order, is_blank, wide_trim
from .diff import FILE

# fixed values: extensions, names, words and texts of the classifiers
LANGUAGES = {".cs": "csharp", ".ts": "typescript", ".js": "javascript", ".py": "python", ".go": "go", ".sql": "sql", ".proto": "protobuf", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown"}
SLASH_COMMENTS = (".cs", ".ts", ".js", ".java", ".go", ".cpp", ".c", ".h", ".swift", ".kt")
HASH_COMMENTS = (".py", ".sh", ".yaml", ".yml", ".rb", ".tf", ".toml", ".ps1")
MARKUP_COMMENTS = (".html", ".xml", ".svg", ".razor")
EVIDENCE = {
    "binary": "Binary file modification",
    "no_lines": "Zero line changes in diff",
    "generated": "Auto-generated code or minified asset detected by filename pattern",
    "documentation": "Documentation file modified",
    "migration": "Database migration script or entity framework migration class modified",
    "blank": "All added and deleted lines contain only whitespace",
    "test_comments": "Only comment changes in test file",
    "comments": "Only comment and whitespace lines changed",
    "test": "Test code modified",
    "proto": "gRPC protocol buffer schema modified",
    "logic": "Functional code modifications present",
}
NO_RISK = "No functional changes in code or configuration"
SENSITIVE_EVIDENCE = "File contains sensitive security configuration"
MODULES = ("Database & Entity Models", "APIs & Controllers", "Services & Business Logic", "gRPC & External Integrations", "Infrastructure & Unit Tests", "Configuration & Environment")


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extname(path)), F.lit("text"))


def is_comment_line(content: Column, ext: Column) -> Column:
    """Whether a line is blank or a comment in the family of the extension."""
    t = wide_trim(content)
    starts = lambda *heads: t.rlike(r"\A(?:" + "|".join(heads) + ")")
    family = first_match(
        [
            (ext.isin(*SLASH_COMMENTS), starts("//", r"/\*", r"\*") | t.endswith("*/")),
            (ext.isin(*HASH_COMMENTS), t.startswith("#")),
            (ext == ".sql", starts("--", "//", r"/\*", r"\*")),
            (ext.isin(*MARKUP_COMMENTS), starts("<!--", "-->")),
        ],
        F.lit(False),
    )
    return (t == "") | family


def is_test_file(path: Column) -> Column:
    return contains_any(path, "/tests/", "\\tests\\", "/test/", "\\test\\") | ends_with_any(basename(path), "Test.cs", "Tests.cs", ".test.ts", ".spec.ts", "_test.go")


def is_generated_file(path: Column) -> Column:
    return ends_with_any(basename(path), ".designer.cs", ".g.cs", ".generated.cs") | contains_any(path, "/generated/", "\\generated\\") | ends_with_any(path, ".min.js", ".min.css")


def file_facts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``files`` with path, all_blank, all_comments and text: added lines, then deleted ones, joined by line feeds."""
    path = F.coalesce(first_filled(F.col("new_path"), F.col("old_path")), F.lit(""))
    changed = lines.where("type in ('add', 'delete')").join(files.select(*FILE, extname(path).alias("ext")), FILE)
    sums = changed.groupBy(*FILE).agg(
        F.bool_and(is_blank(F.col("content"))).alias("all_blank"),
        F.bool_and(is_comment_line(F.col("content"), F.col("ext"))).alias("all_comments"),
        F.array_join(in_order(F.col("content"), (F.col("type") == "delete"), F.col("n")), "\n").alias("text"),
    )
    out = files.join(sums, FILE, "left").withColumn("path", path)
    # no changed line at all: every line is blank, and a comment
    return out.withColumns({"all_blank": F.coalesce("all_blank", F.lit(True)), "all_comments": F.coalesce("all_comments", F.lit(True)), "text": F.coalesce("text", F.lit(""))})


def parsed_facts(parsed: DataFrame) -> DataFrame:
    """``file_facts`` of ``diff.parsed_files``, inside the row: no explode, no shuffle."""
    path = F.coalesce(first_filled(F.col("new_path"), F.col("old_path")), F.lit(""))
    of = lambda role: F.transform(F.filter("lines", lambda x: x["role"] == role), lambda x: F.substring(x["line"], 2, 1 << 30))
    d = parsed.withColumn("path", path).withColumn("changed", F.concat(of("add"), of("delete"))).drop("lines")
    blank, comment = F.forall("changed", is_blank), F.forall("changed", lambda c: is_comment_line(c, extname(F.col("path"))))
    return d.withColumns({"all_blank": blank, "all_comments": comment, "text": F.array_join("changed", "\n")}).drop("changed")


def change_kind(facts: DataFrame) -> Column:
    """Struct (kind, functional_change, confidence, evidence) by the first rule that holds on a row of ``file_facts``."""
    path, ext, base = F.col("path"), extname(F.col("path")), basename(F.col("path"))
    zero = (F.col("additions") == 0) & (F.col("deletions") == 0)
    moved = F.col("status").isin("renamed", "copied")
    manifest = base.isin("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml") | ends_with_any(base, ".csproj", ".props", ".targets")
    locked = base.contains("lock") | (base == "package.json")
    migration = contains_any(path, "/Migrations/", "\\Migrations\\") | contains_any(base, "Add_Table", "Add_Column") | ((ext == ".sql") & contains_any(path, "/migrations/", "/schema/"))
    test = is_test_file(path)

    def says(kind, functional: bool, confidence: float, evidence) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_column(kind).alias("kind"), F.lit(functional).alias("functional_change"), F.lit(confidence).alias("confidence"), F.array(as_column(evidence)).alias("evidence"))

    e = EVIDENCE
    comments = F.col("all_comments")
    return first_match(
        [
            (F.col("is_binary"), says("unknown", True, 0.9, e["binary"])),
            (zero & moved, says("formatting_only", False, 1.0, F.concat(F.lit("File "), F.col("status"), F.lit(" with 0 line changes")))),
            (zero, says("whitespace_only", False, 1.0, e["no_lines"])),
            (is_generated_file(path), says("generated_only", True, 0.95, e["generated"])),
            (ext.isin(".md", ".txt", ".rst") | base.isin("LICENSE", "CHANGELOG.md"), says("documentation_only", False, 1.0, e["documentation"])),
            (manifest, says(F.when(locked, "dependency_change").otherwise("configuration"), True, 0.95, F.concat(F.lit("Project configuration or dependency manifest modified: "), base))),
            (ext.isin(".json", ".yaml", ".yml", ".env", ".config", ".ini"), says("configuration", True, 0.9, F.concat(F.lit("Configuration file modified: "), ext))),
            (migration, says("database_migration", True, 0.95, e["migration"])),
            (F.col("all_blank"), says("whitespace_only", False, 1.0, e["blank"])),
            (comments & test, says("test_only", False, 1.0, e["test_comments"])),
            (comments, says("comment_only", False, 1.0, e["comments"])),
            (test, says("test_only", False, 0.95, e["test"])),
            (ext == ".proto", says("api_contract", True, 0.95, e["proto"])),
        ],
        says("functional_logic", True, 0.85, e["logic"]),
    )


RISK_EVIDENCE = (
    ("public_api", "API endpoint route or gRPC RPC method definition modified"),
    ("public_api", "Public Controller action method signature modified"),
    ("auth_security", "Authentication, authorization, or security sensitive logic modified"),
    ("database_schema", "Database table or column structure altered"),
    ("proto_contract", "gRPC protocol buffer contract file modified"),
    ("secret_config", "Application configuration or secret property modified"),
    ("dependency", "External dependency manifest or lockfile modified"),
    ("concurrency_transaction", "Database transaction or thread concurrency sync primitive modified"),
)


def with_risk(facts: DataFrame, sensitive: Column | None = None) -> DataFrame:
    """``file_facts`` with ``classification`` and now ``risk``, a struct (level, tags, evidence); a sensitive file is high whatever it is.

    The rules are tested once into an array of flags; tags, evidence and level are read off it.
    """
    path, text, ext, base = F.col("path"), F.col("text"), extname(F.col("path")), basename(F.col("path"))
    kind, functional = F.col("classification.kind"), F.col("classification.functional_change")
    has = lambda c, p: c.rlike("(?i)" + p)
    routed = has(text, r"\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\b|rpc\s+\w+\s*\(")
    signature = has(text, r"public\s+async\s+Task<[^>]+>\s+\w+\s*\(|public\s+\w+\s+\w+\s*\([^)]*\)")
    # alternatives of one verb are folded into one pattern, so a text is searched once; the matches are the same
    surface = base.contains("Controller") | (ext == ".proto")
    flags = F.array(
        surface & routed,
        surface & ~routed & signature,
        has(text, r"\[Authorize\b|\[AllowAnonymous\]|jwt|token|bearer|claim|permission|rbac|password|hash|encrypt|secret") | has(path, "jwt|token|bearer|claim|permission|rbac|identity"),
        (kind == "database_migration") | has(text, r"migrationBuilder\.(CreateTable|DropTable|AddColumn|DropColumn|AlterColumn)|(CREATE|ALTER|DROP)\s+TABLE"),
        ext == ".proto",
        (kind == "configuration") | (base == "appsettings.json") | base.endswith(".env") | has(text, "apiKey|ConnectionString|Password|Secret"),
        kind == "dependency_change",
        has(text, r"TransactionScope|BeginTransactionAsync|lock\s*\(|SemaphoreSlim|Monitor\."),
    )
    off = F.array(*(F.lit(False) for _ in RISK_EVIDENCE))
    d = facts.withColumn("_r", F.when(functional, flags).otherwise(off)).withColumn("_s", F.lit(False) if sensitive is None else sensitive)
    r = [F.get("_r", F.lit(i)) for i in range(len(RISK_EVIDENCE))]
    tags = F.array_distinct(compact_tags([(c, name) for c, (name, _) in zip(r, RISK_EVIDENCE)]))
    why = compact_tags([(c, text) for c, (_, text) in zip(r, RISK_EVIDENCE)] + [(~functional, NO_RISK)])
    level = first_match(
        [
            (F.col("_s"), F.lit("high")),
            (~functional, F.lit("none")),
            (r[2] | r[3], F.lit("high")),
            (r[0] | r[1] | r[5] | r[7], F.lit("medium")),
            (r[4] | r[6] | (kind == "functional_logic"), F.lit("low")),
        ],
        F.lit("none"),
    )
    more = lambda c, x: F.concat(c, compact_tags([(F.col("_s"), x)]))
    return d.withColumn("risk", F.struct(level.alias("level"), more(tags, "sensitive_configuration").alias("tags"), more(why, SENSITIVE_EVIDENCE).alias("evidence"))).drop("_r", "_s")


def module_of(path: Column) -> Column:
    """The module of a path by the first rule that holds on it in lower case."""
    p = F.lower(path)
    data, api, services, grpc, infra, config = (F.lit(m) for m in MODULES)
    return first_match(
        [
            (contains_any(p, "context", "entity", "entities", "models", "migration") | p.endswith(".sql"), data),
            (contains_any(p, "controller", "route", "/api/"), api),
            (contains_any(p, "proto", "grpc", "client"), grpc),
            (contains_any(p, "test", "spec", "extension", "util", "helper"), infra),
            (ends_with_any(p, ".json", ".env", ".yml", ".xml") | p.contains("config"), config),
            (contains_any(p, "service", "usecase", "domain") | ends_with_any(p, ".cs", ".ts", ".go"), services),
        ],
        infra,
    )
