"""Registered queries over the driver's tables and their SQL counterparts.

The tables hold no change sets, so adapter views give them the shape: an order is a
change set and its line items are changed files; a source is a change set whose files
are its documents, as raw diffs; users' events are revisions and progress events;
pages give urls and markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids, sanitize, text, urls
from .operators import classify, diff, discovery, gate, manifest, payload, progress, reading, registry, render, search
from .operators import symbols as symbol_ops
from .registering import ORACLE, QUERIES, query, read

__all__ = ["ORACLE", "QUERIES"]

NOW = "2024-06-01 00:00:00"


# --- adapter views -----------------------------------------------------------------

#: Kind, tags and level of a file by return flag and line status.
KINDS = {"AF": "functional_logic", "AO": "configuration", "NF": "test_only", "NO": "comment_only", "RF": "database_migration", "RO": "documentation_only"}
TAGS = {"AF": "public_api", "AO": "secret_config", "RF": "database_schema"}
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

FILES_SQL = """
f as (
  select l_orderkey as pr, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as ord,
    cast(l_quantity as bigint) as additions, cast(l_tax * 100 as bigint) as deletions, l_returnflag || l_linestatus as k,
    'src/' || l_returnflag || '/mod' || (l_suppkey % 10) || '/part' || (l_partkey % 100) || '.ts' as path
  from lineitem
), idx as (
  select pr, ord, additions, deletions, path, 'file_' || lpad(cast(ord as varchar), cast(greatest(4, length(cast(ord as varchar))) as integer), '0') as id,
    case k when 'AF' then 'functional_logic' when 'AO' then 'configuration' when 'NF' then 'test_only' when 'NO' then 'comment_only' when 'RF' then 'database_migration' when 'RO' then 'documentation_only' else 'unknown' end as change_kind,
    case k when 'AF' then 'public_api' when 'AO' then 'secret_config' when 'RF' then 'database_schema' end as tag,
    case k when 'RF' then 'high' when 'AF' then 'medium' when 'AO' then 'medium' else 'none' end as risk_level
  from f
)"""


def file_view(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a file index: pr, ord, id, path, language, status, additions, deletions, change_kind, risk_tags, risk_level, detail_ref."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    k = F.concat("l_returnflag", "l_linestatus")
    named = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), k)
    rows = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pr"), F.row_number().over(w).cast("long").alias("ord"), F.col("l_quantity").cast("long").alias("additions"), F.round(F.col("l_tax") * 100).cast("long").alias("deletions"), k.alias("k"),
        F.concat(F.lit("src/"), "l_returnflag", F.lit("/mod"), (F.col("l_suppkey") % 10).cast("string"), F.lit("/part"), (F.col("l_partkey") % 100).cast("string"), F.lit(".ts")).alias("path"),
        F.coalesce(named(KINDS), F.lit("unknown")).alias("change_kind"), F.array_compact(F.array(named(TAGS))).alias("risk_tags"),
        F.when(k == "RF", "high").when(k.isin("AF", "AO"), "medium").otherwise("none").alias("risk_level"),
    )
    fid = text.file_id(F.col("ord"))
    return rows.select("pr", "ord", fid.alias("id"), "path", F.lit(None).cast("string").alias("old_path"), classify.language(F.col("path")).alias("language"), F.lit("modified").alias("status"), "additions", "deletions", "change_kind", "risk_tags", "risk_level", F.concat(F.lit("files/"), fid, F.lit("/change.json")).alias("detail_ref"))


def raw_diff_view(spark: SparkSession, d: str) -> DataFrame:
    """One raw diff a document: its lines as added lines of one new file; the change set is the document."""
    name = F.concat(F.lit("docs/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    n = F.size(F.split("text", "\n", -1)).cast("string")
    raw = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1,"), n, F.lit(" @@\n"), body)
    return read(spark, d, "documents").select(F.col("doc_id").alias("pr"), raw.alias("raw_diff"), "source")


# --- diffs ---------------------------------------------------------------------------


@query("""select doc_id as pr, 'docs/' || source || '/doc' || doc_id || '.md' as path, 'added' as status,
  cast(len(string_split(text, chr(10))) as bigint) as additions, cast(0 as bigint) as deletions from documents""")
def diff_file_stats(spark, d):
    """Per-file counts of parsed raw diffs."""
    files = diff.parsed_files(raw_diff_view(spark, d))
    return files.select("pr", diff.file_path(files).alias("path"), "status", "additions", "deletions")


@query("""select doc_id as pr, cast(i as bigint) as new_line, string_split(text, chr(10))[i] as content
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)""")
def diff_line_numbers(spark, d):
    """Line numbers in hunks."""
    return diff.diff_lines(diff.marked_lines(raw_diff_view(spark, d))).select("pr", F.col("new_line").cast("long").alias("new_line"), "content")


@query("""select doc_id as pr, 'documentation_only' as kind, false as functional_change, cast(1.0 as double) as confidence, 'none' as level, 'markdown' as language from documents""")
def change_kinds(spark, d):
    """Kind, risk and language of every parsed file."""
    facts = classify.parsed_facts(diff.parsed_files(raw_diff_view(spark, d)))
    facts = classify.with_risk(facts.withColumn("classification", classify.change_kind(facts)))
    return facts.select("pr", "classification.kind", "classification.functional_change", F.col("classification.confidence").cast("double").alias("confidence"), "risk.level", classify.language(F.col("path")).alias("language"))


def _lines_view(spark, d):
    """Documents as source files named by their first word, of one class each: every line of the text is a method named by the line's first word, with the line as its comment."""
    code = lambda t, word: F.when(word == "", F.concat(F.lit("// "), t)).otherwise(F.concat(F.lit("public void "), F.initcap(word), F.lit("(int x) // "), t))
    lines = F.transform(F.split("text", "\n", -1), lambda t: code(t, F.regexp_extract(F.lower(t), "[a-z]{3,}", 0)))
    body = F.concat(F.lit("\n+public class Doc {\n+"), F.array_join(lines, "\n+"))
    name = F.concat(F.lit("src/"), F.initcap(F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0)), F.lit("Controller.cs"))
    raw = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1,"), (F.size(lines) + 1).cast("string"), F.lit(" @@"), body)
    return read(spark, d, "documents").select(F.col("doc_id").alias("pr"), raw.alias("raw_diff"))


#: The lines of all documents with the first word of each.
WORD_SQL = """with l as (select doc_id as pr, unnest(string_split(text, chr(10))) as t, unnest(range(2, len(string_split(text, chr(10))) + 2)) as line from documents),
  w as (select pr, t, line, regexp_extract(lower(t), '[a-z]{3,}') as r from l)"""


@query(WORD_SQL + """ select doc_id as pr, 'class' as kind, 'Doc' as name, 'added_symbol' as change, cast(1 as bigint) as line from documents where text is not null
  union all select pr, 'method', upper(r[1]) || r[2:], 'added_symbol', min(line) from w where r not in ('', 'task', 'guid') group by pr, r""")
def diff_symbols(spark, d):
    """Symbols of changed lines, from the whole text of every document."""
    marked = diff.marked_lines(_lines_view(spark, d))
    files = diff.diff_files(marked).withColumn("kind", F.lit("functional_logic"))
    return symbol_ops.symbols(diff.diff_lines(marked), files).select("pr", "kind", "name", "change", F.col("line").cast("long").alias("line"))


@query(WORD_SQL + r""", c as (
  select pr, 'public class Doc {' || chr(10) || string_agg(case when r = '' then '// ' || t else 'public void ' || upper(r[1]) || r[2:] || '(int x) // ' || t end, chr(10) order by line) as code, coalesce(arg_min(r, line) filter (r <> ''), '') as word from w group by pr
), r as (
  select pr, regexp_matches(code, '(?i)\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\b|rpc\s+\w+\s*\(') as route, regexp_matches(code, '(?i)public\s+async\s+Task<[^>]+>\s+\w+\s*\(|public\s+\w+\s+\w+\s*\([^)]*\)') as signature,
    regexp_matches(code, '(?i)\[Authorize\b|\[AllowAnonymous\]|jwt|token|bearer|claim|permission|rbac|password|hash|encrypt|secret') or regexp_matches(word, 'jwt|token|bearer|claim|permission|rbac|identity') as auth,
    regexp_matches(code, '(?i)migrationBuilder\.(CreateTable|DropTable|AddColumn|DropColumn|AlterColumn)|(CREATE|ALTER|DROP)\s+TABLE') as tables,
    regexp_matches(code, '(?i)apiKey|ConnectionString|Password|Secret') as config, regexp_matches(code, '(?i)TransactionScope|BeginTransactionAsync|lock\s*\(|SemaphoreSlim|Monitor\.') as locks from c
)
select pr, 'functional_logic' as kind, case when auth or tables then 'high' when route or signature or config or locks then 'medium' else 'low' end as level,
  concat_ws(',', case when route or signature then 'public_api' end, case when auth then 'auth_security' end, case when tables then 'database_schema' end, case when config then 'secret_config' end, case when locks then 'concurrency_transaction' end) as tags,
  concat_ws('|', 'Functional code modifications present', case when route then 'API endpoint route or gRPC RPC method definition modified' when signature then 'Public Controller action method signature modified' end,
    case when auth then 'Authentication, authorization, or security sensitive logic modified' end, case when tables then 'Database table or column structure altered' end,
    case when config then 'Application configuration or secret property modified' end, case when locks then 'Database transaction or thread concurrency sync primitive modified' end) as evidence from r""")
def code_risk(spark, d):
    """Kind and risk of code made from the whole text of every document."""
    facts = classify.parsed_facts(diff.parsed_files(_lines_view(spark, d)))
    facts = classify.with_risk(facts.withColumn("classification", classify.change_kind(facts)))
    return facts.select("pr", "classification.kind", "risk.level", F.array_join("risk.tags", ",").alias("tags"), F.concat_ws("|", "classification.evidence", "risk.evidence").alias("evidence"))


# --- roll-ups ------------------------------------------------------------------------


@query(f"with {FILES_SQL} select pr, ord, id, path, change_kind, additions, deletions from idx")
def file_index(spark, d):
    """File ids and index rows."""
    return file_view(spark, d).select("pr", "ord", "id", "path", "change_kind", "additions", "deletions")


@query(f"with {FILES_SQL} select pr, change_kind, count(*) as n, min(ord) as first_ord from idx group by pr, change_kind")
def kind_counts(spark, d):
    """A03."""
    return manifest.kind_counts(file_view(spark, d))


ROLLUP_SQL = f"""with {FILES_SQL}, kc as (select pr, change_kind, count(*) as n, min(ord) as first_ord from idx group by pr, change_kind),
pk as (select pr, change_kind as primary_kind from (select *, row_number() over (partition by pr order by n desc, first_ord) as r from kc) where r = 1),
tg as (select pr, tag, min(ord) as o from idx where tag is not null group by pr, tag),
ts as (select pr, string_agg(tag, ',' order by o) as tags, bool_or(tag = 'database_schema') as db, bool_or(tag in ('public_api', 'secret_config')) as mid from tg group by pr),
su as (select pr, count(*) as total_files, cast(sum(additions) as bigint) as total_additions, cast(sum(deletions) as bigint) as total_deletions,
  cast(count(*) filter (risk_level = 'high') as bigint) as risky_files_count, coalesce(string_agg(id, ',' order by ord) filter (risk_level = 'high'), '') as important_file_ids from idx group by pr),
r as (select su.*, primary_kind, coalesce(tags, '') as total_risk_tags, case when db then 'high' when mid then 'medium' when tags is not null then 'low' else 'none' end as overall_level from su join pk using (pr) left join ts using (pr))"""


@query(ROLLUP_SQL + " select pr, total_files, total_additions, total_deletions, risky_files_count, important_file_ids, primary_kind, total_risk_tags, overall_level from r")
def manifest_rollup(spark, d):
    """One manifest summary a change set."""
    r = manifest.rollup(file_view(spark, d))
    return r.select("pr", "total_files", "total_additions", "total_deletions", "risky_files_count", F.array_join("important_file_ids", ",").alias("important_file_ids"), "primary_kind", F.array_join("total_risk_tags", ",").alias("total_risk_tags"), "overall_level")


RANK_SQL = f"""with {FILES_SQL}, p as (select *, (case when tag = 'public_api' then 100 when tag is not null then 80 else 10 end) + additions + deletions as weight from idx),
q as (select *, row_number() over (partition by pr order by weight desc, ord) as rank from p)"""


@query(RANK_SQL + " select pr, id, cast(weight as bigint) as weight, cast(rank as bigint) as rank from q where rank <= 5")
def priority_topk(spark, d):
    """O01, O02."""
    return reading.priority(file_view(spark, d)).where("rank <= 5").select("pr", "id", "weight", F.col("rank").cast("long").alias("rank"))


@query(ROLLUP_SQL + """, p as (select *, (case when tag = 'public_api' then 100 when tag is not null then 80 else 10 end) + additions + deletions as weight from idx),
q as (select *, row_number() over (partition by pr order by weight desc, ord) as rank, row_number() over (partition by pr, tag is not null order by weight desc, ord) as rr from p),
l as (select pr, list('files/' || id || '.md' order by rank) as al, list('files/' || id || '.md' order by rank) filter (tag is not null and rr <= 3) as ri from q group by pr),
m as (select r.*, al, case when ri is null then al[1:3] else ri end as ins, overall_level = 'high' or total_files > 30 as deep, total_risk_tags <> '' as tagged,
  total_files <= 3 and overall_level in ('none', 'low') and primary_kind in ('comment_only', 'documentation_only', 'test_only') and total_risk_tags = '' as skim from r join l using (pr))
select pr, case when skim then 'skim' when deep then 'deep_review' when tagged or risky_files_count > 0 or total_files > 10 then 'inspect_priority_files' else 'standard' end as mode,
  case when skim then primary_kind || ', risk ' || overall_level || ', ' || total_files || ' file(s) changed' when deep then 'High risk (' || overall_level || ') or large file count (' || total_files || ' files)'
    when tagged or risky_files_count > 0 or total_files > 10 then concat_ws('; ', case when tagged then 'risk tags: ' || replace(total_risk_tags, ',', ', ') end, case when risky_files_count > 0 then risky_files_count || ' risky file(s)' end, case when total_files > 10 then total_files || ' files changed' end)
    else 'Standard changes in ' || total_files || ' file(s), primary kind: ' || primary_kind end as reason,
  array_to_string(case when skim then [] when deep then al[1:5] when tagged or total_files > 10 then ins else al[1:2] end, ',') as required,
  array_to_string(case when skim then al[1:1] when deep then al[6:10] when tagged or total_files > 10 then list_filter(al, lambda x: not list_contains(ins, x))[1:5] else al[3:5] end, ',') as optional,
  case when skim then 'small' when deep then 'extensive' when tagged or risky_files_count > 0 or total_files > 10 then 'large' else 'medium' end as token_budget from m""")
def reading_mode(spark, d):
    """Reading mode, reason and files to read."""
    index = file_view(spark, d)
    m = reading.reading_modes(manifest.rollup(index), index)
    return m.select("pr", "mode", "reason", F.array_join("required_next_files", ",").alias("required"), F.array_join("optional_next_files", ",").alias("optional"), "token_budget")


@query(f"""with {FILES_SQL}, m as (select * from idx where lower(path) like '%mod3%' and tag = 'secret_config'), t as (select *, count(*) over (partition by pr) as total, row_number() over (partition by pr order by ord) as rn from m)
select pr, id, path, total from t where rn <= 2""")
def search_files(spark, d):
    """F01, O04."""
    return search.search_files(file_view(spark, d), path="MOD3", language="TypeScript", risk_tag="secret_config", limit=2).select("pr", "id", "path", "total")


@query("""select o_orderkey as id from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def existing_prs(spark, d):
    """Semi-join."""
    done = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return discovery.with_revision(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), done)


@query("""select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def skipped_prs(spark, d):
    """anti-join."""
    done = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return discovery.without_revision(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), done)


def _stats_and_files(spark, d):
    f = file_view(spark, d)
    stats = f.select("pr", "ord", F.lit("modified").alias("status"), F.col("additions").alias("lines_added"), F.col("deletions").alias("lines_removed"), F.lit(None).cast("string").alias("old_path"), F.col("path").alias("new_path"))
    parsed = f.where("ord % 2 = 1").select("pr", F.col("ord").alias("file_ord"), F.when(F.col("ord") % 3 == 0, F.col("path")).otherwise(F.lit("x")).alias("old_path"), F.when(F.col("ord") % 3 == 0, F.lit("y")).otherwise(F.col("path")).alias("new_path"), F.lit("modified").alias("status"), F.lit(False).alias("is_binary"), "additions", "deletions", F.array(F.col("path")).alias("header_lines"))
    return stats, parsed


@query(f"""with {FILES_SQL} select a.pr, a.ord, (select min(b.ord) from idx b where b.pr = a.pr and b.ord % 2 = 1 and b.path = a.path) as file_ord from idx a""")
def diffstat_join(spark, d):
    """First parsed file on new or old path."""
    return manifest.match_files(*_stats_and_files(spark, d)).select("pr", "ord", "file_ord")


# --- gate ----------------------------------------------------------------------------


@query("""select l_orderkey as pr, cast(l_linenumber as varchar) as subject, 'seen ' || count(*) || ' times' as detail from lineitem group by l_orderkey, l_linenumber having count(*) > 1""")
def dup_ids(spark, d):
    """V04, A11."""
    index = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_linenumber").cast("string").alias("id"))
    return gate.duplicate_ids(index).select("pr", "subject", "detail")


@query(f"""with {FILES_SQL}, t as (select pr, count(*) as files, cast(sum(additions) as bigint) as adds from idx group by pr), told as (select pr, files + (case when pr % 7 = 0 then 1 else 0 end) as tf, adds + (case when pr % 5 = 0 then 2 else 0 end) as ta, files, adds from t)
select pr, 'totals' as rule, 'error' as severity, 'total_files' as subject, tf || ' <> ' || files as detail from told where tf <> files
union all select pr, 'totals', 'error', 'total_additions', ta || ' <> ' || adds from told where ta <> adds
union all select pr, 'important_file_id', 'error', 'file_9999', 'not in the index' from t where pr % 11 = 0""")
def gate_violations(spark, d):
    """Totals and important ids against the index."""
    index = file_view(spark, d)
    told = manifest.rollup(index).withColumns({"total_files": F.col("total_files") + (F.col("pr") % 7 == 0).cast("long"), "total_additions": F.col("total_additions") + F.when(F.col("pr") % 5 == 0, 2).otherwise(0), "important_file_ids": F.when(F.col("pr") % 11 == 0, F.array(F.lit("file_9999"))).otherwise(F.col("important_file_ids"))})
    return gate.totals(told, index).unionByName(gate.important_ids(told, index))


@query(f"""with {FILES_SQL}, kc as (select pr, change_kind, count(*) as n from idx group by pr, change_kind) select pr, change_kind as subject, (n + 1) || ' <> ' || n as detail from kc where pr % 3 = 0""")
def kind_count_warnings(spark, d):
    """V09, A09."""
    index = file_view(spark, d)
    told = manifest.rollup(index).withColumn("kind_counts", F.when(F.col("pr") % 3 == 0, F.transform("kind_counts", lambda x: F.struct(x["change_kind"].alias("change_kind"), (x["n"] + 1).alias("n")))).otherwise(F.col("kind_counts")))
    return gate.kind_mismatch(told, index).select("pr", "subject", "detail")


@query(f"""with {FILES_SQL} select pr, 'missing_detail' as rule, id as subject, 'files/' || id || '/change.json' as detail from idx where ord = 3
union all select pr, 'path_traversal', id, '../patch.diff' from idx where ord = 4 union all select pr, 'orphan', 'file_8888', 'not in the index' from idx where ord = 5""")
def gate_references(spark, d):
    """References and orphans."""
    index = file_view(spark, d)
    details = index.where("ord <> 3").select("pr", F.col("detail_ref").alias("ref"), F.when(F.col("ord") == 4, "../patch.diff").otherwise("patch.diff").alias("patch_ref"), F.col("id").alias("folder"))
    extra = index.where("ord = 5").select("pr", F.lit("files/file_8888/change.json").alias("ref"), F.lit("patch.diff").alias("patch_ref"), F.lit("file_8888").alias("folder"))
    patches = index.select("pr", F.concat(F.lit("files/"), "id", F.lit("/patch.diff")).alias("ref"))
    found = gate.references(index, details, patches).unionByName(gate.orphans(details.unionByName(extra), index))
    return found.select("pr", "rule", "subject", "detail")


# --- state ---------------------------------------------------------------------------


@query("""with r as (select user_id as pr, event_id, ts, row_number() over (partition by user_id order by ts desc, cast(event_id as varchar)) - 1 as rank from events)
select pr, cast(event_id as varchar) as revision, rank from r where not (event_id % 10 = 0) and (rank >= 3 or ts < timestamp '2024-06-01 00:00:00' - interval 30 days)""")
def retention_victims(spark, d):
    """T02, W08."""
    r = read(spark, d, "events").select(F.col("user_id").alias("pr"), F.col("event_id").cast("string").alias("revision"), F.col("ts").alias("mtime"), (F.col("event_id") % 10 == 0).alias("is_active"))
    return progress.retention_victims(r, F.lit(NOW)).select("pr", "revision", F.col("rank").cast("long").alias("rank"))


@query("select user_id as url, arg_max(event_type, ts) as stage, arg_max(event_id, ts) as event_id from events group by user_id")
def latest_state(spark, d):
    """W07, T06, T01."""
    e = read(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("stage"), "event_id", F.col("ts").alias("time"))
    return progress.latest(e, "url", "time", "stage", "event_id")


@query("""with l as (select user_id, cast(arg_max(event_id, ts) % 101 as bigint) as percent from events group by user_id)
select cast(floor(avg(percent)) as bigint) as overall_percent, cast(count(*) filter (percent = 100) as bigint) as done, count(*) as total from l""")
def progress_overview(spark, d):
    """A17."""
    e = read(spark, d, "events").select(F.col("user_id").alias("url"), (F.col("event_id") % 101).alias("percent"), F.col("ts").alias("time"))
    return progress.overview(e)


STATUS_SQL = "case event_id % 4 when 0 then 'succeeded' when 1 then 'cached' when 2 then 'failed' else 'cancelled' end"


@query(f"""with j as (select event_type as run_id, {STATUS_SQL} as s from events) select run_id, cast(count(*) filter (s = 'succeeded') as bigint) as succeeded, cast(count(*) filter (s = 'cached') as bigint) as cached,
cast(count(*) filter (s = 'failed') as bigint) as failed, cast(count(*) filter (s = 'cancelled') as bigint) as cancelled, count(*) as total from j group by run_id""")
def run_summary(spark, d):
    """A16."""
    s = F.element_at(F.array(*(F.lit(x) for x in ("succeeded", "cached", "failed", "cancelled"))), (F.col("event_id") % 4 + 1).cast("int"))
    return progress.run_summary(read(spark, d, "events").select(F.col("event_type").alias("run_id"), s.alias("status")))


@query("""select count(*) as total, cast(count(*) filter (event_id % 4 = 0) as bigint) as completed, cast(count(*) filter (event_id % 4 = 1) as bigint) as cached, cast(count(*) filter (event_id % 4 = 2) as bigint) as failed,
cast(count(*) filter (event_id % 4 = 3) as bigint) as running, cast(floor(100.0 * count(*) filter (event_id % 4 < 3) / count(*) + 0.5) as bigint) as overall_percent from events""")
def batch_progress(spark, d):
    """A15."""
    s = F.element_at(F.array(*(F.lit(x) for x in ("completed", "cached", "failed", "running"))), (F.col("event_id") % 4 + 1).cast("int"))
    return progress.batch_counts(read(spark, d, "events").select(s.alias("status")))


@query("""with a as (select user_id as id, max(ts) as g, 'c' || (user_id % 3) as hs, 't' as ht from events where user_id % 4 <> 0 group by user_id)
select o_custkey as id, o_orderkey as pr, case when a.id is null then 'Missing' when 'c' || (o_orderkey % 3) = a.hs or a.g >= o_orderdate then 'Cached' else 'Outdated' end as cache_status from orders left join a on a.id = o_custkey""")
def cache_status(spark, d):
    """X30, J07."""
    prs = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pr"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("source_commit"), F.lit("t").alias("target_commit"), F.col("o_orderdate").cast("string").alias("updated_on"))
    active = read(spark, d, "events").where("user_id % 4 <> 0").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").cast("string").alias("generated_at"))
    active = active.withColumns({"have_source": F.concat(F.lit("c"), (F.col("id") % 3).cast("string")), "have_target": F.lit("t")})
    return discovery.cache_status(prs, active).select("id", "pr", "cache_status")


def _listing(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 5 == 0, "Draft: ").otherwise(""), "o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("MERGED").alias("state"),
        F.when(F.col("o_orderkey") % 7 == 0, True).alias("draft"), F.lit(None).cast("boolean").alias("is_draft"), F.lit(None).cast("string").alias("source_branch"), F.lit("main").alias("target_branch"), F.lit(None).cast("string").alias("source_commit"), F.lit(None).cast("string").alias("target_commit"),
        F.col("o_orderdate").cast("string").alias("updated_on"), F.concat(F.lit("{U-"), (F.col("o_custkey") % 3).cast("string"), F.lit("}")).alias("author_uuid"),
    )


@query("""select o_orderkey as id, (case when o_orderkey % 5 = 0 then 'Draft: ' else '' end) || o_orderpriority as title, 'unknown' as source_branch, 'u-1' as author_uuid from orders
  where o_custkey % 3 = 1 and o_orderstatus = 'O' and o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0""")
def pr_view_filter(spark, d):
    """P06, F02, F03, X24, S09."""
    return discovery.view(discovery.normalize(_listing(spark, d)), " {u-1} ", "ready").select("id", "title", "source_branch", "author_uuid")


@query("select min(cast(o_orderdate as timestamp)) as oldest, greatest(1, cast(ceil(epoch(timestamp '2024-06-01 00:00:00' - min(o_orderdate)) / 86400) as bigint)) as days from orders")
def date_span(spark, d):
    """A18."""
    prs = read(spark, d, "orders").select(F.col("o_orderdate").cast("string").alias("updated_on"))
    return discovery.date_span(prs, F.lit(NOW)).select(F.col("oldest").cast("timestamp_ntz").alias("oldest"), "days")


@query("select o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 50")
def newest_prs(spark, d):
    """A page of 50."""
    return discovery.newest(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_on"))).select("id")


# --- text ----------------------------------------------------------------------------

EMAIL_SQL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
UUID_SQL = r"\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?"


@query(rf"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:EMAIL]', 'g'), '{UUID_SQL}', '[REDACTED:UUID]', 'g'), '<[^>]*>', '', 'g') as clean from documents")
def pii_redact(spark, d):
    """X13."""
    return read(spark, d, "documents").select("doc_id", sanitize.sanitize_text(F.col("text")).alias("clean"))


#: One row for every category found in a text.
HITS_SQL = rf"""hits as (select source, unnest(list_filter([
  case when regexp_matches(text, '{EMAIL_SQL}') then 'pii_email' end, case when regexp_matches(regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:EMAIL]', 'g'), '{UUID_SQL}') then 'pii_uuid' end,
  case when regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') then 'private_key' end, case when regexp_matches(text, '(?i)\bBearer\s+[A-Za-z0-9\-._~+/]{{8,}}=*') then 'bearer_token' end,
  case when regexp_matches(text, '\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b') then 'aws_key' end,
  case when regexp_matches(text, '(?i)\b(?:Server|Data Source|Host)\s*=[^;\r\n]+;[^\r\n"'']*?(?:Password|Pwd)\s*=[^;\r\n"'']+;?|\b[a-z][a-z0-9+]*://[^\s:/@]+:[^\s@/]+@[^\s"'']+') then 'connection_string' end
], lambda x: x is not null)) as hit from documents)"""


@query(f"with {HITS_SQL}, s as (select source, count(*) as n, string_agg(distinct hit, ',' order by hit) as categories from hits group by source) select d.source as pr, coalesce(n, 0) as redacted_values, coalesce(categories, '') as categories from (select distinct source from documents) d left join s on d.source is not distinct from s.source")
def redaction_tally(spark, d):
    """What is found in all texts, by source."""
    texts = read(spark, d, "documents").select(F.col("source").alias("pr"), "text")
    return manifest.redaction_tally(texts).select("pr", F.col("redacted_values").cast("long").alias("redacted_values"), F.array_join("categories", ",").alias("categories"))


@query("select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as plain from pages")
def strip_html(spark, d):
    """Tags."""
    return read(spark, d, "pages").select("page_id", F.regexp_replace("html", sanitize.TAG, "").alias("plain"))


@query(r"select page_id, regexp_replace(url || '&token=' || page_id || '&x=1', '([?&](?:access_token|token|key|secret|password|auth|api_key)=)[^&]*', '\1[REDACTED]', 'gi') as clean from pages")
def url_redact(spark, d):
    """X19."""
    return read(spark, d, "pages").select("page_id", sanitize.sanitize_url(F.concat("url", F.lit("&token="), F.col("page_id").cast("string"), F.lit("&x=1"))).alias("clean"))


@query("""select page_id, case when page_id % 4 = 1 then 'insecure protocol' when page_id % 4 = 2 then 'invalid path' when page_id = 0 then 'invalid id' end as error,
  case when page_id % 4 in (0, 3) and page_id > 0 then 'https://bitbucket.org/ws' || (page_id % 9) || '/repo.x/pull-requests/' || page_id end as canonical_url from pages""")
def url_parts(spark, d):
    """Links checked and made canonical."""
    n = F.col("page_id").cast("string")
    link = F.concat(F.when(F.col("page_id") % 4 == 1, "http").otherwise("https"), F.lit("://BitBucket.org/Ws"), (F.col("page_id") % 9).cast("string"), F.lit("/Repo.x/pull-"), F.when(F.col("page_id") % 4 == 2, "x").otherwise("requests"), F.lit("/"), n, F.lit("/?a=1#b"))
    return read(spark, d, "pages").withColumn("l", urls.parse_link(link)).select("page_id", "l.error", "l.canonical_url")


@query("""with u as (select distinct 'https://bitbucket.org/a/b/pull-requests/' || (page_id % 40 + 1) as url, min(page_id) over (partition by page_id % 40) as ord from pages) select ord, url from u""")
def link_dedup(spark, d):
    """Canonical links at their first place."""
    links = read(spark, d, "pages").select(F.col("page_id").alias("ord"), F.concat(F.lit("https://bitbucket.org/A/b/pull-requests/"), (F.col("page_id") % 40 + 1).cast("string"), F.when(F.col("page_id") % 2 == 0, "/").otherwise("?x=y")).alias("url"))
    return registry.deduplicated(links)


@query("""with p as (select page_id, list_filter(string_split(replace(split_part(url, '://', 2), chr(92), '/'), '/'), lambda x: x <> '') as s from pages)
select page_id, case when len(s) <= 3 then array_to_string(s, '/') else s[1] || '/.../' || array_to_string(s[-2:], '/') end as path from p""")
def path_sanitize(spark, d):
    """X18."""
    p = F.element_at(F.split("url", "://", 2), -1)
    return read(spark, d, "pages").select("page_id", sanitize.sanitize_path(p, F.lit("file_0001")).alias("path"))


@query("""select c_custkey, 'repo_' || substr(sha256(lower(c_mktsegment) || '/' || lower(c_name) || ':salt'), 1, 8) as repo_id, 'rev_' || substr(sha256(c_name || ':' || c_mktsegment || ':3.0'), 1, 12) as hashed_revision,
 'bitbucket:' || lower(c_mktsegment) || ':' || lower(c_name) || ':' || c_custkey || ':a:b:v2:' || substr(md5('{}'), 1, 8) as cache_key from customer""")
def opaque_ids(spark, d):
    """X26, X27, X28."""
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    return read(spark, d, "customer").select("c_custkey", ids.repository_id(seg, name, "salt").alias("repo_id"), ids.hashed_revision_id(name, seg).alias("hashed_revision"), ids.cache_key(seg, name, F.col("c_custkey"), F.lit("a"), F.lit("b")).alias("cache_key"))


@query(r"select doc_id, 'a (x) ' || chr(96) || '\(' || doc_id || '\)' || chr(96) || chr(10) || 'z' as text, true as is_normalized from documents")
def text_normalize(spark, d):
    """Un-escaped outside code spans."""
    t = F.concat(F.lit("a \\(x\\) `\\("), F.col("doc_id").cast("string"), F.lit("\\)`\r\nz"))
    return read(spark, d, "documents").select("doc_id", sanitize.normalize_text(t).alias("n")).select("doc_id", "n.text", "n.is_normalized")


@query("""with m as (select page_id % 20 as pr, page_id, regexp_extract(url, '([^/]*)/*$', 1) as name, lower(url) as p from pages),
k as (select *, case when p like '%context%' or p like '%entity%' or p like '%entities%' or p like '%models%' or p like '%migration%' or p like '%.sql' then 'Database & Entity Models' when p like '%controller%' or p like '%route%' or p like '%/api/%' then 'APIs & Controllers'
 when p like '%proto%' or p like '%grpc%' or p like '%client%' then 'gRPC & External Integrations' when p like '%test%' or p like '%spec%' or p like '%extension%' or p like '%util%' or p like '%helper%' then 'Infrastructure & Unit Tests'
 when p like '%.json' or p like '%.env' or p like '%.yml' or p like '%.xml' or p like '%config%' then 'Configuration & Environment' when p like '%service%' or p like '%usecase%' or p like '%domain%' or p like '%.cs' or p like '%.ts' or p like '%.go' then 'Services & Business Logic' else 'Infrastructure & Unit Tests' end as module from m),
f as (select pr, module, name, min(page_id) as o from k group by pr, module, name)
select pr, module, string_agg(name, ',' order by o) as files from f group by pr, module""")
def module_groups(spark, d):
    """X07, A12."""
    p = read(spark, d, "pages").select((F.col("page_id") % 20).alias("pr"), F.col("page_id").alias("ord"), F.col("url").alias("path"))
    return payload.modules(p).select("pr", "module", F.array_join("files", ",").alias("files"))


@query("""select o_orderkey as pr, case when o_orderkey % 3 = 0 then 'ABC-' || o_orderkey when o_orderkey % 3 = 1 then 'XY-' || o_custkey else 'N/A' end as ticket_id,
 case when o_orderkey % 3 = 0 then '[ABC-' || o_orderkey || '] ' when o_orderkey % 3 = 1 then '[XY-' || o_custkey || '] ' else '' end || 'do xy-' || (case when o_orderkey % 3 = 1 then cast(o_custkey as varchar) else 'none' end) as title from orders""")
def ticket_ids(spark, d):
    """X10, X11."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    branch = F.when(o % 3 == 0, F.concat(F.lit("feature/abc-"), o.cast("string"))).otherwise("main")
    commits = F.array(F.concat(F.lit("[tag] wce-1: do xy-"), F.when(o % 3 == 1, c.cast("string")).otherwise("none")))
    rows = read(spark, d, "orders").select(o.alias("pr"), branch.alias("b"), commits.alias("c"))
    rows = rows.withColumn("ticket_id", payload.ticket_id(F.col("b"), F.col("c"), ["ABC-", "XY-"]))
    return rows.select("pr", "ticket_id", payload.title(F.col("b"), F.col("ticket_id"), F.col("c")).alias("title"))


@query("select doc_id, case when length(text) > 1000 then substr(text, 1, 1000) || chr(10) || '... [Diff truncated due to size limit]' else text end as patch from documents")
def truncate_patch(spark, d):
    """O09."""
    return read(spark, d, "documents").select("doc_id", search.truncated(F.col("text"), 1000).alias("patch"))


@query(r"""with c as (select conv_id as pr, row_number() over (partition by conv_id order by turn, text) - 1 as ord, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') as subject from conversations) select pr, ord, subject from c where ord < 10""")
def commit_subjects(spark, d):
    """P02, O03."""
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("pr")).agg(text.in_order(F.struct(F.lit("h").alias("hash"), F.col("text").alias("message")), F.col("turn"), F.col("text")).alias("commits"))
    return manifest.project_commits(c).select("pr", F.col("ord").cast("long").alias("ord"), "subject")


@query(f"""with {FILES_SQL} select pr, '# Files' || chr(10) || chr(10) || '## Read First' || chr(10) || '| File ID | Path | Kind | Status | +/- | Risk Tags |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) ||
 string_agg('| ' || id || ' | ' || path || ' | ' || change_kind || ' | modified | +' || additions || '/-' || deletions || ' | ' || coalesce(tag, 'none') || ' |', chr(10) order by (tag is null), ord) as summary from idx group by pr""")
def files_markdown(spark, d):
    """X41, F11."""
    return render.files_summary(file_view(spark, d))


#: Names that stand for every part of the rule, and near misses; whether the rule takes them.
FILE_NAMES = (
    (".env", True), (".ENV.local", True), ("doc.env", False), ("envs", False), ("appsettings.Dev#.json", True), ("my.appsettings.json", False), ("secrets#.json", True), ("secrets.yml", False), ("credentials#", True),
    ("my-credentials", False), ("doc#.PEM", True), ("doc#.key", True), ("doc#.pfx", True), ("doc#.p12", True), ("doc#.pem.txt", False), ("id_rsa#", True), ("old_id_rsa", False), ("db#.ConnectionStrings.json", True), ("doc#.json", False), ("doc#.ts", False),
)
FILE_NAMES_SQL = ", ".join(f"({k}, '{name}', {str(hit).lower()})" for k, (name, hit) in enumerate(FILE_NAMES))


@query(f"select doc_id, 'a/' || replace(t.name, '#', cast(doc_id as varchar)) as name, t.hit as sensitive from documents join (values {FILE_NAMES_SQL}) t(k, name, hit) on doc_id % {len(FILE_NAMES)} = t.k")
def sensitive_files(spark, d):
    """F08 over all documents: every part of the rule and its near misses."""
    at = (F.col("doc_id") % len(FILE_NAMES) + 1).cast("int")
    name = F.replace(F.element_at(F.array(*(F.lit(n) for n, _ in FILE_NAMES)), at), F.lit("#"), F.col("doc_id").cast("string"))
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("a/"), name).alias("name"))
    return rows.withColumn("sensitive", sanitize.is_sensitive_file(F.col("name")))


@query(r"""select doc_id, cast(doc_id % 50 as bigint) as files, cast(doc_id % 9 as bigint) as additions, cast(0 as bigint) as deletions from documents""")
def shortstat(spark, d):
    """S08."""
    n = F.col("doc_id")
    line = F.concat(F.lit(" "), (n % 50).cast("string"), F.lit(" files changed, "), (n % 9).cast("string"), F.lit(" insertions(+)"))
    return read(spark, d, "documents").select("doc_id", payload.shortstat(line).alias("s")).select("doc_id", "s.files", "s.additions", "s.deletions")


@query("""select c_custkey, 'Bearer [REDACTED_TOKEN] [REDACTED_EMAIL] {"token": "[REDACTED]"}' as line, substr(c_name, 1, 4) || '****' || substr(c_name, length(c_name) - 3) as masked from customer""")
def log_redact(spark, d):
    """X14, X15."""
    line = F.concat(F.lit("Bearer abc."), F.col("c_custkey").cast("string"), F.lit(" c"), F.col("c_custkey").cast("string"), F.lit('@mail.org {"token" : "t'), "c_name", F.lit('"}'))
    return read(spark, d, "customer").select("c_custkey", sanitize.redact_auth(sanitize.redact_log(line)).alias("line"), sanitize.mask_token(F.col("c_name")).alias("masked"))


from . import cases, service_queries, stored_queries  # noqa: E402, F401  (they register their queries)
