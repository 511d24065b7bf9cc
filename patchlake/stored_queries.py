"""Registered queries that write a store, a clustered table or an index from the driver's tables and answer from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import diff, gate, search, trigrams
from .registering import query, read
from .sources import clustered, commits, keyed, landed, store
from .sources.shared import fresh_path
from .streaming import refresh, sessions

NOW = "2024-06-01 00:00:00"


@query("""with d as (
  select doc_id // 8 as pr, doc_id % 8 as k, (7 - doc_id % 8) * 12 + (doc_id * 7) % 20 as days, length(text) as chars from documents
), r as (
  select *, row_number() over (partition by pr order by days, k) - 1 as rank, k = max(k) over (partition by pr) as active from d
), kept as (
  select *, active or (rank < 3 and days <= 30) as live from r
), b as (
  select k, count(*) as n, count(*) filter (live) as alive, sum(chars) as chars, sum(chars) filter (live) as alive_chars from kept group by k
)
select 'b' || k as batch, alive as revisions, n as rows_left, cast(chars as bigint) as chars_left from b where 2 * alive >= n
union all
select 'collected', cast(sum(alive) as bigint), cast(sum(alive) as bigint), cast(sum(alive_chars) as bigint) from b where alive > 0 and 2 * alive < n having count(*) > 0""")
def collected_batches(spark, d):
    """What is left in each batch of a store after collection and sweep.

    Documents are revisions: eight ids are one change set, each published in a batch of
    its own, the later the younger.
    """
    root = fresh_path(spark, "store")
    docs = read(spark, d, "documents")
    days = (7 - F.col("doc_id") % 8) * 12 + (F.col("doc_id") * 7) % 20
    for k in range(8):
        own = docs.where(F.col("doc_id") % 8 == k)
        pr = F.floor(F.col("doc_id") / 8).cast("long").alias("pr")
        revisions = own.select(pr, (F.lit(NOW).cast("timestamp") - F.make_dt_interval(days.cast("int"))).alias("generated_at"))
        store.publish_batch(root, {"texts": own.select(pr, "text")}, revisions, f"b{k}")
    store.collect(spark, root, F.lit(NOW), batch="collected")
    store.sweep(spark, root, F.lit(NOW), 0)
    live = store.snapshot(spark, root).revisions().groupBy("batch").agg(F.count("*").alias("revisions"))
    left = spark.read.parquet(f"{root}/tables/texts").groupBy(F.substr("batch", F.lit(3)).alias("batch")).agg(F.count("*").alias("rows_left"), F.sum(F.length("text")).alias("chars_left"))
    return left.join(live, "batch", "full").select("batch", "revisions", "rows_left", "chars_left")


@query(r"""with d as (
  select coalesce(source, '') as pr, 'file_' || lpad(cast(doc_id as varchar), cast(greatest(4, length(cast(doc_id as varchar))) as integer), '0') as file_id, 'docs/' || doc_id || '.md' as path, coalesce(text, '') as t
  from documents where doc_id % 100 = 0
)
select pr, file_id, path, length(t) > 16000 as truncated, sha256(case when length(t) > 16000 then substr(t, 1, 16000) || chr(10) || '... [Diff truncated due to size limit]' else t end) as patch_sha256 from d""")
def file_lookups(spark, d):
    """One file's change and patch for every document whose id is divisible by 100, from clustered tables."""
    root = fresh_path(spark, "clustered")
    docs = read(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("pr"), text.file_id(F.col("doc_id")).alias("file_id"), "doc_id", F.coalesce("text", F.lit("")).alias("patch"))
    clustered.write(docs.select("pr", "file_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")), f"{root}/changes", "pr", ["file_id"])
    clustered.write(docs.select("pr", "file_id", "patch"), f"{root}/patches", "pr", ["file_id"])
    asked = docs.where(F.col("doc_id") % 100 == 0).select("pr", "file_id")
    found = search.file_changes(clustered.lookup_all(spark, f"{root}/changes", asked), clustered.lookup_all(spark, f"{root}/patches", asked))
    return found.select("pr", "file_id", "path", "truncated", F.sha2("patch", 256).alias("patch_sha256"))


#: Patterns of one search: long and short, common, rare and absent, in either case.
PATTERNS = ("farm", "HTTPS://M.", "/de/", "?page=2", "x", "ou", ".example.org/en/1", "utm_source=feed", "zzzz", "TH", "9", "#top", "aaaa", "://")


@query("""with q as (select unnest([%s]) as pattern), h as (
  select pattern, url, page_id from q join pages on contains(lower(url), lower(pattern))
), r as (select *, row_number() over (partition by pattern order by page_id, url) as rank, count(*) over (partition by pattern) as total from h)
select pattern, url, page_id, rank, total from r where rank <= 50""" % ", ".join(f"'{p}'" for p in PATTERNS))
def path_search(spark, d):
    """The first 50 files of each pattern and how many there are, from a trigram index of all urls."""
    pages = read(spark, d, "pages").select("page_id", "url")
    index = trigrams.build(pages, fresh_path(spark, "trigrams"), "url")
    return trigrams.search_index(index, pages, list(PATTERNS), 50, "url", ("page_id", "url")).select("pattern", "url", "page_id", F.col("rank").cast("long").alias("rank"), "total")


@query("""with e as (
  select user_id, ts, event_id, event_type, epoch_us(ts) as us from events where user_id is not null and ts is not null
), c as (
  select *, coalesce(us - lag(us) over (partition by user_id order by us, event_id) >= 1800000000, true) as fresh from e
), n as (
  select *, sum(cast(fresh as integer)) over (partition by user_id order by us, event_id rows unbounded preceding) as no from c
), s as (
  select user_id, no, min(us) as a, max(us) as b, count(*) as events, arg_max(event_type, (us, event_id)) as stage from n group by user_id, no
)
select user_id, a as started_us, b as ended_us, events, stage from s
where (b + 1800000000 + 999) // 1000 <= (select max(us) // 1000 - 600000 from e)""")
def lapsed_sessions(spark, d):
    """All events as a stream; the sessions of 30 minutes that have lapsed when the watermark stands 10 minutes before the last event, each with its last stage."""
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream takes no plain file
    # times without a zone are taken as UTC, whatever the session's
    events = events.withColumn("ts", F.timestamp_seconds(F.lit(0)) + (F.col("ts") - F.expr("timestamp_ntz'1970-01-01'")))
    found = sessions.lapsed(events, "user_id", "ts", "event_id", "event_type")
    out = fresh_path(spark, "sessions")
    sessions.write_lapsed(found, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows")
    return rows.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "events", "stage")


@query("""select doc_id // 4 as key, max_by(doc_id, (doc_id % 3, doc_id)) as doc_id, max_by(sha256(coalesce(text, '')), (doc_id % 3, doc_id)) as text_sha256
from documents where doc_id is not null group by 1 having not max_by(doc_id % 7 = 0, (doc_id % 3, doc_id))""")
def merged_index(spark, d):
    """A keyed table after three merges of all documents: four ids share a key, the last merge of a key wins, ids divisible by 7 remove it."""
    root = fresh_path(spark, "keyed")
    keyed.create(spark, root, "key long, doc_id long, text_sha256 string", ["key"], 16)
    docs = read(spark, d, "documents").where("doc_id is not null")
    rows = docs.select(F.floor(F.col("doc_id") / 4).cast("long").alias("key"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), (F.col("doc_id") % 7 == 0).alias("gone"))
    for turn in range(3):
        keyed.merge(spark, root, rows.where(F.col("doc_id") % 3 == turn), ["doc_id"], "gone")
    return keyed.snapshot(spark, root).rows()


#: Pages of listings: 64 ids are one, page after page; some fail, some never landed, some lead back.
LANDED_SQL = """select doc_id // 64 as pr, doc_id % 64 as k, length(coalesce(text, '')) as chars,
  case when doc_id % 64 = 40 and doc_id // 64 % 5 = 0 then 33 when doc_id % 64 = 63 or (doc_id % 64 = 20 and doc_id // 64 % 3 = 1) then null else doc_id % 64 + 1 end as nxt,
  case when doc_id % 89 = 88 then 'HTTP 500' end as error
from documents where doc_id is not null and doc_id % 97 <> 96"""


@query(f"""with recursive p as ({LANDED_SQL}), w(pr, k, depth) as (
  select distinct doc_id // 64, cast(0 as bigint), 1 from documents where doc_id is not null
  union all
  select w.pr, cast(p.nxt as bigint), depth + 1 from w join p on p.pr = w.pr and p.k = w.k where nxt is not null and error is null and depth <= 50
), r as (
  select w.pr, depth, chars, case when depth > 50 then 'page limit reached' when p.k is null then 'page not landed' else error end as bad from w left join p on p.pr = w.pr and p.k = w.k
)
select pr, count(*) filter (bad is null) as pages, coalesce(string_agg(cast(chars as varchar), ',' order by depth) filter (bad is null), '') as sizes, max(bad) is null as complete, max(bad) as warning from r group by pr""")
def page_chains(spark, d):
    """Listings of pages followed from link to link: whole ones, loops, gaps, failed pages and those of more than 50 pages."""
    n = F.col("doc_id")
    docs = read(spark, d, "documents").where("doc_id is not null")
    pr, k = F.floor(n / 64).cast("long"), n % 64
    link = lambda c: F.concat(F.lit("https://api.example.org/"), pr.cast("string"), F.lit("?page="), c.cast("string"))
    after = F.when((k == 40) & (pr % 5 == 0), 33).when((k != 63) & ~((k == 20) & (pr % 3 == 1)), k + 1)
    pages = docs.where(n % 97 != 96).select(pr.alias("pr"), link(k).alias("link"), F.array(F.length(F.coalesce("text", F.lit("")))).alias("values"), link(after).alias("next"), F.when(n % 89 == 88, "HTTP 500").alias("error"))
    heads = docs.select(pr.alias("pr"), link(F.lit(0)).alias("link")).distinct()
    return landed.chains(heads, pages).select("pr", "pages", F.array_join("values", ",").alias("sizes"), "complete", "warning")


#: Documents as revisions: eight ids are one change set, two more of them land with each wave; some come late, some with a known commit.
REVISIONS_SQL = """select doc_id, doc_id // 8 as pr, doc_id % 8 // 2 as wave, coalesce(text, '') as t,
  case when doc_id // 8 % 4 = 2 then 'h' || doc_id % 8 // 4 else 'h' || doc_id end as commit,
  case when doc_id // 8 % 3 = 1 and doc_id % 8 // 2 = 2 then 1 else 10 + doc_id % 8 * 3 % 10 + doc_id % 8 // 2 * 2 end as day
from documents where doc_id is not null"""


def _wave(n: int) -> str:
    """The state after wave ``n``: of each change set the revision made in the last wave that found one outdated."""
    return f"""n{n} as (
  select r.pr, max_by(r.doc_id, (r.day, r.commit)) as doc_id, max_by(r.commit, (r.day, r.commit)) as commit, max(r.day) as day
  from r left join a{n - 1} a on a.pr = r.pr where wave = {n} and (a.pr is null or (r.commit <> a.commit and r.day > a.day)) group by r.pr
), a{n} as (
  select * from n{n} union all select * from a{n - 1} where pr not in (select pr from n{n})
)"""


@query(f"""with r as ({REVISIONS_SQL}), a_ as (select pr, doc_id, commit, day from r where false), {', '.join(_wave(n).replace('a-1', 'a_') for n in range(4))}, made as (
  {' union all '.join(f'select {n} as wave, pr, doc_id from n{n}' for n in range(4))}
)
select pr, cast(made.wave as bigint) as wave, commit as source_commit, 'docs/' || doc_id || '.md' as path, cast(len(string_split(t, chr(10))) as bigint) as additions from made join r using (pr, doc_id)""")
def refreshed_revisions(spark, d):
    """What four runs of the refresh stream analysed of all documents, landed in four waves."""
    n = F.col("doc_id")
    root, landing = fresh_path(spark, "refreshed"), fresh_path(spark, "landing")
    pr, k, name = F.floor(n / 8).cast("long"), n % 8, F.concat(F.lit("docs/"), n.cast("string"), F.lit(".md"))
    wave = F.floor(k / 2).cast("int")
    commit = F.concat(F.lit("h"), F.when(pr % 4 == 2, F.floor(k / 4)).otherwise(n).cast("string"))
    day = F.when((pr % 3 == 1) & (wave == 2), 1).otherwise(10 + k * 3 % 10 + wave * 2)
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n+"))
    raw = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1 @@\n+"), body)
    docs = read(spark, d, "documents").where("doc_id is not null").select(pr.alias("pr"), commit.alias("source_commit"), F.lit("main").alias("target_commit"), F.concat(F.lit("2024-05-"), F.lpad(day.cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("updated_on"), raw.alias("raw_diff"), wave.alias("wave"))
    facts = [F.col(c) for c in ("source_commit", "target_commit", "updated_on")]

    def put(rows, base, token):
        files = diff.parsed_files(rows.select("pr", "raw_diff"))
        tables = {"files": files.select("pr", diff.file_path(files).alias("path"), "additions", F.lit(int(token.split("-")[1])).cast("long").alias("wave"))}
        store.publish_batch(root, tables, rows.select("pr", "generated_at", "source_commit", "target_commit"), base=base, token=token)

    for turn in range(4):
        docs.where(F.col("wave") == turn).drop("wave").write.mode("append").parquet(landing)
        stream = spark.readStream.schema(docs.drop("wave").schema).parquet(landing)
        refresh.refresh(stream, root, put, f"{root}-checkpoint", "refresh", facts).awaitTermination()
    at = store.snapshot(spark, root)
    return at.rows("files").join(at.revisions().select("pr", "origin", "source_commit"), ["pr", "origin"]).select("pr", "wave", "source_commit", "path", "additions")


@query("""with d as (
  select doc_id, doc_id // 8 as pr, len(string_split(coalesce(text, ''), chr(10))) as adds, coalesce(lang, 'unknown') as kind, 'file_000' || (doc_id % 8 + 1) as fid,
    case when doc_id % 31 = 0 then 'file_0001' else 'file_000' || (doc_id % 8 + 1) end as id from documents where doc_id is not null
), i as (select *, case when doc_id % 41 = 0 then '../x' else 'files/' || id || '/change.json' end as ref from d), x as (
  select doc_id, pr, fid, 'files/' || fid || '/change.json' as ref, case when doc_id % 47 = 0 then '../p' else 'patch.diff' end as patch_ref from d where doc_id % 43 <> 0
), r as (select pr, sum(adds) as adds from d group by pr)
select pr, 'index_schema' as rule, 'error' as severity, id as subject, 'status' as detail from i where doc_id % 37 = 0
union all select pr, 'duplicate_id', 'error', id, 'seen ' || count(*) || ' times' from i group by pr, id having count(*) > 1
union all select pr, 'path_traversal', 'error', id, ref from i where ref = '../x'
union all select pr, 'missing_detail', 'error', id, ref from i where ref <> '../x' and (pr, ref) not in (select (pr, ref) from x)
union all select i.pr, 'path_traversal', 'error', id, patch_ref from i join x on x.pr = i.pr and x.ref = i.ref where patch_ref = '../p'
union all select i.pr, 'missing_patch', 'error', id, patch_ref from i join x on x.pr = i.pr and x.ref = i.ref where patch_ref <> '../p' and x.doc_id % 53 = 0
union all select pr, 'totals', 'error', 'total_additions', (adds + 1) || ' <> ' || adds from r where pr % 5 = 0
union all select pr, 'important_file_id', 'error', 'file_0099', 'not in the index' from r where pr % 6 = 0
union all select pr, 'important_file_id', 'error', 'file_0001', 'not in the index' from r where pr not in (select pr from i where id = 'file_0001')
union all select pr, 'kind_counts', 'warning', kind, (count(*) + 1) || ' <> ' || count(*) from d where pr % 7 = 0 group by pr, kind
union all select distinct pr, 'orphan', 'warning', fid, 'not in the index' from x where (pr, fid) not in (select (pr, id) from i)
union all select pr, 'coverage_schema', 'error', 'diff', 'odd' from r where pr % 11 = 0""")
def gate_report(spark, d):
    """Every violation of faulty change sets made of all documents, in one pass over all parts."""
    n = F.col("doc_id")
    fid = lambda o: F.concat(F.lit("file_000"), (o + 1).cast("string"))
    ref = lambda i: F.concat(F.lit("files/"), i, F.lit("/change.json"))
    docs = read(spark, d, "documents").where("doc_id is not null").select("doc_id", F.floor(n / 8).cast("long").alias("pr"), fid(n % 8).alias("fid"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("additions"), F.coalesce("lang", F.lit("unknown")).alias("change_kind"))
    own = docs.withColumn("id", F.when(n % 31 == 0, "file_0001").otherwise(F.col("fid")))
    index = own.select("pr", "id", F.concat(F.lit("docs/"), n.cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), F.when(n % 37 == 0, "odd").otherwise("added").alias("status"), "additions", F.lit(0).cast("long").alias("deletions"), "change_kind", F.expr("cast(array() as array<string>)").alias("risk_tags"), F.when(n % 41 == 0, "../x").otherwise(ref(F.col("id"))).alias("detail_ref"))
    kinds = docs.groupBy("pr", "change_kind").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"))
    counts = F.collect_list(F.struct("change_kind", (F.col("files") + (F.col("pr") % 7 == 0).cast("long")).alias("n")))
    rolled = kinds.groupBy("pr").agg(F.sum("files").alias("total_files"), (F.sum("additions") + (F.col("pr") % 5 == 0).cast("long")).alias("total_additions"), F.lit(0).cast("long").alias("total_deletions"), counts.alias("kind_counts"))
    rolled = rolled.withColumns({"overall_level": F.lit("low"), "primary_kind": F.lit("unknown"), "important_file_ids": F.when(F.col("pr") % 6 == 0, F.array(F.lit("file_0001"), F.lit("file_0099"))).otherwise(F.array(F.lit("file_0001")))})
    details = docs.where(n % 43 != 0).select("pr", ref(F.col("fid")).alias("ref"), F.when(n % 47 == 0, "../p").otherwise("patch.diff").alias("patch_ref"), F.col("fid").alias("folder"))
    patches = docs.where(n % 53 != 0).select("pr", F.concat(F.lit("files/"), "fid", F.lit("/patch.diff")).alias("ref"))
    coverage = docs.select("pr").distinct().select("pr", F.lit("diff").alias("section"), F.when(F.col("pr") % 11 == 0, "odd").otherwise("complete").alias("status"), F.lit(False).alias("truncated"), F.lit(1).alias("items_fetched"))
    return gate.violations(rolled, index, details, patches, coverage)
