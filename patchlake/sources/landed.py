"""Reading provider payloads and published documents that have been landed as files.

Provider calls are not made here: a lander writes each answer to a file, and these
readers give it a schema. A part that could not be fetched is an absent row, which
coverage reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

METADATA = "struct<id:bigint,title:string,description:string,state:string,draft:boolean,author:struct<display_name:string,username:string,uuid:string>,source:struct<branch:struct<name:string>,commit:struct<hash:string>>,destination:struct<branch:struct<name:string>,commit:struct<hash:string>>,updated_on:string>"
COMMIT = "struct<hash:string,message:string>"
DIFFSTAT = "struct<status:string,lines_added:bigint,lines_removed:bigint,old:struct<path:string>,new:struct<path:string>>"


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pr, metadata) of JSON lines with pr and metadata; unreadable lines are dropped."""
    return spark.read.schema(f"pr string, metadata {METADATA}").json(path, mode="DROPMALFORMED")


def pages(spark: SparkSession, path: str, item: str, most: int = 50) -> DataFrame:
    """Rows (pr, values, complete, warning) of paged listings: JSON lines (pr, page, values, next, error).

    Pages up to the first failed one, and at most ``most``, count; a listing cut short
    keeps what it has and says so.
    """
    raw = spark.read.schema(f"pr string, page int, values array<{item}>, next string, error string").json(path)
    first_bad = raw.where("error is not null").groupBy("pr").agg(F.min("page").alias("bad"), F.min_by("error", "page").alias("why"))
    d = raw.join(first_bad, "pr", "left").where(F.col("page") < F.coalesce("bad", F.lit(1 << 30)))
    packed = F.array_sort(F.collect_list(F.when(F.col("page") <= most, F.struct("page", "values"))))
    whole = d.groupBy("pr").agg(packed.alias("p"), F.max("page").alias("last"), F.max_by("next", "page").alias("next"))
    heads = raw.select("pr").distinct().join(whole, "pr", "left").join(first_bad, "pr", "left")
    warning = F.coalesce("why", F.when((F.col("last") > most) | ((F.col("last") == most) & F.col("next").isNotNull()), F.lit("page limit reached")))
    values = F.flatten(F.transform("p", lambda x: F.coalesce(x["values"], F.expr(f"cast(array() as array<{item}>)"))))
    return heads.select("pr", F.coalesce(values, F.expr(f"cast(array() as array<{item}>)")).alias("values"), warning.isNull().alias("complete"), warning.alias("warning"))


def chains(heads: DataFrame, landed: DataFrame, most: int = 50) -> DataFrame:
    """Rows (pr, pages, values, complete, warning): listings put together by following each page's ``next``.

    ``heads`` (pr, link) names the first page of each listing, ``landed`` (pr, link, values,
    next, error) holds pages in any order, repeated or unreachable ones included. A listing
    ends at a page without next, before a failed page or one that never landed, or after
    ``most`` pages; a loop is followed until then, as a reader would. What was reached is
    kept. Of several pages of one link one without error counts, then the last by next and
    values. Null listings or links are in no chain; an empty next is none.

    Only links take part in the search, values are joined once. It doubles its stride: from
    where each page leads in 1, 2, 4, ... steps, all pages of depth up to 2, 4, 8, ... follow,
    so 50 pages take six rounds, and fewer if no page has that many after it. A listing's
    result is at most ``most`` pages.
    """
    pages = landed.where("pr is not null and link is not null").withColumn("next", F.nullif("next", F.lit("")))
    order = F.struct(F.col("error").isNull(), "next", F.xxhash64("values"))
    one = lambda *c: pages.groupBy("pr", "link").agg(F.max_by(F.struct(*c), order).alias("x")).select("pr", "link", "x.*")
    chain = heads.where("pr is not null and link is not null").groupBy("pr").agg(F.min("link").alias("link")).withColumn("depth", F.lit(1))
    jumps, stride = written(one("next", "error").where("next is not null and error is null").select("pr", "link", F.col("next").alias("to")), "jumps"), 1
    while stride <= most and not jumps.isEmpty():
        further = chain.join(jumps, ["pr", "link"]).select("pr", F.col("to").alias("link"), (F.col("depth") + stride).alias("depth"))
        chain = written(chain.unionByName(further.where(F.col("depth") <= most + 1)), "chain")
        stride *= 2
        if stride <= most:
            jumps = written(jumps.join(jumps.select("pr", F.col("link").alias("to"), F.col("to").alias("beyond")), ["pr", "to"]).select("pr", "link", F.col("beyond").alias("to")), "jumps")
    found = chain.join(one("error", "values").withColumn("known", F.lit(True)), ["pr", "link"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    read = (F.col("depth") <= most) & F.col("error").isNull() & F.col("known")
    end = F.when(F.col("depth") > most, "page limit reached").when(~F.col("known"), "page not landed").otherwise(F.col("error"))
    by = found.groupBy("pr").agg(F.array_sort(F.collect_list(F.when(read, F.struct("depth", "values")))).alias("p"), F.max(end).alias("warning"))
    kind = by.schema["p"].dataType.elementType["values"].dataType.simpleString()
    empty = F.expr(f"cast(array() as {kind})")
    return by.select("pr", F.size("p").cast("long").alias("pages"), F.flatten(F.transform("p", lambda x: F.coalesce(x["values"], empty))).alias("values"), F.col("warning").isNull().alias("complete"), "warning")


def raw_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pr, raw_diff): one text file a pr, named by it; gzip files are read as they are."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.diff|\.patch|\.txt)?(?:\.gz)?\z", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("pr"), F.col("value").alias("raw_diff"))


def collect(meta: DataFrame, commits: DataFrame, diffstat: DataFrame, diffs: DataFrame) -> DataFrame:
    """Raw revisions: one row for each pr with metadata; what else is missing is empty, with a coverage word and a warning."""
    part = lambda d, name: d.select("pr", F.col("values").alias(name), F.col("complete").alias(f"{name}_ok"), F.col("warning").alias(f"{name}_warning"))
    d = meta.join(part(commits, "commits"), "pr", "left").join(part(diffstat, "diffstat"), "pr", "left").join(diffs, "pr", "left")
    word = lambda name: F.when(F.col(f"{name}_ok").isNull(), "failed").when(F.col(f"{name}_ok"), "complete").otherwise("partial")
    warnings = F.array_compact(F.array("commits_warning", "diffstat_warning", F.when(F.col("raw_diff").isNull(), "diff not fetched")))
    return d.select(
        "pr", "metadata", F.coalesce("commits", F.expr(f"cast(array() as array<{COMMIT}>)")).alias("commits"), F.coalesce("diffstat", F.expr(f"cast(array() as array<{DIFFSTAT}>)")).alias("diffstat"),
        F.coalesce("raw_diff", F.lit("")).alias("raw_diff"), F.struct(F.lit("complete").alias("metadata"), word("commits").alias("commits"), word("diffstat").alias("diffstat"), F.when(F.col("raw_diff").isNull(), "failed").otherwise("complete").alias("diff")).alias("coverage"),
        warnings.alias("warnings"),
    )


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a file that is no JSON gives a row of nulls."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc")).select("doc.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; one bad line discards its whole file."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("_file", F.input_file_name())
    d = lines.select("_file", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x")).select("_file", "x.*")
    bad = d.where("_corrupt_record is not null").select("_file").distinct()
    return d.join(bad, "_file", "left_anti").drop("_file", "_corrupt_record")


def links(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, url) of a link registry {schema_version, items}."""
    return json_document(spark, path, "schema_version string, items array<string>").select(F.posexplode("items").alias("ord", "url"))
