"""Substring search over paths by a positional trigram index.

Every distinct path gives, for each of its positions, the three characters that begin
there; two padding characters at its end give the last two positions one as well, so a
pattern of one or two characters is the beginning of a trigram wherever it occurs.
Postings are sorted by trigram and path and dealt by ranges of both, so a trigram that
most paths have fills many files and no task.

A search takes for each pattern its rarest trigrams, the smallest first, joins their
postings on path and place, and verifies what is left on the paths themselves. Postings
of other trigrams and the other paths are not read: filters on the trigram reach the
bounds of files and row groups, paths are looked up by bucket.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import clustered

PAD = "\x00\x00"
#: Trigrams of a pattern that are intersected before the rest is verified.
ROUNDS = 2
#: Patterns of one search; they go out with the plan.
MOST_PATTERNS = 1000


@dataclass
class Index:
    spark: SparkSession
    folder: str

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, path_id long, at int").parquet(f"{self.folder}/postings")

    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long").parquet(f"{self.folder}/grams")


def build(paths: DataFrame, folder: str, path_col: str = "path", files: int | None = None, buckets: int = 64) -> Index:
    """Index the distinct lower-cased paths of a table; null paths are left out, an empty table gives an index that finds nothing."""
    spark = paths.sparkSession
    low = F.lower(F.col(path_col))
    names = paths.where(F.col(path_col).isNotNull()).select(low.alias("low")).distinct().select(F.xxhash64("low").alias("path_id"), "low")
    clustered.write(names, f"{folder}/names", "path_id", [], buckets)
    names = spark.read.schema("path_id long, low string").parquet(f"{folder}/names")
    padded = F.concat("low", F.lit(PAD))
    at = F.explode(F.sequence(F.lit(1), F.length("low")))
    rows = names.where("low <> ''").select("path_id", padded.alias("padded"), at.alias("at")).select(F.substring("padded", F.col("at"), F.lit(3)).alias("gram"), "path_id", "at")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["gram", "path_id", "at"]
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.option("parquet.bloom.filter.enabled#gram", "true").option("parquet.block.size", clustered.GROUP_BYTES).parquet(f"{folder}/postings")
    index = Index(spark, folder)
    index.postings().groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(1 if files == 1 else files, "gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
    return index


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def candidates(index: Index, patterns: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Rows (pattern, path_id) that the rarest trigrams of each lower-case pattern leave."""
    spark = index.spark
    long, short = [p for p in patterns if len(p) >= 3], [p for p in patterns if 0 < len(p) < 3]
    of = {p: {p[k : k + 3]: k for k in range(len(p) - 3, -1, -1)} for p in long}  # each trigram at its first place
    asked = sorted({g for grams in of.values() for g in grams})
    n = {r["gram"]: r["n"] for r in index.grams().where(F.col("gram").isin(asked)).collect()} if asked else {}
    chosen = [(p, at, g, k) for p, grams in of.items() if all(g in n for g in grams) for at, (_, g, k) in enumerate(sorted((n[g], g, k) for g, k in grams.items())[:rounds])]
    found = []

    def read(step: int) -> DataFrame:
        own = [(p, g, k) for p, at, g, k in chosen if at == step]
        plan = F.broadcast(spark.createDataFrame(own, "pattern string, gram string, place int"))
        rows = index.postings().where(F.col("gram").isin(sorted({g for _, g, _ in own})))
        return rows.join(plan, "gram").select("pattern", "path_id", (F.col("at") - F.col("place")).alias("start")).where("start > 0")

    if chosen:
        left = read(0)
        for step in range(1, max(at for _, at, _, _ in chosen) + 1):
            more = {p for p, at, _, _ in chosen if at == step}
            rest = left.where(~F.col("pattern").isin(sorted(more)))
            left = rest.unionByName(left.where(F.col("pattern").isin(sorted(more))).join(read(step), ["pattern", "path_id", "start"], "left_semi"))
        found.append(left.select("pattern", "path_id"))
    if short:
        rows = index.postings().where(_any([F.col("gram").startswith(p) for p in short]))
        begun = F.filter(F.array(*map(F.lit, short)), lambda p: F.startswith("gram", p))
        found.append(rows.select(F.explode(begun).alias("pattern"), "path_id"))
    if not found:
        return spark.createDataFrame([], "pattern string, path_id long")
    return reduce(DataFrame.unionByName, found).distinct()


def search_paths(index: Index, patterns: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Rows (pattern, low): the lower-cased paths that hold each pattern, compared without case.

    An empty pattern is no filter and finds nothing here; a pattern given twice is
    answered once. Places of equal trigrams within a pattern count once.
    """
    if len(set(patterns)) > MOST_PATTERNS:
        raise ValueError(f"at most {MOST_PATTERNS} patterns a search")
    spark, lows = index.spark, sorted({p.lower() for p in patterns if p})
    found = candidates(index, lows, rounds)
    names = clustered.lookup_all(spark, f"{index.folder}/names", found)
    hits = found.join(names, "path_id").where(F.contains("low", "pattern")).select(F.col("pattern").alias("lowered"), "low")
    if not lows:
        return hits.withColumnRenamed("lowered", "pattern")
    given = spark.createDataFrame([(p, p.lower()) for p in sorted(set(patterns)) if p], "pattern string, lowered string")
    return hits.join(F.broadcast(given), "lowered").select("pattern", "low")


def search_index(index: Index, files: DataFrame, patterns: list[str], limit: int = 50, path_col: str = "path", order: tuple[str, ...] = ("pr", "ord")) -> DataFrame:
    """Rows of ``files`` whose path holds each pattern, the first ``limit`` by ``order``, with ``pattern``, ``total`` before the limit and ``rank``."""
    from pyspark.sql import Window

    hits = files.withColumn("low", F.lower(F.col(path_col))).join(search_paths(index, patterns), "low").drop("low")
    total = hits.groupBy("pattern").agg(F.count("*").alias("total"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy(*order))).where(F.col("rank") <= limit)
    return ranked.join(total, "pattern")
