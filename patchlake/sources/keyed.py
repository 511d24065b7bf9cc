"""Tables that rows are merged into by key: buckets by a hash of the key, rewritten only if touched.

A version names one folder a bucket. A merge reads and rewrites the buckets its keys fall
into and puts one numbered commit that re-points them, so a reader sees all of a merge or
none, and every other file keeps its name. Two writers of different buckets both succeed;
of two that touch one bucket the second to commit reads it anew and merges once more.
Which row of a key wins is decided by the number of its merge, never by a clock. A hash
spreads the keys evenly, and a key has one row, so no bucket grows with a hot key; rows of
one merge are reduced by key before they are dealt to buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits
from .commits import Conflict

__all__ = ["Conflict", "Table", "create", "merge", "snapshot", "sweep"]

#: Merges after which a commit names every bucket, so that readers open few commits.
STATE_EVERY = 50
#: Column by which a merge deals its files to folders.
DEALT = "keyed_bucket"


@dataclass
class Table:
    """The table at one version: its schema, keys, number of buckets and the folder of each bucket that has rows."""

    spark: SparkSession
    root: str
    version: int
    schema: str
    keys: list[str]
    buckets: int
    folders: dict[int, str]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other folder is opened or listed."""
        paths = [f"{self.root}/{f}" for b, f in sorted(self.folders.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def find(self, asked: DataFrame) -> DataFrame:
        """The rows of the asked keys: only their buckets are read."""
        asked = asked.select(*self.keys).distinct()
        touched = [r[0] for r in asked.select(self.bucket().alias("b")).distinct().collect()]  # at most one a bucket
        match = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"w.`{k}`")) for k in self.keys]
        return self.rows(touched).alias("a").join(asked.alias("w"), match, "left_semi")


def create(spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64) -> Table:
    """A new table; the number of buckets stays. Conflict if there is one already."""
    if not keys or buckets < 1:
        raise ValueError("a keyed table needs keys and buckets")
    if DEALT in (f.name.lower() for f in spark.createDataFrame([], schema).schema):
        raise ValueError(f"no column may be named {DEALT}")
    record = {"kind": "create", "schema": schema, "keys": keys, "buckets": buckets, "folders": {}}

    def first(news: list[dict]) -> None:
        if news:
            raise Conflict(f"{root} is there already")

    commits.commit(spark, root, record, 0, first)
    return snapshot(spark, root)


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Table:
    """The table at ``version``, or the last one."""
    known = commits.since(spark, root, 0, version)
    if not known:
        raise FileNotFoundError(f"no keyed table at {root}")
    at = max(i for i, c in enumerate(known) if c["kind"] in ("create", "state"))
    folders: dict[int, str] = {}
    for c in known[at:]:
        folders |= {int(b): f for b, f in c["folders"].items()}
    base = known[0]
    return Table(spark, root, known[-1]["version"], base["schema"], base["keys"], base["buckets"], {b: f for b, f in folders.items() if f})


def _reduced(table: Table, new: DataFrame, order: list[str], gone: str | None) -> DataFrame:
    """One row (bucket, gone, row) a key: the last by ``order``, ties to the larger row."""
    columns = [f.name for f in table.spark.createDataFrame([], table.schema).schema]
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    d = new.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(table.keys)), table.bucket().alias("_b"), flag.alias("_gone"), row.alias("_row"), F.struct(*(F.col(f"`{o}`") for o in order), flag.alias("_gone"), row.alias("_row")).alias("_order"))
    return d.groupBy("_b", *(f"_k{i}" for i in range(len(table.keys)))).agg(F.max_by(F.struct("_gone", "_row"), "_order").alias("_x")).select("_b", "_x._gone", "_x._row")


def merge(spark: SparkSession, root: str, new: DataFrame, order: list[str], gone: str | None = None, tries: int = 20) -> int:
    """Replaces or adds the row of each key of ``new`` and returns the version; no rows, no commit.

    Of several rows of one key the last by ``order`` counts, nulls first, ties to the larger
    row. Rows whose flag ``gone`` is set remove their key. Null keys are keys like others.
    Columns that the table lacks are not kept. A run that fails leaves a folder no version
    names.
    """
    table = snapshot(spark, root)
    draft = f"{root}/drafts/{uuid.uuid4().hex}"
    _reduced(table, new, order, gone).write.parquet(draft)
    news = spark.read.parquet(draft)
    touched = sorted(r[0] for r in news.select("_b").distinct().collect())  # at most one a bucket
    try:
        for _ in range(tries if touched else 0):
            folder = f"data/{uuid.uuid4().hex}"
            old = table.rows([b for b in touched if b in table.folders])
            columns = [F.col(f"`{c}`") for c in old.columns]
            both = old.select(table.bucket().alias("_b"), F.lit(0).alias("_new"), F.lit(False).alias("_gone"), F.struct(*columns).alias("_row"))
            both = both.unionByName(news.select("_b", F.lit(1).alias("_new"), "_gone", "_row"))
            keys = [F.col(f"_row.`{k}`").alias(f"_k{i}") for i, k in enumerate(table.keys)]
            # dealt by bucket, so that a bucket is one file; grouping by key within needs no further exchange
            last = both.repartition("_b").groupBy("_b", *keys).agg(F.max_by(F.struct("_gone", "_row"), "_new").alias("_x"))
            left = last.where("not _x._gone").select(F.col("_b").alias(DEALT), "_x._row.*")
            left.write.partitionBy(DEALT).parquet(f"{root}/{folder}")
            have = {int(n.removeprefix(f"{DEALT}=")) for n in commits.names(spark, f"{root}/{folder}") if n.startswith(f"{DEALT}=")}
            changed = {b: f"{folder}/{DEALT}={b}" if b in have else None for b in touched}
            record = {"kind": "merge", "folders": changed}
            if table.version % STATE_EVERY == 0:
                record = {"kind": "state", "folders": {b: f for b, f in (table.folders | changed).items() if f}}

            def check(later: list[dict], whole: bool = record["kind"] == "state") -> None:
                if later and (whole or any(int(b) in touched for c in later for b in c["folders"])):
                    raise Conflict("a bucket was merged by another writer")

            try:
                return commits.commit(spark, root, record, table.version, check)
            except Conflict:
                _delete(spark, f"{root}/{folder}")
                table = snapshot(spark, root)
        if touched:
            raise Conflict(f"lost against other writers {tries} times")
        return table.version
    finally:
        _delete(spark, draft)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the bucket folders that none of the last ``keep`` versions names; returns how many.

    Folders that no version ever named may belong to a writer at work and stay.
    """
    last = commits.latest(spark, root)
    if not last:
        return 0
    live = {f for v in range(max(1, last - keep + 1), last + 1) for f in snapshot(spark, root, v).folders.values()}
    named = {f for c in commits.since(spark, root, 0) for f in c["folders"].values() if f}
    dead = [f for f in sorted(named - live) if commits.names(spark, f"{root}/{f}")]
    for f in dead:
        _delete(spark, f"{root}/{f}")
    return len(dead)
