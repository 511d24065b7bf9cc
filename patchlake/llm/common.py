"""Shared helpers: reading tables, tables in the shared folder, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD_BREAK = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine may leave it unset and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="patchlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and readable after executors are lost."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver runs outside its folder."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


#: Rows in a batch sent to a worker, and rows of it that are looked at together; texts may be long.
BATCH_ROWS, SLICE_ROWS = 2000, 500


def small_batches(spark: SparkSession) -> None:
    """Sends workers smaller batches than Spark's default, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that a task has freed back to the system; the worker may stay idle for long."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc here
        pass


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``start()`` is called once in a task and its result on every few hundred rows."""

    def run(batches):
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = step(batch.slice(at, SLICE_ROWS))
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        end = getattr(step, "end", None)
        if end is not None:
            yield from end()
        del step, end
        release()

    importable(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps of map-reduce connected
    components until the edge set stops changing: O(log^2 n) rounds, each a
    grouped minimum and an equi-join, so neither a node's neighbours nor a
    component ever meet in one task or on the driver. Every round is a table in
    the shared folder. Null or looping edges carry nothing and are ignored.
    Nodes without an edge are not returned.
    """

    def neighbours_min(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("u"), F.col("v")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = both.join(neighbours_min(both), "u").where("v > u")
        return out.select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(low, "u")
        return star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))

    e = edges.where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        e = written(small(large(e)).where("u <> v").distinct(), "cc")
        mark = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(pmod(xxhash64(v, u), 1000003) as long)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
