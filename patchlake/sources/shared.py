"""The folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine may leave it unset and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="patchlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return (root if ":/" in root else f"file://{os.path.abspath(root)}").rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(d: DataFrame, tag: str) -> DataFrame:
    """``d`` as a table in the shared folder: computed once, readable after executors are lost."""
    path = fresh_path(d.sparkSession, tag)
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)
