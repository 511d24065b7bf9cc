"""Tables laid out for point look-ups: buckets by a hash of the key, sorted inside, with Bloom filters.

A look-up of one key opens one bucket, and of its files the row groups whose bounds and
Bloom filter admit the key, so its cost does not grow with the table. The rows are dealt
by ranges of bucket, key and order, so the rows of a hot key fill several files instead
of one task. The number of buckets and
the schema are kept beside the table, which may be empty.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits

LAYOUT = "_layout.json"
#: Bytes of a row group, so that a look-up reads little.
GROUP_BYTES = 1 << 20


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write(d: DataFrame, path: str, key: str, order: list[str], buckets: int = 64, files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Writes ``d`` clustered by ``key`` and sorted by ``order`` within it, into ``buckets`` folders. Null keys have a bucket like any other."""
    spark = d.sparkSession
    files = files or max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = d.withColumn("bucket", _bucket([F.col(key)], buckets))
    by = ["bucket", key, *order]
    writer = dealt.repartitionByRange(files, *by).sortWithinPartitions(*by).write.partitionBy("bucket").option("parquet.block.size", group_bytes)
    for c in (key, *order):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    commits.put_if_absent(spark, f"{path}/{LAYOUT}", json.dumps({"key": key, "order": order, "buckets": buckets, "schema": dealt.schema.jsonValue()}))


def _layout(spark: SparkSession, path: str) -> dict:
    return json.loads(commits.read_text(spark, f"{path}/{LAYOUT}"))


def _table(spark: SparkSession, path: str, told: dict) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(path)


def lookup(spark: SparkSession, path: str, key, *order) -> DataFrame:
    """The rows of one key, and of given values of the first columns of its order."""
    told = _layout(spark, path)
    d = _table(spark, path, told)
    wanted = F.lit(key).cast(d.schema[told["key"]].dataType)
    tests = [F.col("bucket") == _bucket([wanted], told["buckets"]), F.col(told["key"]) == wanted, *(F.col(c) == F.lit(v) for c, v in zip(told["order"], order))]
    return d.where(reduce(Column.__and__, tests)).drop("bucket")


def lookup_all(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The rows whose key, and whose order columns where ``asked`` has them, are asked for; each as often as it is there."""
    told = _layout(spark, path)
    by = [c for c in (told["key"], *told["order"]) if c in asked.columns]
    keys = asked.select(*by).distinct().withColumn("bucket", _bucket([F.col(told["key"])], told["buckets"]))
    return _table(spark, path, told).join(keys, ["bucket", *by], "left_semi").drop("bucket")
