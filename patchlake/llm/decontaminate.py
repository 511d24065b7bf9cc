"""Benchmark decontamination with a broadcast hash set of the benchmark's word windows.

Every window of an item (ten consecutive words, or the whole item if it has fewer) is
normalised, hashed and entered in one index, each distinct window once. Documents are
cut into words inside their row, every window of theirs is hashed and looked up in the
broadcast index, and hits are verified word by word in the join itself, so only true
hits leave it. They are gathered by document in the task that scanned it. From them
come the spans of words hit, which a caller may cut out, and the items hit.

The index is broadcast only up to ``BLOCK_BYTES``, measured before; a larger one goes
out in blocks, each scanned against all documents and its hits written before the next.
Windows with the same items form one class, told apart by a hash of their item set, so
a window that a third of all items share is one entry of one class, and documents hit
alike share one list of items. Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Words of a window.
WINDOW = 10
#: What stands between the words of a text whose A-Z are lower-cased: ASCII other than digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text as it came, with what follows each, and what stands before the first.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
LEAD = r"\A[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the index that go out in one broadcast.
BLOCK_BYTES = 64 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; a text of ASCII alone takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK), "")


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id as text, window, length), each window of an item once; an item without words has none."""
    cut = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    cut = cut.withColumn("length", F.least(F.size("words"), F.lit(size)))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1))
    return cut.select("item_id", "words", "length", at.alias("at")).select("item_id", F.slice("words", F.col("at"), F.col("length")).alias("window"), "length").distinct()


class Index:
    """The distinct windows of a benchmark and the items of each class of windows.

    ``windows``: (h, window, length, class); ``items``: (class, item_id). A class is
    named by its first window's hash; classes are found by count, exclusive or and sum
    of the hashes of their items' ids, so no list of items is ever gathered.
    """

    def __init__(self, benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text"):
        found = written(item_windows(benchmark, size, id_col, text_col), "decontaminate-items")
        marks = [F.count("item_id").alias("n"), F.bit_xor(F.xxhash64("item_id")).alias("x"), F.sum(F.xxhash64(F.lit("s"), F.col("item_id")).cast("decimal(20,0)")).alias("s")]
        sets = written(found.groupBy("window", "length").agg(*marks).withColumn("h", F.xxhash64("window")), "decontaminate-sets")
        same = [F.col("n").eqNullSafe(F.col("cn")), F.col("x").eqNullSafe(F.col("cx")), F.col("s").eqNullSafe(F.col("cs"))]
        first = sets.groupBy(F.col("n").alias("cn"), F.col("x").alias("cx"), F.col("s").alias("cs")).agg(F.min(F.struct("h", "window")).alias("first"))
        self.windows = written(sets.join(first, same[0] & same[1] & same[2]).select("h", "window", "length", F.xxhash64("first").alias("class")), "decontaminate-index")
        named = first.select(F.col("first.window").alias("window"), F.xxhash64("first").alias("class"))
        self.items = written(found.where("item_id is not null").join(named, "window").select("class", "item_id"), "decontaminate-classes")
        told = self.windows.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 16 * F.col("length") + 64), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")).first()
        self.bytes, self.lengths = told["bytes"], sorted(told["lengths"])  # at most as many lengths as a window has words


def _scanned(docs: DataFrame, windows: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, copy, marks, classes): the places (at, length) of windows in each document hit, and the windows' classes."""
    cut = docs.select(F.col(id_col).alias("doc"), _copy(F.col(text_col)).alias("copy"), words(F.col(text_col)).alias("words"))
    each = cut.select("doc", "copy", "words", F.explode(F.array(*map(F.lit, lengths))).alias("length")) if len(lengths) > 1 else cut.withColumn("length", F.lit(lengths[0]))
    # not a filter, which would cut the text into words once more
    places = F.when(F.size("words") >= F.col("length"), F.sequence(F.lit(1), F.size("words") - F.col("length") + 1))
    each = each.select("doc", "copy", "words", F.col("length").alias("own_length"), F.explode(places).alias("at"))
    own = F.slice("words", F.col("at"), F.col("own_length"))
    probes = each.select("doc", "copy", "at", "own_length", own.alias("own"), F.xxhash64(own).alias("own_h"))
    # "between" and not "=": the words are compared at hits only and stay out of the join's key, which is one long
    hit = probes.join(F.broadcast(windows), (F.col("own_h") == F.col("h")) & F.col("window").between(F.col("own"), F.col("own")))
    marks = F.collect_set(F.struct("at", F.col("length"))).alias("marks")
    return hit.groupBy("doc", "copy").agg(marks, F.collect_set("class").alias("classes"))


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), RAW_BREAK), "")).cast("long")


def _copy(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def hits(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc, copy, spans, n_hit, classes) of documents with a hit.

    ``spans`` are the maximal runs (first, last) of word places hit, from 1, ascending;
    equal rows (id and text) share one row here.
    """
    spark, blocks = docs.sparkSession, -(-index.bytes // block_bytes)
    schema = f"doc {docs.schema[id_col].dataType.simpleString()}, copy string, marks array<struct<at:int,length:int>>, classes array<bigint>"
    if not blocks:
        found = spark.createDataFrame([], schema)
    else:
        path = fresh_path(spark, "decontaminate-hits")
        for block in range(blocks):
            part = index.windows if blocks == 1 else index.windows.where(F.pmod(F.xxhash64(F.lit("block"), F.col("h")), F.lit(blocks)) == block)
            _scanned(docs, part, index.lengths, id_col, text_col).write.mode("append").parquet(path)
        found = spark.read.schema(schema).parquet(path)
    if blocks > 1:
        found = found.groupBy("doc", "copy").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"), F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("marks", lambda m: F.sequence(m["at"], m["at"] + m["length"] - 1)))))
    found = found.select("doc", "copy", "classes", places.alias("places"))
    p = F.col("places")
    firsts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
    lasts = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
    spans = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return written(found.select("doc", "copy", spans.alias("spans"), F.size(p).cast("long").alias("n_hit"), F.array_sort("classes").alias("classes")), "decontaminate-spans")


def items_hit(found: DataFrame, index: Index) -> DataFrame:
    """Rows (classes, item_id): the items of each distinct set of classes, each once."""
    sets = found.select("classes").distinct()
    return sets.select("classes", F.explode("classes").alias("class")).join(index.items, "class").select("classes", "item_id").distinct()


def _beside(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of ``docs`` as ``row`` with the hits of its id and text, if any."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own"), _copy(F.col(text_col)).alias("own_copy"))
    return rows.join(found, F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_copy") == F.col("copy")), "left")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (id_col, n_words, n_hit, spans, items), one for every row of ``docs``.

    ``items`` are the ids of the items with an occurring window, as sorted text. A
    null or empty text has no words and no hits; items with a null id mark words but
    are not listed; items without words have no window; items of one id are one.
    Repeated rows are returned as often as they come in, null ids too; empty tables
    give no rows and no hits. Other columns are ignored.
    """
    index = Index(benchmark, size)
    found = hits(docs, index, id_col, text_col, block_bytes)
    lists = items_hit(found, index).groupBy("classes").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = written(found.join(lists, "classes", "left").select("doc", "copy", "spans", "n_hit", "items"), "decontaminate-found")
    rows = docs.select(F.col(id_col).alias("own"), _n_words(F.col(text_col)).alias("n_words"), _copy(F.col(text_col)).alias("own_copy"))
    joined = rows.join(found, F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_copy") == F.col("copy")), "left")
    empty = F.expr("cast(array() as array<string>)")
    return joined.select(F.col("own").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", empty).alias("items"))


def without_documents(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents of which more than ``least_share`` of the words are hit; columns as they were."""
    found = hits(docs, Index(benchmark, size), id_col, text_col).select("doc", "copy", "n_hit")
    n_words = _n_words(F.col(f"row.`{text_col}`"))
    return _beside(docs, found, id_col, text_col).where(F.col("n_hit").isNull() | (F.col("n_hit") <= F.lit(least_share) * n_words)).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words hit cut out of their texts, each with what stands between it and the next word; other rows and columns as they were."""
    found = hits(docs, Index(benchmark, size), id_col, text_col).select("doc", "copy", "spans")
    text = F.col(f"row.`{text_col}`").cast("string")
    d = _beside(docs, found, id_col, text_col).withColumn("pieces", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))))
    last = F.coalesce(F.array_max("spans.last"), F.lit(0))
    before = F.transform("spans", lambda s, i: F.struct(F.coalesce(F.get(F.col("spans.last"), i - 1), F.lit(0)).alias("since"), s["first"].alias("upto")))
    kept = F.transform(before, lambda s: F.array_join(F.slice("pieces", s["since"] + 1, s["upto"] - s["since"] - 1), ""))
    tail = F.array_join(F.slice("pieces", last + 1, F.size("pieces") - last), "")
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.regexp_extract(text, LEAD, 0), F.array_join(kept, ""), tail))
    return d.select(*((clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
