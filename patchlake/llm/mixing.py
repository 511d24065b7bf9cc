"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

A document's place in its source is a 48-bit hash of its id. Words are summed by
source and hash bucket; the bucket in which the budget runs out is refined by the
next bits until the threshold is a single hash value. Documents are then taken by a
comparison with their source's threshold: nothing is sorted, and no task ever sees
more of a source than one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HASH_BITS = 48
LEVEL_BITS = 16
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    flat = F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def place(key: Column) -> Column:
    """48 bits of the MD5 of the key as text; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size): weights repeat by code point of the source, null last.

    ``share`` of all words is dealt by weight; no target exceeds ``most`` times its
    source, what is above is dealt again by weight among the others. That is one
    common level a weight: sources are capped in the order of their cap per weight
    until the level of the rest stays below theirs.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
    d = d.withColumn("level", (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    d = d.withColumn("open", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    d = d.withColumn("level", F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return d.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows (source, edge, below, own): the hash ``edge`` at which the words of ``rows`` (source, h, size) exceed the source's budget.

    ``below`` words have a smaller hash, ``own`` have this one. Where all words fit,
    ``edge`` is past the last hash. ``budgets`` has (source, budget).
    """
    found = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(True).alias("inside"), F.lit(0).cast("long").alias("own"))
    found = written(found, "mixing")
    for left in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        at = found.where("inside").select(F.col("source").alias("s"), "prefix", "below", "budget")
        near = F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("h", left + LEVEL_BITS) == F.col("prefix"))
        sums = rows.join(at, near).groupBy("s", "below", "budget", F.shiftrightunsigned("h", left).alias("bucket")).agg(F.sum("size").alias("own"))
        up_to = F.col("below") + F.sum("own").over(Window.partitionBy("s").orderBy("bucket"))
        first = sums.withColumn("cum", up_to).where("cum > budget").groupBy("s").agg(F.min(F.struct("bucket", F.expr("cum - own").alias("below"), "own")).alias("x"))
        last = sums.groupBy("s").agg(F.max(F.expr("below")).alias("b0"), F.sum("own").alias("all"))
        both = first.select(F.col("s").alias("t"), "x").join(last, F.expr("s <=> t"), "right")
        step = both.select(F.col("s").alias("r"), F.col("x.bucket").alias("bucket"), F.coalesce("x.below", F.expr("b0 + all")).alias("b"), F.coalesce("x.own", F.lit(0)).alias("o"))
        joined = found.join(step, F.expr("source <=> r"), "left")
        found = written(
            joined.select(
                "source", "budget", F.coalesce("bucket", F.shiftleft("prefix", LEVEL_BITS)).cast("long").alias("prefix"),
                F.coalesce("b", "below").alias("below"), (F.col("inside") & F.col("bucket").isNotNull()).alias("inside"), F.coalesce("o", F.lit(0)).cast("long").alias("own"),
            ), "mixing",
        )
    return found.select("source", "budget", F.when(F.col("inside"), F.col("prefix")).otherwise(F.lit(1 << HASH_BITS)).alias("edge"), "below", F.when(F.col("inside"), F.col("own")).otherwise(0).alias("own"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, source, size, h) of ``docs``, rows (s, source_size, target, whole, rest, edge1, lack, edge2) of its sources and rows (hs, hh, heavy) of their heavy hashes.

    A hash is heavy if its rows fit the lack one by one and exceed it together: it is
    taken or left as a block, so the second pass leaves it out.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = written(sized.withColumn("h", place(F.col("doc_id"))), "mixing")
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixing")
    whole = F.when(F.col("source_size") > 0, F.floor(F.expr("target / nullif(source_size, 0) + 1e-9"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("whole", whole).withColumn("rest", F.greatest(F.expr("target - whole * source_size"), F.lit(0.0))), "mixing")
    one = threshold(sized, goal.select("source", F.col("rest").alias("budget")))
    one = one.select(F.col("source").alias("s1"), F.col("edge").alias("edge1"), (F.col("budget") - F.col("below")).alias("lack"))
    one = written(one, "mixing")
    left = sized.join(one, F.expr("source <=> s1")).where("h >= edge1 and size <= lack and size > 0").select("source", "h", "size", "lack")
    blocks = left.groupBy("source", "h").agg(F.sum("size").alias("all"), F.max("lack").alias("lack"))
    heavy = written(blocks.where("all > lack").select(F.col("source").alias("hs"), F.col("h").alias("hh"), F.lit(True).alias("heavy")), "mixing")
    left = left.join(heavy, F.expr("source <=> hs and h = hh"), "left_anti").select("source", "h", "size")
    two = threshold(left, one.select(F.col("s1").alias("source"), F.col("lack").alias("budget")))
    up = F.expr("own > 0 and (below + own) - budget < budget - below")
    two = two.select(F.col("source").alias("s2"), (F.col("edge") + up.cast("int")).alias("edge2"))
    plan = goal.join(one, F.expr("source <=> s1")).join(two, F.expr("source <=> s2")).select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", "edge1", "lack", "edge2")
    plan = written(plan, "mixing")
    return sized, plan, heavy


#: How often a row (size, h) beside its source's row of the plan and its heavy hash, if any, is taken; once more than as a whole only if the rest holds a word.
COPIES = "whole + cast(rest >= 1 and (h < edge1 or (heavy is null and size <= lack and h < edge2)) as int)"


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for every row of ``docs``.

    Each source takes all its documents as often as its target holds the source as a
    whole, and once more those below a hash threshold for the rest. What the rest then
    lacks is filled by a second, nested threshold over the documents above the first
    that are no larger than the lack, hashes that exceed it as a whole left out. A null
    text has size 0, and a null source is a source of its own; rows with equal ids share their fate, so repeated rows and
    null ids are taken or left together; an empty table gives an empty result; other
    columns are ignored.
    """
    sized, plan, heavy = mixing_plan(docs, id_col, source_col, text_col)
    out = sized.join(plan, F.expr("source <=> s")).join(heavy, F.expr("source <=> hs and h = hh"), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.expr(COPIES)).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them."""
    _, plan, heavy = mixing_plan(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), place(F.col("doc_id").cast("long")).alias("h"))
    taken = rows.join(plan, F.expr("source <=> s")).join(heavy, F.expr("source <=> hs and h = hh"), "left").select("_row", F.expr(COPIES).cast("int").alias("n")).where("n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "n"))).select("_row.*")
