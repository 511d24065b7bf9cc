"""Quality rules learnt as a decision list, in DataFrame functions only.

Text statistics are computed once, per row, without explode or shuffle: windows of
eight words are compared inside the row by chained 64-bit hashes. Sequential covering
then learns ordered rules from labelled rows: each rule grows by the threshold with
the largest information gain, read off histograms that Spark sums over all labelled
rows, and is pruned on rows kept aside. The list is emitted as one ordered
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .toxicity import BROADCAST_ROWS

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_EMPTY = "cast(array() as array<bigint>)"


def _paired(name: str, gap: int) -> Column:
    """Hash of each entry of an array with the one ``gap`` places on."""
    n = f"greatest(size({name}) - {gap}, 0)"
    return F.expr(f"if({n} = 0, {_EMPTY}, zip_with(slice({name}, 1, {n}), slice({name}, {gap + 1}, {n}), (a, b) -> xxhash64(a, b)))")


STATISTICS = ("word_chars", "n_words", "n_symbols", "n_upper", "n_bangs", "n_digits", "n_lines", "n_dup_lines", "n_distinct_words", "n_repeat_words")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text and with counts of its words, lines and characters; a null text has no words.

    Columns of ``docs`` named like a statistic give way to it.
    """
    own = [c for c in docs.columns if c != text_col and c not in STATISTICS]
    keep = ["_own"]  # a struct, so that no name of theirs meets one of those below
    d = docs.select(F.struct(*own).alias("_own") if own else F.lit(0).alias("_own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", F.trim(F.translate("_t", "\t\n\x0b\f\r", "     ")).alias("_s"))
    d = d.select(*keep, "_t", F.expr("if(_s = '', cast(array() as array<string>), split(_s, ' +'))").alias("_w"), F.length(F.replace("_s", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"))
    d = d.select(
        *keep, "word_chars", F.size("_w").cast("long").alias("n_words"), F.expr("transform(_w, w -> xxhash64(w))").alias("_h"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        (F.length("_t") - F.length(F.translate("_t", "0123456789", ""))).cast("long").alias("n_digits"),
        F.expr(r"filter(split(_t, '\n'), l -> rlike(l, '[^ \\t-\\r]'))").alias("_l"),
    )
    d = d.select(*[c for c in d.columns if c not in ("_l", "_h")], "_h", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("_h")).cast("long").alias("n_distinct_words"))
    rest = [c for c in d.columns if c != "_h"]
    d = d.select(*rest, _paired("_h", 1).alias("_h"))
    d = d.select(*rest, _paired("_h", 2).alias("_h"))
    d = d.select(*rest, _paired("_h", 4).alias("_h"))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(*rest, F.when(repeats, F.expr("sort_array(zip_with(_h, sequence(0, size(_h) - 1), (a, i) -> struct(a, i)))")).alias("_o"))
    d = d.select(*rest, F.expr("filter(zip_with(slice(_o, 1, size(_o) - 1), slice(_o, 2, size(_o) - 1), (x, y) -> if(x.a = y.a, array(x.i, y.i), cast(null as array<int>))), p -> p is not null)").alias("_p"))
    d = d.select(*rest, F.expr("sort_array(array_distinct(flatten(_p)))").alias("_q"))
    covered = F.expr(f"aggregate(zip_with(slice(_q, 1, size(_q) - 1), slice(_q, 2, size(_q) - 1), (x, y) -> least({WINDOW}, y - x)), 0, (s, x) -> s + x) + {WINDOW}")
    d = d.select(*rest, F.coalesce(F.when(F.col("_q").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.select(*(["_own.*"] if own else []), *STATISTICS)


def _ratio(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules may test, by name."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_char": _ratio("n_symbols", "word_chars"),
        "upper_per_char": _ratio("n_upper", "word_chars"),
        "bangs_per_word": _ratio("n_bangs", "n_words"),
        "digits_per_char": _ratio("n_digits", "word_chars"),
        "dup_lines_share": _ratio("n_dup_lines", "n_lines"),
        "repeated_share": _ratio("n_repeat_words", "n_words"),
        "distinct_share": _ratio("n_distinct_words", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds names the rule that rejects a text, none keeps it."""

    rules: list[list[Test]] = field(default_factory=list)

    def column(self) -> Column:
        out = None
        for rule in self.rules:
            cond = rule[0].column()
            for test in rule[1:]:
                cond = cond & test.column()
            name = F.lit(" and ".join(map(str, rule)))
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return F.lit(None).cast("string") if out is None else out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """FOIL's gain of narrowing p0 positives and n0 negatives to p and n."""
    if p <= 0:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, key: str = "doc_id", label: str = "quality", max_rules: int = 12, max_tests: int = 3, precision: float = 0.95, least: int = 5, cuts: int = 32) -> DecisionList:
    """A decision list that rejects rows whose ``label`` is 0, from text statistics with labels.

    A third of the rows, by a hash of ``key``, prunes and accepts rules: a rule is
    taken if it rejects bad rows with ``precision`` there, at least ``least`` of them
    counting both parts. Thresholds are quantiles of each label's rows. All counts
    are sums in Spark over all labelled rows; the driver sees histograms only.
    """
    names = list(features())
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 0).cast("long").alias("bad"), (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("prune")), F.lit(3)) == 0).alias("aside"), *(c.alias(n) for n, c in features().items())
    )
    shares = [(k + 0.5) / cuts for k in range(cuts)]
    spread = rows.groupBy("bad").agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in names)).collect()
    if len(spread) < 2:
        return DecisionList()
    points = {n: sorted({float(v) for r in spread for v in r[n]}) for n in names}
    between = {n: [(a + b) / 2 for a, b in zip(p, p[1:])] or p for n, p in points.items()}
    bins = F.array(*(sum(((F.col(n) > v).cast("int") for v in between[n]), F.lit(0)) for n in names))
    table = written(rows.select("bad", "aside", bins.alias("bins")), "quality")

    def met(rule: list[tuple[int, bool, int]]) -> Column:
        cond = F.lit(True)
        for f, above, at in rule:
            here = F.col("bins")[f]
            cond = cond & ((here > at) if above else (here <= at))
        return cond

    done: list[list[tuple[int, bool, int]]] = []
    out = DecisionList()
    while len(done) < max_rules:
        left = table
        for rule in done:
            left = left.where(~met(rule))
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < max_tests:
            hist = left.where(~F.col("aside")).where(met(rule)).select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for r in hist:
                by.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
            p0, n0 = (sum(x[k] for x in by.get(0, {}).values()) for k in (0, 1))
            if p0 == 0 or n0 == 0:
                break
            best = (0.0, None)
            for f, own in sorted(by.items()):
                p = n = 0
                for at in sorted(own)[:-1]:
                    p, n = p + own[at][0], n + own[at][1]
                    for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if (g := _gain(p0, n0, x, y)) > best[0] + 1e-9:
                            best = (g, (f, above, at))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        parts = [rule[: k + 1] for k in range(len(rule))]
        sums = left.groupBy("aside").agg(*(x for k, part in enumerate(parts) for x in (F.sum(F.when(met(part), F.col("bad")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(met(part), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}")))).collect()
        aside = next((r for r in sums if r["aside"]), None)
        ranked = []
        for k, part in enumerate(parts):
            p, n = (aside[f"p{k}"], aside[f"n{k}"]) if aside else (0, 0)
            both = sum(r[f"p{k}"] for r in sums)
            wrong = sum(r[f"n{k}"] for r in sums)
            if p + n and p / (p + n) >= precision and both / (both + wrong) >= precision and both >= least:
                ranked.append(((p - n) / (p + n), p, -k, part))
        if not ranked:
            break
        rule = max(ranked, key=lambda x: x[:3])[3]
        done.append(rule)
        out.rules.append([Test(names[f], above, between[names[f]][at]) for f, above, at in rule])
    return out


def _sized(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """``marks`` for a broadcast if the label table has few enough rows."""
    return F.broadcast(marks) if labels.count() <= BROADCAST_ROWS else marks


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for every row of ``docs``.

    ``kept`` is false where the fixed base limits fail, else where a learnt rule
    rejects the text; ``rule`` names that rule. A null or empty text has no words and
    fails. Repeated rows are returned as often as they come in; null ids are judged
    and never learnt from; labels other than 0 and 1 are ignored, of contradicting
    ones the larger counts; without labels of both kinds only the base limits judge;
    an empty table gives an empty result; other columns are ignored.
    """
    stats = written(text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "quality")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rules = learn(stats.where(~base_failed()).join(marks, "doc_id"))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rules.column()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base limits and the rules learnt from all labelled rows among them."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_sized(marks, labels), "doc_id")
    stats = written(text_statistics(known), "quality")
    rules = learn(stats.where(~base_failed()))
    whole = text_statistics(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    # with a column that is not deterministic the filter stays above the statistics, which else were computed in it again and again
    whole = whole.withColumn("_stay", F.monotonically_increasing_id())
    return whole.where(~base_failed() & rules.column().isNull() & (F.col("_stay") >= 0)).select("_row.*")
