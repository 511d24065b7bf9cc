"""Phrase collocations: n-grams counted by the PCY and DHP bucket method, pass by pass.

Pass 1 counts words exactly and, in the same scan, the bucket of every bigram. Pass 2
counts bigrams exactly, but only those whose words are frequent (Apriori) and whose
bucket is (PCY), and counts the buckets of trigrams made of such bigrams (DHP). Pass 3
counts the trigrams whose two bigrams are frequent and whose bucket is. What decides is
broadcast as bitmaps: bit b says that bucket b holds at least the least count. There
is a bucket for every ``BUCKET_BYTES`` of text, up to ``MOST_BUCKETS``, which bounds the
broadcast. Two phrases in one bucket only let an infrequent one through to the exact
count, so results are whole with any number of buckets; more of them prune more.

A task cuts texts into words with array operations on their bytes, gives each distinct
word of a block a number through Arrow's dictionary and counts n-grams as packed
numbers; it hands bucket counts on before they exceed ``HELD_BUCKETS``, so its memory is
bounded by the block, those and the bitmaps. Counts are summed by
Spark, first in the task; scores are exact decimals of 38 digits.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, written

LEAST = 10
TOP = 2000
#: Bytes of text for a bucket, and the most and the fewest buckets (a bit each in the broadcast).
BUCKET_BYTES, MOST_BUCKETS, FEWEST_BUCKETS = 8, 1 << 28, 1 << 20
#: Buckets with a count that a task holds.
HELD_BUCKETS = 1 << 22
#: Buckets in a row on the way from tasks to bitmaps.
SPAN = 1 << 16
#: Bytes of text that a task looks at together.
BLOCK_BYTES = 4 << 20
#: Groups in which a language's candidates are ranked before the best of each meet.
SALTS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in words, 1 between words of a piece, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Block:
    """The words of some texts of one language: ``code`` numbers them, ``words`` names the numbers; ``joined[i]`` if words i and i + 1 are of one piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(first) + 1, np.int32 if len(raw) < 1 << 31 else np.int64)
        np.cumsum(end - first, out=offsets[1:])
        wide = offsets.dtype == np.int64
        words = (pa.LargeBinaryArray if wide else pa.BinaryArray).from_buffers(pa.large_binary() if wide else pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        breaks = np.cumsum(kind == 2, dtype=np.int64)
        piece = breaks[first] if len(first) else np.zeros(0, np.int64)
        self.joined = piece[1:] == piece[:-1]

    def hashes(self) -> np.ndarray:
        """64 bits for each distinct word, the language's own."""
        seed = xxhash.xxh64_intdigest(self.lang.encode("utf-8", "surrogatepass"))
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct bigrams' first and second numbers, their counts, and for each word the number of the bigram it begins or -1."""
        size = max(1, len(self.words))
        packed = self.code[:-1][self.joined] * size + self.code[1:][self.joined]
        distinct, at, count = np.unique(packed, return_inverse=True, return_counts=True)
        begun = np.full(len(self.code), -1, np.int64)
        begun[:-1][self.joined] = at
        return distinct // size, distinct % size, count, begun

    def trigrams(self, begun: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct trigrams both of whose bigrams are in ``keep``: the number of the first bigram, of the second, and the count."""
        if len(begun) < 3:
            return (np.zeros(0, np.int64),) * 3
        one, two = begun[:-1], begun[1:]
        both = (one >= 0) & (two >= 0)
        one, two = one[both], two[both]
        both = keep[one] & keep[two]
        size = max(1, len(keep))
        distinct, count = np.unique(one[both] * size + two[both], return_counts=True)
        return distinct // size, distinct % size, count


def _mixed(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several in their order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out


class Counters:
    """Bucket counts of a task, each up to 255; only buckets with a count are held."""

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    @staticmethod
    def _summed(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")
        at, counts = at[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[first], np.minimum(255, np.add.reduceat(counts, first, dtype=np.int64)).astype(np.uint8)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        if len(hashes):
            self.parts.append(self._summed((hashes & self.mask).astype(np.uint32), np.minimum(counts, 255)))
            self.held += len(self.parts[-1][0])

    def full(self) -> bool:
        """Whether more than ``HELD_BUCKETS`` are held after equal ones are summed."""
        if self.held > HELD_BUCKETS:
            self._fold()
            # near the limit each block would be summed with all that is held
            return self.held > HELD_BUCKETS // 2
        return False

    def _fold(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.held = len(self.parts[0][0])

    def spans(self):
        """(span, places as 16 bits, counts) of the spans with a count; nothing is held after."""
        self._fold()
        parts, self.parts, self.held = self.parts, [], 0
        for at, counts in parts:
            cut = np.flatnonzero(np.diff(at // SPAN, prepend=np.uint32(0xFFFFFFFF)))
            for low, high in zip(cut, [*cut[1:], len(at)]):
                yield int(at[low]) // SPAN, (at[low:high] % SPAN).astype("<u2").tobytes(), counts[low:high].tobytes()


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set in a bitmap."""
    at = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _bits(places: np.ndarray, size: int) -> bytes:
    marked = np.zeros(size, np.uint8)
    marked[places] = 1
    return np.packbits(marked, bitorder="little").tobytes()


def _merged_spans(spans: DataFrame, least: int, buckets: int) -> DataFrame:
    """Rows (span, bits) of the buckets with ``least`` or more in all tasks; a task holds one span's sums at a time."""

    def start():
        state = {"span": None, "sum": None}
        size = min(SPAN, buckets)

        def closed():
            if state["span"] is not None:
                bits = _bits(np.flatnonzero(state["sum"] >= least), size)
                yield pa.RecordBatch.from_arrays([pa.array([state["span"]], pa.int32()), pa.array([bits], pa.binary())], names=["span", "bits"])

        def step(batch: pa.RecordBatch):
            for span, at, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if span != state["span"]:
                    yield from closed()
                    state.update(span=span, sum=np.zeros(size, np.int64))
                state["sum"][np.frombuffer(at, "<u2")] += np.frombuffer(count, np.uint8)  # places of a row are distinct

        step.end = closed
        return step

    grouped = spans.select("span", "places", "counts").repartition(F.col("span")).sortWithinPartitions("span")
    return map_batches(grouped, start, "span int, bits binary")


def _marked(grams: DataFrame, names: list[str], buckets: int) -> DataFrame:
    """Rows (span, bits) that mark the hash of each phrase (lang, words...)."""

    def start():
        def step(batch: pa.RecordBatch):
            columns = [c.to_pylist() for c in batch.columns]
            seeds = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in columns[0]]
            each = [np.fromiter((xxhash.xxh64_intdigest(w, s) for w, s in zip(c, seeds)), np.uint64, len(seeds)) for c in columns[1:]]
            hashes = each[0] if len(each) == 1 else _mixed(*each)
            at = np.unique(hashes & np.uint64(buckets - 1)).astype(np.int64)
            cut = np.flatnonzero(np.diff(at // SPAN, prepend=-1))
            parts = np.split(at, cut[1:]) if len(at) else []
            return pa.RecordBatch.from_arrays([pa.array([int(p[0]) // SPAN for p in parts], pa.int32()), pa.array([(p % SPAN).astype("<u2").tobytes() for p in parts], pa.binary()), pa.array([b"\x01" * len(p) for p in parts], pa.binary())], names=["span", "places", "counts"])

        return step

    bits = map_batches(grams.select("lang", *(F.col(n).cast("binary").alias(n) for n in names)), start, "span int, places binary, counts binary")
    return _merged_spans(bits, 1, buckets)


def _bitmap(spans: DataFrame, buckets: int) -> np.ndarray:
    """The bitmap on the driver: ``buckets`` bits, whatever the corpus."""
    size = min(SPAN, buckets) // 8
    out = np.zeros(buckets // 8, np.uint8)
    for r in spans.toLocalIterator():
        out[r["span"] * size : (r["span"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


PASS = "lang string, w1 binary, w2 binary, w3 binary, n long, span int, places binary, counts binary"
_KINDS = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = [f.split()[0] for f in PASS.split(", ")]


def _grams(lang: str, words: list[pa.Array], count: np.ndarray) -> pa.RecordBatch:
    n = len(count)
    columns = [pa.array([lang] * n, pa.string()), *(w.cast(pa.binary()) for w in words), *(pa.nulls(n, pa.binary()) for _ in range(3 - len(words))), pa.array(count.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, k) for k in _KINDS[5:])], names=_NAMES)


def _span_rows(counters: Counters):
    rows = counters.spans()
    while part := list(islice(rows, 512)):
        span, places, counts = zip(*part)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), k) for k in _KINDS[:5]), pa.array(span, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=_NAMES)


def scan(docs: DataFrame, order: int, buckets: int, items=None, frequent=None) -> DataFrame:
    """Rows of ``PASS`` of one pass over ``docs`` (lang, text): partial counts of phrases of ``order`` words, and of the buckets of the next order.

    ``items`` and ``frequent`` are broadcast bitmaps: of the frequent phrases one word
    shorter, and of the frequent buckets of this order.
    """

    def start():
        known = np.frombuffer(items.value, np.uint8) if items else None
        dense = np.frombuffer(frequent.value, np.uint8) if frequent else None
        counters = Counters(buckets) if order < 3 else None
        held: dict[str, list[bytes]] = {}
        size = [0]

        def counted(lang: str, texts: list[bytes]):
            block = Block(lang, texts)
            if not len(block.code):
                return
            h = block.hashes()
            one, two, count, begun = block.bigrams()
            if order == 1:
                counters.add(_mixed(h[one], h[two]), count)
                yield _grams(lang, [block.words], np.bincount(block.code, minlength=len(block.words)))
                return
            pair = _mixed(h[one], h[two])
            keep = has(known, pair) if order == 3 else has(known, h[one]) & has(known, h[two]) & has(dense, pair)
            a, b, times = block.trigrams(begun, keep)
            triple = _mixed(h[one[a]], h[two[a]], h[two[b]])
            if order == 2:
                counters.add(triple, times)
                yield _grams(lang, [block.words.take(pa.array(x[keep])) for x in (one, two)], count[keep])
            else:
                some = has(dense, triple)
                a, b, times = a[some], b[some], times[some]
                yield _grams(lang, [block.words.take(pa.array(x)) for x in (one[a], two[a], two[b])], times)

        def flush():
            for lang, texts in held.items():
                yield from counted(lang, texts)
                if counters and counters.full():
                    yield from _span_rows(counters)
            held.clear()
            size[0] = 0

        def step(batch: pa.RecordBatch):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    size[0] += len(text)
                    if size[0] >= BLOCK_BYTES:
                        yield from flush()

        def end():
            yield from flush()
            if counters:
                yield from _span_rows(counters)

        step.end = end
        return step

    return map_batches(docs, start, PASS)


def _summed(rows: DataFrame, order: int, least: int) -> DataFrame:
    names = [f"w{k}" for k in range(1, order + 1)]
    return rows.where("span is null").groupBy("lang", *names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _shared_bits(spark: SparkSession, spans: DataFrame, buckets: int):
    return spark.sparkContext.broadcast(_bitmap(spans, buckets).tobytes())


def counts(docs: DataFrame, least: int = LEAST, buckets: int | None = None, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Per language all words, and the words, bigrams and trigrams that occur ``least`` times or more: (lang, n), (lang, w1, f), (lang, w1, w2, f), (lang, w1, w2, w3, f)."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if buckets is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))
    if buckets & (buckets - 1) or not 8 <= buckets <= 1 << 32 or not 1 <= least <= 255:
        raise ValueError("buckets must be a power of two from 8 to 2^32, least from 1 to 255")
    first = written(scan(source, 1, buckets), "phrases-1")
    whole = written(first.where("span is null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-n")
    words = written(_summed(first, 1, least), "phrases-words")
    known, dense = _shared_bits(spark, _marked(words, ["w1"], buckets), buckets), _shared_bits(spark, _merged_spans(first.where("span is not null"), least, buckets), buckets)
    second = written(scan(source, 2, buckets, known, dense), "phrases-2")
    bigrams = written(_summed(second, 2, least), "phrases-bigrams")
    known.unpersist()
    dense.unpersist()
    known, dense = _shared_bits(spark, _marked(bigrams, ["w1", "w2"], buckets), buckets), _shared_bits(spark, _merged_spans(second.where("span is not null"), least, buckets), buckets)
    trigrams = written(_summed(scan(source, 3, buckets, known, dense), 3, least), "phrases-trigrams")
    known.unpersist()
    dense.unpersist()
    return whole, words, bigrams, trigrams


def _score():
    """floor(1000000 * a * a / (l * r)) in decimals of up to 38 digits: exact for counts below 10^15."""
    long = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", long("a") * long("a") * F.lit(1_000_000).cast("decimal(7,0)"), long("l") * long("r"))


def candidates(words: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Rows (lang, w1, w2, w3, a, l, r, score): every phrase at its lowest-scoring cut, ties to the earlier one."""
    w = lambda name, by: words.select("lang", F.col("w1").alias(by), F.col("f").alias(name))
    b = lambda name, *by: bigrams.select("lang", F.col("w1").alias(by[0]), F.col("w2").alias(by[1]), F.col("f").alias(name))
    two = bigrams.withColumnRenamed("f", "a").join(w("l", "w1"), ["lang", "w1"]).join(w("r", "w2"), ["lang", "w2"]).withColumn("score", _score())
    three = trigrams.withColumnRenamed("f", "a").join(w("l1", "w1"), ["lang", "w1"]).join(w("r2", "w3"), ["lang", "w3"]).join(b("l2", "w1", "w2"), ["lang", "w1", "w2"]).join(b("r1", "w2", "w3"), ["lang", "w2", "w3"])
    three = three.select("lang", "w1", "w2", "w3", "a", F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r"))))).withColumn("score", _score())
    three = three.groupBy("lang", "w1", "w2", "w3", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "w1", "w2", "w3", "a", "x.l", "x.r", "x.score")
    return two.select("lang", "w1", "w2", F.lit(None).cast("binary").alias("w3"), "a", "l", "r", "score").unionByName(three)


def maximal(found: DataFrame) -> DataFrame:
    """``found`` without the bigrams inside a trigram that occurs at least half as often."""
    inside = found.where("w3 is not null").select("lang", F.col("a").alias("longer"), F.inline(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))))
    most = inside.groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    short = found.where("w3 is null").join(most, ["lang", "w1", "w2"], "left").where("longer is null or 100 * longer < 50 * a")
    return short.select(*found.columns).unionByName(found.where("w3 is not null"))


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, buckets: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    A null or empty text has no words; null languages are ``und``, as are documents so
    marked. Repeated rows count as often as they come in; ties in score and count go
    by the phrase's bytes. Phrases never cross a piece or a text. An empty table, or
    one without frequent phrases, gives an empty result. Other columns are ignored.
    A task works on whole texts of about ``BLOCK_BYTES`` together, one text at least.
    """
    whole, words, bigrams, trigrams = counts(docs, least, buckets, text_col, lang_col)
    found = maximal(written(candidates(words, bigrams, trigrams), "phrases-candidates"))
    named = found.select("lang", F.concat_ws(" ", F.col("w1").cast("string"), F.col("w2").cast("string"), F.col("w3").cast("string")).alias("phrase"), "a", "l", "r", "score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
