"""SimHash near-duplicate detection by multi-index hashing.

A text's fingerprint holds, bit by bit, the majority over the hashes of its word
shingles. Two texts are linked when their fingerprints differ in few bits. Links
are found without comparing all pairs: the fingerprint is cut into segments, every
fingerprint is entered in one table per segment, and each looks up a small Hamming
ball around its own segment value. If a link may differ in ``radius`` bits and
there are ``m`` segments, one segment differs in at most ``radius // m`` bits, so
balls of that radius miss nothing. Matches are verified on the complete
fingerprint inside the join, so only true links are ever emitted.

Scale: equal fingerprints are collapsed before anything is joined (a third of all
rows may be one copy: it is one row here), rows of the index carry two longs, and
the joins are equi-joins on (segment, value) that adaptive execution can split.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, written

SEED = 42
#: Id lists of at most so many rows are broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = np.arange(8) * 256
_CHUNK = 1 << 16


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int):
    """XXH64 of the shingles in order, in chunks; the whole sequence if it is shorter than a shingle."""
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        shingles = zip(*(part[k:] for k in range(width)))
        yield np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, len(part) - width + 1)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits from a hash (splitmix64); word 0 is the hash itself."""
    if word == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def simhash(text: str | None, width: int = 3, n64: int = 1) -> list[int]:
    """The fingerprint as ``n64`` signed longs; zero for a text without words."""
    total, counts = 0, np.zeros((n64, 8, 8), np.int64)
    for h in shingle_hashes(ascii_words(text), width):
        total += len(h)
        for k in range(n64):
            at = (_mixed(h, k).view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel()
            counts[k] += np.bincount(at, minlength=2048).reshape(8, 256) @ _BYTE_BITS
    if not total:
        return [0] * n64
    return np.packbits((2 * counts > total).ravel(), bitorder="little").view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n64: int = 1) -> DataFrame:
    """Rows (id_col, f0, f1, ...): one long for every 64 bits. Null text counts as empty."""
    names = [f"f{k}" for k in range(n64)]

    def start():
        def step(batch: pa.RecordBatch):
            prints = np.array([simhash(t, width, n64) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, n64)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k]) for k in range(n64))], names=[id_col, *names])

        return step

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, start, f"{id_col} long, " + ", ".join(f"{n} long" for n in names))


def _masks(bits: int, ball: int) -> list[int]:
    return [sum(1 << b for b in at) for r in range(1, ball + 1) for at in combinations(range(bits), r)]


def segment_matches(prints: DataFrame, node: str, segments: list[tuple[int, int, int]], ball: int, keep: Column) -> DataFrame:
    """Pairs (a, b) of nodes that share a segment up to ``ball`` bits and satisfy ``keep`` on (x.f0, y.f0).

    ``prints`` has a distinct long ``node`` and the words f0, f1, ...; a segment is
    (word, lowest bit, bits). For a ball of one bit only the flips of unset bits are
    looked up: of two values that differ in one bit exactly one has it unset, so
    each pair is met once and half the probes suffice.
    """
    values = F.array(*(F.struct(F.lit(i).alias("s"), F.shiftrightunsigned(F.col(f"f{w}"), lo).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (w, lo, n) in enumerate(segments)))
    widest = max(n for _, _, n in segments)
    one = ball <= 1
    seg = prints.select(F.col(node).cast("long").alias("id"), "f0", F.inline(values))
    key = lambda v: F.shiftleft(F.col("s").cast("long"), widest).bitwiseOR(v)
    table = seg.select(key(F.col("v")).alias("k"), F.col("id").alias("y"), F.col("f0").alias("g0"))
    same = seg.select(key(F.col("v")).alias("k"), F.col("id").alias("x"), F.col("f0").alias("h0"), F.lit(True).alias("same"))
    probes = same
    if ball:
        sizes = {n: F.array(*(F.lit(m).cast("long") for m in _masks(n, ball))) for n in {n for _, _, n in segments}}
        flips = None
        for n, masks in sizes.items():
            own = [i for i, (_, _, b) in enumerate(segments) if b == n]
            part = seg.where(F.col("s").isin(own)).select("id", "f0", "s", "v", F.explode(masks).alias("m"))
            if one:
                part = part.where(F.col("v").bitwiseAND(F.col("m")) == 0)
            part = part.select(key(F.col("v").bitwiseXOR(F.col("m"))).alias("k"), F.col("id").alias("x"), F.col("f0").alias("h0"), F.lit(False).alias("same"))
            flips = part if flips is None else flips.unionByName(part)
        probes = same.unionByName(flips)
    order = F.col("x") < F.col("y")
    pairs = probes.join(table, (probes["k"] == table["k"]) & keep & ((~F.col("same")) & (F.col("x") != F.col("y")) | order))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def even_segments(bits: int, m: int) -> list[tuple[int, int, int]]:
    """``bits`` (at most 64) cut into ``m`` adjacent segments of nearly equal width."""
    cut = [bits * i // m for i in range(m + 1)]
    return [(0, lo, hi - lo) for lo, hi in zip(cut, cut[1:])]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """Rows (id_col, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id
    reachable over links of at most ``radius`` differing bits, the row's own
    included. Null and empty texts have fingerprint zero and link like any other;
    repeated rows are returned as often as they come in; a null id is returned and
    never becomes a component_id unless its component has no other. An empty table
    gives an empty result. Other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = prints.groupBy("f0").agg(F.min(id_col).alias("low"), F.count("*").alias("n"))
    nodes = written(nodes, "simhash")
    near = F.expr(f"bit_count(h0 ^ g0) <= {radius}")
    links = segment_matches(nodes.select(F.col("f0").alias("node"), "f0"), "node", even_segments(64, segments), radius // segments, near)
    roots = components(links)
    low = nodes.join(roots, nodes["f0"] == roots["node"]).select("f0", "root", "low")
    low = low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("f0", "component_id")
    alone = nodes.where("n > 1").join(low.select("f0"), "f0", "left_anti").select("f0", F.col("low").alias("component_id"))
    known = written(low.unionByName(alone), "simhash")
    out = prints.join(known, "f0", "left")
    return out.select(id_col, F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.coalesce("component_id", id_col).alias("component_id"))


#: For similarity groups: 256 minima of a text's distinct shingles under as many odd multipliers, of which
#: 36 bands hold 7 each. Of pairs of similarity s, 1 - (1 - s^7)^36 share a band: 99.98 % at 0.8, more above.
MINIMA, BANDS, BAND = 256, 36, 7
_ODD = np.random.default_rng(SEED).integers(0, 2**64, MINIMA, np.uint64, endpoint=False) | np.uint64(1)
_PLACE = np.random.default_rng(SEED + 1).integers(0, 2**64, (BANDS, BAND), np.uint64, endpoint=False) | np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bits in which the sketches of a pair may differ, of all 256 and of the first 64. A bit differs with probability
#: (1 - s) / 2, so at 0.8 they differ in 25.6 and 6.4 on average; these limits are some six deviations off.
APART, ROUGH = 56, 20
#: A second sketch, of the texts that share a bucket with another group: one bit each of so many minima. At 0.8 a pair
#: differs in 204.8 of 2,048 on average; the limit is four deviations above, so it loses about 1 pair in 30,000 there.
WIDE = 2048
WIDE_APART = 259
_WIDE_ODD = np.random.default_rng(SEED + 2).integers(0, 2**64, WIDE, np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    parts = list(shingle_hashes(ascii_words(text), width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def min_hashes(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set that is not empty the band keys and the sketch: one bit of every minimum, as four signed longs."""
    low = _minima(shingles, _ODD)
    with np.errstate(over="ignore"):
        keys = _mixed((low[: BANDS * BAND].reshape(BANDS, BAND) * _PLACE).sum(axis=1, dtype=np.uint64), 1)
    return keys.view(np.int64), _bits(low)


def _minima(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    low = np.full(len(odd), 2**64 - 1, np.uint64)
    step = max(1, 65_536 // len(odd))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), step):
            np.minimum(low, np.multiply.outer(odd, shingles[at : at + step]).min(axis=1), out=low)
    return low


def _bits(low: np.ndarray) -> np.ndarray:
    """One bit of every minimum, as signed longs."""
    with np.errstate(over="ignore"):
        bits = ((low ^ (low >> np.uint64(29))) * _FOLD) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.intersect1d(a, b, assume_unique=True).size
    union = a.size + b.size - both
    return both / union if union else 1.0


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (id_col, group_id) for every distinct id: near-duplicate groups by word shingles.

    Candidates share one of the bands of minima over the sets of ``width``-word
    shingles and have sketches that differ in few bits; a candidate becomes a link
    if the sets themselves have a Jaccard similarity of ``least`` or more. Bands and
    limits are laid out for 0.8 or more; see the figures beside them. A large group
    is not spelt out in pairs: links to the smallest node of each bucket come first, and
    the complete look-up, between the groups so found, compares a wider sketch inside the
    join, so pairs well below the bound never leave it. Texts with
    the same words are one node, whatever their number. ``group_id`` is the smallest
    id of the group. Rows of one id are expected to have one text. Null and empty texts are one group of their own. Null ids are
    left out: they name no document.
    """
    named = docs.where(F.col(id_col).isNotNull())
    none = np.empty(0, np.int64), np.zeros(4, np.int64)

    def start():
        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            same = [xxhash.xxh3_64_intdigest(b" ".join(ascii_words(t)), SEED) for t in texts]
            found = [min_hashes(h) if (h := shingle_set(t, width)).size else none for t in texts]
            keys = pa.array([k for k, _ in found], pa.list_(pa.int64()))
            prints = np.array([p for _, p in found], np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(same, np.uint64).view(np.int64)), keys, *(pa.array(prints[:, k]) for k in range(4))],
                names=["id", "words", "bands", "f0", "f1", "f2", "f3"],
            )

        return step

    source = named.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(map_batches(source, start, "id long, words long, bands array<long>, f0 long, f1 long, f2 long, f3 long"), "similar")
    nodes = written(prints.groupBy("words").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), *(F.first(f"f{k}").alias(f"f{k}") for k in range(4))), "similar")
    full = nodes.select("node", "f0", "f1", "f2", "f3")
    at_a = full.select(F.col("node").alias("a"), *(F.col(f"f{k}").alias(f"p{k}") for k in range(4)))
    at_b = full.select(F.col("node").alias("b"), *(F.col(f"f{k}").alias(f"q{k}") for k in range(4)))
    apart = "+".join(f"bit_count(p{k} ^ q{k})" for k in range(4))

    def verify():
        def step(batch: pa.RecordBatch):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ha = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            hb = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            ok = [k for k in range(len(a)) if _jaccard(ha[k], hb[k]) >= least]
            return pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([b[k] for k in ok], pa.int64())], names=["a", "b"])

        return step

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = written(ids.distinct(), "similar")
        # a bounded list of ids is sent to the texts; a longer one meets them in a shuffle
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        return source.join(ids, "id", "left_semi").dropDuplicates(["id"])

    def links(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.join(at_a, "a").join(at_b, "b").where(F.expr(f"{apart} <= {APART}")).select("a", "b"), "similar")
        sets = written(_shingle_sets(texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), width), "similar")
        checked = pairs.join(sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
        return written(map_batches(checked.select("a", "b", "ha", "hb"), verify, "a long, b long"), "similar")

    # what a pair a node and bucket ties together needs no other link; the complete look-up is between the groups so found
    rows = nodes.select(F.explode("bands").alias("k"), F.col("node").alias("x"), F.col("f0").alias("h0"))
    met = written(rows.groupBy("k").agg(F.min(F.struct("x", "h0")).alias("p"), F.count("*").alias("n")).where("n > 1").select("k", F.col("p.x").alias("y"), F.col("p.h0").alias("g0")), "similar")
    entries = written(rows.join(met, "k"), "similar")
    rough = F.expr(f"bit_count(h0 ^ g0) <= {ROUGH}")
    first = links(entries.where((F.col("x") != F.col("y")) & rough).select(F.col("y").alias("a"), F.col("x").alias("b")).distinct())
    known = components(first).select(F.col("node").alias("x"), F.col("root").alias("g"))
    grouped = written(entries.select("k", "x", "h0").join(known, "x", "left").withColumn("g", F.coalesce("g", "x")), "similar")
    mixed = written(grouped.groupBy("k").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("k"), "similar")
    own = written(grouped.join(mixed, "k"), "similar")
    wide = written(_wide_sketches(texts_of(own.select(F.col("x").alias("id"))), width), "similar")
    own = written(own.join(wide, "x"), "similar")
    other = own.select("k", F.col("x").alias("y"), F.col("h0").alias("g0"), F.col("g").alias("gy"), F.col("w").alias("wy"))
    differ = F.expr("+".join(f"bit_count(w[{k}] ^ wy[{k}])" for k in range(WIDE // 64)) + f" <= {WIDE_APART}")
    between = own.withColumnRenamed("k", "kx").join(other, (F.col("kx") == F.col("k")) & (F.col("g") != F.col("gy")) & (F.col("x") < F.col("y")) & rough & differ)
    second = links(between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    roots = components(first.unionByName(second))
    named_nodes = prints.select("id", "words").join(nodes.select("words", "node"), "words")
    out = named_nodes.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("group_id"))
    return out.groupBy(F.col("id").alias(id_col)).agg(F.min("group_id").alias("group_id"))


def _wide_sketches(docs: DataFrame, width: int) -> DataFrame:
    """Rows (x, w): the second sketch of a text."""

    def start():
        def step(batch: pa.RecordBatch):
            words = [_bits(_minima(shingle_set(t, width), _WIDE_ODD)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["x", "w"])

        return step

    return map_batches(docs.select("id", "text"), start, "x long, w array<long>")


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, h): the sorted distinct shingle hashes of a text as bytes."""

    def start():
        def step(batch: pa.RecordBatch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "h"])

        return step

    return map_batches(docs.select("id", "text"), start, "id long, h binary")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows (id_col, group_id) for every id that is not alone: documents linked by SimHash or by similarity.

    SimHash comes first, as ``simhash_components`` has it: fingerprints of few differing
    bits are links. What it misses near the bound is added by ``similar_groups``, and the
    links of both are followed together, so no link of either is lost. ``group_id`` is
    the smallest id reachable; null ids name no document.
    """
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col)
    by_print = simhash_components(named, id_col, text_col).select(F.col(id_col).alias("a"), F.col("component_id").alias("b"))
    by_sets = similar_groups(named, id_col, text_col, **how).select(F.col(id_col).alias("a"), F.col("group_id").alias("b"))
    return components(by_print.unionByName(by_sets)).select(F.col("node").alias(id_col), F.col("root").alias("group_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group the document with the smallest id.

    Of several rows of one id only the smallest by its text (null first), then by a
    hash of the whole row takes part; rows with a null id name no document and stay.
    """
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "similar-again")
    if again.count():
        once, row = docs.join(again, "doc_id", "left_anti").select(docs.columns), F.struct(*docs.columns)
        twice = docs.join(again, "doc_id", "left_semi").select(row.alias("_row"))
        twice = twice.groupBy("_row.doc_id").agg(F.min_by("_row", F.struct(F.col("_row.text"), F.xxhash64("_row"))).alias("_row")).select("_row.*")
        docs = once.unionByName(twice.select(docs.columns))
    groups = near_copies(docs, **how)
    gone = written(groups.where("doc_id <> group_id").select("doc_id"), "similar-gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
