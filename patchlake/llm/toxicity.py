"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Three passes, all over Arrow batches. One counts, over every labelled training row,
in how many toxic and other texts each hashed n-gram occurs (summed in each task
before the shuffle). The counts give the log-count ratios and the most telling
n-grams. The second takes the presence of those n-grams in a bounded sample of the
labelled rows and fits a logistic regression on ratio-scaled presence. The third
scores every text. The model is a few hundred kilobytes whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

BITS = 20
ORDERS = (3, 4, 5)
_PIECE = 1 << 20
_P = np.uint64(0x100000001B3)
_K = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: str | None):
    """Hashed character n-grams of the lower-cased text, white space runs as one space, in bounded pieces."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(ORDERS)
    for at in range(0, max(1, len(codes) - longest + 1), _PIECE):
        c = codes[at : at + _PIECE + longest - 1].astype(np.uint64)
        h = c
        for n in range(2, longest + 1):
            if len(c) < n:
                return
            h = h[:-1] * _P + c[n - 1 :]
            if n in ORDERS:
                yield ((h * _K + np.uint64(n) * _P) * _K >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """``slot`` maps a bucket to a feature or -1; a score is the logistic of ``bias`` plus the weights present."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def present(self, text: str | None) -> np.ndarray:
        hits = [s[s >= 0] for s in (self.slot[b] for b in ngram_buckets(text))]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ngram_label_counts(labelled: DataFrame) -> DataFrame:
    """Rows (bucket, n1, n0) from (text, label): texts of each label that hold the n-gram; bucket -1 counts the texts."""

    def start():
        counts, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
        totals = np.zeros(2, np.int64)

        def step(batch: pa.RecordBatch):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in ngram_buckets(text):
                    seen[b] = True
                here = np.flatnonzero(seen)
                counts[label, here] += 1
                seen[here] = False
                totals[label] += 1

        def end():
            if totals.any():
                at = np.flatnonzero(counts[0] + counts[1])
                rows = [np.append(at, -1), np.append(counts[1, at], totals[1]), np.append(counts[0, at], totals[0])]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["bucket", "n1", "n0"])

        step.end = end
        return step

    parts = map_batches(labelled.select("text", "label"), start, "bucket long, n1 long, n0 long")
    return parts.groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, weight: np.ndarray, l2: float = 3e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights on presence (ratio times coefficient) and the bias, by accelerated gradient steps."""
    lengths = np.array([len(r) for r in rows])
    idx = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    size, total = len(ratio), weight.sum()
    scaled = ratio[idx]
    v, b = np.zeros(size), 0.0
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, scaled * v[idx], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / total
        gv = np.bincount(idx, g[row] * scaled, minlength=size) + l2 * v
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * gv, 0.99 * s + 0.01 * gv * gv
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        v -= 0.05 * fix * m / (np.sqrt(s) + 1e-9)
        b -= 0.05 * fix * mb / (np.sqrt(sb) + 1e-9)
    return v * ratio, b


#: Sides of the dice that picks rows to fit on: fine enough for any number of rows.
DICE = 1 << 50


def dice(key: str):
    """A number below ``DICE`` by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(DICE))


def fit(labelled: DataFrame, key: str = "doc_id", features: int = 4096, max_fit_rows: int = 8000) -> Model:
    """A model from rows (key, text, label 0 or 1).

    Counts and ratios cover all rows. The regression's weights are fitted on at most
    about ``max_fit_rows`` rows a label, chosen by a hash of ``key``.
    Without rows of both labels the model gives every text the share of toxic rows.
    """
    counts = written(ngram_label_counts(labelled), "toxicity")
    total = counts.where("bucket = -1").first()
    n1, n0 = (total["n1"], total["n0"]) if total else (0, 0)
    slot = np.full(1 << BITS, -1, np.int64)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(slot, np.zeros(0), float(np.log(share / (1 - share))))
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
    both = (F.col("n1") + F.col("n0") + 0.5) / (n1 + n0 + 1)
    gain = (p1 - p0) * (p1 - p0) / (both * (1.0001 - both))
    best = counts.where("bucket >= 0 and n1 + n0 >= 3").select("bucket", "n1", "n0", gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(features).collect()
    slot[[r["bucket"] for r in best]] = np.arange(len(best))
    c1, c0 = np.array([r["n1"] for r in best], float), np.array([r["n0"] for r in best], float)
    ratio = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    probe = Model(slot, np.zeros(len(best)), 0.0)

    def start():
        def step(batch: pa.RecordBatch):
            packed = [probe.present(t).astype(np.int32).tobytes() for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], names=["label", "present"])

        return step

    share1, share0 = min(1.0, max_fit_rows / n1), min(1.0, max_fit_rows / n0)
    chosen = labelled.where(dice(key) < F.when(F.col("label") == 1, F.lit(int(share1 * DICE))).otherwise(F.lit(int(share0 * DICE))))
    sample = map_batches(chosen.select("text", F.col("label").cast("int").alias("label")), start, "label int, present binary").collect()
    rows = [np.frombuffer(r["present"], np.int32) for r in sample]
    y = np.array([r["label"] for r in sample], float)
    weight = np.where(y == 1, 1 / share1, 1 / share0)
    w, b = fit_logistic(rows, y, ratio, weight)
    return Model(slot, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score): every whole text's score, 0 to 1. A null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def step(batch: pa.RecordBatch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")), start, f"{id_col} long, score double")


#: Label tables of at most so many rows are broadcast (a few tens of MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def with_labels(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Rows (doc_id, text, label) of the documents that have a 0 or 1 in ``column``; of contradicting labels the larger counts."""
    marks = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    if labels.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id")


def held_out(doc_id, parts: int, which: int):
    """Whether crc32 of the id as text leaves ``which`` when divided by ``parts``; null ids are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == which, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from the labelled rows that are not held out (crc32 of the id mod 3 is
    1); only the text enters a score. Null and empty texts score the model's bias,
    repeated rows are returned as often as they come in, null ids are scored and
    never learnt from, an empty table gives an empty result, other columns are
    ignored.
    """
    learn = with_labels(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)), labels, "toxic")
    out = score(docs, fit(learn))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; learns from all labelled rows.

    Null and empty texts are kept unless the bias alone reaches the threshold;
    repeated rows and null ids are judged like any other.
    """
    model = fit(with_labels(docs.where(F.col("doc_id").isNotNull()), labels, "toxic"))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def start():
        own = shared.value

        def step(batch: pa.RecordBatch):
            return batch.filter(pa.array([own.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

        return step

    return map_batches(docs, start, docs.schema)
