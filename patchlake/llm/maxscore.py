"""Exact top-k search by inner product with MaxScore over sharded postings.

A query's terms are the dimensions in which it is not zero. A shard keeps for each term
the vectors with a component there, by columns. A vector's score over a set of terms is at
most the product of the two norms over that set, which bounds any tail of terms. With the
k-th best score known so far as the floor, terms are sorted by size and split: the
non-essential ones are the longest tail that alone cannot reach the floor, so a vector in
none of the essential postings cannot compete. Essential postings are traversed in a few
steps; after each, vectors whose sum so far and bound for the rest stay below the floor
drop out. The non-essential terms are probed for the vectors still competitive, and what
is left has its complete integer score.

Scale: a small sample of the vectors, picked by a hash, gives every query a first floor.
Queries are taken in blocks of bounded size, each sent to all tasks. A task reads its
vectors once a block, in shards of bounded size built once as they stream by, and carries
each query's best from shard to shard, so the floor rises; it reports k rows a query, and
those are merged by rank. No vector is shuffled or copied for the sake of a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

#: Bytes of a shard's columns, of a block of queries and of the sample that gives the first floors.
SHARD_BYTES, BLOCK_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 20, 2 << 20
#: Share of the query's norm left at which vectors that cannot compete any more drop out.
CHECKS = (0.75, 0.6, 0.45, 0.3, 0.2, 0.1)
#: A term's postings are kept as a list if fewer than this share of the shard's vectors have it.
SPARSE = 0.25
#: Share of a shard's vectors up to which the competitive ones are picked out of the columns.
GATHER = 0.3
_EXACT = 2.0**53


@dataclass
class Work:
    """Postings of essential terms traversed, components probed, and components a full scan would read."""

    traversed: int = 0
    probed: int = 0
    whole: int = 0


class Shard:
    """Postings of the rows of ``w`` (vectors by dimensions, integers), by columns."""

    def __init__(self, ids: np.ndarray, w: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(w.T)
        self.norm = np.sqrt(np.einsum("ij,ij->i", w.astype(float), w.astype(float))) * (1 + 1e-9)
        self.most = float(np.abs(w).max()) if w.size else 0.0
        listed = [np.flatnonzero(c) for c in self.columns]
        self.lists = [x if len(x) < SPARSE * len(ids) else None for x in listed]

    def search(self, q: np.ndarray, own_id, k: int, floor: float | None = None, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of vectors among which are the ``k`` best but the query's own; those below ``floor`` may be missing."""
        work = work or Work()
        n = len(self.ids)
        work.whole += n * int(np.count_nonzero(q))
        if self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) >= _EXACT:  # sums may not fit a double
            score = np.array([sum(int(a) * int(b) for a, b in zip(q, v)) for v in self.columns.T], object)
            return self._best(np.arange(n), score, own_id, k)
        terms = np.argsort(-np.abs(q), kind="stable")[: np.count_nonzero(q)]
        size = q[terms]
        rest = np.append(np.sqrt(np.cumsum(size[::-1] ** 2)[::-1]), 0.0) * (1 + 1e-9)
        if floor is None or floor <= 0 or not len(terms):
            work.traversed += n * len(terms)
            return self._best(np.arange(n), size @ self.columns[terms], own_id, k)
        essential = int(np.argmax(rest * float(self.norm.max(initial=0)) < floor)) if n else 0
        rows = self._listed(terms[:essential])
        part = np.zeros(n if rows is None else len(rows))
        steps = sorted({int(np.argmax(rest <= share * rest[0])) for share in CHECKS} | {essential, len(terms)} - {0})
        at = 0
        for to in steps:
            own = self.columns[terms[at:to]] if rows is None else self.columns[np.ix_(terms[at:to], rows)]
            part += size[at:to] @ own
            count = own.size
            work.traversed, work.probed = (work.traversed + count, work.probed) if to <= essential else (work.traversed, work.probed + count)
            at = to
            norm = self.norm if rows is None else self.norm[rows]
            keep = part + rest[at] * norm >= floor
            if rows is None:
                some = np.flatnonzero(keep)
                if len(some) > GATHER * n and at < len(terms):
                    continue  # reading whole columns is cheaper than picking so many vectors from them
                rows, part = some, part[some]
            else:
                rows, part = rows[keep], part[keep]
            if at < len(terms) and len(rows):
                # what the terms traversed have used up of a vector's norm is not left for the others
                used = np.square(self.columns[np.ix_(terms[:at], rows)]).sum(0)
                left = np.sqrt(np.maximum(self.norm[rows] ** 2 - used, 0.0) + 1e-6)
                keep = part + rest[at] * left >= floor
                rows, part = rows[keep], part[keep]
            if not len(rows):
                break
        return self._best(rows, part, own_id, k)

    def _listed(self, terms: np.ndarray) -> np.ndarray | None:
        """The vectors in the postings of ``terms``; None for all."""
        lists = [self.lists[t] for t in terms]
        if any(x is None for x in lists):
            return None
        found = np.zeros(len(self.ids), bool)
        for x in lists:
            found[x] = True
        return np.flatnonzero(found)

    def _best(self, rows: np.ndarray, score: np.ndarray, own_id, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids[rows]
        if own_id is not None:
            other = ids != own_id
            ids, score = ids[other], score[other]
        if len(ids) > 4 * k and score.dtype != object:
            high = score >= np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[high], score[high]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


class Best:
    """Each query's ``k`` best so far over the shards of one task; ``floors`` are scores that others reach ``k`` times."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: list[float | None], k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, list(floors), k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        self.work = Work()

    def meet(self, shard: Shard) -> None:
        for i, q in enumerate(self.vectors):
            ids, score = shard.search(q, self.ids[i], self.k, self.floors[i], self.work)
            if not len(ids):
                continue
            ids, score = np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], score])
            order = np.lexsort((ids, -score))[: self.k]
            self.found[i] = ids[order], score[order]
            if len(order) == self.k and (self.floors[i] is None or score[order[-1]] > self.floors[i]):
                self.floors[i] = float(score[order[-1]])

    def rows(self):
        for query, (ids, score) in zip(self.ids, self.found):
            for v, s in zip(ids, score):
                yield int(query), int(v), int(s)


def _matrix(values: list, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def integer_components(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as double; null unless all components are there and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _floors(asks: DataFrame, sample_ids: np.ndarray, sample: np.ndarray, k: int, block: Column) -> DataFrame:
    """``asks`` with the k-th best score of each query within the sample, null where that has fewer, and its block."""
    shared = asks.sparkSession.sparkContext.broadcast((sample_ids, sample))
    dims = sample.shape[1]

    def start():
        shard = Shard(*shared.value)

        def step(batch: pa.RecordBatch):
            ids, vectors = batch.column(0).to_pylist(), _matrix(batch.column(1).to_pylist(), dims)
            floors = []
            for own, q in zip(ids, vectors):
                _, score = shard.search(q, own, k)
                floors.append(float(score[k - 1]) if len(score) == k else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(floors, pa.float64())], names=["vec_id", "v", "block", "floor"])

        return step

    return written(map_batches(asks.select("vec_id", "v", block.cast("int").alias("block")), start, "vec_id long, v array<double>, block int, floor double"), "vectors")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` largest integer inner products, ties to the smaller id.

    Components become floor(1024 x). Candidates are all rows but those with the
    query's own id; fewer than ``k`` rows where there are fewer. Vectors that are null
    or hold a null or non-finite component, and null ids, take no part; shorter
    vectors count as padded with zeros. Repeated rows of one id are one candidate and
    one query: the first by its components. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integer_components(F.col(vector_col)).alias("v"), is_query.alias("asks"))
    rows = written(rows.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "vectors")
    many, asked, dims = rows.agg(F.count("*"), F.count_if(F.col("asks")), F.max(F.size("v"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    hashed = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    picked = rows.where(hashed(1, max(1, -(-many * dims * 8 // SAMPLE_BYTES))) == 0).select("vec_id", "v").collect()
    sample = np.array([r["vec_id"] for r in picked], np.int64), _matrix([r["v"] for r in picked], dims)
    blocks = max(1, -(-asked * dims * 8 // BLOCK_BYTES))
    asks = _floors(rows.where("asks"), *sample, k, hashed(2, blocks))
    each = max(1024, SHARD_BYTES // (8 * dims))
    near = None
    for b in range(blocks):
        part = _against(rows, asks.where(F.col("block") == b).collect(), dims, each, k)
        near = part if near is None else near.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _against(rows: DataFrame, block: list, dims: int, each: int, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score): of every task's vectors the ``k`` best of each query of ``block``, in shards of ``each`` vectors."""
    block = sorted(block, key=lambda r: r["vec_id"])
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in block], np.int64), _matrix([r["v"] for r in block], dims), [r["floor"] for r in block]))

    def start():
        best, ids, held = Best(*shared.value, k), [], []

        def build():
            if ids:
                best.meet(Shard(np.concatenate(ids), np.concatenate(held)))
                ids.clear()
                held.clear()

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, each):
                some = batch.slice(at, each)
                ids.append(np.array(some.column(0), np.int64))
                held.append(_matrix(some.column(1).to_pylist(), dims))
                if sum(map(len, ids)) >= each:
                    build()

        def end():
            build()
            found = list(best.rows())
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[at : at + 10_000])], names=["query_id", "vec_id", "score"])

        step.end = end
        return step

    return map_batches(rows.select("vec_id", "v"), start, "query_id long, vec_id long, score long")
