"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Each text is cut by both tokenizers; the byte offsets where tokens of both end cut it
into groups, and the tokens of a group are linked. A text's distinct links are packed
int64 keys, id of A above id of B. Each task counts the keys of its texts with
``np.unique``; the partial counts are sorted over all tasks by ranges of the key and
equal keys summed in runs. Every range becomes one shard, a file of sorted keys and a
file of counts in the shared folder, under a name of the attempt that wrote it; the
table of shards lists only those of attempts that won. Look-ups map the shards into
memory and search them with ``np.searchsorted``; where the shared folder is no file
system of the machine, a few shards at a time are read instead.

The texts are tokenised once: keys and their repeats in a text are a table in the
shared folder. Only the shards' bounds and the best count of each id of A, which the
vocabulary bounds, pass the driver.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, written
from .packing import Encoder, _byte_level
from .warc import file_system

#: Links of a group up to which they are made one by one; beyond, its distinct ids are paired.
WIDE = 1024
#: Keys a task holds before it counts them, and distinct ones it holds before it hands them on.
HELD_KEYS, HELD_COUNTS = 1 << 21, 1 << 22
#: Partial counts in a shard, about.
SHARD_ROWS = 1 << 22
#: Shards a task keeps in memory where they cannot be mapped.
KEPT_SHARDS = 4
LOW = (1 << 32) - 1


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class PlainEncoder(Encoder):
    """An encoder to which the strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


class Tokenizers:
    """Both tokenizers, their tokens' bytes, and their ids' decimal digits with what follows them in a list of groups."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = PlainEncoder(path_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of, vocabulary = _byte_level(), self.encode_a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        p = self.pieces
        self.bytes_b = [bytes([int(p.id_to_piece(k)[1:-1], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode() for k in range(p.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.size, self.digits = n, [f"{k}{after}".encode() for after in ",|;" for k in range(n)]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if either's bytes are not a space and the text."""
        raw = b" " + text.encode("utf-8", "surrogatepass")
        a = np.frombuffer(self.encode_a(" " + text), np.uint32)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw:
            return None
        b = self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return a.astype(np.int64), np.array(b, np.int64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(times, first)


class Alignment:
    """The groups of two id lists over the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        self.a, self.b = a, b
        self.group_a, self.group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(common)), np.bincount(self.group_b, minlength=len(common))
        self.n_groups, self.n_links = len(common), int((self.in_a * self.in_b).sum())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct packed keys, ascending, and how often each is linked. A group of very many links is paired by its distinct ids."""
        first_b = np.cumsum(self.in_b) - self.in_b
        wide = np.flatnonzero(self.in_a * self.in_b > WIDE)
        own = self.group_a if not len(wide) else self.group_a[~np.isin(self.group_a, wide)]
        ids = self.a if not len(wide) else self.a[~np.isin(self.group_a, wide)]
        times = self.in_b[own]
        total = int(times.sum())
        step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        keys = (np.repeat(ids, times) << 32) | self.b[np.repeat(first_b[own], times) + step]
        keys, count = np.unique(keys, return_counts=True)
        if not len(wide):
            return keys, count
        parts = [(keys, count)]
        first_a = np.cumsum(self.in_a) - self.in_a
        for g in wide:
            x, cx = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            y, cy = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            parts.append((((x[:, None] << 32) | y).ravel(), np.outer(cx, cy).ravel()))
        return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    def text(self, t: Tokenizers) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        n, m = len(self.a), len(self.b)
        place_a = np.arange(n) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        place_b = np.arange(m) + np.cumsum(self.in_a)[self.group_b]
        last_a, last_b = np.append(self.group_a[1:] != self.group_a[:-1], True), np.append(self.group_b[1:] != self.group_b[:-1], True)
        merged = np.empty(n + m, np.int64)
        merged[place_a] = self.a + t.size * last_a
        merged[place_b] = self.b + 2 * t.size * last_b
        return b"".join(map(t.digits.__getitem__, merged.tolist()))[:-1]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, keys binary, times binary"
_KINDS = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.binary(), pa.binary()]
_NAMES = [f.split()[0] for f in ALIGNED.split(", ")]
_loaded: dict[tuple[str, str], Tokenizers] = {}


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``ALIGNED``, one for every row of ``docs``.

    ``keys`` are the distinct packed links of the text (little-endian int64, each the
    step from the one before), ``times`` how often each is linked (uint32). ``groups``
    is filled only if asked for. A null or empty text, and one that a tokenizer does
    not keep byte by byte, has no tokens: zeros, no links and an empty digest.
    """
    own = paths or vocabulary_paths()

    def start():
        t = _loaded.get(own) or _loaded.setdefault(own, Tokenizers(*own))

        def row(key, text):
            ids = t.ids(text) if text else None
            if ids is None:
                return key, 0, 0, 0, 0, "", "" if with_groups else None, b"", b""
            x = Alignment(*ids, t.len_a, t.len_b)
            keys, times = x.links()
            groups = x.text(t)
            return key, len(x.a), len(x.b), x.n_groups, x.n_links, hashlib.sha256(groups).hexdigest(), groups.decode() if with_groups else None, np.diff(keys, prepend=0).astype("<i8").tobytes(), times.astype("<u4").tobytes()

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [row(k, x) for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], names=_NAMES)

        return step

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, start, ALIGNED)


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<i8"))


def partial_counts(aligned: DataFrame) -> DataFrame:
    """Rows (key, n): in how many texts of a task a key is linked; a key may come several times from one task."""

    def rows(keys, n):
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])

    def start():
        fresh: list[np.ndarray] = []
        state = {"fresh": 0, "keys": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}

        def fold():
            keys, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.zeros(0, np.int64),) * 2
            fresh.clear()
            state["keys"], state["n"] = _summed(np.concatenate([state["keys"], keys]), np.concatenate([state["n"], n.astype(np.int64)]))
            state["fresh"] = 0

        def step(batch: pa.RecordBatch):
            for raw in batch.column(0).to_pylist():
                fresh.append(_keys(raw))
                state["fresh"] += len(fresh[-1])
                if state["fresh"] > HELD_KEYS:
                    fold()
                    if len(state["keys"]) > HELD_COUNTS:
                        yield from rows(state["keys"], state["n"])
                        state["keys"], state["n"] = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def end():
            fold()
            yield from rows(state["keys"], state["n"])

        step.end = end
        return step

    return map_batches(aligned.select("keys"), start, "key long, n long")


SHARDS = "path string, first long, last long, rows long, ids binary, best binary"


def shards(partial: DataFrame, folder: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows of ``SHARDS``: the files (``path``.keys, ``path``.counts) of each range of keys, and the best count of each id of A in it."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def start():
        fs, root = file_system(folder)
        state: dict = {"path": None, "best": {}}

        def put(keys, n):
            if not len(keys):
                return
            if state["path"] is None:
                state.update(path=f"{root}/{uuid.uuid4().hex}", first=int(keys[0]), rows=0)
                state["out"] = [fs.open_output_stream(f"{state['path']}.{x}") for x in ("keys", "counts")]
            for out, x in zip(state["out"], (keys, n)):
                out.write(x.astype("<i8").tobytes())
            state.update(last=int(keys[-1]), rows=state["rows"] + len(keys))
            ids, at = np.unique(keys >> 32, return_index=True)
            for k, most in zip(ids.tolist(), np.maximum.reduceat(n, at).tolist()):
                state["best"][k] = max(most, state["best"].get(k, 0))

        held: list = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def step(batch: pa.RecordBatch):
            keys, n = _summed(*(np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)))
            put(keys[:-1], n[:-1])
            held[:] = keys[-1:], n[-1:]  # the next rows may go on with the last key
            return None

        def end():
            put(*held)
            if state["path"] is not None:
                for out in state["out"]:
                    out.close()
                best = sorted(state["best"].items())
                ids, most = (np.array([x[k] for x in best], "<i8").tobytes() for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((state["path"], pa.string()), (state["first"], pa.int64()), (state["last"], pa.int64()), (state["rows"], pa.int64()), (ids, pa.binary()), (most, pa.binary()))], names=[f.split()[0] for f in SHARDS.split(", ")])

        step.end = end
        return step

    rows = partial.count()
    ranged = partial.repartitionByRange(max(1, -(-rows // shard_rows)), "key").sortWithinPartitions("key")
    return written(map_batches(ranged, start, SHARDS), "alignment-shards")


class Lookup:
    """Counts of keys from the shards of a folder, opened when first asked for."""

    def __init__(self, folder: str, listed: list[tuple[str, int, int]]):
        self.fs, _ = file_system(folder)
        self.listed = sorted(listed, key=lambda x: x[1])
        self.first, self.last = (np.array([x[k] for x in self.listed], np.int64) for k in (1, 2))
        self.open: OrderedDict[str, tuple] = OrderedDict()

    def _shard(self, path: str) -> tuple:
        if path not in self.open:
            if os.path.exists(path + ".keys"):
                self.open[path] = tuple(np.memmap(f"{path}.{x}", "<i8", "r") for x in ("keys", "counts"))
            else:
                while len(self.open) >= KEPT_SHARDS:
                    self.open.popitem(last=False)
                self.open[path] = tuple(np.frombuffer(self.fs.open_input_file(f"{path}.{x}").read(), "<i8") for x in ("keys", "counts"))
        return self.open[path]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ``keys`` (ascending), 0 for one that no text links."""
        out = np.zeros(len(keys), np.int64)
        ends = np.searchsorted(keys, self.first, "left"), np.searchsorted(keys, self.last, "right")
        for (path, _, _), low, high in zip(self.listed, *ends):
            if low < high:
                stored, n = self._shard(path)
                at = np.minimum(np.searchsorted(stored, keys[low:high]), len(stored) - 1)
                out[low:high] = np.where(stored[at] == keys[low:high], n[at], 0)
        return out


def scored(aligned: DataFrame, folder: str, listed: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose count is the highest of their id of A, ties included) and ``count_sum`` in place of keys."""
    rows = listed.collect()  # one for each shard, and the best count of each id of A
    best: dict[int, int] = {}
    for r in rows:
        for k, most in zip(np.frombuffer(bytes(r["ids"]), "<i8").tolist(), np.frombuffer(bytes(r["best"]), "<i8").tolist()):
            best[k] = max(most, best.get(k, 0))
    top = np.zeros(max(best, default=0) + 1, np.int64)
    for k, most in best.items():
        top[k] = most
    told = aligned.sparkSession.sparkContext.broadcast(([(r["path"], r["first"], r["last"]) for r in rows], top))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def start():
        shards, most = told.value
        find = Lookup(folder, shards)

        def step(batch: pa.RecordBatch):
            keys = [_keys(x) for x in batch.column("keys").to_pylist()]
            lengths = np.array([len(x) for x in keys], np.int64)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            distinct, at = np.unique(flat, return_inverse=True)
            count = find(distinct)
            is_best = count == most[distinct >> 32] if len(distinct) else np.zeros(0, bool)
            times = np.concatenate([np.frombuffer(x, "<u4") for x in batch.column("times").to_pylist()]).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(lengths)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * is_best[at], times * count[at])]
            n_best, count_sum = (s[cut[1:]] - s[cut[:-1]] for s in sums)
            columns = [batch.column(n) for n in names[:5]] + [pa.array(n_best), pa.array(count_sum)] + [batch.column(n) for n in names[7:]]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    return map_batches(aligned, start, schema)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups), one for every row of ``docs``.

    A pair's count is the number of rows whose text links it, so repeated rows count
    as often as they come in; a null id is carried. Null, empty and unfaithful texts
    have zeros and an empty digest; an empty table gives an empty result. Other
    columns are ignored. A text is tokenised whole, whatever its length.
    """
    spark = docs.sparkSession
    path, folder = fresh_path(spark, "alignment"), fresh_path(spark, "alignment-files")
    alignments(docs, paths, with_groups, id_col, text_col).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(ALIGNED).parquet(path)
    return scored(aligned, folder, shards(written(partial_counts(aligned), "alignment-partial"), folder, shard_rows))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (a, b, n): the table of counts itself, from partial counts."""
    total = partial_counts(aligned).groupBy("key").agg(F.sum("n").alias("n"))
    return total.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit(LOW)).alias("b"), "n")
