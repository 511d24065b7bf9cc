"""Hierarchical packing of tokenised documents into windows of several context sizes.

A document gives its full windows of the largest size at once; its rest is routed to
the smallest tier that holds it whole. Each task packs its tiers for themselves, the
longest first: the longest rest of a tier opens a window of the tier's size, whose gap
is filled by the longest rests of this and the shorter tiers that fit and at last by a
cut one, so every window is full. What a task has left at its end, less than the
shortest tier, goes into windows of falling powers of two (fewer tokens than one window
of that tier, whatever the task's size), so there is no padding.

Step groups hold windows of one size and the same number of tokens each. They are
balanced over all tasks: the pieces are a table in the shared folder, the windows of
each tier are counted by task, and a window's place among all windows of its tier
gives its group; only the last group of a tier is not full. Tokens are never shuffled.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

END = 1
#: Context sizes, ascending; each is a power of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens in a step group.
STEP_TOKENS = 64 * 2048
#: Tokens a task holds back to choose from, spread over the tiers.
SPARE = 256 * 2048
#: Letters of the longest word that goes through the byte-pair core, whose time grows with the square of a word.
LONGEST = 1000
#: White space besides the space and the line feed, of either reading of ``\\s``.
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
ODD_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_level() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    Where the file's ids follow its merges, as in any byte-level vocabulary of this
    family, texts go through a byte-pair core built from the file's own vocabulary,
    which gives the same ids several times faster. It gets texts whose white space is
    single spaces and line feeds, so that both cut them alike; any other text, one with
    a very long word and one that holds the string of an added token go through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in model.get("added_tokens") or []]
        model = model["model"]
        self.core = self._core(model["vocab"], model.get("merges") or [])

    @staticmethod
    def _core(vocab: dict[str, int], merges: list):
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if not pairs or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        of = _byte_level()
        ranks = {bytes(of[c] for c in t): k for t, k in vocab.items() if k < 256 + len(pairs)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("core", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        """Whether all white space is single spaces and line feeds, no word is very long and no added token is spelt out."""
        if any(c in text for c in ODD_ASCII) or not text.isascii() and any(c in text for c in ODD_WIDE):
            return False
        if any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")) or any(t in text for t in self.added):
            return False
        return max(map(len, text.split()), default=0) <= LONGEST

    def __call__(self, text: str) -> bytes:
        if self.core is not None and self._plain(text):
            return array("I", self.core.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Packer:
    """Packs (doc, ids) of one task; rows are (doc, start, ids, doc_tokens, task, tier, number, offset): a piece and the window it lies in."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.task, self.tiers, self.largest = task, tiers, tiers[-1]
        self.dealt: dict[int, int] = {}  # windows of each size so far
        self.rest: dict[int, list[tuple[int, int]]] = {t: [] for t in tiers}  # (length, number) ascending; number finds the piece
        self.held = dict.fromkeys(tiers, 0)  # tokens of each tier's rests
        self.piece: dict[int, tuple] = {}
        self.number = 0

    def _emit(self, pieces: list[tuple], tier: int) -> Iterator[tuple]:
        number = self.dealt.get(tier, 0)
        self.dealt[tier] = number + 1
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.task, tier, number, offset
            offset += len(ids) // 4

    def _put(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        tier = next(t for t in self.tiers if length <= t)
        self.number += 1
        self.piece[self.number] = piece
        insort(self.rest[tier], (length, self.number))
        self.held[tier] += length

    def _take(self, tier: int, at: int) -> tuple:
        length, number = self.rest[tier].pop(at)
        self.held[tier] -= length
        return self.piece.pop(number)

    def _fill(self, gap: int) -> Iterator[tuple]:
        """Pieces that fill ``gap`` exactly, if there are as many tokens: the longest that fit, then one cut from the shortest rest that is too long."""
        while gap and self.number:
            for tier in reversed(self.tiers):
                at = bisect_right(self.rest[tier], (gap, self.number))
                if at:
                    piece = self._take(tier, at - 1)
                    gap -= len(piece[2]) // 4
                    yield piece
                    break
            else:
                tier = next((t for t in self.tiers if self.rest[t]), None)
                if tier is None:
                    return
                doc, start, ids, total = self._take(tier, 0)
                self._put((doc, start + gap, ids[4 * gap :], total))
                yield doc, start, ids[: 4 * gap], total
                gap = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        whole = total - total % self.largest
        for start in range(0, whole, self.largest):
            yield from self._emit([(doc, start, ids[4 * start : 4 * (start + self.largest)], total)], self.largest)
        if whole < total:
            self._put((doc, whole, ids[4 * whole :], total))

    def pack(self, spare: int) -> Iterator[tuple]:
        """Full windows, tier by tier from the longest, until each tier's rests are at most its part of ``spare`` tokens or too few for a window."""
        part = spare // len(self.tiers)
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            while self.held[tier] > part and sum(self.held[t] for t in self.tiers[: k + 1]) >= tier:
                first = self._take(tier, len(self.rest[tier]) - 1)
                yield from self._emit([first, *self._fill(tier - len(first[2]) // 4)], tier)

    def end(self) -> Iterator[tuple]:
        """All that is left: full windows of every tier, then of falling powers of two."""
        yield from self.pack(0)
        while pool := sum(self.held.values()):
            size = 1 << (pool.bit_length() - 1)
            yield from self._emit(list(self._fill(size)), size)


PIECES = "doc_id long, start long, ids binary, doc_tokens long, task long, sequence_tokens long, number long, offset long"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
_encoders: dict[str, Encoder] = {}


def _batch_of(part: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), _KINDS)], names=[f.split()[0] for f in PIECES.split(", ")])


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row[2])
        if len(part) >= 4000 or held > 4_000_000:
            yield _batch_of(part)
            part, held = [], 0
    if part:
        yield _batch_of(part)


def pieces(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``PIECES``: each piece and the window of its task it lies in."""

    def start():
        packer = Packer(TaskContext.get().partitionId(), tiers)
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        last = END.to_bytes(4, "little")

        def rows_of(batch):
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    yield from packer.add(key, encode(text or "") + last)
                if sum(packer.held.values()) > SPARE:
                    yield from packer.pack(SPARE // 2)

        def step(batch: pa.RecordBatch):
            yield from _batched(rows_of(batch))

        step.end = lambda: _batched(packer.end())
        return step

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, start, PIECES)


#: Tasks times tiers up to which the window counts are broadcast (some 30 bytes a row).
BROADCAST_ROWS = 1_000_000


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, ids, doc_tokens, sequence_id, offset, sequence_tokens, step_group), one for each piece of a document.

    ``ids`` are the piece's token ids (little-endian unsigned 32-bit); a sequence is a
    window of ``sequence_tokens`` tokens, all of them used. ``step_group`` numbers
    groups of ``step_tokens`` tokens, each of windows of one size, over all tasks.
    A null or empty text is one piece that holds the end token; null ids are packed
    and carried; repeated rows are packed as often as they come in; an empty table
    gives an empty result; other columns are ignored.
    """
    cut = written(pieces(docs, path or vocabulary_path(), tiers, id_col, text_col), "packing")
    many = cut.groupBy("task", "sequence_tokens").agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("sequence_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    places = written(many.select(F.col("task").alias("t"), F.col("sequence_tokens").alias("w"), F.coalesce(before, F.lit(0)).alias("before")), "packing")
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    placed = cut.join(places, (F.col("task") == F.col("t")) & (F.col("sequence_tokens") == F.col("w")))
    size = F.expr("cast(log2(sequence_tokens) + 0.5 as long)")
    group = F.floor((F.col("before") + F.col("number")) * F.col("sequence_tokens") / F.lit(step_tokens))
    return placed.select(
        "doc_id", "start", "ids", "doc_tokens", (F.shiftleft("task", 32) + F.shiftleft("number", 4) + size).alias("sequence_id"), "offset", "sequence_tokens",
        (F.shiftleft(size, 48) + group).cast("long").alias("step_group"),
    )
