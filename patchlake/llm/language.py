"""Language identification: word-first scoring with a backoff to shorter character n-grams.

A word seen in training scores by its log frequency in each language. Any other word
falls back to its character n-grams, the longest first: the first order at which some
of its n-grams are known gives the mean of their log frequencies. The language with
the largest sum over the text's words wins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .toxicity import DICE, dice, held_out

ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Tokens whose rows a worker remembers (some 30 MB), and tokens of a text summed at a time.
_CACHE, _PART = 200_000, 50_000


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


@dataclass
class Model:
    """``tables[0]`` maps a word, ``tables[n]`` an n-gram, to its row of log frequencies in ``langs``."""

    langs: list[str]
    tables: dict[int, dict[str, int]]
    logs: np.ndarray
    _at: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def word(self, word: str) -> np.ndarray:
        known = self.tables.get(0, {}).get(word)
        if known is not None:
            return self.logs[known]
        for n in ORDERS:
            own = self.tables.get(n, {}).get
            found = [k for k in map(own, grams(word, n)) if k is not None]
            if found:
                return self.logs[found].sum(0) / len(found)
        return np.zeros(len(self.langs))

    def _place(self, token: str) -> int:
        """Where the row of a token's summed words is remembered."""
        at = len(self._at)
        if self._rows is None or at == len(self._rows):
            more = np.zeros((max(1024, at), len(self.langs)))
            self._rows = more if self._rows is None else np.concatenate([self._rows, more])
        words = _LETTERS.findall(token)
        self._rows[at] = self.word(words[0]) if len(words) == 1 else sum((self.word(w) for w in words), np.zeros(len(self.langs)))
        self._at[token] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share among all; ``und`` and 0 for a text without letters or a model without languages.

        Rows of tokens are summed in the order of the text, whatever is remembered, so
        the same text and model give the same bits.
        """
        if not self.langs or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        many = Counter(text.lower().split())
        total, tokens = np.zeros(len(self.langs)), list(many)
        for k in range(0, len(tokens), _PART):
            part = tokens[k : k + _PART]
            if len(self._at) + len(part) > _CACHE:
                self._at.clear()
            known = self._at.get
            rows = [at if (at := known(t)) is not None else self._place(t) for t in part]
            total += np.fromiter(map(many.__getitem__, part), float, len(part)) @ self._rows[rows]
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(share[best] / share.sum())


def _counts(rows: DataFrame) -> DataFrame:
    """Rows (kind, gram, lang, n) from (text, lang): kind 0 for words, n for n-grams; summed in each task first."""

    def start():
        words: dict[str, Counter] = {}

        def flush():
            out: list[tuple[int, str, str, int]] = []
            for lang, own in words.items():
                out += [(0, w, lang, n) for w, n in own.items()]
                for order in ORDERS:
                    some: Counter = Counter()
                    for w, n in own.items():
                        for g in grams(w, order):
                            some[g] += n
                    out += [(order, g, lang, n) for g, n in some.items()]
            words.clear()
            if out:
                kind, gram, lang, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(gram), pa.array(lang), pa.array(n, pa.int64())], names=["kind", "gram", "lang", "n"])

        def step(batch: pa.RecordBatch):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(_LETTERS.findall((text or "").lower()))
            if sum(map(len, words.values())) > 1_000_000:
                yield from flush()

        step.end = flush
        return step

    parts = map_batches(rows.select("text", "lang"), start, "kind int, gram string, lang string, n long")
    return parts.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, key: str = "doc_id", max_fit_rows: int = 4000, entries: int = 40_000) -> Model:
    """A model from rows (key, text, lang), lang not null.

    Learns from at most about ``max_fit_rows`` rows a language, chosen by a hash of
    ``key``, and keeps the ``entries`` most frequent words and n-grams of each order.
    """
    many = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(many)
    if not langs:
        return Model([], {}, np.zeros((0, 0)))
    limit = F.create_map(*(F.lit(x) for lang in langs for x in (lang, int(DICE * min(1.0, max_fit_rows / many[lang])))))
    counts = written(_counts(labelled.where(dice(key) < limit[F.col("lang")])), "language")
    size = counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    all_of, kinds_of = {(r["kind"], r["lang"]): r["n"] for r in size}, {}
    for r in size:
        kinds_of[r["kind"]] = max(kinds_of.get(r["kind"], 0), r["d"])
    whole = counts.groupBy("kind", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    top = reduce(DataFrame.unionByName, (whole.where((F.col("kind") == k) & (F.col("total") >= 2)).orderBy(F.desc("total"), "gram").limit(entries) for k in (0, *ORDERS)))
    tables: dict[int, dict[str, int]] = {}
    logs = []
    for r in top.collect():
        here, k = {x["lang"]: x["n"] for x in r["by"]}, r["kind"]
        tables.setdefault(k, {})[r["gram"]] = len(logs)
        logs.append([np.log((here.get(x, 0) + 0.5) / (all_of.get((k, x), 0) + 0.5 * kinds_of[k])) for x in langs])
    return Model(langs, tables, np.array(logs).reshape(-1, len(langs)))


def language(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learns from the text and lang of rows that are not held out (crc32 of the id
    mod 4 is 2); only the text enters a prediction. A null text, or one without a
    letter, is ``und`` with score 0; ties go to the smaller language by code point;
    repeated rows are returned as often as they come in; null ids are predicted and
    never learnt from; an empty table gives an empty result; other columns are
    ignored.
    """
    learn = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", 4, 2))
    model = fit(learn.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def step(batch: pa.RecordBatch):
            pairs = [own.predict(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_batches(source, start, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
