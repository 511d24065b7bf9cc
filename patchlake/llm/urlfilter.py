"""URL filter: host rules first, else word segmentation and naive Bayes.

A rule (host, path, verdict) fits its host and all subdomains where the url's path
starts with the rule's; the longest wins. Rules are one ordered conditional
expression. Other urls are judged by their words: Viterbi splits each name in the host
and path into the likeliest words of a unigram model, and multinomial naive Bayes
scores the words.

Nobody labels urls, so both classes are learnt from all urls of the table, starting
from a short seed vocabulary: urls with a word that is a blocked seed are the first
blocked ones; the words of either side are counted in Spark, the counts make a model, the
model labels every url anew, and the words counted again make the next. So a word that keeps company with blocked ones gets a weight of its own, and a seed that
mostly stands in clean urls loses its weight. Rules take no part in this: they are
policies on places, not statements on words.

Model size: a word is kept if it makes up at least ``SHARE`` of all tokens, which no more
than 1 / ``SHARE`` words can, so the model is bounded and the rule is the same at every size.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .html import host_of

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Seed words of urls to block and to allow.
BLOCKED = "ads adserver adult bet bets betting bingo bonus casino cams cash cheap crack cracked dating drugs escort free gambling game hack hentai jackpot keygen loan loans lottery malware naked nude payday pharma pharmacy phishing pills pirate poker porn prize roulette serial sex sexy slot slots spam spins torrent tracker tracking viagra warez webcam win winner xxx".split()
ALLOWED = "about academy archive article articles blog book books city college culture data doc docs edu education encyclopedia english forum gallery gov guide health help history home index journal law learn library list magazine map market math media movie museum music nature news online page paper people photo post press product project radio report research review school science shop society sport sports store story study support team tech times travel university video weather web wiki work world".split()
_TOKEN = re.compile(r"[^\W\d_]+")
#: Parts of a host that say nothing of its content.
PLAIN = frozenset("www com net org example html htm php http https m".split())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, like ``net/``; null if none does."""
    out = None
    for name, start, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.lit(name + start)) if out is None else out.when(fits, F.lit(name + start))
    return F.lit(None).cast("string") if out is None else out


def tokens(host: str, path: str) -> list[str]:
    return [t for t in _TOKEN.findall(f"{host} {path}".lower()) if t not in PLAIN]


class Segmenter:
    """The likeliest split of a name under a unigram model; unknown stretches cost by their length."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = math.log(total) + 2
        self._known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name in self._known:
            return self._known[name]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                word = name[start:end]
                cost = self.cost.get(word)
                if cost is None:
                    cost = self.unknown + 1.5 * (end - start)
                options.append((best[start][0] + cost, start))
            # a stretch longer than any word goes on from where it began
            if end > self.longest:
                options.append((best[end - self.longest - 1][0] + self.unknown + 1.5 * (self.longest + 1), end - self.longest - 1))
            best.append(min(options))
        words, at = [], len(name)
        while at:
            words.append(name[best[at][1] : at])
            at = best[at][1]
        if len(self._known) < 100_000:
            self._known[name] = words[::-1]
        return words[::-1]


#: Least share of all tokens that makes a token or word part of the model.
SHARE = 1 / 200_000
#: Letters a word of the unigram model may have; longer names are split and scored like any other.
LONGEST = 64
#: Times each seed word counts in the unigram model and on its side of naive Bayes, besides what is counted.
SEEN, PSEUDO = 50, 20


def _falls_apart(token: str, n: int, words: Counter) -> bool:
    """Whether a token is two or more words of at least three letters, each a seed or as frequent as the token."""
    ends = [0]
    for end in range(3, len(token) + 1):
        if any((w := token[start:end]) != token and (w in _SEEDS or words[w] >= n) for start in ends if end - start >= 3):
            ends.append(end)
    return ends[-1] == len(token)


_SEEDS = frozenset((*BLOCKED, *ALLOWED))


def segmenter(counts: dict[str, int]) -> Segmenter:
    """A unigram model from counts of whole tokens and the seeds; a token that falls apart into shorter words is no word itself."""
    out = Counter(dict.fromkeys(_SEEDS, SEEN))
    for token, n in sorted(counts.items(), key=lambda x: (len(x[0]), x[0])):
        if token in _SEEDS or len(token) < 6 or not _falls_apart(token, n, out):
            out[token] += n
    return Segmenter(out)


class Model:
    """Multinomial naive Bayes over words of three letters and more, with Laplace smoothing."""

    def __init__(self, names: Segmenter, bad: dict[str, int] | None = None, good: dict[str, int] | None = None, urls: tuple[int, int] = (1, 9)):
        """``bad`` and ``good``: counts of words in blocked and allowed urls; ``urls``: how many urls were blocked and allowed."""
        self.segmenter = names
        bad, good = Counter(bad or {}), Counter(good or {})
        bad.update(dict.fromkeys(BLOCKED, PSEUDO))
        good.update(dict.fromkeys(ALLOWED, PSEUDO))
        words = {w for w in (*bad, *good) if len(w) > 2}
        b, g = (sum(side[w] for w in words) + len(words) for side in (bad, good))
        self.ratio = {w: math.log((bad[w] + 1) / b) - math.log((good[w] + 1) / g) for w in words}
        self.bias = math.log((urls[0] + 1) / (urls[1] + 1))

    def words(self, host: str, path: str) -> list[str]:
        return [w for t in tokens(host, path) for w in self.segmenter.split(t)]

    def score(self, host: str, path: str) -> float:
        """Log odds of blocking."""
        return self.bias + sum(self.ratio.get(w, 0.0) for w in self.words(host, path))


def _summed(urls: DataFrame, count, names: list[str]) -> DataFrame:
    """Rows (word, *names): ``count(host, path, sums)`` over all urls, summed in each task first; the word ``""`` counts urls."""

    def start():
        sums: dict[str, list[int]] = {}

        def flush():
            if sums:
                words, many = list(sums), list(zip(*sums.values()))
                sums.clear()
                yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array(n, pa.int64()) for n in many)], names=["word", *names])

        def step(batch: pa.RecordBatch):
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count(host, path, sums)
                if len(sums) > 300_000:
                    yield from flush()

        step.end = flush
        return step

    parts = map_batches(urls.select("host", "path"), start, "word string, " + ", ".join(f"{n} long" for n in names))
    return written(parts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)), "urls")


def _frequent(sums: DataFrame, names: list[str], share: float) -> tuple[dict[str, list[int]], list[int]]:
    """The words with at least ``share`` of all counts, at most 1 / ``share`` of them, and the urls on either side."""
    n = "+".join(names)
    whole = sums.where("word <> ''").agg(F.sum(F.expr(n))).first()[0] or 0
    rows = sums.where((F.col("word") == "") | (F.expr(n) >= share * whole)).collect()
    out = {r["word"]: [r[x] for x in names] for r in rows}
    return out, out.pop("", [0] * len(names))


def fit(urls: DataFrame, rounds: int = 4, share: float = SHARE) -> Model:
    """A model from rows (host, path): tokens of all urls make the unigram model, then ``rounds`` times all urls are labelled, first by the seeds, and their words counted."""

    def tokens_of(host, path, sums):
        for t in tokens(host, path):
            if len(t) <= LONGEST:
                sums.setdefault(t, [0])[0] += 1

    seen, _ = _frequent(_summed(urls, tokens_of, ["n"]), ["n"], share)
    model = Model(segmenter({t: n for t, (n,) in seen.items()}))
    seeds = frozenset(BLOCKED)
    for k in range(rounds):
        shared = urls.sparkSession.sparkContext.broadcast(model)

        def labelled(host, path, sums, shared=shared, first=k == 0):
            now = shared.value
            words = now.words(host, path)
            blocked = not seeds.isdisjoint(words) if first else now.score(host, path) > 0
            for w in ("", *words):
                sums.setdefault(w, [0, 0])[0 if blocked else 1] += 1

        sums, sides = _frequent(_summed(urls, labelled, ["bad", "good"]), ["bad", "good"], share)
        shared.unpersist()
        model = Model(model.segmenter, {w: b for w, (b, _) in sums.items() if b}, {w: g for w, (_, g) in sums.items() if g}, (sides[0], sides[1]))
    return model


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score) for every row of ``pages``.

    ``verdict`` is the rule's, else block if the model's log odds are above 0. A null
    url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed, unless blocked urls are the majority of the table. Very long names are
    split and scored whole. Repeated rows are returned as often as they come in, null ids too; an
    empty table gives an empty result; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(fit(rows))

    def start():
        model = shared.value

        def step(batch: pa.RecordBatch):
            scores = [model.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["page_id", "host", "path", "score"])

        return step

    out = map_batches(rows, start, "page_id long, host string, path string, score double")
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") > 0, "block").otherwise("allow")
    for name, path, says in rules:
        verdict = F.when(F.col("rule") == name + path, says).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
