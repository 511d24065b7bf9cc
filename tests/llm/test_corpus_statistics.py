"""Phrases, alignment and decontamination against brute force, with odd texts, ties, nulls, empty tables and clashing columns."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.llm import alignment, decontaminate, phrases
from patchlake.llm.queries import OP11_SQL, OP13_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, words string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(k, t, lang, "s", None, 1, "row", "words") for k, t, lang in rows], schema).repartition(3)


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# --- phrases -----------------------------------------------------------------------


def brute_phrases(rows, least, top):
    f, whole = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            whole[lang] += len(w)
            for n in (1, 2, 3):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in found.items():
        if len(p) == 3 and any(100 * b >= 50 * a and q[0] == p[0] and (q[1:3] == p[1:] or q[2:] == p[1:]) for q, b in found.items() if len(q) == 4):
            continue
        cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, l, r = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, at, x[2].decode(), -x[1], x[3], x[4], whole[lang], -x[0]) for lang, xs in out.items() for at, x in enumerate(sorted(xs)[:top], 1))


WORDS = ["a", "B", "c", "É", "é", "日本", "x-y", " ", "=", "a" * 3000]


def phrase_rows(n=240):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        gaps = rng.choice([" ", "  ", "\t", ". ", "\n", "!", " , "], 40, p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        picked = rng.choice(len(WORDS), 40, p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.08, 0.05, 0.04, 0.02, 0.01])
        rows.append((k, "".join(WORDS[i] + g for i, g in zip(picked, gaps)), [None, "en", "de", "und"][k % 4]))
    same = "the very same words again and again the very same words."
    return [*rows, *((None, same, "en") for _ in range(30)), (1, None, "en"), (2, "", None), (3, " \t\n.!", "fr"), (4, "one two", "fr")]


@pytest.mark.parametrize("buckets", [8, 64, 1 << 18])
def test_phrases_equal_brute_force_with_any_number_of_buckets(spark, buckets):
    rows = phrase_rows()
    got = phrases.phrases(docs(spark, rows), least=10, top=25, buckets=buckets)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 10, 25)


def test_phrases_in_small_blocks_and_buckets_that_overflow_a_byte(spark, monkeypatch):
    rows = phrase_rows(60) * 3
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 100)
    monkeypatch.setattr(phrases, "HELD_BUCKETS", 50)
    assert sorted(map(tuple, phrases.phrases(docs(spark, rows), least=200, top=9, buckets=1 << 17).collect())) == brute_phrases(rows, 200, 9)


def test_phrases_of_empty_tables(spark):
    assert phrases.phrases(docs(spark, [])).collect() == []
    assert phrases.phrases(docs(spark, [(1, "too few", "en"), (2, None, None)])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 3_000_000_019, 2_999_999_999 * 3
    d = spark.createDataFrame([(a, l, r)], "a long, l long, r long").withColumn("score", phrases._score())
    assert d.first()["score"] == 10**6 * a * a // (l * r)


def test_pruning_bitmaps_hold_only_frequent_buckets(spark):
    """The pass counts of bigrams leave out those whose bucket is rare, and none that is frequent."""
    rows = phrase_rows()
    source = docs(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    first = phrases.scan(source, 1, 1 << 18)
    spans = first.where("span is not null")
    bits = phrases._bitmap(phrases._merged_spans(spans, 10, 1 << 18), 1 << 18)
    every = phrases._bitmap(phrases._merged_spans(spans, 1, 1 << 18), 1 << 18)
    set_, all_ = (int(np.unpackbits(x).sum()) for x in (bits, every))
    f = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            f.update(((lang or "und"), *w[i : i + 2]) for i in range(len(w) - 1))
    assert all_ <= len(f) and sum(n >= 10 for n in f.values()) * 0.99 <= set_ < all_


# --- alignment ---------------------------------------------------------------------

TEXTS = ["Hello world", " leading  and double ", "日本語のテキスト", "a" * 3000, "ab" * 700, "<|endoftext|> and <s></s><unk><0x0A>", "line\nfeed\ttab\r\n", "é́ 🙂🙂 zero\x00byte", "▁marked", "x", " ", "\n", "12345678901234567890 3.14159", "Hello world", None, "", "   wide"]


def brute_alignment(texts):
    t = alignment.Tokenizers(*alignment.vocabulary_paths())
    each, count = [], Counter()
    for text in texts:
        ids = None
        if text:
            whole = (t.encode_a.tokenizer.encode(" " + text, add_special_tokens=False).ids, t.pieces.encode(text))
            joined = [b"".join(b[i] for i in v) for v, b in zip(whole, (t.bytes_a, t.bytes_b))]
            ids = whole if joined == [(" " + text).encode()] * 2 else None
        if ids is None:
            each.append(None)
            continue
        ends = [list(itertools.accumulate(len(b[i]) for i in v)) for v, b in zip(ids, (t.bytes_a, t.bytes_b))]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append((ids[0][i:k], ids[1][j:m]))
            i, j = k, m
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        count.update(links.keys())
        each.append((ids, groups, links))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for x in each:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        ids, groups, links = x
        s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(s.encode()).hexdigest(), s))
    return out


def test_alignment_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = TEXTS + ["".join(rng.choice(list("aábc  1.\n日<>'T"), 60)) for _ in range(60)]
    want = sorted((k if k % 7 else None, *x) for k, x in enumerate(brute_alignment(texts)) if k % 7) + [x for k, x in enumerate(brute_alignment(texts)) if not k % 7]
    d = docs(spark, [(k if k % 7 else None, t, "en") for k, t in enumerate(texts)])
    got = [tuple(r) for r in alignment.align(d, with_groups=True).collect()]
    assert sorted(r for r in got if r[0] is not None) == want[: len([r for r in got if r[0] is not None])]
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(x for x in want if len(x) == 8)


def test_alignment_with_many_shards_read_or_mapped(spark, monkeypatch):
    d = docs(spark, [(k, t, "en") for k, t in enumerate(TEXTS)])
    one = sorted(map(tuple, alignment.align(d).collect()))
    assert sorted(map(tuple, alignment.align(d, shard_rows=20).collect())) == one


def test_shards_hold_the_summed_counts_in_order(spark, tmp_path):
    aligned = alignment.alignments(docs(spark, [(k, t, "en") for k, t in enumerate(TEXTS)]))
    folder = f"file://{tmp_path}/shards"
    listed = alignment.shards(alignment.partial_counts(aligned), folder, 30).collect()
    assert len(listed) > 3
    find = alignment.Lookup(folder, [(r["path"], r["first"], r["last"]) for r in listed])
    counts = {(r["a"] << 32) | r["b"]: r["n"] for r in alignment.pair_counts(aligned).collect()}
    keys = np.array(sorted([*counts, 5, 7 << 33]), np.int64)
    assert find(keys).tolist() == [counts.get(k, 0) for k in keys.tolist()]
    assert sum(r["rows"] for r in listed) == len(counts)
    monkey = alignment.Lookup(folder, [(r["path"], r["first"], r["last"]) for r in listed])
    monkey._shard = lambda path: tuple(np.frombuffer(monkey.fs.open_input_file(f"{path}.{x}").read(), "<i8") for x in ("keys", "counts"))
    assert monkey(keys).tolist() == find(keys).tolist()


def test_wide_groups_are_paired_by_distinct_ids():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 400), rng.integers(0, 4, 300)
    length = np.ones(5, np.int64)
    x = alignment.Alignment(a, np.concatenate([b, b[:100]]), length, length)
    x.group_a[:], x.group_b[:] = 0, 0
    x.in_a, x.in_b = np.array([400]), np.array([400])
    keys, times = x.links()
    want = Counter((int(p) << 32) | int(q) for p in a for q in np.concatenate([b, b[:100]]))
    assert dict(zip(keys.tolist(), times.tolist())) == want


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(docs(spark, [])).collect() == []
    assert [tuple(r) for r in alignment.align(docs(spark, [(1, None, "en"), (1, "", None)])).drop("groups").collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


# --- decontamination ---------------------------------------------------------------


def brute_report(rows, items, size=10):
    cut = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(s or ""))
    windows = {}
    for k, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = []
    for k, text, _ in rows:
        w, hit, ids = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i + 1, i + n + 1))
                    ids |= {str(x) for x in got if x is not None}
        out.append((k, len(w), len(hit), tuple(sorted(ids))))
    return out


LONG = "One two THREE four, five six seven-eight nine ten eleven twelve thirteen"
ITEMS = [(3, LONG), (10, LONG + " fourteen"), (2, "short Item"), (2, "é É"), (7, None), (8, " .,;"), (None, "nobody's words here"), (11, LONG), (12, "single")]
ROWS = [
    (1, "before one two three four five six seven eight nine ten after", "en"), (2, LONG, "en"), (2, LONG, "en"), (2, "other " + LONG.lower() + ". Fourteen", "en"), (None, "a short item. SHORT item", "en"), (None, "a short item. SHORT item", None),
    (4, None, "en"), (5, "", "en"), (6, "...", "en"), (7, "É é é É", "fr"), (8, "nobody s words here, nobody", "en"), (9, "clean words only", "en"), (10, " ".join(["single"] * 3000), "en"), (11, "one two three four five six seven eight nine", "en"),
]


@pytest.fixture(scope="module")
def contaminated(spark):
    items = spark.createDataFrame([(k, t, "x", 1) for k, t in ITEMS], "item_id long, text string, words string, h long")
    return docs(spark, ROWS), items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 700])
def test_report_equals_brute_force_in_one_block_or_many(contaminated, block_bytes):
    got = decontaminate.report(*contaminated, block_bytes=block_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r[0], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=key) == sorted(brute_report(ROWS, ITEMS), key=key)


def test_spans_cut_out_leave_nothing_to_hit_and_other_texts_alone(contaminated):
    d, items = contaminated
    clean = decontaminate.without_spans(d, items)
    assert clean.columns == d.columns
    texts = Counter((r["doc_id"], r["text"]) for r in clean.collect())
    want = Counter({(1, "before after"): 1, (2, ""): 2, (2, "other "): 1, (None, "a "): 2, (4, None): 1, (5, ""): 1, (6, "..."): 1, (7, "É é "): 1, (8, "nobody"): 1, (9, "clean words only"): 1, (10, ""): 1, (11, ROWS[-1][1]): 1})
    assert texts == want


def test_documents_are_dropped_by_the_share_hit(contaminated):
    d, items = contaminated
    assert sorted(r["doc_id"] for r in decontaminate.without_documents(d, items).collect()) == [4, 5, 6, 9, 11]
    some = decontaminate.without_documents(d, items, least_share=0.9).collect()
    assert sorted(r["doc_id"] or 0 for r in some) == [0, 0, 1, 4, 5, 6, 7, 8, 9, 11]


def test_decontamination_of_empty_tables(spark, contaminated):
    d, items = contaminated
    assert decontaminate.report(d.limit(0), items).collect() == []
    got = decontaminate.report(d, items.where("item_id in (7, 8)")).collect()
    assert len(got) == len(ROWS) and all(r["n_hit"] == 0 and r["items"] == [] for r in got)


def test_no_python_on_the_native_path(contaminated):
    plan = decontaminate.report(*contaminated)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_counterparts_on_odd_rows(spark, contaminated):
    import duckdb

    d, items = contaminated
    con = duckdb.connect()
    con.register("documents", d.toPandas().assign(doc_id=lambda x: x["doc_id"].astype("Int64")))
    con.register("benchmark", items.toPandas().assign(item_id=lambda x: x["item_id"].astype("Int64")))
    told = con.sql(OP13_SQL).fetchall()
    assert sorted((r[1], r[2], r[3]) for r in told) == sorted((n, hit, len(ids)) for _, n, hit, ids in brute_report(ROWS, ITEMS))
    rows = phrase_rows()
    con.register("documents", docs(spark, rows).select("doc_id", "text", "lang").toPandas())
    assert sorted(con.sql(OP11_SQL).fetchall()) == brute_phrases(rows, 10, 2000)
