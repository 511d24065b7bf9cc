import random
import re

import numpy as np

from patchlake.llm import simhash


def _groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def _texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    out = [None, "", "one", "One", " one\n", "a b", None]
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    out.append("x " * 70_000)
    return out


def test_components_equal_brute_force(spark):
    texts = _texts()
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, f0 string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    prints = np.array([simhash.simhash(t) for t in texts], np.int64).view(np.uint64).ravel()
    want = _groups(len(texts), lambda a, b: int(prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {k: (f"{int(prints[k]):016x}", want[k]) for k in range(len(texts))}
    assert got[0][0] == "0" * 16 and got[1][1] == 0 and got[3] == got[2]


def test_similar_groups_equal_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(df).collect()}

    def shingles(t):
        w = simhash.ascii_words(t)
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    want = _groups(len(texts), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert got == dict(enumerate(want))


def _same_groups(spark, pairs):
    """Whether each pair, and nothing else, is one group; every pair is similar enough."""
    texts = [" ".join(w) for pair in pairs for w in pair]
    for a, b in pairs:
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) >= 0.8 * len(x | y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(df).collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


def test_replaced_blocks_and_appended_tails_are_found(spark):
    rng = random.Random(7)
    pick = lambda n: rng.choices([f"w{k}" for k in range(5000)], k=n)
    pairs = []
    for _ in range(60):
        a, at = pick(500), rng.randrange(400)
        pairs += [(a, a[:446] + pick(54)), (b := pick(500), b[:at] + pick(50) + b[at + 50 :]), (c := pick(500), c + pick(120))]
    _same_groups(spark, pairs)


def test_repeated_passages_are_found(spark):
    rng = random.Random(8)
    pairs = []
    for n, times in ((300, 8), (300, 5), (500, 10), (120, 2)) * 10:
        a = rng.choices([f"w{k}" for k in range(5000)], k=n)
        pairs.append((a, a + a[:12] * times))
    _same_groups(spark, pairs)


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.similar_groups(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r)[0::2] for r in simhash.simhash_components(rows).orderBy("doc_id").collect()] == [(None, 5), (5, 5), (5, 5), (7, 5)]
    assert sorted(r["doc_id"] or 0 for r in simhash.one_of_each(rows).collect()) == [0, 5]


def test_of_rows_with_one_id_the_smallest_text_stays(spark):
    a, b, c = "b c d e f g h i j", "a c d e f g h i j", "x y z x y z x y z"
    rows = spark.createDataFrame([(1, a, "p"), (1, b, "q"), (1, b, "r"), (2, a, "s"), (3, c, "t"), (4, c, "u"), (None, c, "v"), (None, c, "v")], "doc_id long, text string, source string")
    for parts in (1, 3):
        got = sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in simhash.one_of_each(rows.repartition(parts)).collect())
        assert [x[:2] for x in got] == [(0, c), (0, c), (1, b), (2, a), (3, c)] and got[2] in ((1, b, "q"), (1, b, "r"))


def _linked(texts):
    """By brute force: fingerprints of at most 3 differing bits, or shingle sets similar to 0.8 or more."""
    prints = np.array([simhash.simhash(t) for t in texts], np.int64).view(np.uint64).ravel()
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    bits = lambda a, b: int(prints[a] ^ prints[b]).bit_count() <= 3
    return bits, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])


def test_one_of_each_follows_simhash_links_and_similarity(spark):
    rng = random.Random(11)
    words, pairs = [f"w{k}" for k in range(5000)], []
    while len(pairs) < 4:
        a = rng.choices(words, k=300)
        b = [rng.choice(words) if k % 30 == 7 else w for k, w in enumerate(a)]
        bits, similar = _linked([" ".join(a), " ".join(b)])
        if bits(0, 1) and not similar(0, 1):
            # linked to the pair's second text by similarity only: the group needs links of both kinds
            pairs += [" ".join(a), " ".join(b), " ".join(b[:290])]
    texts = pairs + _texts()
    bits, similar = _linked(texts)
    want = _groups(len(texts), lambda a, b: bits(a, b) or similar(a, b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(set(want))
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_copies(df).collect()} == {k: g for k, g in enumerate(want) if want.count(g) > 1}


def test_fingerprints_equal_a_plain_count_of_bits():
    import xxhash

    for text in _texts():
        words = [w for w in re.split("[\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w][:3000]
        text = " ".join(words)
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([text] if words else [])
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        assert simhash.simhash(text)[0] % 2**64 == want
