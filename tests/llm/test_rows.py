import base64
import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from patchlake.llm import html, maxscore, mixing, packing, warc


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", None]), "w " * rng.randint(0, 60)) for k in range(900)] + [(5000, "d", None), (5001, "d", ""), (None, "a", "x y"), (None, "a", "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[1] for r in rows}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    want, left, open_ = {}, 1.5 * sum(size.values()), set(weights)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= over
    for s in weights:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 10
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.mixed(df)
    assert out.columns == df.columns


def test_mix_reaches_targets_beside_a_heavy_id(spark):
    rows = [(k, "a", "w " * 13) for k in range(159)] + [(1000 + k, "b", "w " * 5) for k in range(134)] + [(None, "b", "w " * 5)] * 66
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r for r in mixing.mix(df).collect() if r["size"] == 5]
    assert len(got) == 200 and {r["source_size"] for r in got} == {1000}
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 5 and 1100 < got[0]["target"] < 1200
    assert mixing.mixed(df).where("source = 'b'").count() * 5 == sum(r["taken"] for r in got)


def _tokens(tok, text):
    return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [None, "", "a  b\n\nc", "don't\tstop\r\n", " x ", "naïve café — 12,345 <|endoftext|>", "word " * 30_000, "u" * 5000]
    texts += [" ".join(rng.choices(["alpha", "beta,", "Gamma.", "δέλτα", "42", "new\nline"], k=rng.randint(1, 900))) for _ in range(300)]
    texts += ["short text " * rng.randint(1, 20) for _ in range(3000)]
    rows = list(enumerate(texts)) + [(None, "null id"), (7000, "twice is twice"), (7000, "twice is twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit("clash")).repartition(3)
    got = packing.pack(df, step_tokens=8192).collect()
    tok = Tokenizer.from_file(packing.vocabulary_path())
    own, seqs, used = defaultdict(list), defaultdict(list), {}
    for r in got:
        own[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        seqs[r["sequence_id"]].append((r["offset"], len(r["ids"]) // 4))
        used[r["sequence_id"]] = (r["sequence_tokens"], r["step_group"])
    last = array("I", [1]).tobytes()
    for k, t in [*enumerate(texts), (None, "null id")]:
        assert b"".join(x for _, x in sorted(own[k])) == _tokens(tok, t or "") + last
    assert sum(len(x) for _, x in own[7000]) == 2 * len(_tokens(tok, "twice is twice") + last)
    for k, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == used[k][0] and at <= 2048 and at & (at - 1) == 0
    # windows under the shortest tier hold less than one of its windows a task
    assert sum(n for n, _ in used.values() if n < 256) < 3 * 256
    assert {256, 512, 1024, 2048} <= {n for n, _ in used.values()}
    groups = defaultdict(list)
    for n, g in used.values():
        groups[g].append(n)
    assert all(len(set(g)) == 1 for g in groups.values())
    for tier in (256, 512, 1024, 2048):
        sums = [sum(g) for _, g in sorted(groups.items()) if g[0] == tier]
        assert all(x == 8192 for x in sums[:-1]) and 0 < sums[-1] <= 8192
    assert packing.pack(df.limit(0)).count() == 0


def test_packer_routes_rests_to_tiers_and_fills_gaps_from_shorter_ones():
    p = packing.Packer(0)
    piece = lambda n: b"\0\0\0\0" * n
    for doc, n in enumerate((1500, 400, 200, 700, 300, 2048 + 100, 30)):
        list(p.add(doc, piece(n)))
    assert {t: [n for n, _ in r] for t, r in p.rest.items()} == {256: [30, 100, 200], 512: [300, 400], 1024: [700], 2048: [1500]}
    rows = [(r[5], r[0], r[1], len(r[2]) // 4) for r in p.pack(0)]
    # 1500 leaves a gap of 548: the longest rests that fit are 400 and 100, then 30, and 18 are cut off the shortest left
    assert rows[:4] == [(2048, 0, 0, 1500), (2048, 1, 0, 400), (2048, 5, 2048, 100), (2048, 6, 0, 30)] and rows[4] == (2048, 2, 0, 18)
    assert rows[5:] == [(1024, 3, 0, 700), (1024, 4, 0, 300), (1024, 2, 18, 24)]
    assert [(r[5], r[0], len(r[2]) // 4) for r in p.end()] == [(128, 2, 128), (16, 2, 16), (8, 2, 8), (4, 2, 4), (2, 2, 2)]


def test_encoder_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(packing.vocabulary_path()), packing.Encoder(packing.vocabulary_path())
    texts = ["p\tq\tr\n\n\nb", "x\u3000y\u3000z\n\n\nw", "a\u00a0b  c", "p\tq\n\nr", "a b\nc", " a", "a ", "\na\n", "", " ", "\n\n\t.\ta\t.", "hello <|endoftext|> world", "<|endoftext|>", "x" * 3000]
    rng = random.Random(11)
    parts = ["a", "the", "word", ".", ",", "'s", "é", "ß", "日本", "12", "#", "<|endoftext|>", " ", " ", " ", "\n", "\t", "  ", "\u3000", "\xa0", "\x85", "\r\n", "\x1c", "\u2028", "👍🏽", "\u0301"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(6000)]
    assert [encode(t) for t in texts] == [_tokens(tok, t) for t in texts]


def _brute_top_k(rows, k=10):
    import math

    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, [float("inf")]), [float(math.floor(1024 * x)) for x in v])
    want = []
    for q in good:
        if q % 100 == 0:
            best = sorted(((-sum(int(a) * int(b) for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("kind", ["dense", "sparse", "huge"])
def test_maxscore_equals_brute_force(spark, monkeypatch, kind):
    rng = random.Random(6)
    one = {"dense": lambda: [rng.gauss(0, 1) for _ in range(6)], "sparse": lambda: [rng.choice([0.0] * 9 + [rng.random()]) for _ in range(24)], "huge": lambda: [rng.choice([-1, 1]) * rng.randint(1, 3) * 2.0 ** (7 * k // 5) for k in range(12)]}[kind]
    rows = [(k, one()) for k in range(2700)] + [(10_000 + k, rows_of_ties) for k, rows_of_ties in enumerate([[1.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 40)]
    rows += [(20_000, None), (20_100, [float("nan")] * 6), (20_200, [1.0, None]), (20_300, [0.0] * 6), (None, [1.0] * 6), (20_400, [float("inf")] * 6), (20_500, []), (20_600, [0.5]), (7, [9.0] * 6), (100, [2.0] * 6), (300, rows[300][1])]
    monkeypatch.setattr(maxscore, "SHARD_BYTES", 1)  # shards of 1024 vectors
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", 900)
    monkeypatch.setattr(maxscore, "SAMPLE_BYTES", 3000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = maxscore.top_k(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _brute_top_k(rows)
    assert maxscore.top_k(df.limit(0), F.lit(True)).count() == 0
    few = df.where("vec_id in (100, 200, 3)")
    assert sorted(map(tuple, maxscore.top_k(few, F.col("vec_id") % 100 == 0).collect())) == _brute_top_k([r for r in rows if r[0] in (100, 200, 3)])


def test_maxscore_traverses_and_probes_a_part_only():
    import numpy as np

    rng = np.random.default_rng(3)
    w = np.floor(1024 * (x := rng.normal(size=(20_000, 64))) / np.linalg.norm(x, axis=1, keepdims=True))
    ids = np.arange(len(w))
    floors = []
    for q in range(20):
        floors.append(float(maxscore.Shard(ids[::5], w[::5]).search(w[q], q, 10)[1][9]))
    best = maxscore.Best(ids[:20], w[:20], floors, 10)
    for at in range(0, len(w), 4096):
        best.meet(maxscore.Shard(ids[at : at + 4096], w[at : at + 4096]))
    for q in range(20):
        score = w @ w[q]
        score[q] = -np.inf
        assert best.found[q][1].tolist() == np.sort(score)[::-1][:10].tolist()
    assert best.work.traversed < 0.5 * best.work.whole and best.work.probed < 0.25 * best.work.whole


def _kinds(rows):
    """The records' kinds by the contract: one response a payload, the smallest id's; the others revisit it."""
    groups = defaultdict(list)
    for k, u, h in rows:
        groups[h or ""].append((k is None, k or 0, u or "", k))
    out = []
    for own in groups.values():
        own.sort(key=lambda x: x[:3])
        first = own[0][3]
        out += [(-1 if k is None else k, "response" if n == 0 or first is None else "revisit", None if n == 0 else first) for n, (_, _, _, k) in enumerate(own)]
    return sorted(out, key=repr)


WARC_ROWS = [(k, f"http://h/{k}", f"<p>{k % 7}</p>") for k in range(60)] + [(90, None, None), (91, "ü ö", ""), (None, "u", "<p>1</p>"), (92, "a", "x" * 300_000), (93, "a", "same"), (93, "a", "same"), (93, "b", "same"), (None, "a", "same"), (None, "a", "none has an id"), (None, "b", "none has an id"), (None, "b", "alone")]


def test_warc_round_trip(spark, tmp_path):
    rows = WARC_ROWS
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    first = warc.write(df, folder, roll_bytes=4000, shard_bytes=400)
    assert first["records"] == len(rows) and first["files"] > 3
    got = warc.read(spark, folder).collect()
    for r in got:
        if r["payload"] is not None:
            assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["payload_digest"]
    assert sorted(((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in got), key=repr) == _kinds(rows)
    listed = sorted(map(tuple, warc.manifest(spark, folder).collect()))
    assert warc.write(df.repartition(5), f"file://{tmp_path}/w2", roll_bytes=4000, shard_bytes=400) == first
    assert sorted(map(tuple, warc.manifest(spark, f"file://{tmp_path}/w2").collect())) == listed
    empty = f"file://{tmp_path}/w3"
    assert warc.write(df.limit(0), empty) == {"files": 0, "records": 0} and warc.read(spark, empty).count() == 0
    assert {p.name for p in (tmp_path / "w").glob("*.warc.gz")} == {n for n, *_ in listed} and not (tmp_path / "w" / "tmp").exists()
    for name, size, crc, _ in listed:
        data = (tmp_path / "w" / name).read_bytes()
        assert (zlib.crc32(data), len(data)) == (crc, size)


def test_warc_sql_and_code_agree_on_repeated_rows_and_null_ids(spark, tmp_path):
    import duckdb

    from patchlake.llm import queries

    spark.createDataFrame(WARC_ROWS, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op4_warc(spark, f"file://{tmp_path}")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.OP4_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_mixing_sql_and_code_agree_beside_heavy_ids_and_empty_texts(spark, tmp_path):
    import duckdb

    from patchlake.llm import queries

    rng = random.Random(21)
    rows = [(k, "a", "w " * 13) for k in range(159)] + [(1000 + k, "b", "w " * 5) for k in range(134)] + [(None, "b", "w " * 5)] * 66 + [(3000 + k, "c", "w " * rng.randint(0, 3)) for k in range(50)] + [(4000 + k, None, rng.choice([None, "", "x y"])) for k in range(20)] + [(77, "d", "w w w")] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op3_mixing(spark, f"file://{tmp_path}")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.OP3_SQL})").fetchall()
    plain = lambda rows: sorted([(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows], key=repr)
    assert plain(map(tuple, got.collect())) == plain(want)


def test_no_document_is_taken_more_than_twice(spark):
    rows = [(k, "a", "one two three four five") for k in range(4)] + [(10 + k, "a", "") for k in range(6)] + [(100 + k, "b", "w " * 40) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    times = {r["doc_id"]: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()}
    assert max(times.values()) == 2 and all(times.get(k) == 2 for k in (0, 10, 15))
