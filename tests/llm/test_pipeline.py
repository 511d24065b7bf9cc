import random

from pyspark.sql import functions as F

import corpus_pipeline


def _write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")


def _tables(spark, n=260):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        w = rng.choices(words, k=60)
        toxic, bad = k % 6 == 0, k % 7 == 0
        if toxic:
            w[rng.randrange(60)] = "vilescum"
        if bad:
            w = [x + "%%%" for x in w]
        rows.append((k, " ".join(w), "en", f"s{k % 3}", "x"))
        labels.append((k, int(not bad), int(toxic)))
    copy = " ".join(rng.choices(words, k=80))
    rows += [(1000 + k, copy if k < 30 else copy + f" tail{k}", "en", "s0", "x") for k in range(40)]
    rows += [(None, copy + " other words that only this text has got in it all", None, None, None), (2000, None, "en", "s1", None), (2001, "", "en", "s1", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs, labels = _tables(spark)
    folder = f"file://{tmp_path}/t"
    _write(spark, folder, docs, labels)
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"file://{tmp_path}/s{k}")
        after = spark.read.parquet(f"file://{tmp_path}/s{k}")
        if k < 4:
            assert after.columns == docs.columns, name
            kept[name] = sorted(r["doc_id"] or -1 for r in after.collect())
        now = after
    truth = {r["doc_id"]: r for r in labels.collect()}
    clean = [k for k, r in truth.items() if not r["toxic"]]
    assert not [k for k in kept["toxicity"] if k in truth and truth[k]["toxic"]] and set(clean) <= set(kept["toxicity"])
    good = [k for k in clean if truth[k]["quality"]]
    assert set(good) <= set(kept["quality"]) and not [k for k in kept["quality"] if k in truth and not truth[k]["quality"]]
    assert not {2000, 2001} & set(kept["quality"])
    # the copies and near copies are one document; the rest stays
    assert [k for k in kept["near_dedup"] if 1000 <= k < 2000] == [1000] and set(good) <= set(kept["near_dedup"])
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(kept["mixing"].count(k) for k in set(kept["mixing"])) <= 2
    packed = now.agg(F.sum("length").alias("n"), F.max("sequence_tokens").alias("m")).first()
    assert packed["n"] > 0 and packed["m"] <= 2048


def test_empty_tables(spark, tmp_path):
    docs, labels = _tables(spark, 10)
    folder = f"file://{tmp_path}/t"
    _write(spark, folder, docs.limit(0), labels.limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
