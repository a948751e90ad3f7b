import tracemalloc

import numpy as np

from siltstone.llm import langid, queries


def test_held_out_languages(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op4_langid(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    rows = got.merge(docs, on="doc_id")
    rows = rows[rows.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (rows.lang_pred == rows.lang).mean() > 0.95


def test_odd_rows(spark):
    rows = [(1, "der und die", "de", "x"), (2, "the and of", "en", None), (3, None, "en", "x"), (4, "12 !!", None, "x"), (4, "12 !!", None, "x"), (5, "le la de " * 30_000, "fr", "x"), (None, "", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(df, langid.learn(df)).collect()
    assert [r.lang_pred for r in got] == ["de", "en", "und", "und", "und", "fr", "und"]
    assert all(0 <= r.score <= 1 and r._score in ("x", None) for r in got)
    assert [r.lang_pred for r in langid.predict(df, langid.learn(df.limit(0))).collect()] == ["und"] * 7
    assert langid.predict(df, langid.learn(df.where("lang = 'de'"))).first().lang_pred == "de"


def test_families():
    assert langid.family_of("en") == langid.family_of("de") != langid.family_of("fr")
    assert langid.family_of("xx") == "xx"


def test_no_language_is_left_out(spark):
    rows = [(k, f"{chr(97 + k % 12)}{chr(97 + (k * 5) % 26)}{chr(97 + k % 12)} " * 20, f"x{k % 12}") for k in range(240)] + [(7, "aaa " * 9, "x0")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, per_language=5)
    assert sorted(sum(model.families.values(), [])) == sorted({r[2] for r in rows})


def test_fit_holds_its_sample_once():
    rng = np.random.default_rng(5)
    x = rng.random((1000, langid.BUCKETS), np.float32)
    x[::2, 7] += 3
    held = x.copy()
    tracemalloc.start()
    model = langid.fit(x, ["en", "fr"] * 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < held.nbytes / 2
    head = model.heads.index(("germanic", "", ""))
    assert (((held @ model.weights + model.bias)[:, head] > 0) == (np.arange(1000) % 2 == 0)).mean() > 0.99
