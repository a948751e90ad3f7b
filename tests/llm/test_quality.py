import numpy as np

from siltstone.llm import quality, queries


def test_held_out_labels(spark, sf_dir):
    got = queries.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    rows = got.merge(labels, on="doc_id")
    rows = rows[rows.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (rows.predicted == rows.quality).mean() > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_pairs_by_brute_force():
    rng = np.random.default_rng(1)
    ids = np.stack([rng.integers(0, 40, 30), rng.integers(0, 5, 30)], 1)
    ends = np.zeros(30, np.int64)
    ends[[9, 10, 29]] = 1
    doc = [0] * 10 + [1] + [2] * 19
    want = []
    for i in range(30):
        for j in range(30):
            if doc[i] == doc[j] and 0 < abs(i - j) <= 2:
                want.append(ids[i, 0] * quality.BUCKETS + ids[j, 0])
            if doc[i] == doc[j] and abs(i - j) == 1:
                want.append(ids[i, 1] * quality.BUCKETS + ids[j, 1])
        want += [ids[i, 0] * quality.BUCKETS + ids[i, 1], ids[i, 1] * quality.BUCKETS + ids[i, 0]]
    assert sorted(want) == sorted(quality.pair_codes(ids, ends).tolist())


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "a b c", 0.5), (3, "x " * 50_000, 0.5), (3, "x " * 50_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    vectors = quality.context_vectors(df)
    net = quality.learn(df, labels, vectors)
    got = quality.score(df, vectors, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r._score == 0.5 for r in got)
    empty = df.limit(0)
    assert quality.score(empty, quality.context_vectors(empty), net).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit(x, y)
    p = net.probability(x)
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = (p >= lo) & (p < lo + 0.25)
        assert abs(p[part].mean() - y[part].mean()) < 0.08


def test_long_words_count_whole():
    text = "a" * 200 + "1" + "b" * 63 + " end"
    assert "".join(quality.words_of(text)) == text.replace(" ", "") and max(map(len, quality.words_of(text))) == quality.PIECE
    assert quality.words_of("two words") == ["two", "words"] and quality.words_of("") == []
    assert quality.shape("aB9" * 20) != quality.shape("aB9" * 19 + "aB-")
