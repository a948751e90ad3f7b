import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lm, queries


def brute(docs, train):
    counts = Counter()
    for text in train:
        counts.update([*lm.words_of(text), lm.END])
    n, v = sum(counts.values()), len(counts)
    out = []
    for key, text in docs:
        tokens = [*lm.words_of(text), lm.END]
        out.append((key, len(tokens), sum(t in counts for t in tokens), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return n, out


def test_base_by_brute_force_and_model_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "CARRIED", 3000)  # so that many words go through the join
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, want = brute(docs, [t for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2])
    got = {r.doc_id: r for r in queries.op1_lm(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for key, tokens, known, base in want:
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, zlib.crc32(str(key).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_by_brute_force(spark, monkeypatch):
    """Every token's probability from the model's own formula, symbol by symbol, and its share of a class."""
    monkeypatch.setattr(lm, "SYMBOLS", lm.CLASSES + 4)
    monkeypatch.setattr(lm, "CARRIED", 6)
    rows = [(1, "a b a c a b d"), (2, "a c b e f g"), (3, "unseen unseen a hot"), (4, None)] + [(10 + k, "hot b") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    in_training = F.col("doc_id") < 3
    counts, vocab, model = lm.learn(df, in_training)
    assert b"hot" in vocab.words and len(vocab.words) <= 6 and vocab.own == 3
    seen = Counter(w for k, t in rows if k < 3 for w in lm.words_of(t))
    own = [w for w, _ in sorted(seen.items(), key=lambda r: (-r[1], r[0]))][:3]
    weight = Counter({k: 1 for k in range(lm.CLASSES)})
    for word, c in seen.items():
        if word not in own:
            weight[lm.class_of(word)] += c + 1
    context, target, bias = model.both[:, : lm.DIM], model.both[:, lm.DIM : -1], model.both[:, -1]

    def symbol(word):
        return 1 + own.index(word) if word in own else 1 + len(own) + lm.class_of(word)

    def log_probability(text):
        h2, h1, out = 0, 0, 0.0
        for word in [*lm.words_of(text), None]:
            s = 0 if word is None else symbol(word)
            scores = bias + target @ (model.position[0] * context[h1]) + target @ (model.position[1] * context[h2])
            out += scores[s] - np.log(np.exp(scores.astype(float)).sum())
            if word is not None and word not in own:
                out += math.log((seen[word] + 1) / weight[lm.class_of(word)])
            h2, h1 = h1, s
        return out / math.log(10)

    got = {r.doc_id: r for r in lm.score(df, counts, vocab, model).collect()}
    assert all(got[k].score == pytest.approx(log_probability(t), abs=1e-4) for k, t in rows)
    n, want = brute(rows, [t for k, t in rows if k < 3])
    assert vocab.tokens == n and all((got[k].n_tokens, got[k].n_known) == (a, b) and got[k].base_score == pytest.approx(c) for k, a, b, c in want)


def test_probabilities_sum_to_one():
    words = [b"w%d" % k for k in range(3000)]
    vocab = lm.Vocabulary(10_000, 3001, words, np.arange(3000, 0, -1), 50)
    model = lm.LogBilinear.start(vocab)
    model.both[:, :-1] *= 8
    near, far, normal = model.tables()
    for h1, h2 in ((0, 0), (5, 9), (vocab.symbols - 1, 3)):
        assert np.exp(near[h1] + far[h2] - normal[h1, h2]).sum() == pytest.approx(1, abs=1e-3)


def test_training_learns_an_order():
    vocab = lm.Vocabulary(400, 5, [b"a", b"b", b"c", b"d"], np.array([100, 100, 100, 100]), 100)
    model = lm.LogBilinear.start(vocab)
    trainer = lm.Trainer(model, vocab, 0)
    h2, h1, w = lm.contexts([np.tile([1, 2, 3, 4], 50) for _ in range(20)])
    for _ in range(60):
        trainer.step(h2, h1, w)
    near, far, normal = lm.LogBilinear(trainer.both, trainer.position).tables()
    assert np.exp(near[1] + far[4] - normal[1, 4])[2] > 0.8


def test_odd_rows(spark):
    rows = [(1, None, 3.5), (None, "", 3.5), (2, "A b\x0bB\xa0c a", 3.5), (2, "A b\x0bB\xa0c a", 3.5), (3, "zz " * 60_000, 3.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    counts, vocab, model = lm.learn(df.where("doc_id = 2"))
    got = lm.score(df, counts, vocab, model).collect()
    n, want = brute([r[:2] for r in rows], [r[1] for r in rows if r[0] == 2])
    assert n == vocab.tokens
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for r, w in zip(sorted([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got], key=key), sorted(want, key=key), strict=True):
        assert r[:3] == w[:3] and r[3] == pytest.approx(w[3])
    counts, vocab, model = lm.learn(df.limit(0))
    assert [r.base_score for r in lm.score(df, counts, vocab, model).collect()] == [0.0] * 5
    assert lm.score(df.limit(0), counts, vocab, model).count() == 0


def test_a_batch_is_looked_up_at_once(monkeypatch):
    words = [b"w%d" % k for k in range(3000)]
    vocab = lm.Vocabulary(3001, 3001, words, np.arange(3000, 0, -1), 5)
    texts = [[], [b"w1", b"x", b"w2999"], [b"w2"], [], [b"yy"] * 3]
    want = [vocab.read(t) for t in texts]
    calls = []
    monkeypatch.setattr(lm.Vocabulary, "read", lambda self, words, of=lm.Vocabulary.read: calls.append(len(words)) or of(self, words))
    places, symbols = vocab.read_all(texts)
    assert calls == [7]
    assert [p.tolist() for p in places] == [a.tolist() for a, _ in want] and [s.tolist() for s in symbols] == [b.tolist() for _, b in want]
    assert [len(p) for p in vocab.read_all([[], []])[0]] == [0, 0] and vocab.read_all([]) == ([], [])
