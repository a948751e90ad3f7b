from collections import Counter
from itertools import combinations

import numpy as np

from siltstone.llm import neardup, queries


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    """Class of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        small, large = sorted((sum(sets[a].values()), sum(sets[b].values())))
        if small and small >= 0.8 * large:
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (small + large - both):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(rows))]


def as_sets(ids, groups):
    out = {}
    for i, g in zip(ids, groups, strict=True):
        out.setdefault(g, set()).add(i)
    return {frozenset(s) for s in out.values()}


def test_classes_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op7_neardup(spark, sf_dir).collect()
    assert len(got) == len(rows)
    want = as_sets([r[0] for r in rows], brute(rows))
    found = as_sets([r.doc_id for r in got], [r.class_id for r in got])
    assert found == want
    assert sum(r.keep for r in got) == len(want)
    assert all(r.class_id <= r.doc_id and (r.keep == (r.class_id == r.doc_id)) for r in got)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, long), (6, long), (None, long), (7, long + " x"), (8, "one three")]
    df = spark.createDataFrame([(a, b, 0, 1) for a, b in rows], "doc_id long, text string, uid int, a int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.class_id, r.class_size) for r in neardup.near_duplicates(df).collect()))
    assert got == [(False, 1, 1, 1), (False, 2, 2, 1), (False, 3, 3, 1), (False, 4, 4, 2), (False, 5, 4, 2), (False, 6, 6, 4), (False, 6, 6, 4), (False, 7, 6, 4), (False, 8, 8, 1), (True, 0, 6, 4)]
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_agreement_follows_weighted_jaccard():
    shingler = neardup.Shingler()
    base = [f"w{k}" for k in range(400)]
    other = base[:350] + [f"v{k}" for k in range(60)] + base[350:] * 2
    doc, unit = shingler.units([" ".join(base), " ".join(other)])
    a, b = shingles(" ".join(base)), shingles(" ".join(other))
    want = sum((a & b).values()) / sum((a | b).values())
    k = 4000
    sig = neardup.signatures(doc, unit, 2, k)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_chains_join_in_one_class(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.uid: r.root for r in neardup.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == 100


def test_a_bucket_of_unlike_texts_loses_no_link(spark):
    rng = np.random.default_rng(4)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = []
    for _ in range(40):
        own = [f"o{rng.integers(10**9)}" for _ in range(30)]
        texts += [shared + " " + " ".join(own), shared + " " + " ".join(own[:-1] + ["z"])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert as_sets([r.doc_id for r in got], [r.class_id for r in got]) == as_sets(range(len(rows)), brute(rows))


def test_members_that_are_never_heads_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(7)
    # Twelve segments of two versions each: texts that differ in one segment are alike, others aren't, and
    # every unit is in many texts.
    points = []
    while len(points) < 32:
        x = rng.integers(0, 2, 12)
        y = x.copy()
        y[rng.integers(12)] ^= 1
        if all((p != q).sum() > 1 for p in points for q in (x, y)):
            points += [x, y]
    rows = [(k, " ".join(f"s{n}v{v}w{w}" for n, v in enumerate(points[p]) for w in range(20))) for k, p in enumerate(rng.permutation(32))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # All members of a bucket share one part, as some do by chance at any width.
    monkeypatch.setattr(neardup.F, "pmod", lambda a, b: neardup.F.lit(0))
    got = neardup.near_duplicates(df, bands=8, rows=1).collect()
    assert as_sets([r.doc_id for r in got], [r.class_id for r in got]) == as_sets(range(len(rows)), brute(rows))


def test_stars_cost_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(neardup, "stored", lambda df, what, of=neardup.stored: written.append(what) or of(df, what))
    stars = spark.createDataFrame([(1, k) for k in range(2, 40)] + [(50, 60), (61, 50), (7, 7)], "a long, b long")
    assert {r.uid: r.root for r in neardup.components(stars).collect()} == {k: 1 for k in range(2, 40)} | {60: 50, 61: 50}
    assert written == ["edges"]
    assert neardup.components(stars.limit(0)).count() == 0
