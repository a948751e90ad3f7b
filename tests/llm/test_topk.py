import duckdb
import numpy as np

from siltstone.llm import queries, topk


def brute(asked, data, k):
    """Every row but those of the query's own key, repeats included; null keys last among ties."""
    out = []
    for q, v in asked:
        found = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), x is None, x or 0) for x, w in data if x != q and len(w) == len(v)]
        out += [(q, n + 1, None if none else x, min(topk.MOST, max(topk.LEAST, -s))) for n, (s, none, x) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.op2_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(duckdb.sql(queries.ORACLE_SQL["op2_topk"]).fetchall())


def test_clusters_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK_BYTES", 3200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    centres = rng.integers(-50, 50, (6, 4)) * 100
    data = [(k, (centres[k % 6] + rng.integers(-3, 4, 4)).astype(float).tolist()) for k in range(400)]
    data += [(1000 + k, [7.0, 7.0, 7.0, 7.0]) for k in range(200)] + [(1000, [7.0] * 4)] * 30 + [(2000, [1.0, 2.0]), (2001, [3.0, 4.0]), (None, [7.0] * 4), (None, [7.0] * 4)]
    asked = [d for d in data if d[0] is not None and d[0] % 20 == 0]
    df, q = spark.createDataFrame(data, "key long, v array<double>"), spark.createDataFrame(asked, "key long, v array<double>")
    for pivots, groups in ((12, 4), (None, None)):
        got = sorted((tuple(r) for r in topk.top_k(q, df, 5, pivots=pivots, groups=groups).collect()), key=str)
        assert got == brute(asked, data, 5)


def test_repeated_rows_are_candidates_each(spark):
    data = [(1, [1.0, 0.0])] * 2 + [(2, [5.0, 0.0])] * 3 + [(3, [5.0, 0.0]), (None, [5.0, 0.0])]
    df = spark.createDataFrame(data, "key long, v array<double>")
    got = sorted((tuple(r) for r in topk.top_k(df, df, 4).collect()), key=str)
    assert got == brute([d for d in data if d[0] is not None], data, 4)
    assert (1, 1, 2, 5) in got and (1, 4, 3, 5) in got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 5), (1, None, 5), (2, [], 5), (3, [nan, 1.0], 5), (4, [inf, 1.0], 5), (5, [None, 1.0], 5), (6, [-0.5, 70000.0], 5), (100, [-0.0001, 0.5], 5), (200, [], 5), (None, [1.0, 1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    kept = {-1 if r.key is None else r.key: r.v for r in v.collect()}
    assert kept == {-1: [1024, 1024], 0: [1024, 2048], 2: [], 6: [-512, 70000 * 1024], 100: [-1, 512], 200: []}
    got = sorted((tuple(r) for r in topk.top_k(v.where("key % 100 = 0"), v).collect()), key=str)
    data = [(None if k < 0 else k, x) for k, x in kept.items()]
    assert got == brute([d for d in data if d[0] is not None and d[0] % 100 == 0], data, 10)
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v.where("key = 0"), v.limit(0)).count() == 0


def test_immense_components_stay_exact(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 5.0]), (2, [3e38, 4.0]), (3, [-3e38, 1.0]), (4, [-3e38, 2.0]), (5, [2.0, 1.0]), (6, [9e15, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    data = [(r.key, r.v) for r in v.collect()]
    got = sorted((tuple(r) for r in topk.top_k(v, v, 6).collect()), key=str)
    assert got == brute(data, data, 6)
    assert [r[2] for r in sorted(got, key=lambda r: (r[0], r[1])) if r[0] == 0] == [1, 2, 6, 5, 4, 3]


def test_products_choose_an_exact_form():
    for top in (2.0**20, 2.0**27, 2.0**40):
        a = np.array([[top - 1] * 64])
        assert int(topk._products(a, a)[0, 0]) == 64 * int(top - 1) ** 2
