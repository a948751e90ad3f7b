import zlib
from collections import Counter

import numpy as np

from siltstone.llm import queries, sharding


def test_whole_table_in_shards(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 24 and max(counts.values()) < 3 * min(counts.values())


def test_many_buckets_and_odd_rows(spark):
    rows = [(k % 7 if k % 5 else None, None if k % 11 == 0 else "" if k % 13 == 0 else "t" * (k * 40), 1, "x") for k in range(300)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, slot int, bucket string")
    first = sharding.shuffled_shards(df, 3, bucket_bytes=20_000).collect()
    again = sharding.shuffled_shards(df.repartition(5), 3, bucket_bytes=20_000).collect()
    assert len(first) == 350 and all(r._slot == 1 and r.bucket == "x" for r in first)
    for found in (first, again):
        for shard in {r.shard for r in found}:
            assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert Counter((r.doc_id, r.shard) for r in first) == Counter((r.doc_id, r.shard) for r in again)
    assert sharding.shuffled_shards(df.limit(0), 3).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1200 and min(seen.values()) > 800
    assert sorted(sharding.fisher_yates(1000, 5).tolist()) == list(np.arange(1000))


def test_shards_and_places_by_brute_force(spark):
    """Rendezvous over Spark's own hash, row by row, and buckets that follow each shard's bytes."""
    rows = [(None, "n" * 500) for _ in range(200)] + [(k, "t" * 50) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shuffled_shards(df, 4, bucket_bytes=10_000).collect()
    hashes = spark.createDataFrame([(k, s) for k in {r[0] for r in rows} for s in range(5)], "doc_id long, s int").selectExpr("doc_id", "s", "xxhash64(0, doc_id, s) AS h").collect()
    best = lambda key, n: max((r.h, r.s) for r in hashes if r.doc_id == key and r.s < n)[1]
    assert all((r.shard, r.grown_shard) == (best(r.doc_id, 4), best(r.doc_id, 5)) for r in got)
    assert len(got) == 300
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
