"""Two-pass external shuffle: scatter rows into memory-sized buckets by seeded hashes, then Fisher-Yates
every bucket and write it.

The law is `key`: the shard of a row follows from its key and the number of shards alone (the shard with
the greatest hash of key and shard number), so that one more shard takes rows only into itself. A shard is
a run of buckets; a row's bucket within its shard comes from a seeded hash of its content and its place
in the input, so that copies and the rows of a hot key still spread. Inside a bucket the order is a seeded
Fisher-Yates shuffle of the rows in content order, whatever order they arrive in, so a task that is run
again on the same input writes the same file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import free_name, shared_folder

#: Bytes that a bucket holds in the mean; two buckets fit in a worker beside their shuffled copies.
BUCKET_BYTES = 24_000_000


def key_shard(key: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is greatest."""
    ranked = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(ranked)["s"].cast("int")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its texts and binaries, and eight for any other value."""
    out = F.lit(0).cast("long")
    for field in df.schema.fields:
        long = isinstance(field.dataType, (T.StringType, T.BinaryType))
        out = out + (F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) if long else F.lit(8))
    return out


def fisher_yates(count: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(count): every place in turn swaps with a place not after it."""
    order = np.arange(count)
    draws = np.random.Generator(np.random.PCG64(seed)).random(count)
    for last in range(count - 1, 0, -1):
        other = int(draws[last] * (last + 1))
        order[last], order[other] = order[other], order[last]
    return order


def shuffled_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``df`` in shuffled shards to shared storage and return it as read back.

    Added: shard int, slot long (gapless from 0 within the shard, the row's place in it) and grown_shard int
    (its shard if there were one more). All columns of ``df`` are kept; clashing names get a leading
    underscore. Null texts count no bytes; null keys are one key; repeated rows are rows of their own. A
    shard has as many buckets as its own bytes need, so a hot or null key's shard has more buckets, not
    larger ones (a bucket's bytes vary with its rows' about ``bucket_bytes``). One exchange of the rows, one
    running sum over the buckets' counts.
    """
    spark = df.sparkSession
    for name in ("shard", "slot", "grown_shard"):
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, "_" + name))
    bucket, order, home = free_name(df, "bucket"), free_name(df, "order"), free_name(df, "home")
    shard = key_shard(F.col(key), shards, seed)
    # Bytes of every shard: as many numbers as shards, whatever the rows.
    weight = df.select(shard.alias(home), row_bytes(df).alias("bytes")).groupBy(home).agg(F.sum("bytes").alias("bytes")).collect()
    parts = [1] * shards
    for row in weight:
        parts[row[home]] = max(1, -(-row["bytes"] // bucket_bytes))
    first = np.cumsum([0, *parts]).tolist()
    number = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(home) + 1)
    content = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), F.monotonically_increasing_id())
    scattered = df.withColumn(home, shard)
    scattered = scattered.withColumn(bucket, (number(first[:-1]) + F.pmod(content, number(parts))).cast("int")).drop(home)
    # Equal rows are alike, so content alone fixes what stands at each place.
    scattered = scattered.withColumn(order, F.xxhash64(F.lit(seed + 2), *[F.col(c) for c in df.columns]))
    schema = T.StructType([*df.schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField("place", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        own = table.column(bucket)[0].as_py()
        table = table.take(pc.sort_indices(table, [(order, "ascending"), (key, "ascending")])).drop_columns([order])
        table = table.take(pa.array(fisher_yates(table.num_rows, seed * 1_000_003 + own)))
        return table.append_column("place", pa.array(np.arange(table.num_rows)))

    path = shared_folder(spark, "shards")
    scattered.repartition(first[-1], bucket).groupBy(bucket).applyInArrow(run, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    # Rows before a bucket in its shard: a running sum over one row for each bucket.
    sizes = written.groupBy(F.col(bucket).alias("b")).agg(F.count("*").alias("n"))
    number = F.array(*[F.lit(v) for v in first])
    sizes = sizes.withColumn("shard", (F.size(F.filter(number, lambda f: f <= F.col("b"))) - 1).cast("int"))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("b", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = written.join(starts, written[bucket] == starts["b"])
    return out.select(*[written[c] for c in df.columns], "shard", (F.col("start") + F.col("place")).alias("slot"), key_shard(written[key], shards + 1, seed).alias("grown_shard"))
