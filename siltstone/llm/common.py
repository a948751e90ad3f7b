"""What several operators share: batch bounds, shared storage, stable hashing, reading tables."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch holds at most (a single longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 400, 16_000_000

#: A key is hot from this share of all rows on, so that a table of the hot keys has a bounded size.
HOT_SHARE, HOT_ROWS = 1e-4, 1000

#: White space between words, as the contracts have it.
SPACE = r"[\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, before a plan with Python in it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the cluster's shared checkpoint folder.

    Only a local master may leave ``spark.checkpoint.dir`` unset, as in tests; elsewhere that is an error,
    since executors and driver would not see the same files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir() + "/siltstone-shared"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to shared storage and read back: lineage is cut and survives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``table``, which has each key once, without a hot key's rows in one task.

    Keys with HOT_SHARE of the rows or more (1 / HOT_SHARE keys at most) are looked up in a broadcast of
    their entries; all others meet in an exchange by key. ``rows`` is read three times, so it should be
    stored. Null keys find nothing.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    limit = max(HOT_ROWS, int((counts.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE))
    hot = counts.where(F.col("_n") >= limit).select(key)
    found = stored(hot.join(table, key, "left"), "hot")
    if found.isEmpty():
        return rows.join(table, key, "left")
    names = F.broadcast(found.select(key))
    return rows.join(F.broadcast(found), key).unionByName(rows.join(names, key, "left_anti").join(table, key, "left"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null ids count as remainder of the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def batches_of(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """Texts of an Arrow column; null is the empty text."""
    for value in column.to_pylist():
        yield value if value is not None else ""
