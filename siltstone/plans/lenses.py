"""The tables of a test folder seen as catalogues, versions and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored items of subjects (sources) and sessions (languages)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), "doc_id")).alias("path"),
        F.lit("recording").alias("kind"),
        F.col("source").alias("sub"),
        F.col("lang").alias("ses"),
        F.col("lang").alias("datatype"),
        F.col("n_chars").alias("n_samples"),
        (100 + 50 * (F.col("doc_id") % 4)).cast("double").alias("sfreq"),
        F.col("quality").alias("meta.quality"),
        F.col("toxic").alias("meta.toxic"),
        "doc_id",
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of attributes for each subject."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.concat(F.lit("src"), "n_nationkey").alias("sub"), F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).alias("participant"))


def mixed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a dynamic column that is numeric for even subjects and text for odd ones."""
    even = F.regexp_extract("sub", r"(\d+)$", 1).cast("int") % 2 == 0
    value = F.when(F.col("doc_id") % 3 != 0, F.col("n_samples") % 50)
    entry = F.struct(F.when(even, value.cast("double")).alias("num"), F.when(~even, value.cast("string")).alias("txt"))
    return items(spark, sf_dir).withColumn("dyn", F.create_map(F.lit("meta.x"), entry))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, mine, other): a version of the catalogue and two edits of it."""
    base = items(spark, sf_dir).select("path", "sub", "doc_id", "n_samples")
    mine = base.where("doc_id % 7 <> 0").withColumn("n_samples", F.col("n_samples") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0))
    other = base.where("doc_id % 5 <> 0").withColumn("n_samples", F.col("n_samples") + F.when(F.col("doc_id") % 13 == 0, 2).otherwise(0))
    return base, mine, other


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: a recording for each user, a channel for each event type."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), "ts", "event_id", F.col("value").alias("x"))


#: The same lenses as DuckDB relations, to begin the SQL twins with.
SQL_ITEMS = """items AS (
  SELECT d.source || '/' || d.lang || '/doc-' || d.doc_id AS path, 'recording' AS kind, d.source AS sub, d.lang AS ses,
         d.lang AS datatype, d.n_chars AS n_samples, CAST(100 + 50 * (d.doc_id % 4) AS DOUBLE) AS sfreq,
         l.quality AS quality, l.toxic AS toxic, d.doc_id AS doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

SQL_VERSIONS = (
    SQL_ITEMS
    + """, base AS (SELECT path, sub, doc_id, n_samples FROM items),
mine AS (SELECT path, sub, doc_id, n_samples + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n_samples FROM base WHERE doc_id % 7 <> 0),
other AS (SELECT path, sub, doc_id, n_samples + CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 0 END AS n_samples FROM base WHERE doc_id % 5 <> 0)"""
)
