"""The registered query of each operator: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, lm, media, mixing, neardup, pii, quality, sharding, topk
from siltstone.llm.common import documents, fold

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """A public rank file's bytes and its pattern; the file stays where it is installed."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


@_query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    ranks, pattern = tokenizer_file()
    return bpe.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern)


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality probability of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    vectors = quality.context_vectors(docs)
    net = quality.learn(docs, labels, vectors)
    out = quality.score(docs, vectors, net)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@_query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.where(fold("doc_id", 4) != 2))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@_query
def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts, vocab, model = lm.learn(docs, fold("doc_id", 7) != 2)
    out = lm.score(docs, counts, vocab, model)
    held_out = (fold("doc_id", 7) == 2).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@_query
def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in 24 shuffled shards, from the written shards."""
    out = sharding.shuffled_shards(documents(spark, sf_dir), 24)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@_query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's payload as stored and read back."""
    out = media.document_media(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


@_query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest inner products of every hundredth vector with all others."""
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return topk.top_k(vectors.where("key % 100 = 0"), vectors)


ORACLE_SQL["op2_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id IS DISTINCT FROM d.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


#: Where a deployment has a secret of its own, it passes that instead.
DEMONSTRATION_KEY = "siltstone demonstration key"

#: Powers that flatten the shares of sources, languages and topics.
FLATTENING = {"source": 0.5, "lang": 0.7, "topic": 0.7}


@_query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates in place of personal data."""
    return pii.pseudonymized(documents(spark, sf_dir).select("doc_id", "text"), DEMONSTRATION_KEY)


def mixed_documents(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Documents with tokens, probability and keep, raked by source, language and topic."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    return mixing.mixed(docs, dims, mixing.token_count(F.col("text")), FLATTENING, columns=columns)


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampling probability and whether it is drawn."""
    return mixed_documents(documents(spark, sf_dir), ["doc_id", "source", "lang"])
