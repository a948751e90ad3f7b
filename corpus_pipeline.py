"""A training-data pipeline over documents: identify languages, remove near duplicates, replace personal
data, mix to target weights, and tokenise.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All accept empty tables, null cells, repeated rows and
columns beyond COLUMNS, which they drop; texts count whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, neardup, pii
from siltstone.llm.common import fold, shared_folder
from siltstone.llm.queries import DEMONSTRATION_KEY, mixed_documents, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language (null, empty or letterless texts); lang becomes the predicted one.

    The model learns from the labelled documents outside the held-out fold; without any, no document has a
    language. Null lang, source and doc_id are no reason to reject; repeated rows share their fate.
    """
    model = langid.learn(docs.where(fold("doc_id", 4) != 2))
    found = langid.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of least doc_id, the first of its rows.

    A null doc_id comes last. Null, empty and blank texts have no duplicates and stay.
    """
    return neardup.deduplicated(docs.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text. A null text stays null, with null n_chars; no row goes."""
    found = pii.pseudonymized(docs.select(*COLUMNS), DEMONSTRATION_KEY)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities; copies of a doc_id share their fate.

    Documents without a word are never drawn; a missing source or language is a value of its own.
    """
    return mixed_documents(docs.select(*COLUMNS)).where("keep").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to; null is the empty text."""
    ranks, pattern = tokenizer_file()
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL can't express the learned, hashed and tokenised stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
