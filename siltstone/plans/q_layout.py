"""Folder layouts, history and checks that need no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import reports, signal, verify
from siltstone.operators.store import Repository
from siltstone.plans import lenses
from siltstone.plans.catalogue import register
from siltstone.plans.lenses import table
from siltstone.session import scratch
from siltstone.sources import files


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a folder: a signal and a sidecar each."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("sub-"), "source", F.lit("_run-"), "doc_id", F.lit("_eeg"))
    folder = F.concat(F.lit("sub-"), "source", F.lit("/ses-"), "lang", F.lit("/eeg"))
    rows = docs.select(folder.alias("dir"), name.alias("stem"), F.col("n_chars").alias("length"), F.explode(F.array(F.lit(".edf"), F.lit(".json"))).alias("ext"))
    return rows.select("dir", F.concat("stem", "ext").alias("name"), F.concat("dir", F.lit("/"), "stem", "ext").alias("path"), "ext", "length")


@register("src03_agg09_bundles", "SELECT 'sub-' || source || '/ses-' || lang || '/eeg' AS dir, 'sub-' || source || '_run-' || doc_id AS entities, 'eeg' AS suffix, 2 AS n, CAST(NULL AS VARCHAR) AS problem FROM documents")
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bundles(_listing(spark, sf_dir)).select("dir", "entities", "suffix", F.size("files").alias("n"), "problem")


@register("src12_work_units", "SELECT 'sub-' || source AS sub, 'ses-' || lang AS ses, 'eeg' AS datatype, CAST(2 * sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY source, lang")
def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.work_units(_listing(spark, sf_dir)).select("sub", "ses", "datatype", "n_bytes")


@register("src13_subjects", "SELECT DISTINCT 'sub-' || source AS sub FROM documents WHERE source <> 'src0'")
def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.work_units(_listing(spark, sf_dir)).where("sub <> 'sub-src0'").select("sub").distinct()


@register("src19_earlier_folder_wins", "SELECT source AS key, arg_min(lang, doc_id) AS value FROM documents GROUP BY 1")
def earlier_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("lang").alias("value"), "doc_id")
    return reports.merged_attribute(docs, "key", "value", "doc_id", earliest=True)


@register("src22_edf_header", "SELECT doc_id, make_timestamp(CASE WHEN doc_id % 100 >= 85 THEN 1900 + doc_id % 100 ELSE 2000 + doc_id % 100 END, 2, 1, 3, 4, 5) AS recorded, CAST(doc_id % 1000 AS INTEGER) AS n_channels FROM documents")
def edf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.concat(F.lit("01.02."), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("03.04.05"))
    text = F.concat(F.rpad(F.lit("0"), 168, " "), date, F.rpad(F.lit("256"), 52, " "), F.rpad(F.lit("1"), 16, " "), F.rpad((F.col("doc_id") % 1000).cast("string"), 4, " "))
    head = files.edf_header(text.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", head["recorded"].alias("recorded"), head["n_channels"].alias("n_channels"))


@register("snk03_changed_chunks_only", "SELECT vec_id, c AS chunk FROM embeddings, range(4) r(c) WHERE (vec_id + c) % 5 = 0")
def changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("chunk")
    old = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", chunk).select("vec_id", "chunk", F.slice("embedding", F.col("chunk").cast("int") * 16 + 1, F.lit(16)).alias("samples"))
    edit = (F.col("vec_id") + F.col("chunk")) % 5 == 0
    new = old.withColumn("samples", F.when(edit, F.transform("samples", lambda x: x + F.lit(1.0).cast("float"))).otherwise(F.col("samples")))
    return signal.changed_chunks(new, old, ["vec_id", "chunk"]).select("vec_id", "chunk")


@register("set06_set14_log_and_status", "SELECT * FROM (VALUES (0, 'third'), (1, 'second'), (2, 'first')) t(age, message)")
def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = Repository(spark, scratch(spark, "repo"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_regionkey").alias("sub"), F.concat(F.lit("s"), "n_regionkey", F.lit("/"), "n_nationkey").alias("path"))
    for region, message in enumerate(("first", "second", "third")):
        repo.add(nation.where(F.col("sub") == f"s{region}"))
        repo.commit(message)
    return spark.createDataFrame([(k, m) for k, (_, m) in enumerate(repo.log())], "age int, message string")


@register("set09_reset", "SELECT 0 AS staged")
def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = Repository(spark, scratch(spark, "repo"))
    repo.add(lenses.items(spark, sf_dir).select("sub", "path").where("sub = 'src1'"))
    repo.reset()
    return spark.createDataFrame([(len(repo.status()["staged"]),)], "staged int")


@register("set20_replay", "SELECT doc_id, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 9 <> 0")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import joins

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    patch = docs.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    return joins.upserted(docs, patch, ["doc_id"]).join(docs.where("doc_id % 9 = 0").select("doc_id"), "doc_id", "left_anti")


@register("ver01_types", "SELECT * FROM (VALUES ('dtype', 'n_chars'), ('extra_column', 'spare')) t(code, location)")
def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    stored = docs.withColumn("n_chars", F.col("n_chars").cast("double")).withColumn("spare", F.lit(1))
    found = verify.tables(stored, docs, "doc_id")
    return found.select("code", "location")
