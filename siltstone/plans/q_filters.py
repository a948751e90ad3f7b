"""Predicates and projections over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import lenses, predicate
from siltstone.plans.catalogue import register
from siltstone.plans.lenses import SQL_ITEMS


def _over_items(name: str, text: str | None, condition: str, **filters) -> None:
    """Register a predicate over the catalogue with its SQL condition."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predicate.where(lenses.items(spark, sf_dir), text, **filters).select("path", "n_samples")

    register(name, f"WITH {SQL_ITEMS} SELECT path, n_samples FROM items WHERE {condition}")(query)


_over_items("flt01_parse_text_and_keywords", "n_samples >= 1000", "n_samples >= 1000 AND ses = 'en' AND sfreq < 200", ses="en", sfreq__lt=200)
_over_items("flt02_bool_ops", "ses == 'en' and (n_samples < 300 or sfreq == 250) and not sub == 'src0'", "ses = 'en' AND (n_samples < 300 OR sfreq = 250) AND NOT sub = 'src0'")
_over_items("flt03_column_forms", "col('meta.quality') == 1 and meta.toxic == 0", "coalesce(quality = 1, false) AND coalesce(toxic = 0, false)")
_over_items("flt04_literals", "n_samples > -1 and sfreq in {100, 250.0}", "n_samples > -1 AND sfreq IN (100, 250)")
_over_items("flt05_chained_flip", "500 <= n_samples < 5000", "n_samples >= 500 AND n_samples < 5000")
_over_items("flt06_keyword_suffixes", None, "n_samples > 200 AND sfreq <= 200 AND ses IN ('fr', 'de') AND coalesce(quality <> 0, false)", n_samples__gt=200, sfreq__le=200, ses__in=["fr", "de"], meta__quality__ne=0)
_over_items("flt07_num_range", "n_samples >= '500' and n_samples < 5000", "n_samples >= 500 AND n_samples < 5000")
_over_items("flt08_text_equality", "ses == 'fr' and sub != 'src3'", "ses = 'fr' AND sub <> 'src3'")
_over_items("flt09_text_order", "sub > 'src1' and sub <= 'src4'", "sub > 'src1' AND sub <= 'src4'")
_over_items("flt10_membership", "ses in ['fr', 'de'] and meta.quality not in [0]", "ses IN ('fr', 'de') AND quality IS NOT NULL AND quality NOT IN (0)")
_over_items("flt11_number_as_text", "sfreq in ['250', 'x'] or n_samples == 'abc'", "CAST(CAST(sfreq AS BIGINT) AS VARCHAR) IN ('250', 'x') OR CAST(n_samples AS VARCHAR) = 'abc'")
_over_items("flt12_exists", "exists(meta.quality)", "quality IS NOT NULL")
_over_items("flt13_and_or", "meta.quality == 1 and sfreq > 150 or meta.toxic == 1", "(coalesce(quality = 1, false) AND sfreq > 150) OR coalesce(toxic = 1, false)")
_over_items("flt14_complement", "not meta.quality == 1", "NOT coalesce(quality = 1, false)")
_over_items("flt14_not_equal_contrast", "meta.quality != 1", "quality <> 1")
_over_items("flt16_empty_predicate", "", "true")
_over_items("flt17_kind", None, "kind = 'recording'", kind="recording")
_over_items("flt21_point_lookup", "path == 'src1/en/doc-1'", "path = 'src1/en/doc-1'")


def with_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their subject's attributes; participants are a table of subjects, so Spark broadcasts it if small."""
    return lenses.items(spark, sf_dir).join(lenses.participants(spark, sf_dir), "sub", "left")


PARTICIPANTS = SQL_ITEMS + ", joined AS (SELECT i.*, n.n_regionkey AS region, n.n_name AS name FROM items i LEFT JOIN nation n ON i.sub = 'src' || n.n_nationkey)"


@register("query_end_to_end", f"WITH {PARTICIPANTS} SELECT path, kind, sub, ses, datatype, n_samples FROM joined WHERE datatype = 'en' AND n_samples >= 1000 AND coalesce(region < 2, false)")
def query_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predicate.where(with_participants(spark, sf_dir), "datatype == 'en' and n_samples >= 1000 and participant.region < 2")
    return found.select("path", "kind", "sub", "ses", "datatype", "n_samples").orderBy("sub", "path")


@register("flt15_scalar_participant", f"WITH {PARTICIPANTS} SELECT path FROM joined WHERE coalesce(region >= 2, false) AND coalesce(name > 'C', false) AND n_samples < 400")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.where(with_participants(spark, sf_dir), "participant.region >= '2' and participant.name > 'C' and n_samples < 400").select("path")


_MIXED = (
    SQL_ITEMS
    + """, mixed AS (SELECT *, CAST(regexp_extract(sub, '([0-9]+)$', 1) AS INT) % 2 = 0 AS even,
  CASE WHEN doc_id % 3 <> 0 THEN n_samples % 50 END AS x FROM items)"""
)


@register(
    "flt07_08_mixed_type_column",
    f"WITH {_MIXED} SELECT path FROM mixed WHERE x IS NOT NULL AND (CASE WHEN even THEN x > 7 ELSE CAST(x AS VARCHAR) > '7' END)",
)
def mixed_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.where(lenses.mixed_items(spark, sf_dir), "meta.x > 7").select("path")


@register("flt18_prune_subjects", f"WITH {SQL_ITEMS} SELECT sub FROM items GROUP BY sub HAVING max(n_samples) >= 20000 AND max(CASE WHEN ses = 'en' THEN 1 ELSE 0 END) = 1")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    summary = catalog.summarize(lenses.items(spark, sf_dir))
    return catalog.prune(summary, predicate.parse("n_samples >= 20000 and ses == 'en'")).select("sub")


@register("flt19_find", f"WITH {SQL_ITEMS} SELECT path FROM items WHERE datatype = 'en' AND sub = 'src2' AND sfreq = 200")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    return catalog.find(lenses.items(spark, sf_dir), datatype="en", sub="src2", sfreq="200").select("path")


@register("flt20_only_match", f"WITH {SQL_ITEMS} SELECT path, n_samples FROM items WHERE path = (SELECT min(path) FROM items)")
def only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    items = lenses.items(spark, sf_dir)
    return catalog.only(items, path=items.agg(F.min("path")).first()[0]).select("path", "n_samples")


@register("flt22_prefix_listing", f"WITH {SQL_ITEMS} SELECT path FROM items WHERE path = 'src1/en' OR starts_with(path, 'src1/en/')")
def under(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    return catalog.under(lenses.items(spark, sf_dir), "src1/en").select("path")


@register("flt23_glob_answers", f"WITH {SQL_ITEMS} SELECT path, CASE WHEN regexp_full_match(path, 'src1.*/doc-.*') THEN 'second' WHEN regexp_full_match(path, '.*/en/.*') THEN 'first' END AS answer FROM items")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions import text

    return lenses.items(spark, sf_dir).select("path", text.glob_answer(F.col("path"), {"*/en/*": "first", "src1*/doc-*": "second"}).alias("answer"))


@register("flt24_items_by_kind", f"WITH {SQL_ITEMS} SELECT path FROM items WHERE sub = 'src4' AND ses = 'en' AND kind = 'recording'")
def of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    return catalog.of_kind(lenses.items(spark, sf_dir), "recording", "src4", "en").select("path")


@register("flt25_subjects_sessions", f"WITH {SQL_ITEMS} SELECT DISTINCT sub, ses FROM items")
def subjects_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.items(spark, sf_dir).select("sub", "ses").distinct().orderBy("sub", "ses")


@register("prj01_result_projection", f"WITH {PARTICIPANTS} SELECT path, kind, sub, ses, datatype, n_samples, region, name FROM joined WHERE sfreq = 250")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.where(with_participants(spark, sf_dir), "sfreq == 250").select("path", "kind", "sub", "ses", "datatype", "n_samples", "participant.region", "participant.name")


@register("prj03_column_subset", "SELECT doc_id, n_chars FROM documents")
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.table(spark, sf_dir, "documents").select("doc_id", "n_chars")


@register("prj04_item_rows", f"WITH {SQL_ITEMS} SELECT path, CASE WHEN sfreq > 0 THEN n_samples / sfreq END AS duration_s FROM items")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    return catalog.with_duration(lenses.items(spark, sf_dir)).select("path", "duration_s")


@register(
    "prj05_path_decomposition",
    """WITH p AS (SELECT doc_id, 'sub-' || doc_id % 9 || CASE WHEN doc_id % 3 = 0 THEN '/derivatives/clean' ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN '/ses-' || doc_id % 4 ELSE '' END || CASE WHEN doc_id % 5 < 3 THEN '/eeg' ELSE '' END || '/task-a' AS path FROM documents)
SELECT doc_id, 'sub-' || doc_id % 9 AS sub, CASE WHEN doc_id % 3 = 0 THEN 'derivatives/clean' END AS prefix,
  CASE WHEN doc_id % 2 = 0 THEN 'ses-' || doc_id % 4 END AS ses, CASE WHEN doc_id % 5 < 3 THEN 'eeg' END AS datatype FROM p""",
)
def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    docs = lenses.table(spark, sf_dir, "documents")
    path = F.concat(
        F.lit("sub-"), F.col("doc_id") % 9,
        F.when(F.col("doc_id") % 3 == 0, "/derivatives/clean").otherwise(""),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/ses-"), F.col("doc_id") % 4)).otherwise(""),
        F.when(F.col("doc_id") % 5 < 3, "/eeg").otherwise(""), F.lit("/task-a"),
    )
    return docs.select("doc_id", catalog.placed(path).alias("p")).select("doc_id", "p.sub", "p.prefix", "p.ses", "p.datatype")


@register("prj06_scalar_metadata", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    entry = catalog.scalar_metadata(F.col("props"))["meta.k"]
    return lenses.table(spark, sf_dir, "events").select("event_id", entry["num"].cast("bigint").alias("k"))


@register("prj07_codec_text", "SELECT doc_id, 'bitround(digits=' || doc_id % 5 || ')+zstd(level=3)' AS codec FROM documents")
def codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    steps = F.array(
        F.struct(F.lit("bitround").alias("name"), F.create_map(F.lit("digits"), (F.col("doc_id") % 5).cast("string")).alias("options")),
        F.struct(F.lit("zstd").alias("name"), F.create_map(F.lit("level"), F.lit("3")).alias("options")),
    )
    return lenses.table(spark, sf_dir, "documents").select("doc_id", catalog.codec_text(steps).alias("codec"))


@register("prj08_export_path", "SELECT doc_id, 'sub-' || source || '/ses-' || lang || '/eeg' AS dir, 'sub-' || source || '_ses-' || lang || '_run-' || doc_id || '_eeg' AS stem FROM documents")
def export_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    path = F.concat(F.lit("sub-"), "source", F.lit("/ses-"), "lang", F.lit("/eeg/run-"), "doc_id")
    docs = lenses.table(spark, sf_dir, "documents")
    return docs.select("doc_id", catalog.export_dir(path).alias("dir"), catalog.export_stem(path, F.lit("eeg")).alias("stem"))


@register(
    "prj09_rule_cascade",
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'a' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN lang END, 'unknown') AS value, CASE WHEN doc_id % 4 = 0 THEN 'answer' WHEN doc_id % 3 = 0 THEN 'folder' ELSE 'default' END AS rule FROM documents",
)
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import catalog

    rules = {"answer": F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a"), "doc_id")), "folder": F.when(F.col("doc_id") % 3 == 0, F.col("lang")), "default": F.lit("unknown")}
    return lenses.table(spark, sf_dir, "documents").select("doc_id", catalog.cascade(rules).alias("c")).select("doc_id", "c.value", "c.rule")


@register("prj10_describe_session", f"WITH {SQL_ITEMS} SELECT kind, path, n_samples FROM items WHERE sub = 'src5' AND ses = 'en'")
def describe_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.where(lenses.items(spark, sf_dir), sub="src5", ses="en").select("kind", "path", "n_samples").orderBy("path")
