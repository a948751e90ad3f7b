"""Unnesting and verification over nested forms of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import tables, verify, windows
from siltstone.plans import lenses
from siltstone.plans.catalogue import register
from siltstone.plans.lenses import SQL_VERSIONS, table


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as programs; every seventh order has none."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS program FROM lineitem WHERE l_orderkey % 7 <> 0)"


@register(
    "unn01_therapy_contacts",
    f"""WITH {_LINES} SELECT o_orderkey, l.program AS program, 'Active' AS role, CAST(l_partkey AS VARCHAR) AS contact FROM orders JOIN l ON l_orderkey = o_orderkey WHERE l_partkey % 3 <> 0
UNION ALL SELECT o_orderkey, l.program, 'Return', CAST(l_suppkey AS VARCHAR) FROM orders JOIN l ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 1
UNION ALL SELECT o_orderkey, l.program, 'n/a', 'n/a' FROM orders JOIN l ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 0
UNION ALL SELECT o_orderkey, NULL, 'n/a', 'n/a' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)""",
)
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = F.transform(
        "lines",
        lambda x: F.struct(
            F.when(x["l_partkey"] % 3 != 0, F.array(x["l_partkey"])).otherwise(F.array().cast("array<bigint>")).alias("active"),
            F.when(x["l_partkey"] % 3 == 1, F.array(x["l_suppkey"])).alias("returns"),
        ),
    )
    nested = _nested(spark, sf_dir).withColumn("programs", programs)
    return tables.therapy_contacts(nested, ["o_orderkey"], "programs").drop("p")


@register("unn02_adaptive_settings", f"WITH {_LINES} SELECT l_orderkey AS o_orderkey, program AS entry, l_quantity AS quantity FROM l WHERE l_partkey % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _nested(spark, sf_dir).withColumn("settings", F.transform("lines", lambda x: F.when(x["l_partkey"] % 2 == 0, x)))
    return tables.settings_rows(nested, ["o_orderkey"], "settings").select("o_orderkey", "entry", F.col("setting.l_quantity").alias("quantity"))


@register("unn03_samples_long", "SELECT vec_id, c.channel AS channel, t AS time, embedding[c.k * 4 + t + 1]::DOUBLE AS value FROM embeddings, (VALUES ('L', 0), ('R', 1)) c(channel, k), range(4) r(t)")
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")).alias("t"), F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4)).cast("array<array<double>>").alias("d"), F.array(F.lit("L"), F.lit("R")).alias("n")
    )
    return tables.samples_long(e, ["vec_id"], "t", "d", "n")


@register("unn04_electrodes", "SELECT vec_id, c AS contact, CASE WHEN c < 2 THEN CAST(CAST(c AS INTEGER) AS VARCHAR) ELSE 'n/a' END AS x, 'n/a' AS z FROM embeddings, range(4) r(c)")
def electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")).alias("contacts"), F.array(F.array(F.lit(0), F.lit(5)), F.array(F.lit(1), F.lit(6))).alias("xyz"))
    return tables.electrode_rows(e, ["vec_id"], "contacts", "xyz").select("vec_id", "contact", "x", "z")


@register("unn05a_rows_in_order", "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity").orderBy("l_shipdate", "l_orderkey", "l_linenumber")


@register("unn05b_before_after", "SELECT event_id, event_type AS new, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'n/a') AS previous FROM events")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.previous(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], default="n/a")
    return found.select("event_id", F.col("event_type").alias("new"), "previous")


@register("unn05c_annotation_ends", "SELECT event_id, CAST(event_id AS DOUBLE) AS onset, event_id + value AS \"end\", value AS duration FROM events")
def annotation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.annotation_rows(table(spark, sf_dir, "events"), ["event_id"], F.col("event_id").cast("double"), F.col("value"))


@register("unn05d_answers_wide", "SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS a, max(CASE WHEN turn = 1 THEN role END) AS b FROM conversations GROUP BY conv_id")
def answers_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("turn") == 0, "a").when(F.col("turn") == 1, "b").otherwise("z")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(q).alias("q"), F.collect_list("role").alias("v"))
    return tables.answers_wide(talks, ["conv_id"], "q", "v", ["a", "b"])


@register("unn06_absent_as_na", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang = 'en' THEN 'n/a' ELSE lang END AS lang FROM documents")
def absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.or_na(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang")))


@register("unn07_live_channels", "SELECT event_id FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING NOT bool_and(value < 90))")
def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.live_channels(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("value") < 90).select("event_id")


@register("unn08_fixed_columns", "SELECT lang, doc_id, CAST(NULL AS VARCHAR) AS sex FROM documents")
def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.fixed_columns(table(spark, sf_dir, "documents"), ["lang", "doc_id", "sex"])


@register(
    "unn09_impedance_pairs",
    """SELECT vec_id, 'monopolar' AS kind, 'c' || i AS contact, 'n/a' AS contact_2, CAST((vec_id + i) % 3 AS INTEGER) AS ohm FROM embeddings, range(2) r(i) WHERE (vec_id + i) % 3 <> 0
UNION ALL SELECT vec_id, 'bipolar', 'c' || i, 'c' || j, CAST((vec_id + i + j) % 4 AS INTEGER) FROM embeddings, range(3) r(i), range(3) s(j) WHERE j > i AND (vec_id + i + j) % 4 <> 0""",
)
def impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    matrix = F.array(*[F.array(*[((v + i + j) % 4).cast("int") for j in range(3)]) for i in range(3)])
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.lit(f"c{i}") for i in range(3)]).alias("names"), F.array(*[((v + i) % 3).cast("int") for i in range(2)]).alias("mono"), matrix.alias("bi"))
    return tables.impedance_rows(e, ["vec_id"], "names", "mono", "bi")


@register("unn10_event_union", "SELECT event_id AS id, event_type AS kind, CAST(NULL AS VARCHAR) AS text FROM events UNION ALL SELECT conv_id, role, text FROM conversations")
def event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return tables.event_rows(a, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("kind"), "text"))


@register("unn11_sessions_table", "SELECT DISTINCT source AS participant_id, lang AS session_id, 'n/a' AS acq_time FROM documents")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.col("source").alias("participant_id"), F.col("lang").alias("session_id")).distinct()
    return tables.or_na(found.withColumn("acq_time", F.lit(None).cast("string"))).orderBy("participant_id", "session_id")


@register("unn12_devices", "SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("model"))
    return tables.devices_by_session(orders, "o_custkey", "o_orderkey", ["model"]).select("o_custkey", F.size("devices").cast("long").alias("n"))


@register(
    "ver02_table_compare",
    f"""WITH {SQL_VERSIONS} SELECT 'extra_rows' AS code, 'error' AS severity, CAST(count(*) AS VARCHAR) AS message, '' AS location FROM base WHERE doc_id % 7 = 0
UNION ALL SELECT 'values', 'error', CAST(count(*) AS VARCHAR), 'n_samples' FROM base WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0""",
)
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    return verify.tables(base.select("doc_id", "n_samples").distinct(), mine.select("doc_id", "n_samples").distinct(), "doc_id")


@register(
    "ver08_joi09_fidelity",
    f"""WITH {SQL_VERSIONS} SELECT 'missing' AS code, path AS location FROM base WHERE doc_id % 7 = 0
UNION ALL SELECT 'shape', path FROM base WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0""",
)
def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    source = base.withColumn("checksum", F.col("n_samples").cast("double"))
    return verify.items(source, mine.withColumn("checksum", F.col("n_samples").cast("double"))).select("code", "location")


@register(
    "ver07_joi10_store_check",
    "SELECT 'not_indexed' AS code, source AS location FROM documents GROUP BY source HAVING min(doc_id) % 3 = 0 UNION ALL SELECT 'digest', source FROM documents GROUP BY source HAVING min(doc_id) % 3 = 1",
)
def store_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("sub")).agg(F.min("doc_id").alias("m"))
    index = subs.where("m % 3 <> 0").select("sub", (F.col("m") + F.when(F.col("m") % 3 == 1, 1).otherwise(0)).alias("digest"))
    return verify.store(subs.select("sub", F.col("m").alias("digest")), index).select("code", "location")


@register("ver04_manifest_check", "SELECT 'not_found' AS code, CAST(page_id AS VARCHAR) AS location FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.lit("s1").alias("sub"), F.col("page_id").cast("string").alias("path"))
    return verify.manifest(rows, table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("path"))).select("code", "location")
