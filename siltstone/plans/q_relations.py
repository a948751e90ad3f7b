"""Joins, windows, sorting and limits over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import numeric
from siltstone.operators import joins, windows
from siltstone.plans import lenses
from siltstone.plans.catalogue import register
from siltstone.plans.lenses import SQL_ITEMS, SQL_VERSIONS, table


@register("joi01_items_participants", f"WITH {SQL_ITEMS} SELECT i.path, n.n_regionkey AS region FROM items i LEFT JOIN nation n ON i.sub = 'src' || n.n_nationkey")
def joi01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.items(spark, sf_dir).join(lenses.participants(spark, sf_dir), "sub", "left").select("path", "participant.region")


@register("joi02_semi_subjects", f"WITH {SQL_ITEMS} SELECT path FROM items WHERE sub IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey < 2)")
def joi02(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lenses.participants(spark, sf_dir).where("participant.region < 2").select("sub")
    return lenses.items(spark, sf_dir).join(kept, "sub", "left_semi").select("path")


_OVERLAY = f"WITH {SQL_ITEMS}, staged AS (SELECT path, sub, n_samples + 1 AS n_samples FROM items WHERE sub IN ('src1', 'src2')) SELECT path, n_samples FROM items WHERE sub NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT path, n_samples FROM staged"


@register("joi03_staged_overlay", _OVERLAY)
def joi03(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lenses.items(spark, sf_dir).select("path", "sub", "n_samples")
    staged = items.where("sub in ('src1', 'src2')").withColumn("n_samples", F.col("n_samples") + 1)
    removed = items.where("sub = 'src3'").select("sub")
    return joins.overlaid(items, staged, removed).select("path", "n_samples")


@register("joi06_sidecar_inheritance", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'file' WHEN source = 'src1' THEN 'deep' ELSE 'root' END AS value FROM documents")
def joi06(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    entity = F.create_map(F.lit("run"), F.col("doc_id").cast("string"), F.lit("sub"), F.col("source"))
    files = docs.select(F.col("doc_id").alias("path"), F.concat(F.lit("data/"), "source").alias("dir"), entity.alias("entities"), F.lit("eeg").alias("suffix"))
    empty = F.create_map().cast("map<string,string>")
    one = spark.range(1)
    root = one.select(F.lit("data").alias("dir"), empty.alias("entities"), F.lit("eeg").alias("suffix"), F.lit("k").alias("key"), F.lit("root").alias("value"))
    deep = one.select(F.lit("data/src1").alias("dir"), empty.alias("entities"), F.lit("eeg").alias("suffix"), F.lit("k").alias("key"), F.lit("deep").alias("value"))
    own = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("data/"), "source").alias("dir"), F.create_map(F.lit("run"), F.col("doc_id").cast("string")).alias("entities"), F.lit("eeg").alias("suffix"), F.lit("k").alias("key"), F.lit("file").alias("value"))
    found = joins.inherited(files, root.unionByName(deep).unionByName(own))
    return found.select(F.col("path").alias("doc_id"), "value")


@register("joi07_sidecars_by_stem", "WITH p AS (SELECT page_id, page_id % 10 AS dir, CAST(page_id AS VARCHAR) AS stem FROM pages), s AS (SELECT doc_id % 10 AS dir, CAST(doc_id AS VARCHAR) AS stem FROM documents) SELECT p.page_id, s.stem AS sidecar FROM p LEFT JOIN s ON p.dir = s.dir AND starts_with(s.stem, p.stem)")
def joi07(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("dir"), F.col("page_id").cast("string").alias("stem"))
    sides = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("dir"), F.col("doc_id").cast("string").alias("stem"))
    return joins.beside(files, sides).select("page_id", "sidecar")


@register("joi11_manifest_fallbacks", "SELECT l.l_orderkey, l.l_linenumber, coalesce(o.o_orderpriority, c.c_mktsegment, 'n/a') AS label FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderkey % 3 = 0 LEFT JOIN customer c ON c.c_custkey = l.l_suppkey")
def joi11(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_suppkey"), "c_mktsegment")
    rows = joins.with_fallbacks(table(spark, sf_dir, "lineitem"), [(orders, "l_orderkey", "o_orderpriority"), (people, "l_suppkey", "c_mktsegment")], "label")
    return rows.select("l_orderkey", "l_linenumber", "label")


@register(
    "joi12_as_of_backward",
    """SELECT e.event_id, coalesce((SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts),
  (SELECT min(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup')) AS session FROM events e WHERE e.event_type = 'error'""",
)
def joi12(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", "ts")
    return joins.as_of(left, right, ["user_id"], "ts", "ts", "ts", into="session").select("event_id", "session")


@register(
    "joi13_as_of_forward",
    """SELECT e.event_id, coalesce((SELECT min(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts >= e.ts),
  (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase')) AS session FROM events e WHERE e.event_type = 'view'""",
)
def joi13(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", "ts")
    return joins.as_of(left, right, ["user_id"], "ts", "ts", "ts", forward=True, into="session").select("event_id", "session")


@register("joi14_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 1 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 1")
def joi14(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return joins.upserted(old, old.where("c_custkey % 10 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@register("joi15_seen_before", "SELECT min(turn) AS turn, conv_id, text FROM conversations GROUP BY conv_id, text")
def joi15(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("turn", "conv_id", "text")
    return joins.first_seen(talks.withColumn("k", F.struct("conv_id", "text")), "k", ["turn"]).drop("k")


@register("joi16_clash_set", f"WITH {SQL_VERSIONS} SELECT path FROM base WHERE (doc_id % 7 = 0 OR doc_id % 11 = 0) INTERSECT SELECT path FROM base WHERE (doc_id % 5 = 0 OR doc_id % 13 = 0)")
def joi16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import versions

    base, mine, other = lenses.versions(spark, sf_dir)
    return versions.clashes(versions.difference(base, mine), versions.difference(base, other), ["path"])


@register("joi17_orphans", "SELECT DISTINCT e.user_id, CAST(e.ts AS DATE) AS day FROM events e WHERE e.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.user_id = e.user_id AND CAST(u.ts AS DATE) = CAST(e.ts AS DATE) AND u.event_type = 'view')")
def joi17(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return joins.orphans(days.where("event_type = 'error'"), days.where("event_type = 'view'"), ["user_id", "day"])


@register("joi18_superseded", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def joi18(spark: SparkSession, sf_dir: str) -> DataFrame:
    newer = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id"))
    return joins.superseded(table(spark, sf_dir, "pages").select("page_id"), newer, "page_id")


@register("joi19_create_or_update", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, o.w AS w FROM (SELECT s_suppkey AS k, s_name AS v, s_acctbal AS w FROM supplier WHERE s_suppkey % 2 = 0) o FULL OUTER JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'new' END AS v FROM supplier WHERE s_suppkey % 3 = 0) n ON o.k = n.k")
def joi19(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = table(spark, sf_dir, "supplier")
    old = all_.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.col("s_acctbal").alias("w"))
    new = all_.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, "new").alias("v"))
    return joins.upserted(old, new, ["k"], update=True)


@register("win01_run_numbers", "WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place, n_chars, count(*) OVER w = count(DISTINCT n_chars) OVER w AS fine FROM documents WINDOW w AS (PARTITION BY source, lang)) SELECT doc_id, CASE WHEN fine THEN CAST(n_chars AS VARCHAR) ELSE CAST(place AS VARCHAR) END AS run, CASE WHEN fine THEN 'size' ELSE 'order' END AS run_rule FROM r")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return windows.numbered_runs(docs, ["source", "lang"], {"size": F.col("n_chars")}, ["doc_id"]).select("doc_id", "run", "run_rule")


@register("win02_best_copy", "WITH r AS (SELECT doc_id, row_number() OVER w AS n, first_value(doc_id) OVER w AS best FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id % 3 DESC, doc_id)) SELECT doc_id, CASE WHEN n > 1 THEN best END AS same_as FROM r")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("content"))
    return windows.best_copies(docs, "content", [F.desc(F.col("doc_id") % 3)], "doc_id").select("doc_id", "same_as")


@register("win03_disambiguate", "WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n > 1 THEN role || '-' || n ELSE role END AS name FROM r")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return windows.disambiguated(talks, "role", ["conv_id"], ["turn"], into="name").select("conv_id", "turn", "name")


@register("win04_first_occurrence", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_seen(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"]).select("conv_id", "turn")


@register(
    "win05_islands",
    """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value >= 50 AS hit FROM events),
f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM r WHERE hit)
SELECT user_id, min(i) / 250.0::DOUBLE AS onset, count(*) / 250.0::DOUBLE AS duration FROM f GROUP BY user_id, run""",
)
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(table(spark, sf_dir, "events"), F.col("value") >= 50, ["user_id"], ["ts", "event_id"], 250.0).select("user_id", "onset", "duration")


@register(
    "win06_fill",
    """WITH r AS (SELECT event_id, user_id, ts, CASE WHEN value * 15000 < 1e6 THEN value END AS good FROM events)
SELECT event_id, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM r""",
)
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.filled(events, "value", numeric.invalid(F.col("value") * 15000), ["user_id"], ["ts", "event_id"]).select("event_id", "filled")


_TIMES = "times AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, value FROM events)"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")


@register(
    "win07_grid",
    f"""WITH {_TIMES}, s AS (SELECT user_id, CAST(round_even((t - min(t) OVER (PARTITION BY user_id)) / 86400.0::DOUBLE, 0) AS BIGINT) AS slot, event_id, value FROM times),
o AS (SELECT user_id, slot, arg_max(value, event_id) AS v FROM s GROUP BY user_id, slot),
g AS (SELECT user_id, unnest(range(0, max(slot) + 1)) AS slot FROM o GROUP BY user_id)
SELECT g.user_id, g.slot, last_value(o.v IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, o.v IS NULL AS missing
FROM g LEFT JOIN o ON g.user_id = o.user_id AND g.slot = o.slot""",
)
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gridded(_times(spark, sf_dir), ["user_id"], "t", "value", "event_id", 86400.0)


@register(
    "win08_timing_error",
    f"""WITH {_TIMES}, p AS (SELECT event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM times)
SELECT event_id, round(coalesce(t - (b + greatest(round_even((t - b) / 600.0::DOUBLE, 0), 1) * 600), 0), 3) AS error FROM p""",
)
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.timing_error(_times(spark, sf_dir), ["user_id"], "t", ["t", "event_id"])
    return found.select("event_id", F.round("timing_error", 3).alias("error"))


@register("win09_previous_end", f"WITH {_TIMES} SELECT event_id, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM times")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.previous(_times(spark, sf_dir), ["user_id"], "t", ["t", "event_id"], "before").select("event_id", "before")


@register("win10_quotas", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.quotas(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 3).select("doc_id")


@register("win11_regular_spacing", "WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem) SELECT l_orderkey, coalesce(max(abs(step - f)) <= 1e-6, true) AS regular FROM (SELECT *, min_by(step, CASE WHEN step IS NOT NULL THEN i END) OVER (PARTITION BY l_orderkey) AS f FROM s) GROUP BY l_orderkey")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.regular(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey"])


@register("win12_batches", "SELECT doc_id, CAST(floor((sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars) * 4 / sum(n_chars) OVER (PARTITION BY source)) AS INTEGER) AS batch FROM documents")
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.batches(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "n_chars", 4, ["doc_id"], ["source"]).select("doc_id", "batch")


@register("win13_run_counter", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value >= 50 THEN 0 ELSE 1 END, ts, event_id) AS run FROM events")
def win13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("value") >= 50, 0).otherwise(1)
    return windows.run_counter(table(spark, sf_dir, "events"), ["user_id", "event_type"], [rank, "ts", "event_id"]).select("event_id", "run")


@register("srt01_subject_path_order", f"WITH {SQL_ITEMS} SELECT path, row_number() OVER (PARTITION BY sub ORDER BY path) AS place FROM items")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return lenses.items(spark, sf_dir).select("path", F.row_number().over(Window.partitionBy("sub").orderBy("path")).alias("place")).orderBy("path")


@register("srt02_ties", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@register("lim01_newest_first", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 10")
def lim01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id")


@register("lim02_verify_sample", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def lim02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(25)


@register("lim03_positional", f"WITH {SQL_ITEMS} SELECT path FROM items ORDER BY sub, path LIMIT 1 OFFSET 7")
def lim03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.items(spark, sf_dir).orderBy("sub", "path").offset(7).limit(1).select("path")


@register("lim04_even_sample", f"WITH {SQL_ITEMS}, s AS (SELECT sub, row_number() OVER (ORDER BY sub) AS n FROM (SELECT DISTINCT sub FROM items)) SELECT sub FROM s WHERE n % 4 = 1 ORDER BY sub LIMIT 3")
def lim04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    subs = lenses.items(spark, sf_dir).select("sub").distinct()
    return subs.withColumn("n", F.row_number().over(Window.orderBy("sub"))).where("n % 4 = 1").orderBy("sub").limit(3).select("sub")


@register("top01_largest", f"WITH {SQL_ITEMS} SELECT ses, arg_max(path, n_samples * 1000000 + doc_id) AS path FROM items GROUP BY ses")
def top01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.items(spark, sf_dir).groupBy("ses").agg(F.max_by("path", F.struct("n_samples", "doc_id")).alias("path"))
