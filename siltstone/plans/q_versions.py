"""Aggregations, version algebra and signals over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import numeric, timefn
from siltstone.operators import catalog, reports, signal, versions
from siltstone.plans import lenses, predicate
from siltstone.plans.catalogue import register
from siltstone.plans.lenses import SQL_ITEMS, SQL_VERSIONS, table


@register("agg01_counts_by_kind", f"WITH {SQL_ITEMS} SELECT sub, count(*) AS n_items, count(*) FILTER (kind = 'recording') AS n_recordings, count(DISTINCT ses) AS n_sessions FROM items GROUP BY sub")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.summarize(lenses.items(spark, sf_dir)).select("sub", "n_items", "n_recordings", "n_sessions")


@register("agg02_zone_maps", f"WITH {SQL_ITEMS} SELECT sub, CAST(min(n_samples) AS DOUBLE) AS low, CAST(max(n_samples) AS DOUBLE) AS high, CAST(max(quality) AS DOUBLE) AS quality FROM items GROUP BY sub")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.summarize(lenses.items(spark, sf_dir)).select("sub", F.col("`zmin.n_samples`").alias("low"), F.col("`zmax.n_samples`").alias("high"), F.col("`zmax.meta.quality`").alias("quality"))


@register("agg03_value_sets", f"WITH {SQL_ITEMS} SELECT sub, list_aggregate(list_sort(list(DISTINCT ses)), 'string_agg', ',') AS sessions FROM items GROUP BY sub")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.summarize(lenses.items(spark, sf_dir)).select("sub", F.array_join(F.array_sort("`values.ses`"), ",").alias("sessions"))


@register("agg04_bitmap_of_values", "SELECT lang, count(DISTINCT doc_id % 1000) AS n FROM documents GROUP BY lang")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = reports.value_bitmaps(table(spark, sf_dir, "documents"), ["lang"], F.col("doc_id") % 1000 + 1)
    return maps.select("lang", F.bitmap_count("bits").alias("n"))


@register("agg05_incremental_summary", f"WITH {SQL_VERSIONS} SELECT sub, count(*) AS n, CAST(sum(n_samples) AS BIGINT) AS total FROM mine GROUP BY sub")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    measure = lambda df: df.groupBy("sub").agg(F.count("*").alias("n"), F.sum("n_samples").alias("total"))
    touched = versions.difference(base, mine).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("sub")).distinct()
    return measure(base).join(touched, "sub", "left_anti").unionByName(measure(mine.join(touched, "sub", "left_semi")))


@register("agg06_token_frequency", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(*) = count(DISTINCT doc_id) AS is_distinct FROM documents GROUP BY source")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frequencies(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id").withColumnRenamed("n_values", "langs")


@register("agg07_rule_report", "SELECT 'subject' AS what, CASE WHEN doc_id % 4 = 0 THEN 'answer' ELSE 'folder' END AS rule, count(*) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT 'session', CASE WHEN lang IN ('en', 'de') THEN 'tag' ELSE 'default' END, count(*) FROM documents GROUP BY 1, 2")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = catalog.cascade({"answer": F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("s"), "doc_id")), "folder": F.col("source")})
    session = catalog.cascade({"tag": F.when(F.col("lang").isin("en", "de"), F.col("lang")), "default": F.lit("none")})
    return reports.rule_counts(table(spark, sf_dir, "documents"), {"subject": subject["rule"], "session": session["rule"]})


@register("agg08_duplicate_entities", "SELECT source, lang, n_chars, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])


@register("agg09_file_bundles", "SELECT doc_id // 10 AS bundle, count(DISTINCT lang) AS n, min(CASE WHEN lang = 'en' THEN doc_id END) AS en FROM documents GROUP BY 1")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("bundle"), "lang", "doc_id")
    maps = reports.variants(docs, ["bundle"], "lang", "doc_id")
    return maps.select("bundle", F.size("kinds").cast("long").alias("n"), F.try_element_at("kinds", F.lit("en")).alias("en"))


@register("agg10_local_day", "SELECT user_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_min(event_type, ts) AS kind FROM events GROUP BY 1, 2")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.local_days(table(spark, sf_dir, "events"), ["user_id"], "ts", -5, "event_type")


@register("agg11_mean_of_most_common", "WITH m AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) SELECT event_type, CAST(CAST(sum(CAST(abs(value) AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS DOUBLE) AS mean FROM events WHERE event_type IN (SELECT event_type FROM m) GROUP BY event_type")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mean_of_most_common(table(spark, sf_dir, "events"), "event_type", "value")


@register("agg12_block_sums", "SELECT event_type AS channel, epoch_us(ts) // 3600000000 AS block, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = lenses.signal(spark, sf_dir)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return signal.block_sums(samples, ["channel"], seconds, 3600.0, "x").withColumn("total", F.col("total").cast("double"))


@register("agg13_max_error", f"WITH {SQL_VERSIONS} SELECT max(abs(b.n_samples - m.n_samples)) AS worst, count(*) FILTER (b.n_samples <> m.n_samples) AS n FROM base b JOIN mine m ON b.path = m.path")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    return reports.greatest_error(base, mine, "path", "n_samples")


@register("agg14_mismatch_counts", f"WITH {SQL_ITEMS} SELECT count(*) FILTER (quality IS DISTINCT FROM toxic) AS n_values, count(*) FILTER ((quality IS NULL) <> (toxic IS NULL)) AS n_masks FROM items")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mismatches(lenses.items(spark, sf_dir), F.col("`meta.quality`"), F.col("`meta.toxic`"))


@register("agg15_dead_channels", "SELECT event_type, bool_and(value >= 10) AS all_high, bool_or(value >= 99) AS any_high FROM events GROUP BY 1")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flags(table(spark, sf_dir, "events"), ["event_type"], all_high=("all", F.col("value") >= 10), any_high=("any", F.col("value") >= 99))


@register("agg16_codec_choice", "WITH s AS (SELECT o_orderstatus AS k, o_orderpriority AS mode, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS bytes FROM orders GROUP BY 1, 2) SELECT k, arg_min(mode, bytes) AS mode FROM s GROUP BY k")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_orderpriority").alias("mode"), "o_totalprice")
    return reports.smallest_total(probes, "k", "mode", "o_totalprice")


@register("agg17_gc_accounting", "SELECT source, count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.account(table(spark, sf_dir, "documents"), "n_chars", ["source"])


@register("agg18_tree_size", "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE lang = 'en'")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.account(table(spark, sf_dir, "documents").where("lang = 'en'"), "n_chars", count="files")


@register("agg19_quartiles", "SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quartiles(table(spark, sf_dir, "events"), ["event_type"], "value")


@register("agg20_result_length", f"WITH {SQL_ITEMS} SELECT count(*) AS n FROM items WHERE sfreq > 150")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.where(lenses.items(spark, sf_dir), "sfreq > 150").agg(F.count("*").alias("n"))


@register("agg21_next_label", "SELECT coalesce(max(CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)), 0) + 1 AS next FROM documents")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.next_label(table(spark, sf_dir, "documents"), "source")


@register("agg22_table_shape", "SELECT count(*) AS n_rows, 5 AS n_columns FROM documents")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shape(table(spark, sf_dir, "documents"))


@register("agg23_forms", "SELECT role AS form, count(*) AS n, count(DISTINCT conv_id) AS talks FROM conversations GROUP BY 1")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.forms(table(spark, sf_dir, "conversations"), "role", "conv_id").withColumnRenamed("n_by", "talks")


_DIFF = "SELECT coalesce(b.path, m.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM base b FULL OUTER JOIN mine m ON b.path = m.path WHERE b.path IS NULL OR m.path IS NULL OR b.n_samples IS DISTINCT FROM m.n_samples"


@register("joi04_set02_version_diff", f"WITH {SQL_VERSIONS} {_DIFF}")
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    return versions.difference(base, mine)


@register("set03_diff_counts", f"WITH {SQL_VERSIONS}, d AS ({_DIFF}) SELECT change, count(*) AS n FROM d GROUP BY change")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@register("set04_diff_summary", "SELECT 'src' || doc_id AS item, CASE WHEN doc_id % 2 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), "doc_id").alias("item"), "doc_id")
    nodes = docs.select("item", F.explode(F.array(F.lit("attrs"), F.lit("changed"), F.when(F.col("doc_id") % 2 == 0, "added").otherwise("attrs"))).alias("change"))
    return versions.summarized(nodes)


_DECISION = """SELECT b.path AS path, CASE
  WHEN m.path IS NOT NULL AND m.n_samples = b.n_samples AND o.path IS NOT NULL AND o.n_samples = b.n_samples THEN 'keep'
  WHEN m.path IS NOT NULL AND m.n_samples = b.n_samples THEN CASE WHEN o.path IS NULL THEN 'removed' ELSE 'other' END
  WHEN (o.path IS NOT NULL AND o.n_samples = b.n_samples) OR (m.path IS NULL AND o.path IS NULL) OR m.n_samples = o.n_samples THEN CASE WHEN m.path IS NULL THEN 'removed' ELSE 'mine' END
  ELSE 'conflict' END AS decision
FROM base b LEFT JOIN mine m ON b.path = m.path LEFT JOIN other o ON b.path = o.path"""


@register("joi05_set07_three_way_merge", f"WITH {SQL_VERSIONS} {_DECISION}")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merged(*lenses.versions(spark, sf_dir))


@register("set07_merge_preferring_mine", f"WITH {SQL_VERSIONS}, d AS ({_DECISION}), f AS (SELECT d.path, CASE WHEN decision = 'conflict' THEN CASE WHEN m.path IS NULL THEN 'removed' ELSE 'mine' END ELSE decision END AS decision FROM d LEFT JOIN mine m ON d.path = m.path) SELECT f.path, coalesce(CASE WHEN f.decision = 'other' THEN o.n_samples END, m.n_samples) AS n_samples FROM f LEFT JOIN mine m ON f.path = m.path LEFT JOIN other o ON f.path = o.path WHERE f.decision <> 'removed'")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merge(*lenses.versions(spark, sf_dir), prefer="mine").select("path", "n_samples")


@register("set01_schema_union", "SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return reports.united(a, table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


@register("set05_publish", f"WITH {SQL_VERSIONS} SELECT path, n_samples FROM base WHERE sub NOT IN ('src1', 'src9') UNION ALL SELECT path, n_samples FROM mine WHERE sub = 'src1'")
def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators import joins

    base, mine, _ = lenses.versions(spark, sf_dir)
    return joins.overlaid(base, mine.where("sub = 'src1'"), base.where("sub = 'src9'")).select("path", "n_samples")


@register("set08_revert", f"WITH {SQL_VERSIONS} SELECT path, n_samples FROM base")
def revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    return versions.reverted(mine, base, mine).select("path", "n_samples")


@register("set10_time_travel", f"WITH {SQL_VERSIONS} SELECT path, n_samples FROM mine")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators.store import Repository
    from siltstone.session import scratch

    base, mine, _ = lenses.versions(spark, sf_dir)
    repo = Repository(spark, scratch(spark, "repo"))
    repo.add(mine)
    then = repo.commit("mine")
    repo.add(base, existing="replace")
    repo.commit("base again")
    return repo.read(then).select("path", "n_samples")


#: a <- b <- c <- e (merge of d), b <- d, x alone
COMMITS = [("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["b"]), ("e", ["c", "d"]), ("f", ["e"]), ("g", ["d"]), ("x", [])]
_COMMITS_SQL = "commits(id, parent) AS (VALUES ('b', 'a'), ('c', 'b'), ('d', 'b'), ('e', 'c'), ('e', 'd'), ('f', 'e'), ('g', 'd'))"


def _commits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMITS, "id string, parents array<string>")


@register("set11_ancestors", f"WITH RECURSIVE {_COMMITS_SQL}, up(id, depth) AS (SELECT 'f', 0 UNION ALL SELECT c.parent, up.depth + 1 FROM up JOIN commits c ON c.id = up.id) SELECT id, min(depth) AS depth FROM up GROUP BY id")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.ancestors(_commits(spark), "f")


@register("set12_merge_base", "SELECT 'd' AS id")
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merge_base(_commits(spark), "f", "g")


@register("set13_unique_to_branch", "SELECT * FROM (VALUES ('c'), ('e'), ('f')) t(id)")
def unique_to_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark)
    return versions.ancestors(commits, "f").join(versions.ancestors(commits, "g").select("id"), "id", "left_anti").select("id")


@register("set15_unreachable", "SELECT doc_id AS id FROM documents WHERE doc_id % 8 = 7 AND doc_id < 500")
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c, _ in COMMITS])
    objects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(names, (F.col("doc_id") % 8).cast("int")).alias("commit"), F.col("doc_id").cast("double").alias("ts"), F.col("n_chars").alias("bytes"))
    return versions.unreachable(objects, _commits(spark), ["f", "g"], 500.0).select("id")


@register("set17_move_subtree", f"WITH {SQL_ITEMS} SELECT regexp_replace(path, '^src1/en(/|$)', 'src1/english\\1') AS path FROM items WHERE NOT starts_with(path, 'src2/')")
def move(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lenses.items(spark, sf_dir).select("path")
    return versions.moved(versions.without(items, "src2"), "src1/en", "src1/english")


@register("set18_incremental_index", f"WITH {SQL_VERSIONS} SELECT path, n_samples FROM mine")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, mine, _ = lenses.versions(spark, sf_dir)
    return versions.updated(base, mine, versions.difference(base, mine)).select("path", "n_samples")


_CHUNKS = "numbered AS (SELECT user_id AS recording, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.chunked(lenses.signal(spark, sf_dir), ["recording", "channel"], ["ts", "event_id"], "x", 4)


@register("sig01_window_samples", f"WITH {_CHUNKS} SELECT recording, channel, i, x FROM numbered WHERE i >= 3 AND i < 10")
def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, stop = signal.span(1000, tmin=0.3, tmax=1.0, sfreq=10.0)
    return signal.long_form(signal.window(_chunks(spark, sf_dir), start, stop, 4), "recording", "channel")


@register("sig02_calibrated_window", f"WITH {_CHUNKS} SELECT recording, channel, i, x * 0.5 + 2.0::DOUBLE AS x FROM numbered WHERE i >= 2 AND i < 7")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.long_form(signal.window(_chunks(spark, sf_dir), 2, 7, 4, F.lit(0.5), F.lit(2.0)), "recording", "channel")


@register("sig03_pack_int16", "SELECT event_id, CAST(least(greatest(round_even(value / 0.01::DOUBLE, 0), -32768), 32767) AS INTEGER) AS step FROM events")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", numeric.packed(F.col("value"), F.lit(0.01), F.lit(0.0)).alias("step"))


@register("sig06_channel_picks", f"WITH {_CHUNKS} SELECT CASE channel WHEN 'view' THEN 0 ELSE 1 END AS pick, recording, i, x FROM numbered WHERE channel IN ('view', 'error') AND i < 4")
def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    rows = signal.picked(signal.window(_chunks(spark, sf_dir), 0, 4, 4), [-1, "error"], names)
    return signal.long_form(rows, "pick", "recording")


@register("sig07_block_scan", f"WITH {_CHUNKS} SELECT channel, i // 16 AS block, CAST(sum(CAST(x AS DECIMAL(18,4))) AS DOUBLE) AS total FROM numbered GROUP BY 1, 2")
def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = signal.long_form(_chunks(spark, sf_dir), "channel")
    return signal.block_sums(long, ["channel"], F.col("i"), 16, "x").select("channel", "block", F.col("total").cast("double").alias("total"))


@register("sig08_raw_with_events", "SELECT e.event_id, count(a.event_id) AS n FROM events e LEFT JOIN events a ON a.user_id = e.user_id AND a.event_type = 'signup' WHERE e.event_type = 'error' GROUP BY e.event_id")
def raw_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return signal.with_annotations(events.where("event_type = 'error'"), events.where("event_type = 'signup'"), ["user_id"]).select("event_id", F.col("n_annotations").alias("n"))


@register("sig09_channel_names", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'ch' || label ELSE 'EEG ' || label END AS name FROM embeddings")
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("ch"), "label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", signal.channel_name(own, F.lit(None).cast("string"), F.lit("EEG "), F.col("label")).alias("name"))


@register("sig10_shape", f"WITH {_CHUNKS} SELECT recording, count(DISTINCT channel) AS n_channels, max(i) + 1 AS n_samples, (max(i) + 1) / 250.0::DOUBLE AS duration FROM numbered GROUP BY recording")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _chunks(spark, sf_dir).withColumn("n", F.col("start") + F.size("samples"))
    return ends.groupBy("recording").agg(F.countDistinct("channel").alias("n_channels"), F.max("n").alias("n_samples"), (F.max("n") / 250.0).alias("duration"))


@register("sig11_annotations", "SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE - min(epoch_us(ts) / 1000000.0::DOUBLE) OVER (PARTITION BY user_id) AS onset, event_type AS trial_type FROM events")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return signal.onsets(events, ["user_id"], "t").select("user_id", "onset", F.col("event_type").alias("trial_type"))


@register("sig13_chunk_copy", f"WITH {_CHUNKS} SELECT recording, channel, i, x FROM numbered WHERE i // 4 IN (0, 2)")
def chunk_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.long_form(_chunks(spark, sf_dir).where("chunk in (0, 2)"), "recording", "channel")


@register("sig14_middle_chunk", "SELECT doc_id, ((n_chars + 255) // 256) // 2 AS chunk FROM documents")
def middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", signal.middle_chunk(F.col("n_chars"), F.lit(256)).alias("chunk"))


@register("snk06_sample_patch", f"WITH {_CHUNKS} SELECT recording, channel, i, CASE WHEN i % 5 = 0 THEN x + 1 ELSE x END AS x, bool_or(i % 5 = 0) OVER (PARTITION BY recording, channel, i // 4) AS changed FROM numbered")
def sample_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    patch = signal.long_form(chunks, "recording", "channel").where("i % 5 = 0").withColumn("x", F.col("x") + 1)
    return signal.long_form(signal.patched(chunks, patch, ["recording", "channel"]), "recording", "channel", "changed")


@register("dtm03_relative_onset", "SELECT o_orderkey, o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) AS onset FROM orders")
def onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.onsets(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", "onset")


@register("dtm06_now", "SELECT true AS ok")
def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return spark.range(1).select(timefn.aware(stamp).alias("ok"))
