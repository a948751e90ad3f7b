"""The catalogue of stored items: lookups, derived columns, per-subject summaries and pruning by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.plans import predicate

#: Distinct texts of a column, over all subjects, up to which a summary lists them.
MOST_VALUES = 4096


class NotOne(KeyError):
    """A lookup that must find one item found none or several."""


def find(items: DataFrame, **entities: str) -> DataFrame:
    """Recordings whose columns have these values, given as text; ordered by subject and path."""
    return predicate.where(items, kind="recording", **entities).orderBy("sub", "path")


def only(items: DataFrame, **entities: str) -> DataFrame:
    """The one item that matches, or NotOne; looks at two rows at most."""
    found = predicate.where(items, **entities)
    count = found.limit(2).count()
    if count != 1:
        raise NotOne(f"{'no' if count == 0 else 'more than one'} item for {entities}")
    return found


def output(found: DataFrame, columns: list[str], form: str = "json") -> DataFrame:
    """(value): results as JSON lines, CSV lines (empty for missing), paths, or their count."""
    if form == "json":
        return found.select(F.to_json(F.struct(*columns)).alias("value"))
    if form == "csv":
        return found.select(F.to_csv(F.struct(*columns)).alias("value"))
    if form == "paths":
        return found.select(F.col("path").alias("value"))
    if form == "count":
        return found.agg(F.count("*").cast("string").alias("value"))
    raise ValueError("the form is json, csv, paths or count")


def streamed(items: DataFrame, progress: Callable[[int], None] | None = None) -> Iterator[Row]:
    """Rows one by one in order, the next partition fetched while this one is used.

    At most two partitions are on the driver; a failure is raised where its rows would have come, and a
    caller who stops early ends the job. ``progress`` is told the number of rows so far.
    """
    for n, row in enumerate(items.toLocalIterator(prefetchPartitions=True), 1):
        if progress is not None:
            progress(n)
        yield row


def children(items: DataFrame, path: str) -> DataFrame:
    """(name, is_item, n_items): the next level below ``path`` of the tree that paths make, by name."""
    depth = len([p for p in path.split("/") if p])
    inside = items.where(F.startswith("path", F.lit(path.strip("/") + "/"))) if depth else items
    parts = F.split("path", "/")
    rows = inside.select(F.get(parts, F.lit(depth)).alias("name"), (F.size(parts) == depth + 1).alias("here"))
    return rows.groupBy("name").agg(F.bool_or("here").alias("is_item"), F.count("*").alias("n_items"))


def under(items: DataFrame, path: str) -> DataFrame:
    """The item at ``path`` and all below it, in path order."""
    path = path.strip("/")
    inside = F.lit(True) if not path else (F.col("path") == path) | F.startswith("path", F.lit(path + "/"))
    out = items.where(inside)
    return (out.where(F.col("sub") == path.partition("/")[0]) if path and "sub" in items.columns else out).orderBy("path")


def of_kind(items: DataFrame, kind: str, sub: str, ses: str | None = None) -> DataFrame:
    found = items.where((F.col("sub") == sub) & (F.col("kind") == kind))
    return (found if ses is None else found.where(F.col("ses") == ses)).orderBy("path")


def with_duration(items: DataFrame) -> DataFrame:
    """duration_s where there is a sampling rate above zero."""
    return items.withColumn("duration_s", F.when(F.col("sfreq") > 0, F.col("n_samples") / F.col("sfreq")))


def placed(path: Column) -> Column:
    """struct(sub, prefix, ses, datatype) of an item's path.

    The subject leads; derivatives/<pipeline> is a prefix; a ses-* segment is the session; what comes first
    of two or more segments left is the datatype.
    """
    parts = F.split(path, "/")
    sub = F.filter(parts, lambda p: F.startswith(p, F.lit("sub-")))
    rest = F.filter(parts, lambda p: ~F.startswith(p, F.lit("sub-")))
    derived = F.get(rest, F.lit(0)) == "derivatives"
    prefix = F.when(derived, F.concat_ws("/", F.get(rest, F.lit(0)), F.get(rest, F.lit(1))))
    rest = F.when(derived, F.slice(rest, 3, 1000)).otherwise(rest)
    first = F.get(rest, F.lit(0))
    ses = F.when(F.startswith(first, F.lit("ses-")), first)
    rest = F.when(ses.isNotNull(), F.slice(rest, 2, 1000)).otherwise(rest)
    datatype = F.when(F.size(rest) >= 2, F.get(rest, F.lit(0)))
    return F.struct(F.get(sub, F.lit(0)).alias("sub"), prefix.alias("prefix"), ses.alias("ses"), datatype.alias("datatype"))


#: Metadata that describes the stored samples and stays out of the catalogue.
NOT_INDEXED = ("SamplingFrequency", "ch_names", "data_scale", "data_offset", "data_note")


def scalar_metadata(json: Column) -> Column:
    """map<meta.key, struct<num, txt>> of the top-level scalars of a JSON object; others are left out."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    raw = F.map_entries(F.try_parse_json(json).cast("map<string,variant>"))
    types = F.map_from_entries(F.transform(raw, lambda e: F.struct(e["key"], F.schema_of_variant(e["value"]))))
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.startswith(e["key"], F.lit("_")) & ~e["key"].isin(*NOT_INDEXED) & ~types[e["key"]].rlike("^(OBJECT|ARRAY|VOID)"))

    def value(e: Column) -> Column:
        number = types[e["key"]].rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
        return F.struct(F.when(number, e["value"].try_cast("double")).alias("num"), F.when(~number, e["value"]).alias("txt"))

    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.concat(F.lit("meta."), e["key"]), value(e))))


def codec_text(steps: Column) -> Column:
    """name(key=value,...) of each step of array<struct<name, options>>, joined by +."""

    def one(s: Column) -> Column:
        options = F.array_join(F.transform(F.array_sort(F.map_entries(s["options"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
        return F.when(F.size(s["options"]) > 0, F.concat(s["name"], F.lit("("), options, F.lit(")"))).otherwise(s["name"])

    return F.array_join(F.transform(steps, one), "+")


def export_dir(path: Column) -> Column:
    """The folder of an item on export: its path without the last segment."""
    return F.regexp_replace(path, "/[^/]*$", "")


def export_stem(path: Column, suffix: Column) -> Column:
    """The file stem on export: the segments that are entities, then the suffix, joined by _."""
    entities = F.filter(F.split(path, "/"), lambda p: p.contains("-"))
    return F.array_join(F.concat(entities, F.array(suffix)), "_")


def cascade(rules: dict[str, Column]) -> Column:
    """struct(value, rule) of the first rule with a value."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.cast("string").alias("value"), F.lit(n).alias("rule"))) for n, c in rules.items()])


def summarize(items: DataFrame) -> DataFrame:
    """A row for each subject: counts by kind, sessions, ranges of numbers and distinct texts.

    Texts are listed while a column has at most MOST_VALUES of them over the whole catalogue, else their
    set is null, which prunes nothing; the decision is an aggregate of one row.
    """
    fields = [f for f in items.schema.fields if f.name not in ("sub", "path", "kind")]
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    few = items.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(texts)]).first() if texts else ()
    listed = [c for c, n in zip(texts, few, strict=True) if n <= MOST_VALUES]
    aggregates = [F.count("*").alias("n_items"), F.count_if(F.col("kind") == "recording").alias("n_recordings"), F.count_if(F.col("kind") == "table").alias("n_tables"), F.countDistinct("ses").alias("n_sessions")]
    for c in numbers:
        value = F.col(f"`{c}`").cast("double")
        value = F.when(~F.isnan(value), value)
        aggregates += [F.min(value).alias(f"zmin.{c}"), F.max(value).alias(f"zmax.{c}")]
    aggregates += [F.collect_set(F.col(f"`{c}`")).alias(f"values.{c}") for c in listed]
    return items.groupBy("sub").agg(*aggregates)


def prune(summary: DataFrame, node: predicate.Node | None) -> DataFrame:
    """The subjects that can have a match; one without a match may stay, one with a match never goes."""
    names = set(summary.columns)

    def may(node: predicate.Node | None) -> Column:
        match node:
            case predicate.Both(parts=parts):
                return reduce(lambda a, b: a & b, map(may, parts))
            case predicate.Either(parts=parts):
                return reduce(lambda a, b: a | b, map(may, parts))
            case predicate.Exists(column=c) if f"zmin.{c}" in names:
                return F.col(f"`zmin.{c}`").isNotNull()
            case predicate.Compare(column="sub", op=op, values=values) if op in ("==", "in"):
                return F.col("sub").isin(*map(predicate.text_of, values))
            case predicate.Compare(column=c, op=op, values=values) if f"zmin.{c}" in names:
                numbers = [predicate.number_of(v) for v in values]
                if not numbers or any(n is None or n != n for n in numbers):
                    return F.lit(True)
                low, high = F.col(f"`zmin.{c}`"), F.col(f"`zmax.{c}`")
                tests = {"<": low < numbers[0], "<=": low <= numbers[0], ">": high > numbers[0], ">=": high >= numbers[0]}
                inside = reduce(lambda a, b: a | b, [(low <= n) & (high >= n) for n in numbers])
                return F.coalesce(inside if op in ("==", "in") else tests.get(op, low.isNotNull()), F.lit(False))
            case predicate.Compare(column=c, op="==" | "in", values=values) if f"values.{c}" in names and values:
                return F.arrays_overlap(F.col(f"`values.{c}`"), F.array(*[F.lit(predicate.text_of(v)) for v in values]))
        return F.lit(True)

    return summary.where(may(node))
