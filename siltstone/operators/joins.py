"""Joins with semantics of their own: overlays, upserts, inheritance, as-of and interval assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Combinations of entity names among sidecars that a plan may hold.
KEY_SETS = 200


def overlaid(published: DataFrame, staged: DataFrame, removed: DataFrame | None = None, key: str = "sub") -> DataFrame:
    """Published rows, those of staged or removed subjects replaced by the staged ones."""
    kept = published.join(staged.select(key).distinct(), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(staged, allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], update: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys.

    With ``update`` a null of a new row leaves the old value as it was.
    """
    if not update:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    a = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    b = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_new"))
    pick = {c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("_new", new), ("_old", old)) if c in df.columns]) for c in rest}
    return a.join(b, keys, "full_outer").select(*keys, *[v.alias(c) for c, v in pick.items()])


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, forward: bool = False, into: str = "matched") -> DataFrame:
    """``left`` with the value of the nearest right row at or before its time (forward: at or after).

    Without one, the first right row of the group (forward: the last). Both sides go through one exchange by
    ``by`` and one sort; ties of the right side go to its greater value. Times of both sides share a scale.
    """
    key = F.col(right_time).alias("_t")
    marks = right.select(*by, key, F.col(value).alias("_v"), F.lit(0 if not forward else 1).alias("_side"))
    rows = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1 if not forward else 0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    group = Window.partitionBy(*by)
    mark = F.when(F.col("_side") == (1 if forward else 0), F.struct("_t", "_v"))
    if forward:
        # What follows, as what precedes in the reverse order, so that the frame only grows.
        order = group.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_v"))
        near = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rest = F.max(mark).over(group)
    else:
        order = group.orderBy(F.col("_t"), F.col("_side"), F.col("_v"))
        near = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rest = F.min(mark).over(group)
    found = both.withColumn("_m", F.coalesce(near, rest)).where(F.col("_side") == (0 if forward else 1))
    return found.select(*left.columns, F.col("_m._v").alias(into))


def inherited(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, key, value, conflict) of metadata that files inherit from sidecars.

    ``files`` (path, dir, entities map, suffix); ``sidecars`` (dir, entities map, suffix, key, value). A
    sidecar applies to files of its suffix in its folder or below whose entities contain its own. Deeper
    folders win, then more entities; two values of one rank are a conflict. Every file meets its ancestors'
    sidecars by equality of folder, suffix and the values of the entities that some sidecar names, so no file
    is read against a sidecar that doesn't apply to it. The sets of entity names in use (a handful) are known
    to the plan; more than KEY_SETS of them are an error.
    """
    sets = [r[0] for r in sidecars.select(F.array_sort(F.map_keys("entities")).alias("names")).distinct().limit(KEY_SETS + 1).collect()]
    if len(sets) > KEY_SETS:
        raise ValueError(f"sidecars name entities in more than {KEY_SETS} combinations")
    if not sets:
        sets = [[]]

    def values(entities: Column, names: Column) -> Column:
        # Null if a name is missing, as concat has it.
        given = F.transform(names, lambda n: F.concat(n, F.lit("\u0001"), F.try_element_at(entities, n)))
        return F.when(F.forall(given, lambda g: g.isNotNull()), F.array_join(given, "\u0002"))

    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = files.select("path", "suffix", F.col("entities").alias("own"), F.explode(F.array_distinct(ancestors)).alias("dir"))
    known = F.array(*[F.array(*[F.lit(n) for n in names]).cast("array<string>") for names in sets])
    spread = spread.select("path", "suffix", "dir", F.explode(F.transform(known, lambda names: values(F.col("own"), names))).alias("_of")).where("_of is not null")
    named = sidecars.withColumn("_of", values(F.col("entities"), F.array_sort(F.map_keys("entities"))))
    ranked = spread.distinct().join(named, ["dir", "suffix", "_of"]).withColumn("rank", F.struct(F.size(F.split("dir", "/")) * F.when(F.col("dir") == "", 0).otherwise(1), F.size("entities")))
    best = ranked.groupBy("path", "key", "rank").agg(F.min("value").alias("value"), (F.countDistinct("value") > 1).alias("conflict"))
    top = best.groupBy("path", "key").agg(F.max(F.struct("rank", "value", "conflict")).alias("top"))
    return top.select("path", "key", "top.value", "top.conflict")


def beside(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the sidecars of their folder whose stem begins with theirs."""
    # A sidecar is found under each of its beginnings, by equality.
    stem = F.col("stem")
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.length(stem)), lambda n: F.substr(stem, F.lit(1), n))).alias("stem")
    heads = sidecars.select("dir", starts, F.col("stem").alias("sidecar"))
    return files.join(heads, ["dir", "stem"], "left").select(*files.columns, "sidecar")


def with_fallbacks(df: DataFrame, sources: list[tuple[DataFrame, str, str]], into: str, default: str = "n/a") -> DataFrame:
    """``df`` with the first value that its sources (table, key, value) have, in their order, else a default."""
    names = []
    for n, (source, key, value) in enumerate(sources):
        names.append(f"_{into}{n}")
        df = df.join(source.select(key, F.col(value).alias(names[-1])), key, "left")
    return df.withColumn(into, F.coalesce(*names, F.lit(default))).drop(*names)


def orphans(df: DataFrame, support: DataFrame, by: list[str]) -> DataFrame:
    """(by) of rows without any supporting row, each once."""
    return df.select(*by).distinct().join(support.select(*by), by, "left_anti")


def superseded(df: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """``df`` without rows that a newer one replaces."""
    return df.join(newer.select(key), key, "left_anti")


def first_seen(df: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
