"""Version algebra over catalogues: differences, merges, ancestry, and what is no longer reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MergeConflict(RuntimeError):
    """Both sides changed the same thing in different ways."""


def _side(df: DataFrame, key: str, name: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.struct(*rest).alias(name), F.lit(True).alias(f"in_{name}"))


def updated(index: DataFrame, current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """An index brought up to date from its changes alone: the rows of ``current`` that they name, else its own."""
    return index.join(changes, key, "left_anti").unionByName(current.join(changes.where("change <> 'removed'"), key, "left_semi"))


def difference(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): added, removed or changed from version a to b; one exchange of each."""
    both = _side(a, key, "a").join(_side(b, key, "b"), key, "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def merged(base: DataFrame, mine: DataFrame, other: DataFrame, key: str = "path", prefer: str | None = None) -> DataFrame:
    """(key, decision): keep, mine, other, removed or conflict for every key of the three versions.

    A side that equals the base gives way to the other; equal sides agree; else it is a conflict, which
    ``prefer`` (mine or other) decides.
    """
    joined = _side(base, key, "base").join(_side(mine, key, "mine"), key, "full_outer").join(_side(other, key, "other"), key, "full_outer")

    def same(a: str, b: str):
        return F.col(f"in_{a}").eqNullSafe(F.col(f"in_{b}")) & F.col(a).eqNullSafe(F.col(b))

    side = lambda n: F.when(F.col(f"in_{n}").isNull(), "removed").otherwise(n)
    decision = (
        F.when(same("mine", "base") & same("other", "base"), F.when(F.col("in_base").isNull(), "removed").otherwise("keep"))
        .when(same("mine", "base"), side("other"))
        .when(same("other", "base") | same("mine", "other"), side("mine"))
        .otherwise(F.lit("conflict") if prefer is None else side(prefer))
    )
    return joined.select(key, decision.alias("decision"))


def merge(base: DataFrame, mine: DataFrame, other: DataFrame, key: str = "path", prefer: str | None = None) -> DataFrame:
    """The merged version; raises MergeConflict if something is left to decide."""
    found = merged(base, mine, other, key, prefer)
    clash = found.where("decision = 'conflict'").select(key).limit(1).collect()
    if clash:
        raise MergeConflict(f"both sides changed {clash[0][0]}")
    ours = mine.join(found.where("decision in ('keep', 'mine')").select(key), key, "left_semi")
    theirs = other.join(found.where("decision = 'other'").select(key), key, "left_semi")
    return ours.unionByName(theirs, allowMissingColumns=True)


def moved(df: DataFrame, old: str, new: str, key: str = "path") -> DataFrame:
    """``df`` with everything at or below one path at another."""
    below = (F.col(key) == old) | F.startswith(key, F.lit(old + "/"))
    return df.withColumn(key, F.when(below, F.concat(F.lit(new), F.substr(F.col(key), F.lit(len(old) + 1)))).otherwise(F.col(key)))


def under(df: DataFrame, path: str, key: str = "path") -> DataFrame:
    """What is at or below a path."""
    return df.where((F.col(key) == path) | F.startswith(key, F.lit(path + "/")))


def without(df: DataFrame, path: str, key: str = "path") -> DataFrame:
    """``df`` without what is at or below a path."""
    return df.where(~((F.col(key) == path) | F.startswith(key, F.lit(path + "/"))))


def clashes(mine: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """What both sides changed."""
    return mine.select(*keys).intersect(other.select(*keys))


def summarized(changes: DataFrame) -> DataFrame:
    """(item, change) of (path, item, change) nodes: the strongest change of each item, and of removed
    subtrees only the top."""
    rank = F.create_map(*[x for n, c in enumerate(("added", "removed", "changed", "attrs")) for x in (F.lit(c), F.lit(n))])
    items = changes.groupBy("item").agg(F.min_by("change", rank[F.col("change")]).alias("change"))
    gone = items.where("change = 'removed'").select(F.col("item").alias("top"))
    parts = F.split("item", "/")
    above = items.where("change = 'removed'").select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("top"), (F.size(parts) > 1).alias("deep"))
    below = above.where("deep").join(gone, "top").select("item").distinct()
    return items.join(below, "item", "left_anti")


def reverted(current: DataFrame, before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """``current`` without what changed from before to after; refused if it was changed again since."""
    return merge(after, current, before, key)


def ancestors(commits: DataFrame, start: str, name: str = "commits") -> DataFrame:
    """(id, depth) of a version and all versions before it, over (id, parents array)."""
    spark = commits.sparkSession
    commits.createOrReplaceTempView(name)
    rows = spark.sql(
        f"""WITH RECURSIVE up (id, depth) MAX RECURSION LEVEL 10000 AS (
              SELECT id, 0 FROM {name} WHERE id = :start
              UNION ALL
              SELECT p.parent, up.depth + 1 FROM up JOIN (SELECT id, explode(parents) AS parent FROM {name}) p ON p.id = up.id
            ) SELECT id, depth FROM up""",
        args={"start": start},
    )
    return rows.groupBy("id").agg(F.min("depth").alias("depth"))


def merge_base(commits: DataFrame, mine: str, other: str) -> DataFrame:
    """(id): the nearest version of other's history that is in mine's, too."""
    a, b = ancestors(commits, mine), ancestors(commits, other)
    return b.join(a.select("id"), "id", "left_semi").orderBy("depth", "id").limit(1).select("id")


def unreachable(objects: DataFrame, commits: DataFrame, heads: list[str], cutoff: float) -> DataFrame:
    """Objects (id, commit, ts, bytes) of no version before any head, older than the cutoff."""
    reach = None
    for head in heads:
        found = ancestors(commits, head).select(F.col("id").alias("commit"))
        reach = found if reach is None else reach.unionByName(found)
    return objects.join(reach.distinct(), "commit", "left_anti").where(F.col("ts") < cutoff)
