"""Reports and accounts over items: frequencies, shapes, errors, sizes and choices. All pre-aggregate before they exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_bitmaps(df: DataFrame, group: list[str], number: Column) -> DataFrame:
    """(group, bits): a bitmap of the numbers (from 1) that occur in a group, exact where a hashed filter isn't."""
    return df.groupBy(*group).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def frequencies(df: DataFrame, group: list[str], values: str, key: str) -> DataFrame:
    """(group, n, n_values, is_distinct): how often a token occurs, with how many values, and whether its keys differ."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct(values).alias("n_values"), (F.count("*") == F.countDistinct(key)).alias("is_distinct"))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(what, rule, n): how often each rule decided each thing; one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(what).alias("what"), rule.alias("rule")) for what, rule in rules.items()])
    return df.select(F.inline(pairs)).groupBy("what", "rule").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, entities: list[str]) -> DataFrame:
    """(entities, n) of entity tuples that several rows share."""
    return df.groupBy(*entities).agg(F.count("*").alias("n")).where("n > 1")


def variants(df: DataFrame, group: list[str], kind: str, value: str) -> DataFrame:
    """(group, kinds map kind -> least value) of the kinds that a group has."""
    one = df.groupBy(*group, kind).agg(F.min(value).alias(value))
    return one.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(kind, value))).alias("kinds"))


def local_days(df: DataFrame, group: list[str], time: str, offset_hours: float, first_of: str) -> DataFrame:
    """(group, day, first, last, n, kind): rows by local calendar day, with the earliest row's value."""
    day = F.to_date(F.timestamp_micros(F.unix_micros(F.col(time).cast("timestamp")) + int(offset_hours * 3_600_000_000)))
    return df.groupBy(*group, day.alias("day")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), F.min_by(first_of, time).alias("kind"))


def mean_of_most_common(df: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, mean absolute value) of the kind with most rows, the first by name among equals."""
    by = df.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.abs(value).cast("decimal(18,4)")).alias("total"))
    return by.orderBy(F.desc("n"), kind).limit(1).select(kind, (F.col("total").cast("double") / F.col("n")).alias("mean"))


def greatest_error(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(worst, n): the greatest difference of a value between rows of one key, and how many differ."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("worst"), F.count_if(F.col("_a") != F.col("_b")).alias("n"))


def mismatches(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n_values, n_masks): rows where two columns differ, and where only one is null."""
    return df.agg(F.count_if(~a.eqNullSafe(b)).alias("n_values"), F.count_if(a.isNull() != b.isNull()).alias("n_masks"))


def flags(df: DataFrame, group: list[str], **tests: tuple[str, Column]) -> DataFrame:
    """(group, a column a test): whether ``all`` or ``any`` of a group's rows pass; a dead channel has all flat."""
    made = {"all": F.bool_and, "any": F.bool_or}
    return df.groupBy(*group).agg(*[made[how](test).alias(name) for name, (how, test) in tests.items()])


def smallest_total(df: DataFrame, group: str, choice: str, size: str) -> DataFrame:
    """(group, choice): the choice whose sizes add up to least, as a codec probe decides."""
    sums = df.groupBy(group, choice).agg(F.sum(F.col(size).cast("decimal(18,2)")).alias("bytes"))
    return sums.groupBy(group).agg(F.min_by(choice, F.struct("bytes", choice)).alias(choice))


def account(df: DataFrame, size: str, group: list[str] | None = None, count: str = "objects") -> DataFrame:
    """(group, count, bytes): how many there are and how much they take, by group or in all."""
    return df.groupBy(*(group or [])).agg(F.count("*").alias(count), F.sum(size).alias("bytes"))


def quartiles(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, q1, q2, q3), interpolated."""
    return df.groupBy(*group).agg(*[F.percentile(value, p).alias(f"q{k}") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))])


def ratio_interval(df: DataFrame, a: str, b: str, key: str, times: int = 200) -> DataFrame:
    """(ratio, low, high): sum(a) / sum(b) with a 95 % interval by resampling.

    Every row counts as often as its key's hash draws from Poisson(1) in each round, so the rounds are sums
    of one pass, whatever the partitions.
    """

    def weight(n: int) -> Column:
        u = F.pmod(F.xxhash64(F.lit(n), key), F.lit(1 << 30)) / float(1 << 30)
        # P(Poisson(1) <= m) for m from 0.
        return reduce(lambda w, edge: w + (u >= edge).cast("int"), (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941), F.lit(0))

    rounds = F.array(*[F.sum(F.col(a) * weight(n)) / F.sum(F.col(b) * weight(n)) for n in range(times)])
    out = df.agg((F.sum(a) / F.sum(b)).alias("ratio"), F.array_sort(rounds).alias("_r"))
    return out.select("ratio", F.get("_r", F.lit(int(times * 0.025))).alias("low"), F.get("_r", F.lit(int(times * 0.975))).alias("high"))


def next_label(df: DataFrame, label: str) -> DataFrame:
    """(next): one more than the greatest number at a label's end."""
    return df.agg((F.coalesce(F.max(F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")), F.lit(0)) + 1).alias("next"))


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def forms(df: DataFrame, form: str, by: str) -> DataFrame:
    """(form, n, n_by): submissions of each form, and by how many."""
    return df.groupBy(F.col(form).alias("form")).agg(F.count("*").alias("n"), F.countDistinct(by).alias("n_by"))


def merged_attribute(df: DataFrame, key: str, value: str, order: str, earliest: bool = False) -> DataFrame:
    """(key, value): the last row's value of each key, or the earliest one's."""
    return df.groupBy(key).agg((F.min_by if earliest else F.max_by)(value, order).alias(value))


def united(*parts: DataFrame) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
