"""Window logic: numbering, de-duplication, islands, filling, grids and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_runs(df: DataFrame, group: list[str], candidates: dict[str, Column], order: list[str], into: str = "run") -> DataFrame:
    """A run number for each row of a group: the first candidate that is present and distinct in all of the
    group's rows, else the row's place in ``order``; <into>_rule says which."""
    whole = Window.partitionBy(*group)
    out = df.withColumn("_place", F.row_number().over(whole.orderBy(*order)))
    choice, rule = F.col("_place").cast("string"), F.lit("order")
    for name, column in reversed(candidates.items()):
        out = out.withColumn(f"_{name}", column.cast("string"))
        fine = (F.count(f"_{name}").over(whole) == F.count("*").over(whole)) & (F.size(F.collect_set(f"_{name}").over(whole)) == F.count("*").over(whole))
        choice, rule = F.when(fine, F.col(f"_{name}")).otherwise(choice), F.when(fine, F.lit(name)).otherwise(rule)
    return out.withColumn(into, choice).withColumn(f"{into}_rule", rule).drop("_place", *[f"_{n}" for n in candidates])


def best_copies(df: DataFrame, content: Column | str, better: list[Column], path: str) -> DataFrame:
    """Every row with same_as: the path of the best copy of its content, null for that copy itself."""
    order = Window.partitionBy(content).orderBy(*better, path)
    best = F.first(path).over(order)
    return df.withColumn("same_as", F.when(F.row_number().over(order) > 1, best))


def disambiguated(df: DataFrame, name: str, group: list[str], order: list[str], into: str = "unique_name", mark: str = "-") -> DataFrame:
    """name, name-2, name-3 ... among equal names of a group."""
    place = F.row_number().over(Window.partitionBy(*group, name).orderBy(*order))
    return df.withColumn("_place", place).withColumn(into, F.when(F.col("_place") > 1, F.concat(F.col(name), F.lit(mark), F.col("_place").cast("string"))).otherwise(F.col(name))).drop("_place")


def islands(df: DataFrame, flag: Column, group: list[str], order: list[str], sfreq: float = 1.0) -> DataFrame:
    """(group, onset, duration) of every run of rows where ``flag`` holds; times are row numbers / sfreq."""
    by = Window.partitionBy(*group).orderBy(*order)
    rows = df.select(*group, *order, F.coalesce(flag, F.lit(False)).alias("_on")).withColumn("_i", F.row_number().over(by) - 1)
    # Rows of a run keep their distance from the count of flagged rows.
    on = rows.where("_on").withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*group).orderBy("_i")))
    runs = on.groupBy(*group, "_run").agg(F.min("_i").alias("first"), F.count("*").alias("n"))
    return runs.select(*group, (F.col("first") / sfreq).alias("onset"), (F.col("n") / sfreq).alias("duration"))


def filled(df: DataFrame, value: str, bad: Column, group: list[str], order: list[str], into: str = "filled") -> DataFrame:
    """Bad readings replaced by the last good one before, else the first good one after."""
    good = F.when(~F.coalesce(bad, F.lit(True)), F.col(value))
    # What follows is what precedes in the reverse order: a frame that grows costs a step a row, one that
    # shrinks is computed anew for every row.
    before = F.last(good, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(good, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(into, F.coalesce(before, after))


def gridded(df: DataFrame, group: list[str], time: str, value: str, order: str, step: float = 600.0) -> DataFrame:
    """Readings on a regular grid from each group's first time: (group, slot, value, missing).

    A reading goes to the nearest slot (halves to even), the last of a slot stays, empty slots take the last
    value before them and are flagged.
    """
    start = F.min(time).over(Window.partitionBy(*group))
    slotted = df.withColumn("slot", F.rint((F.col(time) - start) / step).cast("bigint"))
    one = slotted.groupBy(*group, "slot").agg(F.max_by(value, order).alias("_v"))
    last = one.groupBy(*group).agg(F.max("slot").alias("last"))
    grid = last.select(*group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("slot"))
    full = grid.join(one, [*group, "slot"], "left").withColumn("missing", F.col("_v").isNull())
    return filled(full, "_v", F.col("_v").isNull(), group, ["slot"], "value").select(*group, "slot", "value", "missing")


def timing_error(df: DataFrame, group: list[str], time: str, order: list[str], step: float = 600.0, into: str = "timing_error") -> DataFrame:
    """Seconds that a reading is off the slot it should be in after the one before it; 0 for the first."""
    before = F.lag(time).over(Window.partitionBy(*group).orderBy(*order))
    steps = F.greatest(F.rint((F.col(time) - before) / step), F.lit(1.0))
    return df.withColumn(into, F.coalesce(F.col(time) - (before + steps * step), F.lit(0.0)))


def previous(df: DataFrame, group: list[str], value: str, order: list[str], into: str = "previous", default: str | None = None) -> DataFrame:
    """The value of the row before, as a lower bound or a former state; ``default`` (or null) for the first."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(into, before if default is None else F.coalesce(before, F.lit(default)))


def run_counter(df: DataFrame, group: list[str], order: list[Column | str], into: str = "run") -> DataFrame:
    """Counts rows of a group from 1 in the order they arrive."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def biggest_first(df: DataFrame, size: str, workers: int, group: list[str], key: str, into: str = "worker") -> DataFrame:
    """A worker for each job of a group, jobs dealt from the biggest down, there and back, so that loads are near equal."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(size), key)) - 1
    turn = place % (2 * workers)
    return df.withColumn(into, F.least(turn, 2 * workers - 1 - turn))


def quotas(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def regular(df: DataFrame, group: list[str], time: str, order: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(group, regular): whether all steps of a group's times equal its first."""
    by = Window.partitionBy(*group).orderBy(*order)
    steps = df.withColumn("_step", F.col(time) - F.lag(time).over(by)).withColumn("_i", F.row_number().over(by))
    first = F.min_by("_step", F.when(F.col("_step").isNotNull(), F.col("_i")))
    worst = F.greatest(F.abs(F.max("_step") - first), F.abs(F.min("_step") - first))
    return steps.groupBy(*group).agg(F.coalesce(worst <= tolerance, F.lit(True)).alias("regular"))


def batches(df: DataFrame, size: str, count: int, order: list[str], group: list[str], into: str = "batch") -> DataFrame:
    """Contiguous batches of about total / count bytes in each group."""
    whole = Window.partitionBy(*group)
    before = F.sum(size).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return df.withColumn(into, F.floor(before * count / F.sum(size).over(whole)).cast("int"))
