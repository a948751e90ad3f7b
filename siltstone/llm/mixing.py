"""Mixing sources to target weights: rake token weights to the marginals of several columns at once by
iterative proportional fitting, then sample documents with the probabilities that follow.

DataFrame functions only. The table of cells (a row for each combination of values that occurs, with its
tokens) is all that the iteration touches; it stays in Spark, and is written every few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, stored

#: What stands for a missing value of a column.
MISSING = "\u0000missing"

ITERATIONS, TOLERANCE = 50, 1e-4

#: The share of all tokens that a sample has at least, however scarce some cells are.
LEAST_KEPT = 0.25


#: Cells up to this many (a row is some 100 bytes) are raked in one task and travel whole to every other.
CARRIED_CELLS = 20_000

#: Rounds of raking in one plan where the cells are in one task.
ROUNDS_AT_ONCE = 10


def _kept(df: DataFrame, what: str, few: bool) -> DataFrame:
    """``df`` written and read back; as one partition if it has few rows, so that nothing is exchanged."""
    return stored(df, what).coalesce(1) if few else stored(df, what)


def token_count(text: Column) -> Column:
    """Words between white space (0x20, 0x09 to 0x0D); 0 for null, empty and blank texts."""
    # Java's \s is exactly these signs, and quicker than a class that lists them.
    return F.coalesce(F.regexp_count(text, F.lit(r"\S++")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's make-up, for tables without a topic column; shares are of its characters."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    signs = F.when(text.rlike(r"[#$%&*!]"), F.length(F.regexp_replace(text, r"[^#$%&*!]++", ""))).otherwise(0)
    return F.when(bars / size > 0.02, "tabular").when(signs / size > 0.05, "noisy").when(F.length(text) < 500, "short").otherwise("prose")


def cells_of(df: DataFrame, dims: dict[str, Column], tokens: Column) -> DataFrame:
    """(dims..., n, rows): the tokens of every combination of values, and its documents."""
    named = df.select(*[F.coalesce(c.cast("string"), F.lit(MISSING)).alias(name) for name, c in dims.items()], tokens.alias("n"))
    return named.groupBy(*dims).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 0")


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, share): shares of a column's values in proportion to their tokens to a power."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("p"))
    whole = sums.agg(F.sum("p").alias("whole"))
    # One row on the right: a scalar, not a product of tables.
    return sums.join(F.broadcast(whole), F.lit(True)).select("value", (F.col("p") / F.col("whole")).alias("share"))


def _within(shares: DataFrame, live: DataFrame, dim: str, size: float, few: bool) -> DataFrame:
    """Shares of a sample of ``size`` tokens: a value that has too few gives all, the others share the rest."""
    room = live.groupBy(dim).agg((F.sum("n") / F.lit(size)).alias("room"))
    known = _kept(shares.join(room, dim), "rooms", few)
    scale = 1.0
    while True:  # grows until no further value runs out
        out = F.col("share") * F.lit(scale) >= F.col("room")
        full, rest = known.agg(F.sum(F.when(out, F.col("room")).otherwise(0.0)), F.sum(F.when(~out, F.col("share")))).first()
        if rest is None or (1.0 - full) / rest <= scale * (1 + 1e-12):
            break
        scale = (1.0 - full) / rest
    return _kept(known.select(dim, F.least(F.col("share") * F.lit(scale), "room").alias("share")), "target", few)


def _factor(share: Column, whole: Column, part: Column, total: Column) -> tuple[Column, Column]:
    """What a value's weights are multiplied by, and how far its share was off."""
    # Both are bounds from below; the second is exact once it is known which cells are taken whole.
    factor = F.greatest(share / total, (share - F.coalesce(whole, F.lit(0.0))) / part)
    return factor, F.abs(F.coalesce(whole, F.lit(0.0)) + F.coalesce(part, F.lit(0.0)) - share)


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], iterations: int = ITERATIONS, tolerance: float = TOLERANCE, size: float | None = None
) -> DataFrame:
    """``cells`` with w: weights that sum to one and meet every target share, in proportion to n otherwise.

    A value without a target, and a target without cells, count as nothing: the other shares of that column
    are scaled up. Stops when no share is off by more than ``tolerance``, or after ``iterations`` rounds if
    the targets contradict each other; the column off says by how much the worst share misses its target.

    With a ``size``, a sample of so many tokens, no cell weighs more than it has (n / size): a cell that
    would is taken whole, and the rest is raked anew to the same targets. A column w is where it starts from.
    """
    few = cells.count() <= CARRIED_CELLS
    live = cells.withColumn("w", (F.col("w") if "w" in cells.columns else F.col("n")).cast("double")).drop("off")
    shares = {}
    for dim, target in targets.items():
        given = target.groupBy(F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias(dim)).agg(F.sum("share").alias("share")).where("share > 0")
        shares[dim] = _kept(given.join(cells.select(dim).distinct(), dim, "left_semi"), "target", few)
        live = live.join(shares[dim].select(dim), dim, "left_semi")
    live = _kept(live, "cells", few)
    for dim in targets:  # of the values that have cells
        present = shares[dim].join(live.select(dim).distinct(), dim, "left_semi")
        whole = present.agg(F.sum("share")).first()[0]
        shares[dim] = _kept(present.withColumn("share", F.col("share") / F.lit(whole or 1.0)), "target", few)
        if size:
            shares[dim] = _within(shares[dim], live, dim, size, few)
    cap = F.col("n") / F.lit(size) if size else F.lit(float("inf"))
    whole, part = F.when(F.col("w") >= cap, cap), F.when(F.col("w") < cap, F.col("w"))
    columns, worst, done = live.columns, None, 0
    if few:
        for dim in shares:
            live = live.join(shares[dim].withColumnRenamed("share", f"share_{dim}"), dim)
    while done < iterations:
        turns = min(ROUNDS_AT_ONCE, iterations - done) if few else 1
        for _ in range(turns):
            off = []
            for dim, target in shares.items():
                if few:
                    by = Window.partitionBy(dim)
                    live = live.withColumns({"_sum": F.sum("w").over(by), "_whole": F.sum(whole).over(by), "_part": F.sum(part).over(by)})
                    factor, miss = _factor(F.col(f"share_{dim}"), F.col("_whole"), F.col("_part"), F.col("_sum"))
                    live = live.withColumn(f"off_{dim}", miss).withColumn("w", F.col("w") * factor).drop("_sum", "_whole", "_part")
                else:
                    sums = live.groupBy(dim).agg(F.sum("w").alias("sum"), F.sum(whole).alias("whole"), F.sum(part).alias("part")).join(target, dim)
                    factor, miss = _factor(F.col("share"), F.col("whole"), F.col("part"), F.col("sum"))
                    live = live.join(sums.select(dim, factor.alias("factor"), miss.alias(f"off_{dim}")), dim).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
                off.append(f"off_{dim}")
        done += turns
        live = _kept(live, "cells", few)
        worst = live.agg(F.max(F.greatest(*off, F.lit(0.0)))).first()[0]
        live = live.drop(*off)
        if worst is None or worst <= tolerance:
            break
    return live.select(*columns).withColumn("w", F.least("w", cap)).withColumn("off", F.lit(float(worst or 0.0)))


def mixed(
    df: DataFrame,
    dims: dict[str, Column],
    tokens: Column,
    targets: dict[str, DataFrame] | dict[str, float],
    key: str = "doc_id",
    seed: str = "mix",
    least: float = LEAST_KEPT,
    columns: list[str] | None = None,
) -> DataFrame:
    """Every row of ``df`` (or these of its ``columns``) with tokens, probability, keep and margin_error.

    ``targets`` gives for each column a table (value, share), or the power that flattens its own shares. A
    cell's probability is in proportion to its raked weight over its tokens, and the greatest is one: so the
    kept tokens meet the targets in the mean, without repeating a row. A scarce cell would thin all others;
    so where that leaves less than ``least`` of the tokens, the sample has exactly this share of them in the
    mean: cells with too few tokens are taken whole and the rest is raked anew (see rake). Rows are kept by
    a hash of key and seed, so copies of a key share their fate. Rows without tokens or of a value without a
    target have probability 0. Missing values are a value of their own. margin_error is how far the worst
    share of any column stays from its target, the same in every row; targets that contradict each other
    show there. Older columns of the added names get a leading underscore. Texts are read once: tokens and
    values are written beside the rows, which all later passes start from.
    """
    names = list(df.columns if columns is None else columns)
    for name in ("tokens", "probability", "keep", "margin_error"):
        if name in df.columns:
            other = free_name(df, "_" + name)
            df = df.withColumnRenamed(name, other)
            names = [other if c == name else c for c in names]
    spare = {dim: free_name(df, f"dim_{dim}") for dim in dims}
    made = {"tokens": tokens} | {spare[d]: F.coalesce(c.cast("string"), F.lit(MISSING)) for d, c in dims.items()}
    rows = stored(df.withColumns(made).select(*names, *([key] if key not in names else []), *made), "rows")
    cells = stored(cells_of(rows, {d: F.col(spare[d]) for d in dims}, F.col("tokens")), "cells")
    if cells.count() <= CARRIED_CELLS:
        cells = cells.coalesce(1)
    tables = {d: flattened(cells, d, t) if isinstance(t, (int, float)) else t for d, t in targets.items()}
    raked = rake(cells, tables)
    most, whole = raked.agg(F.max(F.col("w") / F.col("n")), F.sum("n")).first()
    size = 1.0 / most if most else 1.0
    if whole and size < least * whole:
        size = least * whole
        raked = rake(raked, tables, size=size)
    rate = F.col("w") / F.col("n") * F.lit(size)
    rate = F.when(rate > 1 - 1e-9, 1.0).otherwise(rate).alias("probability")
    rate = stored(raked.select(*[F.col(d).alias(spare[d]) for d in dims], rate, "off", "rows"), "rates")
    worst, count, total = rate.agg(F.max("off"), F.count("*"), F.sum("rows")).first()
    on = list(spare.values())
    if count <= CARRIED_CELLS:
        out = rows.join(F.broadcast(rate.drop("off", "rows")), on, "left")
    else:
        # Cells with many rows, of which there are CARRIED_CELLS at most, are looked up in a broadcast.
        hot = F.broadcast(rate.where(F.col("rows") > F.lit(total / CARRIED_CELLS)).drop("off", "rows"))
        out = rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rate.drop("off", "rows"), on, "left"))
    chance = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    out = out.withColumn("probability", chance).withColumn("keep", draw < F.col("probability"))
    return out.select(*names, "tokens", "probability", "keep", F.lit(float(worst or 0.0)).alias("margin_error"))
