"""Exact top-k search by inner product as a Voronoi join.

Pivots cut the space into cells. Every cell of data has a summary: its size, its greatest distance from
the pivot and the distances of its nearest members. From these, every group of queries gets a threshold
that at least k data vectors surely reach, and a bound on what each data vector can reach; only vectors
whose bound reaches a group's threshold are sent to it. Groups are solved in blocks, and the best k of
each block merge into the best k of each query.

With q in the cell of p (radius u) and x at distance d from its pivot c, the inner product lies within
p.c -/+ (|p| d + u (|c| + d)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bound_batches, stored

K = 10

#: Pivots of data and of queries grow with the square root of their rows, between these.
PIVOTS, GROUPS = (16, 1024), (1, 64)

#: Bytes of vectors in a block of data, and queries in a block.
DATA_BLOCK_BYTES, QUERY_BLOCK = 10_000_000, 2_000

#: Scores are reported as longs: one beyond them as the nearest long, its rank still by its true value.
MOST, LEAST = 2**63 - 1, -(2**63)

#: ``beyond`` orders scores that share a reported value: below all longs, a long, above all longs.
WITHIN = "m"


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(key, v array<double>) with v = floor(scale * x), whole numbers that doubles hold exactly.

    Vectors that are null or hold null or non-finite components (or, beyond single precision, one whose
    product with ``scale`` is infinite) are left out; all others stay, empty and repeated ones too.
    """
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # false for NaN, too
    # From 2^53 on every double is whole.
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c))
    return df.where(F.col(vector).isNotNull()).where(fine).select(F.col(key).cast("long").alias("key"), whole.alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(-1, size)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles or longs where they hold every sum, else as Python ints."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    reach = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if reach < 2**52:
        return (a @ b.T).astype(np.int64)
    if reach < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.frompyfunc(int, 1, 1)
    return np.dot(exact(a), exact(b).T)


def _beyond(score: int) -> str:
    """Orders as the score does among those that are reported as the same long."""
    if LEAST <= score <= MOST:
        return WITHIN
    digits = str(abs(score))
    if score > 0:
        return f"p{len(digits):05d}{digits}"
    turned = "".join(str(9 - int(d)) for d in digits)
    return f"a{99999 - len(digits):05d}{turned}"


def _placed(df: DataFrame, pivots: np.ndarray, extra: list[str]) -> DataFrame:
    """``df`` with the nearest pivot and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots.astype(np.float64))
    schema = f"{', '.join(f'{c} {t}' for c, t in df.select('v', *extra).dtypes)}, cell int, far double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        with np.errstate(all="ignore"):
            squares = (p * p).sum(1)
        for batch in batches:
            x = _matrix(batch.column(0), p.shape[1])
            with np.errstate(all="ignore"):  # immense components give no distance, and no bound
                d = (x * x).sum(1)[:, None] - 2 * x @ p.T + squares
                cell = d.argmin(1) if len(x) else np.zeros(0, np.int64)
                far = np.linalg.norm(x - p[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return df.select("v", *extra).mapInArrow(run, schema)


def _useful(vectors: DataFrame, keep: int) -> DataFrame:
    """(v, key): of equal vectors the rows that a list of ``keep`` can hold, whichever key is left out of it.

    That are ``keep`` rows of a key at most, and only while fewer than twice as many rows of lesser keys
    stand before it, of which one key's own don't count. Null keys come last.
    """
    order = [F.col("key").isNull(), F.col("key")]
    # Limits on a rank are applied before the exchange, too, so that a hot vector sends few rows.
    same = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v", "key").orderBy(F.lit(0)))).where(F.col("r") <= keep)
    before = F.rank().over(Window.partitionBy("v").orderBy(*order))
    return same.withColumn("r", before).where(F.col("r") <= 2 * keep).drop("r")


def top_k(queries: DataFrame, data: DataFrame, k: int = K, pivots: int | None = None, groups: int | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k greatest integer inner products of every query row.

    ``queries`` and ``data`` are (key, v) as from integer_vectors. Rows with a query's own key are no
    candidates; every other row is one, repeated rows and rows with a null key (last among ties) included.
    Ties go to the smaller key. Of a repeated query key every row is answered; a null query key has no id
    to answer to and asks nothing. Vectors of different sizes don't meet; between empty vectors the score
    is 0. A score beyond 64 bits is ranked by its true value and reported as the nearest long.
    """
    bound_batches(data.sparkSession, 4096)
    queries = queries.where("key is not null")
    out = None
    # One plan for each length that occurs among the queries; a table of embeddings has one.
    for size in sorted(r[0] for r in queries.select(F.size("v")).distinct().collect()):
        asked, given = queries.where(F.size("v") == size), data.where(F.size("v") == size)
        if not size:  # nothing to multiply: the product with one zero
            asked, given = (x.withColumn("v", F.array(F.lit(0.0))) for x in (asked, given))
        part = _one_size(asked, given, max(1, size), k, pivots, groups)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else data.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")


def _pivots(df: DataFrame, count: int, size: int) -> np.ndarray:
    """Distinct vectors of least hash: a sample that doesn't follow the order of the rows."""
    rows = df.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(count).collect()
    return np.array([r[0] for r in rows] or [[0] * size], np.float64)


def _root(rows: int, bounds: tuple[int, int]) -> int:
    return min(bounds[1], max(bounds[0], math.isqrt(rows)))


class Bounds:
    """What the summaries of cells and groups say about products."""

    def __init__(self, p: np.ndarray, c: np.ndarray, nearest: dict[int, list[float]], wide: dict[int, float], k: int):
        with np.errstate(all="ignore"):
            self.centre, self.p_norm, self.c_norm = p @ c.T, np.linalg.norm(p, axis=1), np.linalg.norm(c, axis=1)
        self.radius = np.array([wide.get(g, 0.0) for g in range(len(p))])
        self.live = np.array([g in wide for g in range(len(p))])
        self.threshold = np.full(len(p), -np.inf)
        for g in wide:
            low = [self.range_of(g, j, np.array(ds))[0] for j, ds in nearest.items()]
            low = np.sort(np.concatenate(low)) if low else np.zeros(0)
            if len(low) >= k and not np.isnan(low).any():
                self.threshold[g] = low[-k]

    def range_of(self, g, cell, far) -> tuple[np.ndarray, np.ndarray]:
        """Surely lower and surely upper bounds, rounding included; NaN where components are immense."""
        with np.errstate(all="ignore"):
            width = self.p_norm[g] * far + self.radius[g] * (self.c_norm[cell] + far)
            slack = 1e-9 * (np.abs(self.centre[g, cell]) + width) + 1e-3
            return self.centre[g, cell] - width - slack, self.centre[g, cell] + width + slack


def _one_size(queries: DataFrame, data: DataFrame, size: int, k: int, pivots: int | None, groups: int | None) -> DataFrame:
    queries = queries.withColumn("row", F.monotonically_increasing_id())
    pivots, groups = pivots or _root(data.count(), PIVOTS), groups or _root(queries.count(), GROUPS)
    data_pivots, query_pivots = _pivots(data, pivots, size), _pivots(queries, groups, size)
    placed = stored(_placed(_useful(data, k), data_pivots, ["key"]), "cells")
    asked = stored(_placed(queries, query_pivots, ["key", "row"]), "queries")
    # Summaries: the nearest rows of each cell, of which a query's own key takes k at most; a row a group.
    near = placed.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "key"))).where(F.col("r") <= 2 * k)
    nearest = {}
    for row in near.select("cell", "far", "key").collect():  # pivots x 2k rows
        nearest.setdefault(row["cell"], []).append((row["key"], row["far"]))
    count = placed.count()
    wide = {r["cell"]: (r["u"], r["n"]) for r in asked.groupBy("cell").agg(F.max("far").alias("u"), F.count("*").alias("n")).collect()}
    # Of one key the nearest k rows could all be a query's own: distinct keys count, and one key more than k.
    seen = {j: _by_key(rows) for j, rows in nearest.items()}
    bounds = Bounds(query_pivots, data_pivots, seen, {g: u for g, (u, _) in wide.items()}, k + 1)
    data_block = max(1, DATA_BLOCK_BYTES // (8 * size))
    blocks = max(1, -(-count // data_block))
    query_blocks = max(1, -(-max([n for _, n in wide.values()] or [1]) // QUERY_BLOCK))
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast(bounds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every data vector to the groups whose threshold it may reach."""
        bounds = shared.value
        group = np.arange(len(bounds.live))[:, None]
        for batch in batches:
            cell, far = np.array(batch.column(2)), np.array(batch.column(3))
            upper = bounds.range_of(group, cell[None, :], far[None, :])[1]
            to = ~(upper < bounds.threshold[:, None]) & bounds.live[:, None]  # NaN goes everywhere
            at = to.any(0)
            lists = [np.flatnonzero(column).astype(np.int32) for column in to.T[at]]
            part = batch.filter(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["key", "v", "to"])

    sent = placed.select("v", "key", "cell", "far").mapInArrow(send, "key bigint, v array<double>, to array<int>")
    sent = sent.withColumn("block", F.pmod(F.xxhash64("key", "v"), F.lit(blocks)).cast("int"))
    right = sent.select("key", "v", "block", F.explode("to").alias("group"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))) if query_blocks > 1 else F.lit(0)
    right = right.select("key", "v", "block", "group", parts.alias("part"))
    left = asked.select(F.col("key"), "row", "v", F.col("cell").alias("group"), F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("part"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(asked: pa.Table, given: pa.Table) -> pa.Table:
        q, x = _matrix(asked.column("v").combine_chunks(), size), _matrix(given.column("v").combine_chunks(), size)
        named = given.column("key").is_valid().to_numpy()
        ids = given.column("key").fill_null(0).to_numpy()
        order = np.lexsort((ids, ~named))
        ids, named, x = ids[order], named[order], x[order]
        own, rows = np.array(asked.column("key"), np.int64), np.array(asked.column("row"), np.int64)
        found, names = [], []
        for start in range(0, len(q), 256):
            block = _products(q[start : start + 256], x)
            for i in range(len(block)):
                others = np.flatnonzero((ids != own[start + i]) | ~named)
                scores = block[i][others]
                # Everything at least as good as the k-th, then by score and key, in whose order rows stand.
                if len(scores) > k:
                    best = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                else:
                    best = np.arange(len(scores))
                best = best[np.argsort(-scores[best], kind="stable")][:k]
                found.append((np.full(len(best), rows[start + i]), np.full(len(best), own[start + i]), others[best]))
                names += [int(v) for v in scores[best]]
        row, query, at = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3))
        return pa.table(
            {
                "row": row,
                "query_id": query,
                "vec_id": pa.array(ids[at], pa.int64(), mask=~named[at]),
                "score": pa.array([min(MOST, max(LEAST, v)) for v in names], pa.int64()),
                "beyond": pa.array([_beyond(v) for v in names], pa.string()),
            }
        )

    keys = ["group", "part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "row bigint, query_id bigint, vec_id bigint, score bigint, beyond string")
    # k rows of each block at most, whatever the data.
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_key(rows: list[tuple[int | None, float]]) -> list[float]:
    """One distance for each key (null keys each for themselves), the least."""
    least: dict[int, float] = {}
    free = []
    for key, far in rows:
        if key is None:
            free.append(far)
        else:
            least[key] = min(least.get(key, far), far)
    return [*least.values(), *free]
