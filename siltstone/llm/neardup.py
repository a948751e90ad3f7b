"""Near-duplicate detection by DartMinHash over weighted five-word shingles.

A document is a weighted set: its shingles, each with its count. Darts rain on the plane of weight by rank
of every element: each unit of an element's weight, times each unit of rank, holds a Poisson(1) number of
darts, all drawn by hash, so that two documents with the same element at the same weight see the same
darts. A dart also carries a coordinate of the signature; a document keeps at each coordinate the dart of
least rank, and two documents agree there with a probability equal to their weighted Jaccard similarity.
Only darts of low rank are thrown, on as much rank as the document's weight needs to fill all coordinates.

Weighted Jaccard = sum of smaller counts / sum of larger counts, exact when pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import batches_of, bound_batches, free_name, stored

WORDS = 5
SIMILARITY = 0.8

#: Bands of the signature and coordinates in each: a pair at 0.8 shares no band once in 20,446 times.
BANDS, ROWS = 25, 5

#: Distinct words a worker remembers the hashes of.
CACHE_ENTRIES = 400_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: P(Poisson(1) <= m) for m from 0, on the scale of 32-bit numbers.
_POISSON = (np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, m + 1), initial=1.0) for m in range(11)]) * 2**32).astype(np.uint64)

_STEPS = np.array([(m + 1) * int(_GOLD) % 2**64 for m in range(len(_POISSON))], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to elements: one hash for each shingle and each unit of its count."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def make(self, word: str) -> int:
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        found = self.known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        return found

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document, unit hash), sorted by both; the k-th unit of a shingle has a hash of its own.

        Words are the lower-cased text between white space. A text of fewer than five words is one shingle;
        a text without words has none.
        """
        get, make = self.known.get, self.make
        words = [t.lower().split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        short = (sizes > 0) & (sizes < WORDS)
        hashes = np.array([get(x) or make(x) for w in words for x in w], np.uint64)
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(hashes)) - starts[doc]
        at = np.flatnonzero(place <= sizes[doc] - WORDS)
        shingle = np.zeros(len(at), np.uint64)
        for k in range(WORDS):
            shingle = mix(shingle * _GOLD + hashes[at + k] + np.uint64(k))
        doc = doc[at]
        if short.any():
            few = np.flatnonzero(short)
            whole = [xxhash.xxh3_64_intdigest(" ".join(words[k]).encode("utf-8", "surrogatepass")) for k in few.tolist()]
            doc, shingle = np.concatenate([doc, few]), np.concatenate([shingle, np.array(whole, np.uint64)])
        order = np.lexsort((shingle, doc))
        doc, shingle = doc[order], shingle[order]
        # The unit of a repeated shingle is its place among its equals.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
        first = np.flatnonzero(new)
        unit = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        return doc, np.where(unit == 0, shingle, mix(shingle + unit.astype(np.uint64) * _GOLD))


def signatures(doc: np.ndarray, unit: np.ndarray, count: int, k: int) -> np.ndarray:
    """count x k: the least dart of each coordinate of each document; documents without units stay 0.

    First as much rank as gives k (ln k + 3) darts in the mean; documents with a coordinate still empty
    throw again on twice the rank.
    """
    out = np.full(count * k, np.iinfo(np.uint64).max, np.uint64)
    weight = np.bincount(doc, minlength=count)
    ranks = np.where(weight > 0, k * (np.log(k) + 3) / np.maximum(weight, 1), 0.0)
    todo = np.arange(count)[weight > 0]
    while len(todo):
        mask = np.zeros(count, bool)
        mask[todo] = True
        mine = mask[doc]
        _throw(out, doc[mine], unit[mine], ranks, k)
        rows = out.reshape(count, k)
        todo = todo[(rows[todo] == np.iinfo(np.uint64).max).any(1)]
        ranks[todo] *= 2
    out = out.reshape(count, k)
    out[weight == 0] = 0
    return out


def _throw(out: np.ndarray, doc: np.ndarray, unit: np.ndarray, ranks: np.ndarray, k: int) -> None:
    """Put every dart below its document's rank into ``out``: rank first, then the dart's own bits."""
    cells = np.ceil(ranks[doc]).astype(np.int64)
    for start in range(0, len(doc), 1 << 18):
        part = slice(start, start + (1 << 18))
        times = cells[part]
        d, u = np.repeat(doc[part], times), np.repeat(unit[part], times)
        cell = np.arange(len(d)) - np.repeat(np.cumsum(times) - times, times)
        seed = mix(u + (cell.astype(np.uint64) + np.uint64(1)) * _GOLD)
        draw = seed >> np.uint64(32)
        for m in range(len(_POISSON)):
            hit = np.flatnonzero(draw >= _POISSON[m])
            if not len(hit):
                break
            d, cell, seed, draw = d[hit], cell[hit], seed[hit], draw[hit]
            dart = mix(seed + _STEPS[m])
            rank = cell + (dart >> np.uint64(40)).astype(np.float64) / 2**24
            low = rank < ranks[d]
            dart, rank = dart[low], rank[low].astype(np.float32)
            own = mix(dart ^ _B)
            slot = d[low] * k + (own >> np.uint64(33)).astype(np.int64) % k
            # The bits of a positive float order as it does.
            value = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | own & np.uint64(0xFFFFFFFF)
            np.minimum.at(out, slot, value)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """documents x bands: one hash for each band, the band's number in it."""
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), 0)
    for r in range(rows):
        out = mix(out * _GOLD + signature[:, r * bands : (r + 1) * bands])
    return out.view(np.int64)


def _sketch(df: DataFrame, uid: str, text: str, bands: int, rows: int) -> DataFrame:
    """(uid, content: the hash of all units, keys) of every row with a word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            doc, unit = shingler.units(list(batches_of(batch.column(1))))
            keys = band_keys(signatures(doc, unit, batch.num_rows, bands * rows), bands, rows)
            has, first = np.unique(doc, return_index=True)
            content = [xxhash.xxh3_128_digest(part.tobytes()) for part in np.split(unit, first[1:])] if len(has) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(has)), pa.array(content, pa.binary()), pa.array(list(keys[has]), pa.list_(pa.int64()))], names=["uid", "content", "keys"]
            )

    return df.select(uid, text).mapInArrow(run, "uid bigint, content binary, keys array<bigint>")


def _units(df: DataFrame, text: str) -> DataFrame:
    """(uid, units) of every row, for exact comparison; unit hashes are cut to 32 bits, enough within a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            doc, unit = shingler.units(list(batches_of(batch.column(1))))
            ends = np.searchsorted(doc, np.arange(1, batch.num_rows))
            parts = [np.unique((p >> np.uint64(32)).astype(np.uint32)).view(np.int32) for p in np.split(unit, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32()))], names=["uid", "units"])

    return df.select("uid", text).mapInArrow(run, "uid bigint, units array<int>")


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(key..., a, b, similarity) of pairs (a, b), by their units; both joins can split a hot side."""
    left = units.select(F.col("uid").alias("a"), F.col("units").alias("ua"))
    right = units.select(F.col("uid").alias("b"), F.col("units").alias("ub"))
    met = pairs.join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("ua", "ub"))
    return met.select("a", "b", (both / (F.size("ua") + F.size("ub") - both)).alias("similarity"))


def _split(parted: DataFrame) -> DataFrame:
    """The rows of buckets with two fragments or more."""
    split = parted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return parted.join(split, "key", "left_semi")


def _rare(parted: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """(key, b, root, n, rank): every member under its rarest units, one more than a similar text could lack.

    Texts at ``similarity`` share all but (1 - similarity) of each one's units at most, so with units ranked
    by how many members have them (then by value) they share one of these: new buckets that lose no pair,
    and that hold few members besides those that really are alike.
    """
    live = parted.select(F.col("b").alias("uid"), "root").distinct()
    mine = units.join(live, "uid").select("uid", "root", F.size("units").alias("n"), F.explode("units").alias("key"))
    mine = mine.join(mine.groupBy("key").agg(F.count("*").alias("times")), "key")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("times", "key"))
    kept = mine.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    return kept.where("times > 1").select(F.col("key").cast("long").alias("key"), F.col("uid").alias("b"), "root", "n", "rank")


def connected(df: DataFrame, text: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(exact classes: uid, a; classes that links connect: uid, root) of ``df`` with a column uid.

    First every member of a bucket is compared with its least one. The links so far cut each bucket into
    fragments; in buckets of several fragments, the members of all but the largest are compared with heads
    of the other fragments, eight times as many in every round and at last all members, until a bucket is one
    fragment or all of its members have met; these buckets are by rare units (see _rare), so no pair among
    them goes unseen. So a bucket of n similar texts costs about n comparisons.
    """
    sketch = stored(_sketch(df, "uid", text, bands, rows), "sketch")
    # Equal content first, so that copies cost one row each from here on.
    one = sketch.groupBy("content").agg(F.min("uid").alias("a"))
    classes = sketch.select("uid", "content").join(one, "content").select("uid", "a")
    members = sketch.join(one.select(F.col("a").alias("uid")), "uid", "left_semi").select(F.explode("keys").alias("key"), F.col("uid").alias("b"))
    # Rows of buckets with two classes or more.
    least = members.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    bucket = stored(members.join(least, "key"), "buckets")
    pairs = stored(bucket.where("a <> b").select("a", "b").distinct(), "pairs")
    bucket = bucket.select("key", "b")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "needed")
    units = stored(_units(df.join(needed, "uid", "left_semi"), text), "units")
    roots, tried, width, every = None, None, 1, False
    while True:
        checked = stored(_verified(pairs, units), "checked")
        good = checked.where(F.col("similarity") >= similarity).select("a", "b")
        tried = checked.select("a", "b") if tried is None else tried.unionByName(checked.select("a", "b"))
        # Without a new link, buckets and fragments stay as they are.
        if width == 1 or not good.isEmpty():
            # What is known to be connected is a star around its root, whatever links made it so.
            roots = components(good if roots is None else good.unionByName(roots.select(F.col("uid").alias("a"), F.col("root").alias("b"))))
            parted = bucket.join(roots.withColumnRenamed("uid", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
            parted = _split(parted)
            if width == 1:  # from here on, the buckets are exact
                parted = _split(stored(_rare(stored(parted, "fragments"), units, similarity), "rare"))
            parted = stored(parted, "fragments")
            sizes = parted.groupBy("key", "root").agg(F.count("*").alias("n"))
            largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("whole"))
            most = largest.agg(F.max("whole")).first()[0] or 0
        while True:
            if not most or every:
                return classes, roots
            width *= 8
            # Two members can share a part at any width, so the last round takes each as a head of its own.
            every = width > 8 * most
            # The heads of a bucket: the least of each of ``width`` parts by hash.
            part = F.pmod(F.xxhash64("b", "key"), F.lit(width))
            head = F.struct("b", "root", "n", "rank")
            least_of = parted.select("key", head.alias("h")) if every else parted.groupBy("key", part.alias("part")).agg(F.min(head).alias("h"))
            heads = least_of.select("key", F.col("h.b").alias("head"), F.col("h.root").alias("other"), F.col("h.n").alias("m"), F.col("h.rank").alias("place"))
            small = parted.join(largest, "key").where(F.col("root") != F.col("largest.root")).select("key", "b", "root", "n", "rank")
            # Of two texts that first meet at these ranks, no more units than follow can be shared.
            reach = 1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("place"))
            may = reach >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
            met = small.join(heads, "key").where((F.col("root") != F.col("other")) & may).select(F.least("b", "head").alias("a"), F.greatest("b", "head").alias("b"))
            pairs = stored(met.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                break
        bucket = parted.drop("root")


def components(edges: DataFrame) -> DataFrame:
    """(uid, root) of every end of ``edges`` (a, b): the least uid it is connected with.

    Large-star and small-star steps, each two exchanges of the edges, until only stars are left; the number
    of rounds grows with the logarithm of the longest path. Edges that are stars already cost no round.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u gets u's least neighbour.
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours get the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        low = edges.join(least, "u")
        edges = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(edges, "edges")
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u of ``edges`` (u > v) has one v, and no v is a u: then each v is the least of its component."""
    end = F.explode(F.array(F.struct(F.col("u").alias("uid"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("uid"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    ends = edges.select(end.alias("end")).groupBy("end.uid").agg((F.sum("end.up") + F.max("end.down")).alias("places"))
    return ends.where("places > 1").isEmpty()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every row's key with its class, whether it stays, and its class's size.

    Output: key, class_id (the least key of the class), keep boolean (one row of each class), class_size
    long. Classes are the connected components of pairs at ``similarity`` or more, and of equal texts. Null,
    empty and blank texts have no shingle and so no similarity: each is a class of its own. Rows are told
    apart by place, so repeated keys and null keys are rows of their own; of equal keys one stays.
    """
    return _placed(df, key, text, similarity, bands, rows)[1]


def _placed(df: DataFrame, key: str, text: str, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    bound_batches(df.sparkSession)
    placed = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    classes, roots = connected(placed, "_text", similarity, bands, rows)
    grouped = classes.join(roots.withColumnRenamed("uid", "a"), "a", "left").select("uid", F.coalesce("root", "a").alias("root"))
    rows_ = placed.select("uid", "_key").join(grouped, "uid", "left").select("uid", "_key", F.coalesce("root", "uid").alias("root"))
    rows_ = stored(rows_, "classes")
    # The least key of a class stands for it, the first row of it stays.
    first = rows_.groupBy("root").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "uid")).alias("first"), F.count("*").alias("class_size"))
    out = rows_.join(first, "root").select(
        "uid",
        F.col("_key").alias(key),
        F.col("first._key").alias("class_id"),
        (F.col("uid") == F.col("first.uid")).alias("keep"),
        "class_size",
    )
    return out, out.drop("uid")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each class, all of its columns as they were."""
    spare = free_name(df, "uid")
    out, _ = _placed(df, key, text, similarity, BANDS, ROWS)
    stay = out.where("keep").select(F.col("uid").alias(spare))
    return df.withColumn(spare, F.monotonically_increasing_id()).join(stay, spare, "left_semi").drop(spare)
