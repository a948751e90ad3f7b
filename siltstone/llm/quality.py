"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words and word shapes are hashed into a fixed number of buckets. Every bucket owns a sparse ternary index
vector; its context vector is the sum of the index vectors of all neighbours it has in the whole corpus.
Documents are means of context vectors. The network's output passes through a temperature fitted on rows
it hasn't seen, so that the score is a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import batches_of, bound_batches, free_name

#: Buckets of shapes and of words, and the length of their vectors.
SHAPES, WORDS, DIM = 512, 1536, 64
BUCKETS = SHAPES + WORDS

#: The bounded training sample: about this many labelled documents.
SAMPLE = 8000

#: Distinct words a worker remembers the buckets of; emptied when full.
CACHE_ENTRIES = 400_000

#: Letters of a word at most; a longer one is several words.
PIECE = 64

#: Pairs gathered before they are counted (32 MB).
CODES_AT_ONCE = 8_000_000


def index_vectors() -> np.ndarray:
    """The ternary index vector of every bucket: eight of its entries are +1 or -1."""
    rng = np.random.default_rng(20_240_601)
    out = np.zeros((BUCKETS, DIM))
    for row in out:
        row[rng.choice(DIM, 8, replace=False)] = rng.choice((-1, 1), 8)
    return out


def words_of(text: str) -> list[str]:
    """The words between white space; an over-long one (a text without spaces, encoded data) in pieces."""
    words = text.split()
    if len(text) > PIECE and any(len(w) > PIECE for w in words):
        words = [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]
    return words


def shape(word: str) -> str:
    """The word's pattern: runs of upper, lower and digits as one sign each, other signs as they are."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind or kind not in "Aa9":
            out.append(kind)
    return "".join(out)


class Hasher:
    """Words to pairs of buckets (as one number), with a memory."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def make(self, word: str) -> int:
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        own = SHAPES + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        found = self.known[word] = own * SHAPES + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES
        return found

    def ids(self, words: list[str]) -> np.ndarray:
        """words x 2: the bucket of each word and of its shape."""
        get, make = self.known.get, self.make
        both = np.array([get(w) or make(w) for w in words], np.int64)  # never 0
        return np.stack([both // SHAPES, both % SHAPES], 1)


def pair_codes(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """bucket * BUCKETS + neighbour of all pairs within two places; ``ends`` marks each document's last word."""
    doc = np.cumsum(ends) - ends
    word, form = ids[:, 0], ids[:, 1]
    out = []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        out.append(a * BUCKETS + b)
        out.append(b * BUCKETS + a)

    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        add(word[:-gap][same], word[gap:][same])
    same = doc[1:] == doc[:-1]
    add(form[:-1][same], form[1:][same])
    add(word, form)
    return np.concatenate(out).astype(np.int32)


def context_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM context vectors over all of ``df``: summed per task, then over tasks, in integers."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hasher = np.zeros(BUCKETS * BUCKETS, np.int64), Hasher()
        waiting: list[np.ndarray] = []

        def count() -> None:
            if waiting:
                np.add(counts, np.bincount(np.concatenate(waiting), minlength=len(counts)), out=counts)
                waiting.clear()

        for batch in batches:
            words = [words_of(t) for t in batches_of(batch.column(0))]
            words = [w for w in words if w]
            if words:
                ids = hasher.ids([x for w in words for x in w])
                ends = np.zeros(len(ids), np.int64)
                ends[np.cumsum([len(w) for w in words]) - 1] = 1
                waiting.append(pair_codes(ids, ends))
                if sum(map(len, waiting)) > CODES_AT_ONCE:
                    count()
        count()
        square = counts.reshape(BUCKETS, BUCKETS)
        rows = np.flatnonzero(square.any(1))
        # Doubles hold these sums exactly, and multiply fast.
        sums = (square[rows].astype(np.float64) @ index_vectors()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(sums), pa.list_(pa.int64()))], names=["bucket", "v"])

    partial = df.select(text).mapInArrow(run, "bucket int, v array<bigint>")
    # As many sums as DIM in one row per bucket; each task sends a bucket once.
    total = partial.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(DIM)]).alias("v"))
    out = np.zeros((BUCKETS, DIM))
    for row in total.toArrow().to_pylist():  # at most BUCKETS rows
        out[row["bucket"]] = row["v"]
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
    return (out - out.mean(0)).astype(np.float32)


def pooled(texts: list[list[str]], hasher: Hasher, vectors: np.ndarray) -> np.ndarray:
    """A row per document: mean word vector, mean shape vector, their lengths, and four ratios.

    A document without words is a row of zeros.
    """
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = hasher.ids([x for w in texts for x in w])
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = np.maximum(sizes, 1)

    def mean(bucket: np.ndarray) -> np.ndarray:
        counts = np.bincount(doc * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
        return counts.astype(np.float32) @ vectors / n[:, None]

    words, forms = mean(ids[:, 0]), mean(ids[:, 1])
    twice = doc[1:][(doc[1:] == doc[:-1]) & (ids[1:, 0] == ids[:-1, 0])]
    again = np.bincount(twice, minlength=len(texts)) / np.maximum(sizes - 1, 1)
    distinct = np.array([len(set(w)) for w in texts])
    extra = [np.linalg.norm(words, axis=1), np.linalg.norm(forms, axis=1), again, distinct / n, distinct / n**0.8, np.log1p(sizes) / 8]
    return np.concatenate([words, forms, np.stack(extra, 1)], 1)


@dataclass
class Network:
    """Two layers, and a temperature that calibrates their output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Network:
    """Minibatch Adam on log loss, then the temperature with the least log loss on a fifth held back.

    Without rows, or with one class only, the network is the constant of that share.
    """
    rng = np.random.default_rng(seed)
    size = x.shape[1] if x.ndim == 2 else 2 * DIM + 6
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    net = Network(np.zeros(size), np.ones(size), rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return net
    order = rng.permutation(len(y))
    back, front = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[front].mean(0), 1 / (x[front].std(0) + 1e-3)
    z = np.clip((x - net.mean) * net.scale, -8, 8)
    params = [net.w1, net.b1, rng.normal(0, hidden**-0.5, hidden), np.array([net.b2])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(front), max(1, len(front) // 128)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            dh = d[:, None] * params[2] * (1 - h * h)
            slopes = [z[rows].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d, np.array([d.sum()])]
            t += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    raw = net.logits(x[back])

    def loss(temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -30, 30))), 1e-6, 1 - 1e-6)
        return float(-(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)).mean())

    net.temperature = min(np.geomspace(0.3, 8, 60), key=loss)
    return net


def sample_of(labels: DataFrame, key: str, label: str, size: int) -> DataFrame:
    """(key, label) of about ``size`` labelled keys, chosen by hash; repeated keys take their least label."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("int")).alias("_label"))
    count = one.count()
    return one.where(F.pmod(F.xxhash64(F.lit("quality"), key), F.lit(1 << 30)) < min(1.0, size / max(1, count)) * (1 << 30))


def learn(df: DataFrame, labels: DataFrame, vectors: np.ndarray, text: str = "text", key: str = "doc_id", label: str = "quality", size: int = SAMPLE) -> Network:
    """Fit the network on a bounded sample (about ``size`` keys) of the labelled rows.

    Of the rows of a repeated key the one of least text counts, so a hot key is one row of the sample.
    """
    bound_batches(df.sparkSession)
    chosen = df.select(key, text).join(F.broadcast(sample_of(labels, key, label, size)), key)  # ``size`` bounds the broadcast
    chosen = chosen.groupBy(key, "_label").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias(text))
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            x = pooled([words_of(t) for t in batches_of(batch.column(1))], hasher, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["y", "x"])

    rows = chosen.select("_label", text).mapInArrow(run, "y int, x array<float>").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, 2 * DIM + 6)
    return fit(x, np.array(rows.column("y").to_pylist(), np.float64))


def score(df: DataFrame, vectors: np.ndarray, net: Network, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score double and predicted int (1 if score >= threshold) to every row of ``df``.

    A null or empty text is the zero vector and is scored like any other. One pass, no shuffle; columns of
    those names get a leading underscore.
    """
    bound_batches(df.sparkSession)
    for name in ("score", "predicted"):
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, "_" + name))
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast((vectors, net))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        hasher = Hasher()
        for batch in batches:
            p = net.probability(pooled([words_of(t) for t in batches_of(batch.column(at))], hasher, vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return df.mapInArrow(run, schema)
