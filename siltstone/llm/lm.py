"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, beside the
add-one unigram base.

Token counts cover all training rows and stay in Spark. The most frequent words are symbols of the model;
every other word belongs to one of CLASSES symbols by its last bytes, and shares that symbol's probability
in proportion to its count plus one, as does one unknown word of each class. So the model's probabilities
of all known words, one unknown word a class and the end sum to one.

With context vectors R, target vectors T, position weights C1 and C2 and biases b, the score of w after
(h2, h1) is b_w + T_w.(C1*R_h1) + T_w.(C2*R_h2). Its exponential is a product of two tables, so one matrix
product of those tables gives the normaliser of every context at once, and scoring is look-ups.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import bound_batches, stored

#: Symbols: the end, the most frequent words, and classes of all other words.
SYMBOLS, CLASSES = 2048, 64

#: Length of the vectors, noise words and tokens in a step of training, and its rate.
DIM, NOISE, STEP, RATE = 16, 24, 1024, 0.1

#: Words whose counts travel with the scoring code (some 4 MB, fixed); the counts of others are joined.
CARRIED = 131_072

END = b" "
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """The text's words as UTF-8, A-Z lower-cased; bytes.split cuts at exactly 0x20 and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_tokens(df: DataFrame, text: str = "text", train: Column | None = None) -> DataFrame:
    """(word binary, c long, every long) of each distinct token of ``df``, the end among them: how often it
    stands in rows where ``train`` holds (all, if not given), and in all rows; no rows, no tokens."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Java's \s is 0x20 and 0x09 to 0x0D. One end a row; it is told from words by the space that no word holds.
    split = F.concat(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), F.array(F.lit(" ")))
    own = F.lit(1) if train is None else F.coalesce(train, F.lit(False)).cast("int")
    tokens = df.select(own.alias("own"), F.explode(split).alias("word")).where("word <> ''")
    # For ASCII words, lower is quicker and the same; others keep all but A-Z as it is.
    lowered = F.when(F.octet_length("word") == F.length("word"), F.lower("word")).otherwise(F.translate("word", upper, lower))
    counted = tokens.groupBy(lowered.alias("word")).agg(F.sum("own").alias("c"), F.count("*").alias("every"))
    return counted.select(F.col("word").cast("binary").alias("word"), "c", "every")


@dataclass
class Vocabulary:
    """What scoring needs of the counts: bounded by CARRIED words and CLASSES classes."""

    tokens: int = 0  #: N
    distinct: int = 0  #: V
    words: list[bytes] = field(default_factory=list)  #: the carried words, most frequent in training first, without the end
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ends: int = 0
    class_weight: np.ndarray = field(default_factory=lambda: np.ones(CLASSES))  #: sum of c + 1 outside the symbols, and 1

    def __post_init__(self):
        own = min(int((self.counts > 0).sum()), SYMBOLS - CLASSES - 1)
        self.own = own
        self.index = {w: k for k, w in enumerate(self.words)}
        # Symbols: 0 the end, 1 to ``own`` words, then the classes.
        self.symbol = np.array([1 + k if k < own else 1 + own + class_of(w) for k, w in enumerate(self.words)], np.int64)
        self.symbols = 1 + own + CLASSES
        mass = np.concatenate([[self.ends + 1.0], self.counts[:own] + 1.0, self.class_weight])
        self.share = mass / mass.sum()

    def __reduce__(self):  # the derived parts are made again where it arrives
        return Vocabulary, (self.tokens, self.distinct, self.words, self.counts, self.ends, self.class_weight)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(carried index or -1, symbol) of each word."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        symbol = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int64)
        other = np.flatnonzero(at < 0)
        symbol[other] = 1 + self.own + np.fromiter((class_of(words[k]) for k in other.tolist()), np.int64, len(other))
        return at, symbol

    def read_all(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """read of many texts at once: a lookup of all words together, cut by text again."""
        at, symbol = self.read(list(chain.from_iterable(texts)))
        ends = list(accumulate(map(len, texts), initial=0))
        cuts = list(pairwise(ends))
        return [at[lo:hi] for lo, hi in cuts], [symbol[lo:hi] for lo, hi in cuts]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded summary of a counts table; its other rows stay where they are.

    Carried are the words that occur most often in all rows (training or not), down to a count that at most
    CARRIED words reach: so no word that isn't carried is a hot key, not even one that training lacks.
    """
    own = F.when(F.col("word") == F.lit(END), F.col("c"))
    total = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("int")), F.sum(own)).first()
    words = counts.where(F.col("word") != F.lit(END))
    # Sixteen levels for each doubling of a count: a thousand rows at most.
    level = F.floor(F.log2("every") * 16).cast("int")
    reached, least = 0, None
    for row in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        reached += row["n"]
        if reached > CARRIED:
            break
        least = row["level"]
    top = words.where(level >= least).select("word", "c").collect() if least is not None else []
    top = sorted(((bytes(r[0]), r[1]) for r in top), key=lambda r: (-r[1], r[0]))
    vocab = Vocabulary(total[0] or 0, total[1] or 0, [w for w, _ in top], np.array([c for _, c in top], np.int64), total[2] or 0)
    by_class = words.where("c > 0").groupBy((F.crc32(F.substring("word", -2, 2)) % CLASSES).alias("k")).agg(F.sum(F.col("c") + 1).alias("w")).collect()
    weight = np.ones(CLASSES)
    for row in by_class:
        weight[row["k"]] += row["w"]
    for word, c in top[: vocab.own]:
        weight[class_of(word)] -= c + 1
    return Vocabulary(vocab.tokens, vocab.distinct, vocab.words, vocab.counts, vocab.ends, weight)


@dataclass
class LogBilinear:
    """The model's parameters: a row of ``both`` is (context vector, target vector, bias) of a symbol."""

    both: np.ndarray
    position: np.ndarray  #: 2 x DIM
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def start(cls, vocab: Vocabulary, seed: int = 11) -> LogBilinear:
        both = np.random.default_rng(seed).normal(0, 0.1, (vocab.symbols, 2 * DIM + 1)).astype(np.float32)
        both[:, -1] = np.log(vocab.share)
        return cls(both, np.stack([np.ones(DIM), np.full(DIM, 0.5)]).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by h1 and w with the bias in it, scores by h2 and w, log normaliser by h1 and h2)."""
        context, target, bias = self.both[:, :DIM], self.both[:, DIM:-1], self.both[:, -1]
        near = context * self.position[0] @ target.T + bias
        far = context * self.position[1] @ target.T
        top_near, top_far = near.max(1, keepdims=True), far.max(1, keepdims=True)
        total = np.exp(near - top_near) @ np.exp(far - top_far).T
        return near, far, np.log(total) + top_near + top_far.T


def contexts(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h2, h1, w) of every token of documents given as symbols; ends stand before each document's start."""
    start, end = np.zeros(2, np.int64), np.zeros(1, np.int64)
    stream = np.concatenate([part for s in symbols for part in (start, s, end)]) if symbols else np.zeros(0, np.int64)
    keep = np.ones(len(stream), bool)
    starts = np.cumsum([0] + [len(s) + 3 for s in symbols])[:-1]
    keep[starts] = keep[starts + 1] = False
    at = np.flatnonzero(keep)
    return stream[at - 2], stream[at - 1], stream[at]


def _gathered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``values`` by row: (distinct rows, sums)."""
    order = np.argsort(rows.astype(np.int16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first)


class Trainer:
    """Noise-contrastive estimation: tell the next word from NOISE words drawn by their share.

    The noise words are the same for all tokens of a step, so both directions are matrix products.
    """

    def __init__(self, model: LogBilinear, vocab: Vocabulary, seed: int):
        self.both, self.position = model.both.copy(), model.position.copy()
        self.rng = np.random.default_rng(seed)
        self.offset = np.log(NOISE * vocab.share).astype(np.float32)
        self.rows = np.cumsum(vocab.share)
        self.squares = np.full((len(self.both), 3), 0.1, np.float32)
        self.position_squares = np.full(2, 1.0, np.float32)
        self.seen = 0

    def step(self, h2: np.ndarray, h1: np.ndarray, w: np.ndarray) -> None:
        context, target, bias = self.both[:, :DIM], self.both[:, DIM:-1], self.both[:, -1]
        noise = np.minimum(np.searchsorted(self.rows, self.rng.random(NOISE)), len(self.both) - 1)
        near, far = context[h1], context[h2]
        q = near * self.position[0] + far * self.position[1]
        tw, tn = target[w], target[noise]
        right = _sigmoid((q * tw).sum(1) + bias[w] - self.offset[w])
        wrong = _sigmoid(q @ tn.T + (bias[noise] - self.offset[noise]))
        miss = 1 - right
        dq = miss[:, None] * tw - wrong @ tn
        rows = np.concatenate([w, noise])
        self._move(rows, np.concatenate([miss[:, None] * q, -(wrong.T @ q)]), 1, slice(DIM, 2 * DIM))
        self._move(rows, np.concatenate([miss, -wrong.sum(0)])[:, None], 2, slice(2 * DIM, None))
        self._move(np.concatenate([h1, h2]), np.concatenate([dq * self.position[0], dq * self.position[1]]), 0, slice(0, DIM))
        for k, values in enumerate((near, far)):
            slope = (dq * values).sum(0)
            self.position_squares[k] += (slope**2).mean()
            self.position[k] += 0.05 * slope / np.sqrt(self.position_squares[k])
        self.seen += len(w)

    def _move(self, rows: np.ndarray, slopes: np.ndarray, kind: int, columns: slice) -> None:
        rows, sums = _gathered(rows, slopes)
        self.squares[rows, kind] += (sums**2).mean(1)
        self.both[rows, columns] += RATE * sums / np.sqrt(self.squares[rows, kind])[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _trained(df: DataFrame, vocab: Vocabulary, text: str = "text", rounds: int = 1) -> LogBilinear:
    """Every task trains on all of its rows from the same start; the models are averaged by their tokens.

    A task sends each symbol's row once, whatever it has read, so the exchange is tasks x SYMBOLS rows.
    """
    bound_batches(df.sparkSession)
    model = LogBilinear.start(vocab)
    context = df.sparkSession.sparkContext
    carried = context.broadcast(vocab)
    width = 2 * DIM + 1
    for turn in range(rounds):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            vocab = carried.value
            trainer = Trainer(shared.value, vocab, seed=turn)
            for batch in batches:
                symbols = vocab.read_all([words_of(t) for t in batch.column(0).to_pylist()])[1]
                h2, h1, w = contexts(symbols)
                order = trainer.rng.permutation(len(w))
                for at in range(0, len(w), STEP):
                    part = order[at : at + STEP]
                    trainer.step(h2[part], h1[part], w[part])
            if trainer.seen:
                rows = np.concatenate([trainer.both, np.pad(trainer.position, ((0, 0), (0, width - DIM)))])
                index = np.concatenate([np.arange(len(trainer.both)), [-1, -2]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index, pa.int32()), pa.array(list(rows.astype(np.float64)), pa.list_(pa.float64())), pa.array(np.full(len(index), float(trainer.seen)))],
                    names=["row", "v", "n"],
                )

        sent = df.select(text).mapInArrow(run, "row int, v array<double>, n double")
        mean = sent.groupBy("row").agg(F.array(*[F.sum(F.col("v")[k] * F.col("n")) / F.sum("n") for k in range(width)]).alias("v"))
        both, position = model.both.copy(), model.position.copy()
        for row in mean.toArrow().to_pylist():  # SYMBOLS + 2 rows
            if row["row"] >= 0:
                both[row["row"]] = row["v"]
            else:
                position[-1 - row["row"]] = row["v"][:DIM]
        model = LogBilinear(both, position)
    return model


_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(model: LogBilinear) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's tables, made once in a worker (48 MB)."""
    if model.name not in _TABLES:
        _TABLES.clear()
        _TABLES[model.name] = model.tables()
    return _TABLES[model.name]


def score(df: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row, log10.

    Words that aren't carried go to their counts in one exchange and return summed in another; where
    ``df`` is what was counted, each is rarer in it than the carried ones, known to training or not, so no
    key is hot. Rows are told apart by their place, so repeated or null keys keep a row each. A null or empty text is the end alone. Without training tokens both scores are that of one
    unknown word among none.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((vocab, model))
    core = T.StructType([T.StructField("key", df.schema[key].dataType), *T.StructType.fromDDL("n_tokens bigint, n_known bigint, base double, model double").fields])
    parts_schema = T.StructType.fromDDL("word binary, uid bigint, times int").add("core", core)
    whole = vocab.tokens + vocab.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        near, far, normal = _tables(model)
        numbers = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())]
        known = np.log10(vocab.counts + 1.0)
        end = np.log10(vocab.ends + 1.0) - np.log10(whole)
        in_class = np.concatenate([np.zeros(1 + vocab.own), -np.log10(vocab.class_weight)])
        for batch in batches:
            kind = pa.struct([("key", batch.schema.field(2).type), *numbers])
            uids, sizes, rare, cores = batch.column(0).to_pylist(), [], [], []
            texts = [words_of(text) for text in batch.column(1).to_pylist()]
            places, symbols = vocab.read_all(texts)
            for words, at, symbol in zip(texts, places, symbols, strict=True):
                seen = at >= 0
                logs = known[at[seen]]
                # log10 of (c + 1) counts towards the base, and inside a class towards the model too
                inside = float(logs[symbol[seen] > vocab.own].sum())
                base = float(logs.sum()) - len(words) * np.log10(whole) + end
                cores.append([len(words) + 1, int((vocab.counts[at[seen]] > 0).sum()) + (vocab.ends > 0), base, inside + float(in_class[symbol].sum())])
                rare.append(Counter([words[k] for k in np.flatnonzero(~seen).tolist()]))
                sizes.append(len(words) + 1)
            h2, h1, w = contexts(symbols)
            log = (near[h1, w].astype(np.float64) + far[h2, w] - normal[h1, h2]) / np.log(10)
            if sizes:
                for row, total in zip(cores, np.add.reduceat(log, np.cumsum([0, *sizes[:-1]])), strict=True):
                    row[3] += float(total)
            owner = np.repeat(np.array(uids, np.int64), [len(f) for f in rare])
            word = [w for found in rare for w in found]
            times = [n for found in rare for n in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(owner), pa.array(times, pa.int32()), pa.nulls(len(word), kind)], names=["word", "uid", "times", "core"])
            columns = [batch.column(2), *[pa.array([c[k] for c in cores], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]]
            made = pa.StructArray.from_arrays(columns, fields=list(kind))
            # A key that no word equals, since words hold no space, and that no two rows share.
            word = pa.array([b" %d" % u for u in uids], pa.binary())
            yield pa.RecordBatch.from_arrays([word, batch.column(0), pa.array(np.zeros(len(uids), np.int32)), made], names=["word", "uid", "times", "core"])

    # The reader of a file deals the same rows to the same places each time, so a task run again agrees.
    placed = df.select(F.monotonically_increasing_id().alias("uid"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    parts = placed.mapInArrow(run, parts_schema)
    rare_counts = counts.where("c > 0").select("word", "c")
    joined = parts.join(rare_counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)
    summed = joined.groupBy("uid").agg(
        F.sum(log).alias("extra"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.first("core", ignorenulls=True).alias("core"),
    )
    return summed.select(
        F.col("core.key").alias(key),
        F.col("core.n_tokens").alias("n_tokens"),
        (F.col("core.n_known") + F.col("known")).alias("n_known"),
        (F.col("core.base") + F.col("extra")).alias("base_score"),
        (F.col("core.model") + F.col("extra")).alias("score"),
    )


def learn(df: DataFrame, train: Column | None = None, text: str = "text", rounds: int = 1) -> tuple[DataFrame, Vocabulary, LogBilinear]:
    """Counts (written once to shared storage), their bounded summary, and the trained model.

    Only rows where ``train`` holds are learned from (all, if not given); how often words occur in the other
    rows decides nothing but which counts travel with the scoring code.
    """
    counts = stored(count_tokens(df, text, train), "counts")
    vocab = vocabulary(counts)
    return counts, vocab, _trained(df if train is None else df.where(train), vocab, text, rounds)
