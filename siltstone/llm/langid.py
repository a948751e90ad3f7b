"""Language identification in two levels: a linear machine for the family, then one-versus-one linear
support vector machines between the languages of that family.

Features are relative frequencies of hashed character unigrams and trigrams of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import batches_of, bound_batches, free_name

#: Language families by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
}

#: Hashed feature space.
BUCKETS = 4096

#: The bounded training sample: about this many documents of each language; fewer where many languages
#: would exceed the whole, but LEAST_EACH of every language.
PER_LANGUAGE, WHOLE_SAMPLE, LEAST_EACH = 600, 60_000, 20


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def grams(text: str) -> np.ndarray:
    """Bucket of every character and every trigram of the lower-cased text, non-letters as one space each."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    # Below 128 only a-z are letters here; above, nearly all that occurs in prose are.
    codes = np.where((codes >= 128) | ((codes >= 97) & (codes <= 122)), codes, np.uint32(32))
    tri = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    one = codes[1:-1] * np.uint32(0x27D4EB2F)
    both = np.concatenate([tri ^ tri >> np.uint32(15), one ^ one >> np.uint32(13)])
    return (both * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def frequencies(text: str) -> np.ndarray:
    found = grams(text)
    return np.bincount(found, minlength=BUCKETS).astype(np.float32) / np.float32(max(1, len(found)))


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by accelerated full-batch gradient steps; y is +1 or -1.

    Each class weighs the same, however many rows it has.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = w.copy(), b
    rate = 1 / (2 * float((np.einsum("ij,ij->i", x, x) + 1) @ weight) + decay)
    for step in range(steps):
        short = np.maximum(0, 1 - y * (x @ vw + vb))
        slope = -2 * weight * short * y
        nw = vw - np.float32(rate) * (x.T @ slope + np.float32(decay) * vw)
        nb = vb - np.float32(rate) * slope.sum()
        push = np.float32(step / (step + 3))
        vw, vb, w, b = nw + push * (nw - w), nb + push * (nb - b), nw, nb
    return w, float(b)


@dataclass
class Model:
    """All machines as columns of one matrix, so that a text is read once."""

    families: dict[str, list[str]] = field(default_factory=dict)
    heads: list[tuple[str, str, str]] = field(default_factory=list)  #: (family, "", "") or (family, language, language)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, confidence from 0 to 1); ('und', 0) without letters or without a learned language."""
        if not self.families or text is None or not has_letter(text):
            return "und", 0.0
        if len(self.heads):
            found = grams(text)
            margin = dict(zip(self.heads, np.bincount(found, minlength=BUCKETS) @ self.weights / len(found) + self.bias, strict=True))
        else:
            margin = {}
        names = list(self.families)
        if len(names) > 1:
            ranked = sorted(names, key=lambda n: -margin[n, "", ""])
            family, sure = ranked[0], _logistic(margin[ranked[0], "", ""] - margin[ranked[1], "", ""])
        else:
            family, sure = names[0], 1.0
        members = self.families[family]
        if len(members) == 1:
            return members[0], sure
        votes = dict.fromkeys(members, 0)
        sums = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            m = float(margin[family, a, b])
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(members, key=lambda n: (votes[n], sums[n]))
        closest = min(float(margin[family, a, b]) * (1 if a == best else -1) for a, b in combinations(members, 2) if best in (a, b))
        return best, sure * _logistic(2 * closest)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Learn from rows of relative frequencies and their languages; ``x`` is scaled in place."""
    known = sorted(set(languages))
    model = Model()
    for language in known:
        model.families.setdefault(family_of(language), []).append(language)
    if len(known) < 2:
        return model
    # Some columns at a time: the whole is never there twice.
    scale = 1 / (np.concatenate([x[:, at : at + 256].std(0) for at in range(0, x.shape[1], 256)]) + 1e-4)
    mean = x.mean(0)
    z = np.subtract(x, mean, out=x)
    z *= scale / np.float32(np.sqrt(x.shape[1]))
    own, kin = np.array(languages), np.array([family_of(n) for n in languages])
    machines = []
    if len(model.families) > 1:
        for name in model.families:
            model.heads.append((name, "", ""))
            machines.append(fit_svm(z, np.where(kin == name, 1, -1).astype(np.float32)))
    for name, members in model.families.items():
        for a, b in combinations(members, 2):
            rows = (own == a) | (own == b)
            model.heads.append((name, a, b))
            machines.append(fit_svm(z[rows], np.where(own[rows] == a, 1, -1).astype(np.float32)))
    w = np.array([m[0] for m in machines]).T * (scale / np.sqrt(x.shape[1]))[:, None]
    model.weights = w.astype(np.float32)
    model.bias = (np.array([m[1] for m in machines]) - mean @ w).astype(np.float32)
    return model


def learn(df: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows of ``df``: about ``per_language`` rows of each language.

    The share of each language to take follows from its count over all rows; which rows, from a hash of key
    and text; equal texts of a language count once, so neither a hot key nor copies fill the sample. Every
    language is learned. Rows with a null language or text take no part. Features are made on the executors.
    """
    bound_batches(df.sparkSession)
    df = df.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    # A row for each language, here and in the broadcast.
    counts = df.groupBy(F.col(language).alias("_language")).agg(F.count("*").alias("_n"))
    languages = counts.count()
    if not languages:
        return Model()
    if languages > WHOLE_SAMPLE:
        raise ValueError(f"{languages} distinct values of {language} are no languages")
    each = max(LEAST_EACH, min(per_language, WHOLE_SAMPLE // languages))
    share = counts.select("_language", (F.least(F.lit(1.0), each / F.col("_n")) * (1 << 30)).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), key, text), F.lit(1 << 30))
    chosen = df.select(F.col(language).alias("_language"), F.col(text).alias("_text"), draw.alias("_draw")).join(F.broadcast(share), "_language")
    chosen = chosen.where(F.col("_draw") < F.col("_share")).groupBy("_language", "_text").agg(F.lit(1)).select("_language", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [frequencies(t) for t in batches_of(batch.column(1))]
            index = [np.flatnonzero(r).astype(np.int32) for r in rows]
            value = [r[i] for r, i in zip(rows, index, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["lang", "i", "v"])

    sample = chosen.mapInArrow(run, "lang string, i array<int>, v array<float>").toArrow()
    x = np.zeros((sample.num_rows, BUCKETS), np.float32)
    at = 0
    for batch in sample.to_batches():
        index, value = batch.column("i"), batch.column("v")
        row = np.repeat(np.arange(at, at + batch.num_rows), index.value_lengths().to_numpy(zero_copy_only=False))
        x[row, index.flatten().to_numpy()] = value.flatten().to_numpy()
        at += batch.num_rows
    known = sample.column("lang").to_pylist()
    del sample, index, value, row
    return fit(x, known)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred string and score double to every row; the row's other columns play no part.

    A null, empty or letterless text gets 'und' and 0. Columns of those names get a leading underscore.
    One pass without a shuffle; the model is BUCKETS x machines numbers, 16 kB for each family
    and each pair of languages within one.
    """
    bound_batches(df.sparkSession)
    for name in ("lang_pred", "score"):
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, "_" + name))
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)
