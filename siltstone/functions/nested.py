"""Arrays, maps and JSON on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_or(values: Column, index: Column | int, default: str = "n/a") -> Column:
    """The element, or ``default`` outside the array or where it is null."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.coalesce(F.get(values, index).cast("string"), F.lit(default))


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays as far as the shorter goes."""
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.least(F.size(a), F.size(b)))


def channels_short(matrix: Column) -> Column:
    """Whether an array of arrays has its channels (the short axis) first."""
    return F.size(matrix) <= F.size(F.get(matrix, F.lit(0)))


def transposed(matrix: Column) -> Column:
    inner = F.sequence(F.lit(0), F.size(F.get(matrix, F.lit(0))) - 1)
    return F.transform(inner, lambda k: F.transform(matrix, lambda row: F.get(row, k)))


def oriented(matrix: Column) -> Column:
    """The matrix with channels as rows."""
    return F.when(channels_short(matrix), matrix).otherwise(transposed(matrix))


def dims_valid(shape: Column, dims: Column, coords: Column) -> Column:
    """Dimension names are as many as the shape, distinct, and coordinates fit their dimension."""
    fits = F.forall(F.map_entries(coords), lambda e: F.coalesce(F.size(e["value"]) == F.get(shape, F.array_position(dims, e["key"]).cast("int") - 1), F.lit(False)))
    return (F.size(dims) == F.size(shape)) & (F.size(F.array_distinct(dims)) == F.size(dims)) & fits


def flat_index(shape: Column, at: Column) -> Column:
    """Row-major offset of the element at array<int> ``at``."""
    return F.aggregate(F.arrays_zip(shape.alias("n"), at.alias("i")), F.lit(0), lambda acc, e: (acc * e["n"] + e["i"]).cast("int"))


def labelled_answers(questions: Column, answers: Column) -> Column:
    """map of label -> value; answers beyond the labels, or under an empty one, are item_<place>."""

    def label(pair: Column, i: Column) -> Column:
        return F.coalesce(F.nullif(pair["q"], F.lit("")), F.concat(F.lit("item_"), (i + 1).cast("string")))

    pairs = F.arrays_zip(questions.alias("q"), answers.alias("a"))
    used = F.slice(pairs, 1, F.size(answers))
    return F.map_from_entries(F.transform(used, lambda p, i: F.struct(label(p, i), p["a"])))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def json_safe(text: Column) -> Column:
    """Whether a text is JSON; NaN and Infinity are not."""
    return F.coalesce(F.try_parse_json(text).isNotNull() & ~text.rlike(r"(?<![\w\"])-?(NaN|Infinity)(?![\w\"])"), F.lit(False))


def unmatched(expected: Column, stored: Column) -> Column:
    """The entries of a map that another map doesn't have as they are."""
    return F.map_filter(expected, lambda k, v: ~F.try_element_at(stored, k).eqNullSafe(v))


def record_key(record: Column, without: str) -> Column:
    """A map as JSON with sorted keys, one key left out: what tells records apart."""
    kept = F.map_filter(record, lambda k, v: k != without)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the new one's values win (mapKeyDedupPolicy is LAST_WIN)."""
    return F.map_concat(old, new)


def nested_or(json: Column, path: str, default: str = "n/a") -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(default))
