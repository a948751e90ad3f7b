"""Multichannel signals in chunk rows (recording, channel, chunk, start, samples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class WindowError(ValueError):
    """The window isn't one."""


def chunked(samples: DataFrame, group: list[str], order: list[str], value: str, step: int) -> DataFrame:
    """(group, chunk, start, samples) of one row a sample, in order."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    rows = samples.select(*group, F.col(value).alias("_x"), at.alias("_i")).withColumn("chunk", F.floor(F.col("_i") / step))
    packed = rows.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    return packed.select(*group, "chunk", (F.col("chunk") * step).alias("start"), F.transform("_s", lambda s: s["_x"]).alias("samples"))


def span(n: int, start: int | None = None, stop: int | None = None, tmin: float | None = None, tmax: float | None = None, sfreq: float | None = None) -> tuple[int, int]:
    """[start, stop) of a window, by samples as slices go or by seconds, cut to whole samples."""
    if (start is not None or stop is not None) and (tmin is not None or tmax is not None):
        raise WindowError("samples or seconds, not both")
    if tmin is not None or tmax is not None:
        if not sfreq or sfreq <= 0:
            raise WindowError("seconds need a sampling rate")
        if (tmin is not None and tmin < 0) or (tmax is not None and tmax < 0):
            raise WindowError("times begin at 0")
        start, stop = (None if tmin is None else int(tmin * sfreq)), (None if tmax is None else int(tmax * sfreq))
    first, last, _ = slice(start, stop).indices(n)
    if first >= last:
        raise WindowError("the window is empty")
    return first, last


def window(chunks: DataFrame, start: int, stop: int, step: int, scale: Column | None = None, offset: Column | None = None) -> DataFrame:
    """The chunks' rows cut to [start, stop), in physical units; only the chunks concerned are read."""
    rows = chunks.where(F.col("chunk").between(start // step, (stop - 1) // step))
    low = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    high = F.least(F.lit(stop) - F.col("start"), F.size("samples")).cast("int")
    cut = F.slice("samples", low + 1, F.greatest(high - low, F.lit(0)))
    values = cut if scale is None else F.transform(cut, lambda x: x * scale + (offset if offset is not None else F.lit(0.0)))
    return rows.withColumn("samples", values).withColumn("start", F.col("start") + low)


def long_form(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep..., i, x): a row a sample."""
    return chunks.select(*keep, "start", F.posexplode("samples").alias("p", "x")).select(*keep, (F.col("start") + F.col("p")).alias("i"), "x")


def picked(chunks: DataFrame, picks: list[str | int], names: list[str]) -> DataFrame:
    """Chunks of the picked channels with ``pick``, their place among the picks; indices may be negative."""
    wanted = [(k, names[p] if isinstance(p, int) else p) for k, p in enumerate(picks)]
    missing = [n for _, n in wanted if n not in names]
    if missing:
        raise WindowError(f"no channel {missing[0]!r}")
    picks_df = chunks.sparkSession.createDataFrame(wanted, "pick int, channel string")
    return chunks.join(F.broadcast(picks_df), "channel")  # as many rows as the caller listed


def block_sums(samples: DataFrame, group: list[str], seconds: Column, length: float, value: str) -> DataFrame:
    """Exact sums over blocks of ``length`` seconds."""
    block = F.floor(seconds / length).cast("bigint")
    return samples.groupBy(*group, block.alias("block")).agg(F.sum(F.col(value).cast("decimal(18,4)")).alias("total"), F.count("*").alias("n"))


def patched(chunks: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the patch's samples (keys, i, x) in place, and whether the chunk changed."""
    long = long_form(chunks, *keys, "chunk")
    new = long.join(patch.withColumnRenamed("x", "_new"), [*keys, "i"], "left")
    packed = new.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("_new", "x").alias("x"), "_new"))).alias("s"), F.bool_or(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("x"))).alias("changed"))
    return packed.select(*keys, "chunk", F.get("s", F.lit(0))["i"].alias("start"), F.transform("s", lambda e: e["x"]).alias("samples"), "changed")


def middle_chunk(n: Column, step: Column) -> Column:
    """The chunk in the middle, as a sample of the recording."""
    return F.floor(F.floor((n + step - 1) / step) / 2).cast("bigint")


def onsets(df: DataFrame, group: list[str], time: str, into: str = "onset") -> DataFrame:
    """Rows with their time since the group's first; the first of each group is joined, so no group is one task's."""
    first = df.groupBy(*group).agg(F.min(time).alias("_first"))
    return df.join(first, group).withColumn(into, F.col(time) - F.col("_first")).drop("_first")


def with_annotations(segments: DataFrame, annotations: DataFrame, by: list[str]) -> DataFrame:
    """Segments with the number of annotations of their recording; 0 without any."""
    counted = annotations.groupBy(*by).agg(F.count("*").alias("n_annotations"))
    return segments.join(counted, by, "left").withColumn("n_annotations", F.coalesce("n_annotations", F.lit(0)))


def channel_name(table_name: Column, stored_name: Column, prefix: Column, number: Column) -> Column:
    """A channel's name: the channels table's, else the stored one, else a prefix and its number."""
    return F.coalesce(table_name, stored_name, F.concat(prefix, number))


def changed_chunks(new: DataFrame, old: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """The chunks of ``new`` that ``old`` lacks or has otherwise: all that a write has to touch."""
    before = old.select(*keys, F.col(samples).alias("_before"))
    return new.join(before, keys, "left").where(~F.col(samples).eqNullSafe(F.col("_before"))).drop("_before")


# Compressors that a probe tries, by name and level.
CODECS = (("zstd", 1), ("zstd", 9), ("zlib", 6))


def codec_sizes(chunks: DataFrame, group: list[str], samples: str = "samples", codecs: tuple[tuple[str, int], ...] = CODECS) -> DataFrame:
    """(group, codec, size): the bytes that each compressor makes of each chunk, its samples as float32.

    Compressors have no built-in form that tells their size, so chunks go through Arrow.
    """
    import zlib

    import numpy as np
    import pyarrow as pa
    import zstandard

    check_codecs(codecs)
    kinds = chunks.select(*group).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields), "codec string", "size long"])

    def run(batches):
        make = {(n, k): zstandard.ZstdCompressor(level=k).compress if n == "zstd" else (lambda data, k=k: zlib.compress(data, k)) for n, k in codecs}
        for batch in batches:
            data = [np.asarray(s if s is not None else [], np.float32).tobytes() for s in batch.column(len(group)).to_pylist()]
            for (name, level), compress in make.items():
                sizes = pa.array([len(compress(d)) for d in data], pa.int64())
                label = pa.array([f"{name}({level})"] * len(data), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(group)], label, sizes], names=[*group, "codec", "size"])

    return chunks.select(*group, samples).mapInArrow(run, schema)


def codec_plan(items: DataFrame, sizes: DataFrame, keys: list[str], default: str, level: int | None = None) -> DataFrame:
    """``items`` with the codec that took least for their keys, and how many keys decided.

    ``sizes`` has the keys, codec and size. An item without sizes for all of its first ``level`` keys goes by
    one key fewer, and so on; with none left, or at level 0, it has the default.
    """
    from siltstone.operators import reports

    level = len(keys) if level is None else level
    if not 0 <= level <= len(keys):
        raise ValueError(f"the level is 0 to {len(keys)}")
    out, found = items, []
    for n in range(level, 0, -1):
        group = F.struct(*keys[:n])
        best = reports.smallest_total(sizes.withColumn("_key", group), "_key", "codec", "size").select(*[F.col(f"_key.{k}").alias(k) for k in keys[:n]], F.struct("codec", F.lit(n).alias("decided_by")).alias(f"_c{n}"))
        out = out.join(best, keys[:n], "left")
        found.append(F.col(f"_c{n}"))
    choice = F.coalesce(*found, F.struct(F.lit(default).alias("codec"), F.lit(0).alias("decided_by")))
    return out.select(*items.columns, choice.alias("_c")).select(*items.columns, "_c.codec", "_c.decided_by")


def check_codecs(codecs: tuple[tuple[str, int], ...]) -> None:
    """Refuse compressors and levels that there aren't."""
    for name, level in codecs:
        if name not in ("zstd", "zlib"):
            raise ValueError(f"no compressor {name!r}")
        if not 1 <= level <= {"zstd": 22, "zlib": 9}[name]:
            raise ValueError(f"{name} has no level {level}")


def check_layout(shape: tuple[int, ...], chunk: tuple[int, ...], item_bytes: int) -> None:
    """Refuse chunks that aren't of the array's dimensions, aren't positive, or exceed 2 GiB, Arrow's limit for a value."""
    if len(shape) != len(chunk):
        raise ValueError(f"chunks of {len(chunk)} dimensions for an array of {len(shape)}")
    if any(c < 1 for c in chunk):
        raise ValueError("chunks have at least one sample a side")
    size = item_bytes
    for c in chunk:
        size *= c
    if size >= 1 << 31:
        raise ValueError(f"a chunk of {size} bytes is too large")
