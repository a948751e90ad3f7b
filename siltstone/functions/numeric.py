"""Numbers and signals on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readings this large are no measurements.
INVALID = 1e6


def soft_clamp(x: Column, low: Column, high: Column) -> Column:
    """x inside [low, high]; outside it only as far as log1p of the excess. Null bounds don't bind."""
    above, below = F.coalesce(x > high, F.lit(False)), F.coalesce(x < low, F.lit(False))
    return F.when(above, high + F.log1p(x - high)).when(below, low - F.log1p(low - x)).otherwise(x)


def invalid(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) >= INVALID)


def chunk_count(n: Column, step: Column) -> Column:
    return F.floor((n + step - 1) / step).cast("bigint")


def chunk_length(n: Column, row_bytes: Column, target: int = 8 << 20, most: int = 65_536) -> Column:
    """Samples in a chunk: as many as the target holds, between one and the recording or ``most``."""
    return F.greatest(F.lit(1), F.least(n, F.floor(F.lit(target) / row_bytes).cast("bigint"), F.lit(most))).cast("bigint")


def packed(x: Column, scale: Column, offset: Column, bits: int = 0) -> Column:
    """The 16-bit step of a value: rounded half to even, its last ``bits`` rounded away, clipped."""
    step = F.rint((x - offset) / scale)
    if bits:
        step = F.rint(step / float(1 << bits)) * float(1 << bits)
    return F.least(F.greatest(step, F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def calibrated(step: Column, scale: Column, offset: Column) -> Column:
    return step * scale + offset


def on_grid(x: Column, scale: Column, offset: Column) -> Column:
    """Whether a value is a 16-bit step to within 1e-6 of one."""
    step = (x - offset) / scale
    return (F.abs(step - F.rint(step)) <= 1e-6) & F.rint(step).between(-32768, 32767)


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal to within tolerance plus 1e-5 of the expected value b."""
    return F.abs(a - b) <= tolerance + 1e-5 * F.abs(b)


def window_start(total: Column, window: Column, turn: Column) -> Column:
    """Start of a test window: golden-ratio steps through what room there is."""
    room = F.greatest(total - window, F.lit(0))
    share = turn * 0.6180339887498949
    return F.floor((share - F.floor(share)) * (room + 1)).cast("bigint")


def age_years(seconds: Column) -> Column:
    return F.bround(seconds / (365.25 * 86400), 1)


def onset_bounds(start: Column, end: Column, previous_end: Column) -> Column:
    """struct(low, high) of onsets relative to a session's start; null where a time is missing."""
    low = F.when(previous_end.isNotNull(), F.least(previous_end - start, F.lit(0.0)))
    return F.struct(low.alias("low"), (end - start).alias("high"))


def layout(dtype: Column, calibrated: Column, sample_bytes: Column) -> Column:
    """Storage of a recording: a float type as given; 2-byte calibrated samples as int16; else float32."""
    return F.when(dtype.startswith("float"), dtype).when(calibrated & (sample_bytes == 2), "int16").otherwise("float32")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)
