"""Dates and times on columns; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_minutes(offset: Column) -> Column:
    """Minutes of a UTC+HH:MM text, its sign applied to hours and minutes alike; 0 if it isn't one."""
    sign = F.when(F.regexp_extract(offset, r"^UTC([+-])", 1) == "-", -1).otherwise(1)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(offset, r"^UTC[+-](\d{1,2}):?(\d{2})?$", k), F.lit("")).cast("int"), F.lit(0))
    return F.coalesce(sign * (part(1) * 60 + part(2)), F.lit(0))


def local(seconds: Column, offset: Column) -> Column:
    """struct(label yyyyMMdd, time ISO) of unix seconds at an offset."""
    at = F.timestamp_seconds(seconds + offset_minutes(offset) * 60)
    return F.struct(F.date_format(at, "yyyyMMdd").alias("label"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("time"))


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def full_year(two_digits: Column) -> Column:
    """Recording headers have two digits: 85 and later are of the last century."""
    return F.when(two_digits >= 85, 1900 + two_digits).otherwise(2000 + two_digits)


def header_time(text: Column) -> Column:
    """Timestamp of a header's dd.mm.yy and hh.mm.ss, given as 'dd.mm.yyhh.mm.ss'; null if it isn't one."""
    part = lambda k: F.regexp_extract(text, r"^(\d\d)\.(\d\d)\.(\d\d)(\d\d)\.(\d\d)\.(\d\d)", k).try_cast("int")
    return F.try_make_timestamp_ntz(full_year(part(3)), part(2), part(1), part(4), part(5), part(6).cast("double"))


def from_nanoseconds(ns: Column) -> Column:
    """struct(ts to the microsecond, rest in nanoseconds)."""
    return F.struct(F.timestamp_micros(F.floor(ns / F.lit(1000)).cast("bigint")).alias("ts"), F.pmod(ns, F.lit(1000)).cast("int").alias("rest_ns"))


def sample_index(seconds: Column, sfreq: Column) -> Column:
    """The sample at a time, truncated as a product of doubles."""
    return (seconds.cast("double") * sfreq.cast("double")).cast("bigint")


def aware(text: Column) -> Column:
    """Whether a text is an ISO timestamp with a time zone."""
    zone = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.coalesce(zone & F.try_to_timestamp(text).isNotNull(), F.lit(False))
