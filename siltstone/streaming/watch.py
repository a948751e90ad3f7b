"""Following a repository as a stream: its log of commits, and thin windowed aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "id string, parents array<string>, message string, ts double, pins map<string,string>"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """A stream of commits as their log entries appear."""
    return spark.readStream.schema(COMMIT).json(f"{root.rstrip('/')}/log")


def changed_subjects(stream: DataFrame) -> DataFrame:
    """(id, sub, pin) of every commit's pins."""
    return stream.select("id", F.explode("pins").alias("sub", "pin"))


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need timestamps with a zone; sessions run in UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def window_counts(stream: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are left out."""
    return _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, length), *keys).count()


def session_counts(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts in sessions that end after a gap."""
    return _timed(stream, time).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).count()
