"""The one place where engine-wide Spark settings live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings the operators' results depend on (not tuning): UTC clocks, last key wins in maps.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators' semantics need on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "siltstone", **conf: str) -> SparkSession:
    """The active session, or a new one, with the engine's settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared checkpoint folder, which only a local master may leave unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or tempfile.gettempdir() + '/siltstone').rstrip('/')}/{what}-{uuid.uuid4().hex}"
