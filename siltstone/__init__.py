"""siltstone: a Spark-first engine for versioned collections of recordings, tables and arrays."""

from siltstone.session import session

__all__ = ["session"]
