"""What can be read: readers by name or extension, decoders by ending, and storage addresses."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Reader = Callable[..., DataFrame]

_READERS: dict[str, tuple[Reader, tuple[str, ...]]] = {}
_DECODERS: dict[str, Callable] = {}
RESERVED = ("bids", "manifest", "smart")


class UnknownReader(ValueError):
    """No reader, or more than one, claims a source."""


def register_reader(name: str, reader: Reader, extensions: tuple[str, ...] = ()) -> None:
    """Add a reader; the built-in names stay theirs."""
    if name in RESERVED and name in _READERS:
        raise ValueError(f"{name} is reserved")
    _READERS[name] = (reader, tuple(e.lower() for e in extensions))


def available_readers() -> list[str]:
    return sorted(_READERS)


def reader_for(source: str, name: str | None = None) -> Reader:
    """By name; a folder is BIDS; tables are manifests; else the one reader that claims the extension."""
    if name is not None:
        if name not in _READERS:
            raise UnknownReader(f"no reader {name!r}; there are {', '.join(available_readers())}")
        return _READERS[name][0]
    if os.path.isdir(source) or "." not in source.rstrip("/").rpartition("/")[2]:
        return _READERS["bids"][0]
    claims = [n for n, (_, extensions) in _READERS.items() if n not in RESERVED and source.lower().endswith(extensions or ("\0",))]
    if len(claims) == 1:
        return _READERS[claims[0]][0]
    if not claims and source.lower().endswith((".csv", ".tsv", ".json", ".jsonl")):
        return _READERS["manifest"][0]
    raise UnknownReader(f"{'several readers claim' if claims else 'no reader for'} {source}")


def register_format(extension: str, decoder: Callable) -> None:
    """A decoder for an ending; registering again replaces it and keeps its turn."""
    _DECODERS[extension.lower()] = decoder


def decoders() -> list[tuple[str, Callable]]:
    """The registered endings and their decoders, in turn."""
    return list(_DECODERS.items())


def decoder_for(path: str) -> Callable | None:
    """The first registered ending that the path has."""
    return next((d for e, d in _DECODERS.items() if path.lower().endswith(e)), None)


SCHEMES = {"file": "file", "local": "file", "memory": "memory", "s3": "s3a", "s3a": "s3a", "r2": "s3a", "gs": "gs", "gcs": "gs", "az": "abfs", "abfs": "abfs", "azure": "abfs"}


_STORAGES: dict[str, Callable[[str], str]] = {}


def register_storage(scheme: str, factory: Callable[[str], str]) -> None:
    """A scheme of a caller's own: ``factory`` makes a Hadoop URI of what follows scheme://."""
    if scheme in SCHEMES or not re.fullmatch(r"[a-z][a-z0-9+.-]*", scheme):
        raise ValueError(f"{scheme!r} can't be registered")
    _STORAGES[scheme] = factory


def storage_uri(target: str, *parts: str) -> str:
    """A Hadoop URI for a target and a path below it; credentials in it are refused."""
    match = re.match(r"^([a-z][a-z0-9+.-]*)://(.*)$", target)
    if match is None:
        return "/".join([os.path.abspath(target).rstrip("/"), *parts])
    scheme, rest = match.groups()
    if scheme in _STORAGES:
        return "/".join([_STORAGES[scheme](rest).rstrip("/"), *parts])
    if scheme not in SCHEMES:
        raise ValueError(f"unknown storage {scheme!r}")
    if "@" in rest.partition("/")[0] and SCHEMES[scheme] != "abfs" or re.search(r"[?&](key|secret|token|password)=", rest, re.I):
        raise ValueError("credentials don't belong in an address")
    return "/".join([f"{SCHEMES[scheme]}://{rest.rstrip('/')}", *parts])


class _Folder(InputPartition):
    def __init__(self, sub: str, root: str):
        self.sub, self.root = sub, root


class _FolderReader(DataSourceReader):
    """A partition for each subject's folder; executors list their own."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Folder]:
        return [_Folder(d, self.root) for d in sorted(os.listdir(self.root)) if d.startswith("sub-") and os.path.isdir(os.path.join(self.root, d))] or [_Folder("", self.root)]

    def read(self, partition: _Folder):
        top = os.path.join(partition.root, partition.sub)
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                full = os.path.join(folder, name)
                yield partition.sub, os.path.relpath(full, partition.root), os.path.getsize(full)


class SubjectFolders(DataSource):
    """spark.read.format("siltstone_subjects").load(folder): files of a mounted folder, a task for each subject."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_subjects"

    def schema(self) -> str:
        return "sub string, path string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"])


def inspect(spark: SparkSession, source: str, name: str | None = None) -> DataFrame:
    """Issues of any source (code, severity, message, location), by the reader that would read it."""
    from siltstone.operators import verify
    from siltstone.sources import files

    reader = reader_for(source, name)
    if reader is _manifest:
        listed = files.listing(spark, source.rstrip("/").rpartition("/")[0] or ".")
        return verify.manifest(files.manifest(spark, source), listed)
    if reader is _bids:
        found = files.listing(spark, source)
        people = found.where("path = 'participants.tsv'").isEmpty()
        subs = spark.createDataFrame([], "sub string") if people else files.participants(spark, source).select("sub")
        out = verify.folder(found, subs, files.json_attributes(spark, f"{source.rstrip('/')}/dataset_description.json"))
        bad = files.bundles(found.where(F.col("path").rlike("^sub-") & (F.col("ext") != ".json"))).withColumn("place", F.concat_ws("/", "dir", "entities"))
        return out.unionByName(verify.issues(bad, F.col("problem").isNotNull(), "bundle", F.col("problem"), "place"))
    rows = reader(spark, source)
    if "path" not in rows.columns:
        return verify.issues(rows.limit(1), F.lit(True), "columns", F.lit("the reader gives no paths"), rows.columns[0])
    again = rows.groupBy("path").count()
    return verify.issues(again, F.col("count") > 1, "repeated", F.col("count"), "path")


def _bids(spark: SparkSession, source: str, **options) -> DataFrame:
    from siltstone.sources import bids

    return bids.scan(spark, source, **options)


def _manifest(spark: SparkSession, source: str, **options: str) -> DataFrame:
    from siltstone.sources import files

    return files.manifest(spark, source, **options)


def _smart(spark: SparkSession, source: str, **options) -> DataFrame:
    from siltstone.sources import smart

    return smart.inferred(spark, source, **options)


register_reader("bids", _bids)
register_reader("manifest", _manifest, (".csv", ".tsv", ".json"))
register_reader("smart", _smart)
