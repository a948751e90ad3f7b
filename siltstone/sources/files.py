"""Folders and manifests as DataFrames: listings, format sniffing, sidecar tables and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text, timefn

# First bytes (hex) of formats, and endings that accompany an entry point.
MAGIC = {"30202020202020": "edf", "FF42494F53454D49": "bdf", "52494646": "wav", "89484446": "hdf5", "1F8B": "gzip", "504B0304": "zip", "49492A00": "tiff", "4D4D002A": "tiff"}
COMPANIONS = {".vhdr": (".eeg", ".vmrk"), ".set": (".fdt",), ".hdr": (".img",), ".bval": (".bvec",)}
SIGNALS = (".edf", ".bdf", ".vhdr", ".set", ".fif", ".wav", ".cnt", ".nwb")


def listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path relative to root, dir, name, ext, length, modified) of all files below a folder; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    tail = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    relative = F.substr("path", F.instr("path", tail) + len(tail) + 1)
    rows = found.select(relative.alias("path"), "length", "modified")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return rows.select("path", directory.alias("dir"), F.substring_index("path", "/", -1).alias("name"), text.extension(F.col("path")).alias("ext"), "length", "modified")


def sniffed(ext: Column, head: Column) -> Column:
    """A format by extension, else by the first bytes; 'unknown' otherwise."""
    found = F.when(ext.isin(*SIGNALS, ".tsv", ".csv", ".json", ".txt", ".md"), F.substr(ext, F.lit(2)))
    for magic, name in MAGIC.items():
        found = found.when(F.startswith(F.hex(head), F.lit(magic)), name)
    return found.otherwise("unknown")


def fingerprint(content: Column, ends: int = 1 << 20) -> Column:
    """Length and hash of the first and last MiB: equal files have equal ones."""
    head, tail = F.substr(content, F.lit(1), F.lit(ends)), F.substr(content, F.greatest(F.length(content) - ends + 1, F.lit(1)), F.lit(ends))
    return F.concat_ws("-", F.length(content), F.sha2(F.concat(head, tail), 256))


def fingerprints(spark: SparkSession, files: DataFrame, root: str, ends: int = 1 << 20) -> DataFrame:
    """(path, fingerprint) of files (path relative to root, length), as ``fingerprint`` makes it.

    Only the two ends of a file are read, in tasks, through the file's own storage, so files may be of any
    size. Bytes at an offset have no built-in reader, hence Arrow.
    """
    import hashlib

    import pyarrow as pa

    base = root if "://" in root else f"file://{root}" if root.startswith("/") else f"file:///{root}"

    def run(batches):
        from pyarrow import fs

        storage, folder = fs.FileSystem.from_uri(base.replace("s3a://", "s3://").rstrip("/"))
        for batch in batches:
            marks = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_input_file(f"{folder}/{path}") as file:
                    head = file.read_at(min(ends, length), 0)
                    tail = file.read_at(min(ends, length), max(0, length - ends))
                marks.append(f"{length}-{hashlib.sha256(head + tail).hexdigest()}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["path", "fingerprint"])

    return files.select("path", "length").mapInArrow(run, "path string, fingerprint string")


def companions(files: DataFrame) -> DataFrame:
    """(path, companion): files that belong to an entry point of the same folder and stem."""
    pairs = [(a, b) for a, bs in COMPANIONS.items() for b in bs]
    kinds = files.sparkSession.createDataFrame(pairs, "ext string, other string")
    stem = F.expr("substr(name, 1, length(name) - length(ext))")
    heads = files.select("path", "dir", "ext", stem.alias("stem")).join(F.broadcast(kinds), "ext")  # a fixed table
    tails = files.select(F.col("path").alias("companion"), "dir", F.col("ext").alias("other"), stem.alias("stem"))
    return heads.join(tails, ["dir", "stem", "other"]).select("path", "companion")


def bundles(files: DataFrame) -> DataFrame:
    """(dir, entities text, suffix, files map ext -> path, problem): files that make up one item.

    Two files of one extension, or two signals, are a problem, not a choice.
    """
    stem = text.split_stem(F.expr("substr(name, 1, length(name) - length(ext))"))
    named = files.select("dir", "path", "ext", text.group_name(stem["entities"]).alias("entities"), stem["suffix"].alias("suffix"))
    grouped = named.groupBy("dir", "entities", "suffix").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "path")))).alias("files"), F.count("*").alias("n"), F.count_if(F.col("ext").isin(*SIGNALS)).alias("signals"))
    problem = F.when(F.size("files") < F.col("n"), "repeated extension").when(F.col("signals") > 1, "several signals")
    return grouped.select("dir", "entities", "suffix", "files", problem.alias("problem"))


def tsv(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    """A tab-separated table; n/a and empty cells are null; values stay text unless inferred."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=infer, nullValue="n/a", emptyValue="")


def participants(spark: SparkSession, root: str) -> DataFrame:
    """(sub, participant struct) from participants.tsv with inferred types."""
    rows = tsv(spark, f"{root}/participants.tsv", infer=True)
    rest = [c for c in rows.columns if c != "participant_id"]
    return rows.select(F.col("participant_id").alias("sub"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("participant"))


def sessions(spark: SparkSession, root: str, devices: DataFrame | None = None) -> DataFrame:
    """All sessions tables with their subject, devices joined by session."""
    rows = tsv(spark, f"{root}/sub-*/sub-*_sessions.tsv").withColumn("sub", F.regexp_extract(F.input_file_name(), r"/(sub-[^/]+)/[^/]*$", 1))
    return rows if devices is None else rows.join(devices, "session_id", "left")


def phenotype(spark: SparkSession, root: str, subjects: DataFrame) -> DataFrame:
    """(sub, measure, key, value) of phenotype tables, as text, of subjects that exist."""
    out = None
    for name in sorted({r["name"] for r in listing(spark, f"{root}/phenotype", "*.tsv").select("name").collect()}):
        rows = tsv(spark, f"{root}/phenotype/{name}")
        rest = [c for c in rows.columns if c != "participant_id"]
        part = rows.unpivot("participant_id", rest, "key", "value").withColumn("measure", F.lit(name.removesuffix(".tsv")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "sub string, measure string, key string, value string")
    return out.withColumnRenamed("participant_id", "sub").join(subjects.select("sub").distinct(), "sub", "left_semi").select("sub", "measure", "key", "value")


def json_attributes(spark: SparkSession, path: str) -> dict:
    """A JSON file's members, {} if there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def samples(rows: DataFrame) -> DataFrame:
    """(sample_id, sub, attributes map) of a samples table; rows without an id are left out, the last of an id stays."""
    rest = [c for c in rows.columns if c not in ("sample_id", "participant_id")]
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in rest]), lambda e: e["value"].isNotNull())
    named = rows.where("sample_id is not null").select("sample_id", F.col("participant_id").alias("sub"), F.map_from_entries(entries).alias("attributes"))
    return named.groupBy("sample_id").agg(F.max(F.struct("sub", F.map_entries("attributes").alias("entries"))).alias("m")).select("sample_id", "m.sub", F.map_from_entries("m.entries").alias("attributes"))


def derivatives(files: DataFrame) -> DataFrame:
    """The files below derivatives/NAME, with that as their prefix and path and dir from there on."""
    inside = files.where(F.startswith("path", F.lit("derivatives/")) & (F.size(F.split("path", "/")) > 2))
    prefix = F.concat_ws("/", F.lit("derivatives"), F.split_part("path", F.lit("/"), F.lit(2)))
    rest = F.regexp_replace("path", r"^derivatives/[^/]+/", "")
    return inside.withColumn("prefix", prefix).withColumn("path", rest).withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))


def headerless(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """A recorded table without a header (plain or gzip), its columns as the sidecar names them, as doubles."""
    return spark.read.schema(", ".join(f"`{c}` double" for c in columns)).csv(path, sep="\t", nullValue="n/a")


def unclaimed(files: DataFrame, claimed: DataFrame, policy: str = "reference", most: int = 64 << 20) -> DataFrame:
    """(path, length, stored): what becomes of files that no reader takes: referred to by their path, or
    embedded if they aren't larger than ``most`` bytes; nothing else is a policy."""
    if policy not in ("reference", "embed"):
        raise ValueError("the policy is reference or embed")
    left = not_stored(files, claimed)
    if policy == "reference":
        return left.withColumn("stored", F.lit("reference"))
    return left.withColumn("stored", F.when(F.col("length") <= most, "embedded").otherwise("reference"))


def with_callback(df: DataFrame, function, schema: str) -> DataFrame:
    """Rows that a caller's Python function (dict of a row -> dict, or None to leave it out) makes of rows.

    Whatever the function does has no built-in form; rows go through Arrow in batches.
    """
    import pyarrow as pa

    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            made = [m for row in batch.to_pylist() if (m := function(row)) is not None]
            yield pa.RecordBatch.from_pylist([{n: m.get(n) for n in names} for m in made], schema=kinds) if made else pa.RecordBatch.from_pylist([], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def provenance(content: Column) -> Column:
    """struct(size, sha256) of a file's bytes."""
    return F.struct(F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))


def export_tables(df: DataFrame, root: str, by: str) -> None:
    """Write one folder of tab-separated tables for each value of a column; missing values as n/a."""
    df.write.partitionBy(by).csv(root, sep="\t", header=True, nullValue="n/a")


def exported(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Read back what export_tables wrote."""
    return spark.read.schema(schema).csv(root, sep="\t", header=True, nullValue="n/a")


def scans(spark: SparkSession, root: str) -> DataFrame:
    """All scans tables with their folder."""
    return tsv(spark, f"{root}/sub-*/*/*_scans.tsv").withColumn("dir", F.regexp_extract(F.input_file_name(), r"/(sub-[^/]+/[^/]+)/[^/]*$", 1))


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(original_filename, text) of text files."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.substring_index(F.input_file_name(), "/", -1).alias("original_filename"), F.col("value").alias("text"))


def not_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, length) of files that nothing was made of."""
    return files.select("path", "length").join(stored.select("path"), "path", "left_anti")


def work_units(files: DataFrame) -> DataFrame:
    """(prefix, sub, ses, datatype, dir, n_bytes): what can be read apart, with its size."""
    from siltstone.operators.catalog import placed

    at = placed(F.concat("dir", F.lit("/item")))  # names repeat the subject, folders place the file
    rows = files.select(at["prefix"].alias("prefix"), at["sub"].alias("sub"), at["ses"].alias("ses"), at["datatype"].alias("datatype"), "dir", "length")
    return rows.where("sub is not null").groupBy("prefix", "sub", "ses", "datatype", "dir").agg(F.sum("length").alias("n_bytes"))


def manifest(spark: SparkSession, path: str, path_col: str = "path", sub_col: str = "sub", ses_col: str = "ses", datatype_col: str = "datatype", name_col: str = "name", meta_col: str = "meta") -> DataFrame:
    """(sub, ses, datatype, name, path, meta map, entities map, kind) of a manifest, cells as text.

    A row without a path is attributes; leftover columns are entities; whole decimals lose their .0.
    """
    rows = spark.read.json(path, primitivesAsString=True) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, sep="\t" if path.endswith(".tsv") else ",", header=True, inferSchema=False, quote='"', escape='"')
    known = {"path": path_col, "sub": sub_col, "ses": ses_col, "datatype": datatype_col, "name": name_col, "meta": meta_col}

    def cell(name: str) -> Column:
        value = F.nullif(F.trim(F.col(f"`{name}`")), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
        return value

    rest = [c for c in rows.columns if c not in known.values()]
    whole = lambda c: F.regexp_replace(c, r"^(-?\d+)\.0+$", "$1")
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), whole(cell(c)).alias("value")) for c in rest]), lambda e: e["value"].isNotNull()) if rest else F.array().cast("array<struct<key:string,value:string>>")
    out = rows.select(*[cell(c).alias(n) for n, c in known.items()], F.map_from_entries(entries).alias("entities"))
    return out.withColumn("meta", F.from_json("meta", "map<string,string>")).withColumn("kind", F.when(F.col("path").isNull(), "attrs").otherwise("file"))


def edf_header(content: Column) -> Column:
    """struct(patient, recorded timestamp, header_bytes, n_records, record_seconds, n_channels) of the
    first 256 bytes of an EDF or BDF file; null fields where the header isn't one."""
    field = lambda a, n: F.trim(F.decode(F.substr(content, F.lit(a + 1), F.lit(n)), "ISO-8859-1"))
    return F.struct(
        field(8, 80).alias("patient"),
        timefn.header_time(field(168, 16)).alias("recorded"),
        field(184, 8).try_cast("int").alias("header_bytes"),
        field(236, 8).try_cast("bigint").alias("n_records"),
        field(244, 8).try_cast("double").alias("record_seconds"),
        field(252, 4).try_cast("int").alias("n_channels"),
    )


def wav_samples(df: DataFrame, content: str = "content") -> DataFrame:
    """(path, sfreq, n_channels, samples array<int>) of 8- and 16-bit PCM WAV files, interleaved.

    Decoding bytes has no built-in, so files go through Arrow, a few at a time.
    """
    import io
    import wave

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with wave.open(io.BytesIO(data)) as f:
                    kind = {1: np.uint8, 2: np.dtype("<i2")}[f.getsampwidth()]
                    x = np.frombuffer(f.readframes(f.getnframes()), kind).astype(np.int32) - (128 if f.getsampwidth() == 1 else 0)
                    rows.append((path, float(f.getframerate()), f.getnchannels(), x))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["path", "sfreq", "n_channels", "samples"])

    return df.select("path", content).mapInArrow(run, "path string, sfreq double, n_channels int, samples array<int>")
