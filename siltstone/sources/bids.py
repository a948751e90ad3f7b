"""A folder of subjects read as one catalogue of items, with what becomes of every file in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import catalog, joins
from siltstone.sources import files

#: The columns of a scan. Metadata is JSON text and files are a sorted list, so that versions can be compared.
ITEMS = ("sub", "path", "kind", "prefix", "ses", "datatype", "entities", "suffix", "files", "meta", "n_bytes", "problem")

# Top-level tables and texts with a meaning of their own, and endings of texts.
DESCRIPTION, PARTICIPANTS, SAMPLES = "dataset_description.json", "participants.tsv", "samples.tsv"
TEXTS = (".md", ".txt", ".rst", "")


def _row(rows: DataFrame, **given: Column) -> DataFrame:
    """Items of which only the given columns are known."""
    none = {c: F.lit(None).cast({"files": "array<string>", "n_bytes": "bigint"}.get(c, "string")).alias(c) for c in ITEMS}
    return rows.select(*[given[c].alias(c) if c in given else none[c] for c in ITEMS])


def _led(path: Column) -> Column:
    """A path as stores have it: the subject leads, also of derivatives."""
    return F.regexp_replace(path, "^(derivatives/[^/]+)/(sub-[^/]+)", "$2/$1")


def _attributes(rows: DataFrame, leave: tuple[str, ...]) -> Column:
    """The other columns of a table as JSON text, without the missing ones."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in leave]))


def sidecar_values(spark: SparkSession, sidecars: DataFrame, root: str) -> DataFrame:
    """(dir, entities map, suffix, key, value) of the top-level members of JSON sidecars.

    One read of all of them; a file that isn't a JSON object has no members.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    named = found.select(F.concat(F.lit("/"), "_metadata.file_path").alias("full"), F.from_json("value", "map<string,string>").alias("members"))
    tail = "/" + root.rstrip("/").split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    named = named.select(F.substr("full", F.instr("full", tail) + len(tail)).alias("path"), F.explode("members").alias("key", "value"))
    stem = text.split_stem(F.expr("substr(name, 1, length(name) - length(ext))"))
    placed = sidecars.select("path", "dir", stem["entities"].alias("entities"), stem["suffix"].alias("suffix"))
    return placed.join(named, "path").select("dir", "entities", "suffix", "key", "value")


def recordings(spark: SparkSession, found: DataFrame, root: str) -> DataFrame:
    """An item for each bundle of files in a subject's folders, with the metadata it inherits.

    A file without company that is itself a sidecar, a scans or a sessions table is no item.
    """
    inside = found.where(F.col("path").rlike("^(derivatives/[^/]+/)?sub-[^/]+/"))
    main = inside.where((F.col("ext") != ".json") & ~F.col("name").rlike("_(scans|sessions)\\.tsv$"))
    made = files.bundles(main)
    sizes = main.select("path", "length")
    each = made.select("dir", "entities", "suffix", "problem", F.explode(F.map_values("files")).alias("path")).join(sizes, "path")
    whole = each.groupBy("dir", "entities", "suffix", "problem").agg(F.array_sort(F.collect_list("path")).alias("files"), F.sum("length").alias("n_bytes"))
    stem = F.concat_ws("_", F.nullif("entities", F.lit("")), "suffix")
    items = whole.withColumn("path", F.concat_ws("/", _led(F.col("dir")), stem))
    parts = F.filter(F.split("entities", "_"), lambda p: p != "")
    own = F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, "-", 1), F.substr(p, F.instr(p, "-") + 1))))
    values = sidecar_values(spark, found.where("ext = '.json'"), root)
    got = joins.inherited(items.select("path", "dir", own.alias("entities"), "suffix"), values)
    meta = got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("m"), F.bool_or("conflict").alias("conflict"))
    items = items.join(meta, "path", "left")
    at = catalog.placed(F.concat("dir", F.lit("/item")))
    ends = F.transform("files", text.extension)
    kind = F.when(F.exists(ends, lambda e: e.isin(*files.SIGNALS)), "recording").when(F.exists(ends, lambda e: e.isin(".tsv", ".csv", ".tsv.gz")), "table").otherwise("file")
    problem = F.coalesce("problem", F.when(F.col("conflict"), "sidecars disagree"))
    return _row(items, sub=F.coalesce(at["sub"], F.lit("")), path=F.col("path"), kind=kind, prefix=at["prefix"], ses=at["ses"], datatype=at["datatype"], entities=F.col("entities"), suffix=F.col("suffix"), files=F.col("files"), meta=F.to_json(F.map_from_entries("m")), n_bytes=F.col("n_bytes"), problem=problem)


def scan(spark: SparkSession, root: str, subjects: list[str] | None = None, include_derivatives: bool = True, policy: str = "reference") -> DataFrame:
    """Every item of a folder of subjects (columns ITEMS): kinds recording, table, file, and attrs.

    Attributes come from the description (path ''), participants and sessions tables, phenotype tables,
    samples and top-level texts. JSON files are taken as sidecars where an item has their suffix, and as a
    table's description beside it; a file that none of these takes is a file item, by ``policy`` (see
    files.unclaimed). What belongs to no subject has the subject ''. ``subjects`` restricts what belongs to a subject. Which top-level files there are is
    known to the plan; what subjects have is not.
    """
    root = root.rstrip("/")
    found = files.listing(spark, root)
    if not include_derivatives:
        found = found.where(~F.startswith("path", F.lit("derivatives/")))
    top = [r["path"] for r in found.where("dir in ('', 'phenotype')").select("path").collect()]
    parts = [recordings(spark, found, root)]
    stem = F.expr("substr(name, 1, length(name) - length(ext))")
    notes = found.where("ext = '.json'")
    sidecars = notes.withColumn("suffix", text.split_stem(stem)["suffix"]).join(parts[0].select("suffix").distinct(), "suffix", "left_semi")
    claimed = [parts[0].select(F.explode("files").alias("path")), sidecars.select("path")]
    if DESCRIPTION in top:
        rows = spark.read.text(f"{root}/{DESCRIPTION}", wholetext=True)
        parts.append(_row(rows, sub=F.lit(""), path=F.lit(""), kind=F.lit("attrs"), meta=F.col("value")))
    if PARTICIPANTS in top:
        rows = files.tsv(spark, f"{root}/{PARTICIPANTS}")
        parts.append(_row(rows, sub=F.col("participant_id"), path=F.col("participant_id"), kind=F.lit("attrs"), meta=_attributes(rows, ("participant_id",))))
    if SAMPLES in top:
        rows = files.samples(files.tsv(spark, f"{root}/{SAMPLES}"))
        parts.append(_row(rows, sub=F.coalesce("sub", F.lit("")), path=F.concat_ws("/", "sub", F.lit("samples"), "sample_id"), kind=F.lit("attrs"), meta=F.to_json("attributes")))
    known = reduce(DataFrame.unionByName, [p.select(F.col("sub").alias("participant_id")) for p in parts[:3]]).distinct()
    for path in sorted(p for p in top if p.startswith("phenotype/") and p.endswith(".tsv")):
        rows, name = files.tsv(spark, f"{root}/{path}").join(known, "participant_id", "left_semi"), path.removeprefix("phenotype/").removesuffix(".tsv")
        parts.append(_row(rows, sub=F.col("participant_id"), path=F.concat_ws("/", "participant_id", F.lit("phenotype"), F.lit(name)), kind=F.lit("attrs"), meta=_attributes(rows, ("participant_id",))))
    tables = found.where("name like '%\\_sessions.tsv' and dir not like 'derivatives/%'")
    if not tables.isEmpty():
        rows = files.sessions(spark, root)
        parts.append(_row(rows, sub=F.col("sub"), path=F.concat_ws("/", "sub", "session_id"), kind=F.lit("attrs"), ses=F.col("session_id"), meta=_attributes(rows, ("sub", "session_id"))))
    texts = found.where((F.col("dir") == "") & F.col("ext").isin(*TEXTS))
    names = [p for p in top if "/" not in p and ("." not in p or p.lower().endswith(TEXTS[:-1]))]
    if names:
        rows = files.documents(spark, [f"{root}/{n}" for n in names])
        parts.append(_row(rows, sub=F.lit(""), path=F.col("original_filename"), kind=F.lit("attrs"), meta=F.to_json(F.struct("text", "original_filename"))))
    tabular = F.col("name").rlike("_(scans|sessions)\\.tsv$") | F.col("path").isin(DESCRIPTION, PARTICIPANTS, SAMPLES) | ((F.col("dir") == "phenotype") & (F.col("ext") == ".tsv"))
    beside = found.where(tabular & (F.col("ext") == ".tsv")).select("dir", stem.alias("stem"))
    described = notes.withColumn("stem", stem).join(beside, ["dir", "stem"], "left_semi")
    claimed += [found.where(tabular).select("path"), texts.select("path"), described.select("path")]
    left = files.unclaimed(found, reduce(DataFrame.unionByName, claimed).distinct(), policy)
    owner = F.regexp_extract("path", r"^(?:derivatives/[^/]+/)?(sub-[^/]+)/", 1)
    parts.append(_row(left, sub=owner, path=_led(F.col("path")), kind=F.lit("file"), files=F.array("path"), n_bytes=F.col("length"), meta=F.to_json(F.struct("stored"))))
    out = reduce(DataFrame.unionByName, parts)
    return out if subjects is None else out.where((F.col("sub") == "") | F.col("sub").isin(*subjects))
