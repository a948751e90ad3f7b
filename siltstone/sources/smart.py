"""Any folder as a catalogue: subject, session, datatype and run inferred by rules, with what decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import catalog, reports, windows
from siltstone.sources import files


def inferred(spark: SparkSession, root: str, answers: dict[str, str] | None = None) -> DataFrame:
    """A row for each signal below a folder, copies marked with same_as.

    The subject is an answer for its path, else a sub- tag, else the first folder, else the stem before the
    first underscore. Copies of the same content keep the one with most files beside it.
    """
    found = files.listing(spark, root)
    signals = found.where(F.col("ext").isin(*files.SIGNALS))
    # Only files of one length can be copies; of the others nothing is read.
    alike = signals.groupBy("length").agg(F.count("*").alias("_n")).where("_n > 1").select("length")
    marks = files.fingerprints(spark, signals.join(alike, "length", "left_semi"), root)
    path, stem = F.col("path"), F.expr("substr(name, 1, length(name) - length(ext))")
    folder = F.nullif(F.substring_index("path", "/", 1), F.col("name"))
    subject = catalog.cascade(
        {
            "answer": text.glob_answer(path, answers or {}),
            "tag": F.coalesce(text.tagged(path, "sub"), F.nullif(F.regexp_extract("name", r"sub-([A-Za-z0-9]+)", 1), F.lit(""))),
            "folder": text.alphanumeric(folder, "x") if answers is not None else F.when(folder.isNotNull(), text.alphanumeric(folder, "x")),
            "name": text.alphanumeric(F.substring_index(stem, "_", 1), "x"),
        }
    )
    datatype = catalog.cascade(
        {
            "folder": F.get(F.filter(F.split("dir", "/"), lambda p: p.isin("eeg", "ieeg", "meg", "emg", "beh", "anat", "func")), F.lit(0)),
            "suffix": F.when(text.split_stem(stem)["suffix"].isin("eeg", "ieeg", "meg"), text.split_stem(stem)["suffix"]),
            "default": F.lit("eeg"),
        }
    )
    beside = found.groupBy("dir").agg(F.count("*").alias("beside"))
    rows = signals.select("path", "dir", "name", "ext", "length", stem.alias("stem"), subject["value"].alias("sub"), subject["rule"].alias("sub_rule"), F.coalesce(text.tagged(path, "ses"), F.lit("none")).alias("ses"), datatype["value"].alias("datatype"), datatype["rule"].alias("datatype_rule"))
    rows = rows.join(marks, "path", "left").withColumn("fingerprint", F.coalesce("fingerprint", "path")).join(beside, "dir", "left")
    rows = windows.best_copies(rows, "fingerprint", [F.desc("beside")], "path")
    return windows.numbered_runs(rows, ["sub", "ses", "datatype"], {"name": text.trailing_digits(F.col("stem"))}, ["path"]).drop("stem", "beside")


def rules_report(rows: DataFrame) -> DataFrame:
    """(what, rule, n): how often each rule decided."""
    return reports.rule_counts(rows, {c: F.col(f"{c}_rule") for c in ("sub", "datatype", "run")})
