"""Flat tables out of nested clinical records; every absent value is written as n/a."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.nested import zipped
from siltstone.functions.numeric import soft_clamp


def or_na(df: DataFrame) -> DataFrame:
    """Every column as text, null and empty ones as n/a."""
    return df.select(*[F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("n/a")).alias(c) for c in df.columns])


def fixed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; missing ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def therapy_contacts(df: DataFrame, keep: list[str], programs: str, active: str = "active", returns: str = "returns") -> DataFrame:
    """A row for each contact of each program with its role; a program without contacts, and a record
    without programs, still have a row."""
    rows = df.select(*keep, F.posexplode_outer(programs).alias("program", "p"))
    roles = F.concat(
        F.transform(F.coalesce(f"p.{active}", F.array()), lambda c: F.struct(F.lit("Active").alias("role"), c.alias("contact"))),
        F.transform(F.coalesce(f"p.{returns}", F.array()), lambda c: F.struct(F.lit("Return").alias("role"), c.alias("contact"))),
    )
    flat = rows.withColumn("c", F.explode_outer(roles))
    return flat.select(*keep, "program", "p", F.coalesce("c.role", F.lit("n/a")).alias("role"), F.coalesce(F.col("c.contact").cast("string"), F.lit("n/a")).alias("contact"))


def settings_rows(df: DataFrame, keep: list[str], settings: str) -> DataFrame:
    """A row for each entry that isn't null."""
    return df.select(*keep, F.posexplode(settings).alias("entry", "setting")).where("setting is not null")


def samples_long(df: DataFrame, keep: list[str], time: str, data: str, names: str) -> DataFrame:
    """A row for each channel and sample of segments (time array, data channel-major, channel names)."""
    channels = df.select(*keep, F.col(time).alias("_t"), F.col(data).alias("_d"), F.posexplode(names).alias("_k", "channel"))
    rows = channels.select(*keep, "_t", "channel", F.posexplode(F.get("_d", F.col("_k"))).alias("_i", "value"))
    return rows.where(F.col("_i") < F.size("_t")).select(*keep, "channel", F.get("_t", F.col("_i")).alias("time"), "value")


def electrode_rows(df: DataFrame, keep: list[str], contacts: str, coordinates: str) -> DataFrame:
    """A row for each contact with its coordinates, n/a where there are none."""
    rows = df.select(*keep, F.posexplode(contacts).alias("i", "contact"), F.col(coordinates).alias("_xyz"))
    xyz = F.get("_xyz", F.col("i"))
    part = lambda k, n: F.coalesce(F.get(xyz, F.lit(k)).cast("string"), F.lit("n/a")).alias(n)
    return rows.select(*keep, "contact", part(0, "x"), part(1, "y"), part(2, "z"))


def impedance_rows(df: DataFrame, keep: list[str], names: str, monopolar: str, bipolar: str) -> DataFrame:
    """Monopolar readings by name, and the upper triangle of the bipolar matrix; zeros are no readings."""
    mono = df.select(*keep, F.explode(zipped(F.col(names), F.col(monopolar))).alias("m"))
    mono = mono.select(*keep, F.lit("monopolar").alias("kind"), F.col("m.a").alias("contact"), F.lit("n/a").alias("contact_2"), F.col("m.b").alias("ohm"))
    row = df.select(*keep, names, F.posexplode(bipolar).alias("i", "_row")).select(*keep, names, "i", F.posexplode("_row").alias("j", "ohm"))
    pair = row.where("j > i").select(*keep, F.lit("bipolar").alias("kind"), F.get(names, F.col("i")).alias("contact"), F.get(names, F.col("j")).alias("contact_2"), "ohm")
    return mono.unionByName(pair).where("ohm <> 0")


def event_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two event sources in one shape."""
    return first.unionByName(second, allowMissingColumns=True)


def annotation_rows(df: DataFrame, keep: list[str], start: Column, duration: Column) -> DataFrame:
    return df.select(*keep, start.alias("onset"), (start + duration).alias("end"), duration.alias("duration"))


def clamped_onsets(df: DataFrame, onset: str, low: Column, high: Column) -> DataFrame:
    return df.withColumn(onset, soft_clamp(F.col(onset), low, high))


def answers_wide(df: DataFrame, keep: list[str], questions: str, answers: str, values: list[str]) -> DataFrame:
    """A column for each of the given labels."""
    long = df.select(*keep, F.explode(zipped(F.col(questions), F.col(answers))).alias("qa")).select(*keep, F.col("qa.a").alias("q"), F.col("qa.b").alias("v"))
    return long.groupBy(*keep).pivot("q", values).agg(F.first("v"))


def live_channels(df: DataFrame, group: list[str], channel: str, dead: Column) -> DataFrame:
    """The rows of channels that have any reading that isn't ``dead``."""
    alive = df.groupBy(*group, channel).agg(F.bool_and(dead).alias("_dead")).where(~F.col("_dead")).drop("_dead")
    return df.join(alive, [*group, channel], "left_semi")


def devices_by_session(df: DataFrame, subject: str, session: str, fields: list[str]) -> DataFrame:
    """(subject, devices map session -> struct) of rows with any field filled in."""
    filled = df.where(F.greatest(*[F.length(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields], F.lit(0)) > 0)
    return filled.groupBy(subject).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(session), F.struct(*fields))))).alias("devices"))
