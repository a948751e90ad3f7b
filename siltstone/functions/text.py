"""Text functions on columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of entities in names, and endings that count as one extension.
ENTITY_ORDER = ("sub", "ses", "sample", "task", "tracksys", "acq", "ce", "trc", "stain", "rec", "dir", "run", "mod", "echo", "flip", "inv", "mt", "part", "proc", "hemi", "space", "split", "recording", "chunk", "seg", "res", "den", "label", "desc")
COMPOUND = ("nii.gz", "tsv.gz", "csv.gz", "tar.gz", "ome.zarr", "ome.tif", "ome.tiff", "ome.btf")


def split_stem(stem: Column) -> Column:
    """struct(entities map, suffix): parts key-value between underscores; parts without a dash are the suffix."""
    parts = F.split(stem, "_")
    pairs = F.filter(parts, lambda p: p.contains("-"))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "-", 1), F.substr(p, F.instr(p, "-") + 1)))
    suffix = F.array_join(F.filter(parts, lambda p: ~p.contains("-")), "_")
    return F.struct(F.map_from_entries(entries).alias("entities"), F.nullif(suffix, F.lit("")).alias("suffix"))


def group_name(entities: Column) -> Column:
    """key-value parts in the fixed order, unknown keys after them by name."""
    rank = F.create_map(*[x for k, name in enumerate(ENTITY_ORDER) for x in (F.lit(name), F.lit(k))])
    ranked = F.transform(F.map_entries(entities), lambda e: F.struct(F.coalesce(F.try_element_at(rank, e["key"]), F.lit(len(ENTITY_ORDER))).alias("rank"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda e: F.concat_ws("-", e["key"], e["value"])), "_")


def alphanumeric(text: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^A-Za-z0-9]", ""), F.lit("")), F.lit(fallback))


def extension(path: Column) -> Column:
    """The lower-case ending with its dot, a compound one whole; empty without a dot."""
    name = F.lower(F.substring_index(path, "/", -1))
    compound = F.regexp_extract(name, rf"(\.(?:{'|'.join(map(re.escape, COMPOUND))}))$", 1)
    return F.coalesce(F.nullif(compound, F.lit("")), F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def item_name(path: Column) -> Column:
    """The stem with other signs as _, without leading punctuation; 'data' if nothing is left."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._+-]", "_"), "^[^A-Za-z0-9]+", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("data"))


def normal_name(name: Column) -> Column:
    """Letters only, lower case, of what follows the last slash and the last at sign."""
    last = F.substring_index(F.substring_index(name, "/", -1), "@", -1)
    return F.regexp_replace(F.lower(last), "[^a-z]", "")


def safe_uri(uri: Column) -> Column:
    """A URI without user, query and fragment, its host in lower case; what isn't a URI stays."""
    scheme = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.regexp_replace(F.substr(uri, F.length(scheme) + 1), r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^.*@", ""))
    return F.when(scheme != "", F.concat(F.lower(scheme), host, F.regexp_replace(rest, r"^[^/]*", ""))).otherwise(uri)


def byte_size(n: Column, largest: str = "GB") -> Column:
    """Bytes for people: steps of 1024 up to GB or the largest unit given, one decimal above B; of null, null."""
    x = n.cast("double")

    def step(p: int, unit: str) -> Column:
        # The part below one has few enough bits for exact tenths, so only true ties go to the even one.
        y = x / float(1024**p)
        tenths = F.rint((y - F.floor(y)) * 10).cast("bigint")
        return F.concat((F.floor(y) + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))

    powers = {"KB": 1, "MB": 2, "GB": 3}
    size = F.when(x < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for unit, p in powers.items():
        if p < powers[largest]:
            size = size.when(x < 1024 ** (p + 1), step(p, unit))
    return size.when(x.isNotNull(), step(powers[largest], largest))


def shared_segments(a: Column, b: Column) -> Column:
    """How many leading path segments two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def closest(names: Column, to: Column) -> Column:
    """The name with the longest shared path; the first of several."""
    ranked = F.transform(names, lambda n, i: F.struct(shared_segments(n, to).alias("n"), (-i).alias("i"), n.alias("name")))
    return F.array_max(ranked)["name"]


def glob_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]*?])", "[$1]")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a whole-string regular expression; * and ? also match slashes."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            at = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return f"(?s)^{out}$"


def pseudonym(serial: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a serial number under a key, as lower-case hex; null for null."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), serial.cast("string").cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def glob_answer(path: Column, answers: dict[str, str]) -> Column:
    """The answer of the last pattern that matches."""
    return reduce(lambda old, kv: F.when(path.rlike(glob_regex(kv[0])), kv[1]).otherwise(old), answers.items(), F.lit(None).cast("string"))


SEGMENT = r"[A-Za-z0-9][A-Za-z0-9._+-]*"


def valid_segment(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{SEGMENT}$"), F.lit(False))


def is_segment(text: str) -> bool:
    """valid_segment of one given name."""
    return re.fullmatch(SEGMENT, text) is not None


def valid_entity(key: Column, value: Column) -> Column:
    return F.coalesce(key.rlike("^[A-Za-z][A-Za-z0-9]*$") & value.rlike("^[A-Za-z0-9]+$"), F.lit(False))


def tagged(path: Column, key: str) -> Column:
    """The value of the first folder named key-value; null without one."""
    found = F.filter(F.split(path, "/"), lambda p: F.startswith(p, F.lit(f"{key}-")))
    return F.substr(F.get(found, F.lit(0)), F.lit(len(key) + 2))


def trailing_digits(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)$", 1), F.lit(""))


def entity_path(*parts: Column) -> Column:
    """sub[/ses][/datatype][/name]: the parts that are there."""
    return F.concat_ws("/", *parts)


def channel_type(name: Column) -> Column:
    """The kind of a channel by its ending."""
    low = F.lower(name)
    return F.when(low.endswith("_stimulation"), "MISC").when(low.endswith("_flag"), "TRIG").otherwise("SEEG")


def channel_unit(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith("_stimulation"), "mA").when(low.endswith("_flag"), "n/a").otherwise("uV")


def or_na(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("n/a"))


def short_names(df: DataFrame, name: str, position: str, group: list[str], words: dict[str, str], longest: int = 16, into: str = "short") -> DataFrame:
    """Names with words abbreviated and cut to ``longest``; later equal ones of a group end in ~1, ~2, ..."""
    shortened = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), words.items(), F.col(name))
    cut = df.withColumn(into, F.substring(shortened, 1, longest))
    again = F.row_number().over(Window.partitionBy(*group, into).orderBy(position)) - 1
    ended = F.concat(F.substring(into, 1, longest - 2), F.lit("~"), again.cast("string"))
    return cut.withColumn("_again", again).withColumn(into, F.when(F.col("_again") > 0, ended).otherwise(F.col(into))).drop("_again")
