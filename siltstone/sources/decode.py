"""File contents to arrays: a decoder for each ending, failures as a column instead of a stopped job."""

from __future__ import annotations

import gzip
import io
import struct
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.sources import registry

SCHEMA = "path string, kind string, dims array<string>, shape array<long>, sfreq double, values array<double>, labels array<string>, attributes map<string,string>, content binary, error string"

# Names under which a sampling rate is kept, endings of media, and the sample types of the
# volume header by their code.
RATES = ("sfreq", "fs", "srate", "sampling_rate", "sampling_frequency", "samplerate", "samplingrate", "frequency")
MEDIA = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".avi": "video/x-msvideo", ".pdf": "application/pdf"}
VOLUME_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}

Decoded = dict


def array(values: np.ndarray, dims: list[str], **more) -> Decoded:
    """A decoded array, its values in row-major order."""
    return {"kind": "array", "dims": dims, "shape": list(values.shape), "values": np.ravel(values).astype(float)} | more


def gradients(data: bytes) -> Decoded:
    """Rows of numbers between white space: b-values (one row) or b-vectors (three)."""
    rows = [line.split() for line in data.decode().splitlines() if line.strip()]
    if not rows:
        raise ValueError("no numbers")
    values = np.array(rows, float)
    return array(values[0], ["volume"]) if len(values) == 1 else array(values, ["axis", "volume"])


def volume(data: bytes) -> Decoded:
    """A single-file volume, plain or gzip: raw values; slope and intercept stay attributes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = next((o for o in "<>" if len(data) >= 348 and struct.unpack_from(o + "i", data)[0] == 348), None)
    if order is None or data[344:347] != b"n+1":
        raise ValueError("not a single-file volume")
    dims = struct.unpack_from(order + "8h", data, 40)
    shape = dims[1 : 1 + dims[0]]
    code = struct.unpack_from(order + "h", data, 70)[0]
    if code not in VOLUME_TYPES:
        raise ValueError(f"sample type {code} isn't supported")
    spacing = struct.unpack_from(order + "8f", data, 76)
    start, slope, inter = struct.unpack_from(order + "3f", data, 108)
    kind = np.dtype(VOLUME_TYPES[code]).newbyteorder(order)
    values = np.frombuffer(data, kind, int(np.prod(shape)), int(start)).reshape(shape, order="F")
    names = ["x", "y", "z", "t", "u", "v", "w"][: len(shape)]
    return array(values, names, attributes={"scl_slope": str(slope), "scl_inter": str(inter), "spacing": ",".join(f"{s:g}" for s in spacing[1 : 1 + dims[0]])})


def oriented(values: np.ndarray) -> np.ndarray:
    """Channels by samples: the short axis is the channels; one dimension is one channel."""
    return values[None, :] if values.ndim == 1 else values if values.shape[0] <= values.shape[1] else values.T


def probe(members: dict[str, np.ndarray]) -> tuple[str, float | None]:
    """The largest numeric array of one or two dimensions, and the rate kept nearest to it.

    A rate is a scalar under one of RATES; of several, the one that shares most leading path segments with
    the array's name, then the first by name.
    """
    fits = {n: a for n, a in members.items() if a.dtype.kind in "iuf" and a.ndim in (1, 2) and a.size > 1}
    if not fits:
        raise ValueError("no numeric array of one or two dimensions")
    name = min(fits, key=lambda n: (-fits[n].size, n))
    rates = [n for n, a in members.items() if n.rpartition("/")[2].lower() in RATES and a.size == 1 and a.dtype.kind in "iuf"]

    def shared(other: str) -> int:
        pairs = zip(name.split("/"), other.split("/"), strict=False)
        return next((k for k, (x, y) in enumerate(pairs) if x != y), 0)

    rate = min(rates, key=lambda n: (-shared(n), n), default=None)
    return name, None if rate is None else float(members[rate].reshape(-1)[0])


def arrays(data: bytes) -> Decoded:
    """A recording from an .npy or .npz file; objects in it are refused, never unpickled."""
    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    members = {"data": loaded} if isinstance(loaded, np.ndarray) else {n: loaded[n] for n in loaded.files}
    name, rate = probe(members)
    values = oriented(members[name])
    texts = [n for n in sorted(members) if members[n].dtype.kind == "U" and members[n].shape == (len(values),)]
    labels = members[texts[0]].tolist() if texts else [f"ch{k + 1}" for k in range(len(values))]
    return array(values, ["channel", "sample"], kind="recording", sfreq=rate, labels=labels, attributes={"array": name})


def table(data: bytes) -> Decoded:
    """A gzip table of tab-separated numbers without a header; a first row of names is tolerated."""
    rows = [line.split("\t") for line in gzip.decompress(data).decode().splitlines() if line]
    number = lambda v: float("nan") if v in ("n/a", "") else float(v)
    labels = None
    try:
        [number(v) for v in rows[0]] if rows else []
    except ValueError:
        labels, rows = rows[0], rows[1:]
    values = np.array([[number(v) for v in row] for row in rows], float).reshape(len(rows), -1)
    return array(values, ["row", "column"], kind="table", labels=labels)


def sound(data: bytes) -> Decoded:
    """8-, 16- and 32-bit PCM sound as channels by samples."""
    with wave.open(io.BytesIO(data)) as f:
        kind = {1: "u1", 2: "<i2", 4: "<i4"}[f.getsampwidth()]
        values = np.frombuffer(f.readframes(f.getnframes()), kind).reshape(-1, f.getnchannels()).T
        return array(values.astype(float) - (128 if kind == "u1" else 0), ["channel", "sample"], kind="recording", sfreq=float(f.getframerate()))


def built_in(path: str) -> Callable[[bytes], Decoded] | None:
    ends = {".bval": gradients, ".bvec": gradients, ".nii": volume, ".nii.gz": volume, ".npy": arrays, ".npz": arrays, ".tsv.gz": table, ".wav": sound}
    for end, kind in MEDIA.items():
        ends[end] = lambda data, kind=kind: {"kind": "media", "content": data, "attributes": {"media_type": kind}}
    return next((d for e, d in sorted(ends.items(), key=lambda p: -len(p[0])) if path.lower().endswith(e)), None)


def decoded(contents: DataFrame, policy: str = "reference") -> DataFrame:
    """(SCHEMA) of files (path, content): by a registered decoder, else a built-in one, else by policy.

    A file that no decoder takes is a reference without content, or embedded whole; one whose decoder fails
    has the failure's text in ``error`` and the others are read on. A null content is an error of its own.
    Decoders are Python, so files go through Arrow; every file is a batch of its own on the way out. NaN
    stands for missing numbers.
    """
    if policy not in ("reference", "embed"):
        raise ValueError("the policy is reference or embed")
    own = registry.decoders()
    fields = pa.schema([("path", pa.string()), ("kind", pa.string()), ("dims", pa.list_(pa.string())), ("shape", pa.list_(pa.int64())), ("sfreq", pa.float64()), ("values", pa.list_(pa.float64())), ("labels", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("content", pa.binary()), ("error", pa.string())])

    def one(path: str, data: bytes | None) -> Decoded:
        take = next((d for e, d in own if path.lower().endswith(e)), None) or built_in(path)
        try:
            if data is None:
                raise ValueError("no content")
            if take is not None:
                return take(data)
            return {"kind": "file", "content": data} if policy == "embed" else {"kind": "reference"}
        except Exception as error:  # whatever a decoder raises is that file's result
            return {"kind": "failed", "error": f"{type(error).__name__}: {error}"}

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                made = {"path": path.as_py()} | one(path.as_py() or "", data.as_py())
                made["attributes"] = list(made.get("attributes", {}).items())
                yield pa.RecordBatch.from_arrays([pa.array([made.get(f.name)], f.type) for f in fields], schema=fields)

    return contents.select("path", "content").mapInArrow(run, SCHEMA)
