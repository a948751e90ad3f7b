"""Media columns: documents as interleaved sequences of texts and media references.

Pages are parsed into ordered structs (position, kind, text, digest, caption). Payloads live once each in
a media store under their SHA-256; a join on the digest resolves references, and positions and captions
stay with the item they belong to.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import batches_of, bound_batches, free_name, looked_up, shared_folder, stored

UNIT = 64

#: Samples a second that a stored payload claims; any value keeps the bytes.
RATE = 8000

ITEM = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("caption", T.StringType()),
    ]
)

# Elements without visible text, elements that end a block, and elements of media.
HIDDEN = {"script", "style", "template", "title"}
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "br", "hr", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "main", "aside", "body", "figure", "blockquote", "pre", "dl", "dt", "dd", "form"}
MEDIA = {"img": "image", "audio": "audio", "video": "video", "embed": "file"}

# What may stand in a head, and what a caption can't hold; either ends them without an end tag.
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "template", "noscript"}


class Sequencer(HTMLParser):
    """Collects a page's visible text blocks and media references in their order.

    End tags may be missing: a head ends at the first element that can't be in it, hidden elements hide
    only what the parser takes as their text (script, style) or what stands before their own end, a new
    block or the body; a caption ends with its figure, at the next medium or block, or with the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden: list[str] = []
        self.head = False
        self.players: list[str] = []
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.said: str | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        """The caption so far belongs to the figure; without a medium it becomes text when the figure ends."""
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.said = " ".join(filter(None, (self.said, text))) or None
            self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        if self.figure is not None or self.said:
            for k in self.figure or []:
                self.items[k]["caption"] = self.said or self.items[k]["caption"]
            if self.said and not self.figure:
                self.flush()
                self.items.append({"kind": "text", "text": self.said, "digest": None, "caption": None})
        self.figure, self.said = None, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "head":
            self.head = True
        elif self.head and tag not in IN_HEAD:
            self.head = False
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif self.hidden and tag in BLOCKS and "template" not in self.hidden:
            self.hidden.clear()
        if tag in BLOCKS:
            self.flush()
            if self.caption is not None and tag in ("br", "p"):
                self.caption.append(" ")
            elif self.caption is not None:
                self.end_caption()
        if tag == "figure":
            self.end_figure()
            self.figure = []
        if tag == "figcaption":
            self.flush()
            self.end_caption()
            self.caption = []
        kind = MEDIA.get(tag) or (self.players[-1] if tag == "source" and self.players else "image" if tag == "source" else None)
        if kind and not self.hidden:
            self.medium(kind, dict(attrs))
        if tag in ("audio", "video"):
            self.players.append(tag)

    def medium(self, kind: str, given: dict[str, str | None]) -> None:
        # A source of a picture names its files in srcset.
        where = given.get("src") or (given.get("srcset") or "").strip().partition(" ")[0].rstrip(",")
        if not where:
            return
        self.flush()
        self.end_caption()
        digest = where.rpartition("sha256:")[2] if "sha256:" in where else hashlib.sha256(where.encode("utf-8", "surrogatepass")).hexdigest()
        self.items.append({"kind": kind, "text": None, "digest": digest, "caption": given.get("alt")})
        if self.figure is not None:
            self.figure.append(len(self.items) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.end_caption()
        if tag == "figure":
            self.end_figure()
        if tag in self.players:
            self.players.remove(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden or (self.head and not data.strip()):
            return
        (self.words if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The items of a page; a null or empty page has none. Any text is accepted, however broken its markup."""
    parser = Sequencer()
    parser.feed(html or "")
    parser.close()
    parser.end_figure()
    parser.flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def sequences(df: DataFrame, html: str = "html", name: str = "items") -> DataFrame:
    """``df`` without ``html``, with the page's items as an array of structs; null pages have none."""
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c != html]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.ArrayType(ITEM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([sequence_of(h) for h in batches_of(batch.column(len(kept)))], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], items], names=schema.names)

    return df.select(*kept, html).mapInArrow(run, schema)


def resolved(df: DataFrame, store: DataFrame, key: str, items: str = "items") -> DataFrame:
    """One row per media item: key, position, caption, digest and the store's columns (null: unresolved).

    The store has each digest once, so positions stay as they are. References (short rows) are written
    once; those to a hot digest are resolved by a broadcast, the others meet the store by digest.
    """
    # An inline of the array keeps each item's own position and caption beside its digest.
    refs = df.select(key, F.inline(items)).where("kind <> 'text'").select(key, "position", "kind", "caption", "digest")
    return looked_up(stored(refs, "references"), store, "digest")


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_media(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV."""
    head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    head += b"".join(v.to_bytes(n, "little") for v, n in ((1, 2), (1, 2), (RATE, 4), (RATE, 4), (1, 2), (8, 2)))
    return head + b"data" + len(payload).to_bytes(4, "little") + payload


def from_media(stored: bytes) -> bytes:
    """The samples of a WAV's data chunk."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(stored):
        size = int.from_bytes(stored[at + 4 : at + 8], "little")
        if stored[at : at + 4] == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature_of(payload: bytes) -> str:
    """Loudness, sign changes around the middle and entropy of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    level = samples.astype(np.float32) - 128
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    changes = int(((level[1:] < 0) != (level[:-1] < 0)).sum())
    return f"rms={np.sqrt(float((level.astype(np.float64) ** 2).mean())):.3f};changes={changes};entropy={-(share * np.log2(share)).sum():.4f}"


def write_store(df: DataFrame, text: str = "text") -> DataFrame:
    """Write the payload of every text of ``df`` as media to shared storage; returns it as stored: digest, media.

    Copies within a task's batches are written once; readers drop the rest by digest.
    """
    bound_batches(df.sparkSession)
    path = shared_folder(df.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text in batches_of(batch.column(0)):
                media = to_media(payload_of(text))
                found[hashlib.sha256(media).hexdigest()] = media
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.binary())], names=["digest", "media"])

    schema = "digest string, media binary"
    df.select(text).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def store_features(store: DataFrame) -> DataFrame:
    """Digest once each, with sizes, digests and features made from the stored bytes read back."""
    bound_batches(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = from_media(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    made = store.select("digest", "media").mapInArrow(run, FEATURES)
    # A digest has one row from here on, and its features, made from bytes, are not made again.
    return stored(made.groupBy("digest").agg(*[F.first(c).alias(c) for c in made.columns[1:]]), "features")


def as_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A page for every row: its text as a stored medium, referred to by digest, captioned with its key."""
    bound_batches(df.sparkSession)
    for name in ("n_bytes", "html"):
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, "_" + name))
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("html", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pages = [], []
            for name, text in zip(batch.column(0).to_pylist(), batches_of(batch.column(1)), strict=True):
                digest = hashlib.sha256(to_media(payload_of(text))).hexdigest()
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                name = escape(str(name))
                pages.append(f'<article><h1>{name}</h1><figure><audio src="media/sha256:{digest}"></audio><figcaption>document {name}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def document_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, position, caption, features of the stored payload) of every row of ``df``.

    Null texts are empty (64 zero bytes); equal texts have equal values; repeated rows stay. The digest join
    moves a short row for each document, never its bytes.
    """
    features = store_features(write_store(df, text))
    pages = sequences(as_pages(df, key, text)).select(F.struct(key, "n_bytes").alias("owner"), "items")
    out = resolved(pages, features, "owner")
    return out.select(F.col(f"owner.{key}").alias(key), "owner.n_bytes", "position", "caption", *features.columns[1:])
