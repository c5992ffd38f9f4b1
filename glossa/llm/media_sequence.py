"""Media columns as interleaved document sequences.

A page is parsed into an ordered array of items: texts, and references to media with their captions. A reference
holds the digest of its payload (``src="sha256:..."``), and a join on the
digest resolves it in a media table; items keep position and caption whether or not their payload is found.

Payloads are stored as grey PNG images, one sample a byte and ``WIDTH`` samples a row, padded with 255.
The media table is written to the shared folder, once for each task that meets a payload (to have it once at all would send
all payloads through a shuffle), and everything that is told about a payload comes
from the stored bytes, read back and decoded; only those facts, one row a digest, go through the join.

Defined results: null text counts as empty, and an empty payload is one row of padding; null or empty html has no
items; references without a digest keep a null ``digest``; unknown digests resolve to nulls; repeated rows
repeat; equal payloads have equal facts, and a digest that most rows share is one row of the media side; an empty table gives an
empty table; extra columns play no part in ``digest`` and are kept by ``sequences`` (``items`` replaces a column of that name).
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import prepare, stash
from glossa.llm.html_text import INLINE, TOKEN

WIDTH = 576
#: Digests that a task remembers, so that it encodes these once; others are encoded again, which changes no result.
SEEN = 200_000
PAD = 255
MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
SRC = re.compile(r"""(?<![\w-])(src|alt)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
DIGEST = re.compile(r"sha256:([0-9a-f]{64})$")
WHITE = re.compile(r"\s+")
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
FACTS = "n_payload long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)


def encode_png(payload: bytes) -> bytes:
    """8-bit grey, rows of WIDTH samples without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(stored: bytes) -> np.ndarray:
    """The samples of an image that ``encode_png`` made; damaged files raise ValueError."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, shape = 8, [], None
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError("a chunk of the PNG file is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:]


def facts(stored: bytes) -> tuple[int, str, int, int, str, str]:
    """What is told about a payload, all from its stored bytes."""
    image = decode_png(stored)
    payload = image.tobytes()
    counts = np.bincount(image.ravel() >> 5, minlength=8)
    edges = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum())
    feature = f"png:{image.shape[1]}x{image.shape[0]}:mean={image.mean():.4f}:edge={edges / image.size:.4f}:hist=" + "-".join(map(str, counts.tolist()))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text, padded as ``padded`` does, by Spark's own functions."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    lack = F.when(size == 0, F.lit(WIDTH)).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), lack)))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The media table (digest, media), written to the shared folder."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, media = [], []
            for t in batch.column(0):
                own = padded((t.as_py() or "").encode("utf-8", "surrogatepass"))
                name = hashlib.sha256(own)
                if name.digest() not in seen:
                    if len(seen) < SEEN:
                        seen.add(name.digest())
                    names.append(name.hexdigest())
                    media.append(encode_png(own))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return stash(docs.select(text).mapInArrow(run, "digest string, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """One row per digest: what its stored bytes tell. Small, and written, so that a join with hot digests can be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(m.as_py()) for m in batch.column(1)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["digest", *(f.split()[0] for f in FACTS.split(", "))])

    told = media.select("digest", "media").mapInArrow(run, f"digest string, {FACTS}")
    return stash(told.groupBy("digest").agg(*(F.max(c).alias(c) for c in told.columns[1:])), "media-facts")


def items_of(page: str | None) -> list[dict]:
    """Texts and references of a page in order; a figure's caption goes with the references of that figure."""
    items: list[dict] = []
    parts: list[str] = []
    figure: list[int] | None = None
    caption: list[str] | None = None

    def close() -> None:
        text = WHITE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    at = 0
    for m in TOKEN.finditer(page or ""):
        (parts if caption is None else caption).append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in INLINE - MEDIA and tag != "br":
            continue
        if tag in MEDIA and not m[1]:
            close()
            own = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in SRC.finditer(m[3])}
            if "src" in own:
                known = DIGEST.search(own["src"])
                items.append({"kind": "media", "text": None, "digest": known[1] if known else None, "caption": entities.unescape(own["alt"]) if own.get("alt") else None})
                if figure is not None:
                    figure.append(len(items) - 1)
            continue
        if tag == "figcaption":
            if not m[1]:
                close()
                caption = []
            elif caption is not None:
                said = WHITE.sub(" ", entities.unescape("".join(caption))).strip()
                caption = None
                for i in figure or []:
                    items[i]["caption"] = said or items[i]["caption"]
            continue
        if caption is None:
            close()
        if tag == "figure":
            figure = None if m[1] else []
    parts.append((page or "")[at:])
    close()
    return [{"position": i, **x} for i, x in enumerate(items)]


def sequences(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` without the markup column and with ``items``, the ordered array of texts and references."""
    prepare(pages.sparkSession)
    kept = pages.drop("items")
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    others = [f for f in kept.schema.fields if f.name != page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([items_of(h.as_py()) for h in batch.column(page)], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), own], names=[*(f.name for f in others), "items"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return kept.mapInArrow(run, f"{fields}items array<{ITEM}>")


def resolve(found: DataFrame, media: DataFrame, kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """One row per item, in the columns of the document, the item, and ``media`` (one row per digest) joined on the digest."""
    rows = found.select(*[c for c in found.columns if c != "items"], F.explode("items").alias("item")).where(F.col("item.kind").isin(*kinds))
    return rows.select(*[c for c in rows.columns if c != "item"], "item.*").join(media, "digest", "left")


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html): each document's text as a page, a paragraph a line, whose last figure refers to the text's payload."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text.cast("binary")).cast("long")
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(payload(F.col("text")), 256), F.lit('"><figcaption>'), size.cast("string"), F.lit(" bytes</figcaption></figure>"))
    return docs.select("doc_id", size.alias("n_bytes"), F.concat(F.lit("<p>"), safe, F.lit("</p>"), figure).alias("html"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: sizes, digests and features of its stored payload, found through its reference, and where that stands: n_texts, position, caption."""
    told = describe(store(docs))
    items = sequences(text_pages(docs))
    # Texts stay behind: the join carries the references alone.
    items = items.withColumn("n_texts", F.size(F.filter("items", lambda x: x["kind"] == "text")).cast("long")).withColumn("items", F.filter("items", lambda x: x["kind"] == "media"))
    return resolve(items, told, ("media",)).select(
        "doc_id", "n_bytes", F.col("n_payload").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_texts", "position", "caption"
    )


def page_items(pages: DataFrame, media: DataFrame) -> DataFrame:
    """One row per item of each page (page_id, html): page_id, position, kind, text, digest, caption, and of ``media`` (digest, n_payload) what it resolves to."""
    return resolve(sequences(pages.select("page_id", "html")), media.select("digest", "n_payload")).select("page_id", "position", "kind", "text", "digest", "caption", "n_payload")
