"""Interleaved documents: ordered text and media references from HTML, resolved by digest.

HTML becomes a list of structs in reading order: text, or a reference to media with its caption.
References name the digest of a payload; a media table holds each payload in a stored form (here
8-bit grey PNG images, 64 samples a row) and a digest join resolves them. Positions and captions stay
beside the reference they belong to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .sentencepiece_codec import small_batches

WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])


class _Reader(HTMLParser):
    """Collects text runs and media references in reading order. A figcaption captions the references of its figure, else their alt text does.

    End tags that HTML lets authors leave out are not needed: a head ends where something stands that no head holds,
    a caption with its figure or the next caption, a figure with its section. A caption without references is text.
    """

    HIDDEN = {"script", "style", "noscript", "template"}
    OF_HEAD = HIDDEN | {"title", "meta", "link", "base"}
    MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
    ENDS_FIGURES = {"article", "section", "main", "body", "html", "aside", "td"}
    BREAKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "nav", "header", "footer", "blockquote", "pre", "body", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.head = self.title = False
        self.figures: list[tuple[list[int], list[str]]] = []  # of each open figure its references' places in items, and its captions
        self.caption: list[str] | None = None

    def parse_marked_section(self, i, report=1):
        """Like the comment that browsers take it for; the parser's own reading stops at unknown ones."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def add_text(self, text: str):
        if text := " ".join(text.split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def flush(self):
        self.add_text("".join(self.run))
        self.run.clear()

    def end_caption(self):
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figures:
                self.figures[-1][1].append(text)
            else:
                self.add_text(text)

    def end_figure(self):
        self.end_caption()
        self.flush()
        places, captions = self.figures.pop()
        text = " ".join(filter(None, captions))
        for k in places if captions else ():
            self.items[k]["caption"] = text
        if not places:
            self.add_text(text)

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif self.head and tag not in self.OF_HEAD and not self.hidden:
            self.head = False
        if tag == "body":
            self.hidden = 0
        if tag in self.HIDDEN:
            self.hidden += 1
        self.title = tag == "title" and self.head
        if tag in self.BREAKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in self.MEDIA and not self.hidden:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self.items.append({"kind": self.MEDIA[tag], "text": None, "ref": found["src"], "caption": found.get("alt")})
        elif tag in self.BREAKS and self.caption:
            self.caption.append(" ")

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag == "title":
            self.title = False
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption":
            self.end_caption()
        elif tag in self.BREAKS and self.caption is None:
            self.flush()
        if tag == "figure" and self.figures:
            self.end_figure()
        elif tag in self.ENDS_FIGURES:
            self.end_all()

    def end_all(self):
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()

    def handle_data(self, data):
        if self.head and not self.title and not self.hidden and data.strip():
            self.head = False
        if not self.hidden and not self.head:
            (self.run if self.caption is None else self.caption).append(data)


def closed(html: str) -> str:
    """html with tags and comments that never end as text: else a parser looks for their ends from each of them again."""
    comment = html.rfind("-->") + 3 if "-->" in html else 0
    html = html[:comment] + html[comment:].replace("<!--", "&lt;!--")
    tag = html.rfind(">") + 1
    return html[:tag] + html[tag:].replace("<", "&lt;")


def parse_html(html: str | None) -> list[dict] | None:
    """The items of a page in reading order, positions from 0; null stays null, broken HTML gives what can be read."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(closed(html))
    reader.close()
    reader.end_all()
    return [{"position": i} | x for i, x in enumerate(reader.items)]


#: Characters of pages whose items are Python objects at a time (a longer page is by itself).
PARSED_CHARS = 1 << 20
ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def parsed_pages(texts: pa.Array) -> pa.Array:
    """The items of each page; only few pages at a time are Python objects, however many a batch has."""
    out, some, chars = [], [], 0
    for x in texts:
        html = x.as_py()
        if some and chars + len(html or "") > PARSED_CHARS:
            out.append(pa.array(some, ITEMS))
            some, chars = [], 0
        some.append(parse_html(html))
        chars += len(html or "")
    return pa.concat_arrays([*out, pa.array(some, ITEMS)])


def interleaved(pages: DataFrame, html: str = "html", items: str = "items") -> DataFrame:
    """pages with the list of their items; a null page has a null list, an empty one an empty list; a column of that name is replaced."""
    small_batches(pages.sparkSession)

    @F.arrow_udf(T.ArrayType(ITEM))
    def parsed(texts: pa.Array) -> pa.Array:
        return parsed_pages(texts)

    return pages.withColumn(items, parsed(html))


def media_digest(ref: Column) -> Column:
    """The hex digest that a reference of the form media:sha256-<hex> names, else null."""
    found = F.regexp_extract(ref, r"^media:sha256-([0-9a-f]{64})$", 1)
    return F.when(found != "", found)


def resolve(sequences: DataFrame, media: DataFrame, key: str, items: str = "items") -> DataFrame:
    """One row for each item of each sequence, in the columns key, position, kind, text, caption, digest and media's.

    media: a row for each digest. References whose digest media doesn't hold, and text items, have nulls
    there. Null and empty sequences give no rows. A digest that very many items name only skews a join
    that Spark splits.
    """
    rows = sequences.select(key, F.explode(items).alias("item")).select(key, "item.position", "item.kind", "item.text", "item.caption", media_digest(F.col("item.ref")).alias("digest"))
    return rows.join(media, "digest", "left")


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data and zero bytes up to a positive multiple of width."""
    return data.ljust(max(width, -(-len(data) // width) * width), b"\0")


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes, width in a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without filters and interlacing; checks every chunk's crc."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("no PNG")
    at, width, height, packed = 8, 0, 0, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey without interlacing is read")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


def image_feature(payload: bytes, width: int = WIDTH) -> str:
    """Height, mean, and a 64-bit average hash: which of 8 x 8 blocks are brighter than the whole."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width).astype(np.float64)
    columns = rows.reshape(len(rows), 8, width // 8).mean(2)
    edges = np.linspace(0, len(rows), 9).astype(int)
    blocks = np.array([columns[a:b].mean(0) if b > a else columns[min(a, len(rows) - 1)] for a, b in zip(edges, edges[1:], strict=False)])
    bits = np.packbits((blocks > rows.mean()).ravel()).tobytes().hex()
    return f"{len(rows)}x{width}:{rows.mean():.3f}:{bits}"


MEDIA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def media_table(payloads: DataFrame) -> DataFrame:
    """The stored form of payloads (digest, data): digest, n_bytes (unpadded) and media, written to the shared folder.

    A null payload counts as empty. Equal payloads met by one task are stored once; others may repeat.
    """
    small_batches(payloads.sparkSession)

    def store(batches):
        seen: set[str] = set()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("data"), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    raw = data.as_py() or b""
                    for column, value in zip(out, (digest, len(raw), to_png(padded(raw))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=MEDIA.names)

    return stored(payloads.mapInArrow(store, MEDIA), "media")


DESCRIBED = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def described(media: DataFrame) -> DataFrame:
    """What the stored media hold, from their bytes as read back: one row for each digest."""
    small_batches(media.sparkSession)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def describe(batches):
        for batch in batches:
            rows = []
            for digest, n, data in zip(batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                raw = data.as_py()
                payload = from_png(raw)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), image_feature(payload)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=DESCRIBED.names)

    return media.mapInArrow(describe, DESCRIBED).dropDuplicates(["digest"])


def text_pages(docs: DataFrame) -> DataFrame:
    """For each document a page (doc_id, html) that shows the document's text as a figure, captioned with the id, between two lines of text."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    head, figure = F.concat(F.lit("<article><h1>Document "), name, F.lit("</h1>")), F.concat(F.lit('<figure><img src="media:sha256-'), digest, F.lit('" alt="document"><figcaption>'), name, F.lit("</figcaption></figure>"))
    return docs.select("doc_id", F.concat(head, figure, F.lit("<p>End of document "), name, F.lit("</p></article>")).alias("html"))


def text_payloads(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.sha2(data, 256).alias("digest"), data.alias("data"))
