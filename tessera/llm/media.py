"""Interleaved documents: ordered text and media references from HTML, payloads resolved by digest.

``parse`` turns a page into structs (position, kind, text, digest, caption); ``resolve`` joins the references with a
media table by digest, so positions and captions stay what they were whether or not a payload is known. Media are grey
8-bit images (binary PGM): ``store`` writes a payload as one and ``load`` reads it back.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, table

WIDTH = 192
_HEAD = re.compile(rb"P5\n(\d+) (\d+)\n255\n")
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_SILENT = frozenset(("script", "style", "template", "title"))
_OPEN_TITLE = re.compile(r"<title\b[^>]*>(?!.*</title)", re.I | re.S)


def pad(raw: bytes) -> bytes:
    """``raw`` and blanks up to the next positive multiple of ``WIDTH`` bytes."""
    return raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def store(payload: bytes) -> bytes:
    """A grey image of ``WIDTH`` columns; every byte is one sample."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def load(media: bytes) -> np.ndarray:
    """The samples (rows, columns) of a stored image."""
    head = _HEAD.match(media)
    if not head:
        raise ValueError("not a grey 8-bit image")
    width, rows = int(head[1]), int(head[2])
    return np.frombuffer(media, np.uint8, width * rows, head.end()).reshape(rows, width)


def feature(image: np.ndarray) -> str:
    """Size, mean, spread and mean step along the rows (thousandths), and the shares of the 8 grey levels (per mille)."""
    n = image.size
    total = int(image.sum(dtype=np.int64))
    square = int(np.einsum("ij,ij->", image, image, dtype=np.int64))
    step = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum(dtype=np.int64))
    levels = np.bincount(image.ravel() >> 5, minlength=8)
    return f"{image.shape[1]}x{image.shape[0]};mean={total * 1000 // n};var={(square * n - total * total) // (n * n)};step={step * 1000 // n};levels={'/'.join(str(int(x) * 1000 // n) for x in levels)}"


class _Page(HTMLParser):
    """Collects the items of a page. An element that holds no page text, or a caption, that is never closed ends with the
    block around it or with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent: list[tuple[str, list[str]]] = []  # open silent elements and their text
        self.figures: list[dict] = []  # open figures: their references and their caption
        self.caption: list[str] | None = None
        self.inside = 0  # blocks opened inside the open caption or silent element

    def item(self, kind: str, text: str | None, ref: str | None = None, caption: str | None = None) -> None:
        self.out.append({"position": len(self.out), "kind": kind, "text": text, "ref": ref, "caption": caption})

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.item("text", text)

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption, self.inside = " ".join("".join(self.caption).split()), None, 0
        if text and self.figures:
            figure = self.figures[-1]
            figure["caption"] = f"{figure['caption']} {text}" if figure["caption"] else text
            for k in figure["refs"]:
                self.out[k]["caption"] = figure["caption"]

    def end_silent(self) -> None:
        """A silent element that nothing closed: what it took was page text."""
        for _, text in self.silent:
            self.text += text
        self.silent, self.inside = [], 0

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        figure = self.figures.pop()
        if figure["caption"] and not figure["refs"]:
            self.item("text", figure["caption"])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and tag not in _SILENT:
            if self.silent[-1][0] != "template":
                self.end_silent()
            else:
                self.inside += tag in _BLOCKS
                return
        if tag in _SILENT:
            self.silent.append((tag, []))
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append({"refs": [], "caption": None})
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            values = dict(attrs)
            if values.get("src"):
                figure = self.figures[-1] if self.figures else {"refs": [], "caption": None}
                if self.caption is None:
                    self.flush()
                figure["refs"].append(len(self.out))
                self.item("media", None, values["src"], figure["caption"] or values.get("alt"))
        elif tag in _BLOCKS:
            if self.caption is None:
                self.flush()
            else:
                self.inside += tag not in ("br", "hr")
                self.caption.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1][0]:
                self.silent.pop()
                self.inside = 0
                return
            if tag not in _BLOCKS:
                return
            if self.inside:
                self.inside -= 1
                return
            self.end_silent()
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            if self.figures:
                self.end_figure()
        elif tag in _BLOCKS:
            if self.caption is not None:
                self.caption.append(" ")
                self.inside -= 1
                if self.inside < 0:  # the block around the caption ends
                    self.end_caption()
                    self.flush()
            else:
                self.flush()

    def handle_data(self, data: str) -> None:
        if self.silent:
            self.silent[-1][1].append(data if self.silent[-1][0] in ("title", "template") else "")
        elif self.caption is not None:
            self.caption.append(data)
        else:
            self.text.append(data)

    def finish(self) -> list[dict]:
        self.end_silent()
        self.end_caption()
        while self.figures:
            self.end_figure()
        self.flush()
        return self.out


def sequence(html: str | None) -> list[dict]:
    """The items of a page in order. Captions are those of the figure around a reference, before or behind it, else its ``alt``."""
    page = _Page()
    page.feed(_OPEN_TITLE.sub("", html or ""))
    page.close()
    return page.finish()


ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])
_ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


@F.arrow_udf(T.ArrayType(ITEM))
def parse(html: pa.Array) -> pa.Array:
    return pa.array([sequence(x) for x in html.to_pylist()], _ITEMS)


def digest_of(ref: Column) -> Column:
    """The digest of a reference ``sha256:<hex>``; null for any other."""
    return F.nullif(F.regexp_extract(ref, "^sha256:([0-9a-f]{64})$", 1), F.lit(""))


def interleave(pages: DataFrame, key: str, html: Column, media: DataFrame) -> DataFrame:
    """One row per item of each page, in ``position`` order: ``key, position, kind, text, ref, caption, digest`` and the
    columns of ``media(digest, ...)`` (one row per digest), null where the digest is unknown.

    Only the references' digests take part in the join. Null or empty pages have no item; repeated rows give repeated items.
    """
    items = pages.select(F.col(key), F.explode(parse(html)).alias("item")).select(key, "item.*")
    return items.withColumn("digest", digest_of(F.col("ref"))).join(media, "digest", "left")


MEDIA = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])
_MEDIA = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


@F.arrow_udf(T.BinaryType())
def encode(raw: pa.Array) -> pa.Array:
    """Bytes -> the stored image of the padded payload."""
    return pa.array([store(pad(x or b"")) for x in raw.to_pylist()], pa.binary())


@F.arrow_udf(MEDIA)
def describe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Stored image and the count of its unpadded bytes -> what reading it back gives."""
    for media, sizes in batches:
        out = []
        for m, n in zip(media.to_pylist(), sizes.to_pylist(), strict=True):
            image = load(m)
            payload = image.tobytes()
            out.append({
                "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": feature(image),
            })
        yield pa.array(out, _MEDIA)


def media_table(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` as stored media, one row per different text: ``digest`` (of the unpadded bytes) and what reading gives."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    stored = docs.select(F.sha2(raw, 256).alias("digest"), encode(raw).alias("media"), F.octet_length(raw).cast("long").alias("n"))
    read = stored.select("digest", describe("media", "n").alias("m"))
    return read.groupBy("digest").agg(F.first("m").alias("m")).select("digest", "m.*")


def page_items(spark, sf_dir: str) -> DataFrame:
    """The items of ``pages.html`` in order, references resolved among the texts of ``documents`` as stored media."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    media = cut(media_table(table(spark, sf_dir, "documents").select("text"))).select("digest", "media_bytes", "media_sha256")
    return interleave(pages, "page_id", F.col("html"), media)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Each document as a page: its number as heading, then a figure that refers to the document's own payload; the
    reference is resolved by digest. Null texts are empty payloads; repeated rows and null ids stay.

    The media table (digests and features) is cut first: then both sides of the join come out of a shuffle of their own,
    and adaptive execution may split the partition in which the references of many copies meet.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without number")))
    html = F.concat(F.lit("<h1>"), caption, F.lit('</h1><figure><img src="sha256:'), F.sha2(raw, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    items = interleave(docs, "doc_id", html, cut(media_table(docs)))
    return items.where("kind = 'media'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
