"""Media columns: interleaved sequences of texts and media references.

A page becomes an ordered array of structs, each a text or a reference to media
by digest, with its position and caption.  Payloads live apart in a media table
addressed by digest; a join on the digest resolves references, and positions and
captions stay where they were.  Stored media are read back and described by
features, so a wrong byte shows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

ROW = 192
_SCHEME = "media:"
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "figure", "figcaption", "nav", "footer", "header"}
_MEDIA = {"img", "audio", "video", "source", "embed"}


class _Sequence(HTMLParser):
    """Collects ``(kind, text, source, caption)`` in document order.

    A caption belongs to the media of its open figure; it ends with its own end
    tag, the next block or medium, the figure or the page, and what follows is
    text again.  A caption outside a figure, or in one without media, is text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.caption = False

    def flush(self) -> None:
        text, captioned = " ".join("".join(self.text).split()), self.caption and self.figure
        self.text, self.caption = [], False
        if text and captioned:
            for i in self.figure:
                self.items[i]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text, "source": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = self.figure is not None
        if tag in _MEDIA and found.get("src"):
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"kind": "media", "text": None, "source": found["src"], "caption": found.get("alt")})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parse_page(html: str | None) -> list[dict]:
    """The page's sequence; null is empty.  Malformed HTML is read as far as it goes."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    out = []
    for pos, item in enumerate(parser.items):
        source = item.pop("source")
        out.append({"pos": pos, "digest": source.removeprefix(_SCHEME) if source else None, **item})
    return out


def interleave(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, sequence)`` of each page."""
    item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([parse_page(x) for x in batch.column(html).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([batch.column(key), found], [key, "sequence"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(work, f"{key} {kind}, sequence {SEQUENCE}")


def encode_samples(payload: Column) -> Column:
    """A payload of rows of 192 bytes as a grey image file (PGM), one byte a sample."""
    rows = (F.octet_length(payload) / ROW).cast("long")
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{ROW} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8"), payload)


def payload_of(text: Column) -> Column:
    """UTF-8 of a text, filled with blanks to a positive multiple of 192 bytes."""
    size = F.octet_length(text)
    pad = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW)))
    return F.encode(F.concat(text, F.repeat(F.lit(" "), pad.cast("int"))), "UTF-8")


def media_features(blob: bytes) -> dict:
    """What a stored image holds: payload size and digests, and statistics of its samples."""
    magic, size, depth, payload = blob.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(payload) != width * height:
        raise ValueError("not a stored sample file")
    x = np.frombuffer(payload, np.uint8).reshape(height, width)
    step = np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64)
    middle = x.sum(dtype=np.int64) / x.size
    spread = np.sqrt(max(0.0, np.square(x.astype(np.uint32)).sum(dtype=np.int64) / x.size - middle * middle))
    feature = f"h={height};mean={middle:.4f};std={spread:.4f};min={x.min()};max={x.max()};step={step / x.size:.4f}"
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest(), "feature": feature,
    }


_FEATURES = pa.schema([
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
_FEATURES_SQL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Features of each row of a media table ``(digest, media)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"digest": d.as_py(), **media_features(m.as_py())} for d, m in zip(batch.column("digest"), batch.column("media"))]
            yield pa.RecordBatch.from_pylist(rows, schema=_FEATURES)

    return media.select("digest", "media").mapInArrow(work, _FEATURES_SQL)


def resolve(sequences: DataFrame, key: str, features: DataFrame) -> DataFrame:
    """Each media item's ``(key, pos, caption, digest, n_texts)``, with its payload's features.

    ``n_texts`` is the number of texts in the item's sequence.

    The join is on the digest.  ``features`` may repeat a digest; rows of one
    digest are equal and reduced before they move.  An item without a payload
    keeps nulls.
    """
    texts = F.size(F.filter("sequence", lambda x: x["kind"] == "text"))
    items = sequences.select(key, texts.alias("n_texts"), F.explode("sequence").alias("item")).where(F.col("item.kind") == "media")
    items = items.select(key, "item.pos", "item.caption", "item.digest", "n_texts")
    once = features.groupBy("digest").agg(*[F.first(c).alias(c) for c in features.columns if c != "digest"])
    return items.join(once, "digest", "left")


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A page of a text's lines as paragraphs, with its media in a figure after the first."""
    lines = F.split(escaped(text), "\n", -1)
    figure = F.concat(F.lit(f'<figure><img src="{_SCHEME}'), digest, F.lit('"><figcaption>'), escaped(caption), F.lit("</figcaption></figure>"))
    rest = F.concat(F.lit("<p>"), F.array_join(F.slice(lines, 2, F.size(lines)), "</p><p>"), F.lit("</p>"))
    return F.concat(F.lit("<article><p>"), lines[0], F.lit("</p>"), figure, rest, F.lit("</article>"))


def text_media(documents: DataFrame) -> DataFrame:
    """Store each text as media, refer to it from a page of its lines, and resolve the reference again.

    Returns one row per document: ``doc_id, n_bytes, pos, caption, digest,
    n_texts`` and the features of the stored bytes as read back.  ``n_texts`` is
    the number of texts of the page, one for each line that isn't blank; the
    media stand at ``pos`` among them.  Null text is empty; empty text is one row
    of blanks.  Equal texts have one digest and equal values; each
    row gets its own, also when ids repeat or are null.  Extra columns are left.
    Very long texts are stored whole.  An empty table gives no rows.
    Media are written compressed where their text is, with no shuffle of payloads.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "media")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), payload_of(text).alias("payload"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    stored = scratch.put(rows.select("digest", encode_samples(F.col("payload")).alias("media")), "media", compression="zstd")
    caption = F.concat(F.lit("text of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")))
    pages = rows.select(F.struct("doc_id", "n_bytes").alias("row"), page_of(F.col("text"), F.col("digest"), caption).alias("html"))
    found = resolve(interleave(pages, "row"), "row", describe(stored))
    return found.select("row.doc_id", "row.n_bytes", "pos", "caption", "digest", "n_texts", *[c for c in _FEATURES.names if c != "digest"])


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_texts")
