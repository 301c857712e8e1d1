"""Media columns (operator 10): interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs; a reference names its
payload by digest; a join on the digest resolves payloads (or any columns about them), while
positions and captions stay with the sequence.  Payloads are stored losslessly as 8-bit samples in
WAV containers, the media column of a written table; what is known about them is read back from it.

Scale: of equal payloads one is stored.  Sequences and references are narrow; a join asks only for the
media columns it returns, so payload bytes move only if asked for.  A digest that a third of all rows
refer to is one row of the payload table and may be split by Spark on the side of the references.

Defined results: a null text or page is empty; texts of any length are stored whole; equal payloads
have equal rows of the payload table, of which readers take one; a reference to an unknown digest
keeps its place with a null media struct; repeated rows have a sequence each; an empty table gives no
rows; further columns are ignored, and those of a media table stay inside its struct, so no names clash.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memlake.llm.common import Scratch, documents, key_filter

BLOCK = 64
RATE = 8000
SCHEME = "digest:"
#: Elements whose text is not part of a page.
SILENT = {"script", "style", "template", "noscript"}
#: Elements that end a piece of text.
BREAKS = {"p", "div", "section", "article", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer", "nav", "aside", "main", "title"}
SOURCES = {"img", "audio", "video", "source", "embed"}

SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


class _Interleaver(HTMLParser):
    """Collects text and media references in reading order; a figure's caption goes to its references."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figures: list[list[dict]] = []
        self.captions: list[list[str]] = []

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        if tag in BREAKS or tag in SOURCES:
            self.flush()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.captions.append([])
        elif tag in SOURCES and named.get("src"):
            item = {"kind": "media", "text": None, "ref": named["src"], "caption": named.get("alt") or named.get("title")}
            self.out.append(item)
            if self.figures:
                self.figures[-1].append(item)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.captions:
            caption = "".join(self.captions.pop()).strip()
            for item in self.figures[-1] if self.figures else []:
                item["caption"] = caption or item["caption"]
        elif tag == "figure" and self.figures:
            self.figures.pop()
        if tag in BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.captions[-1] if self.captions else self.text).append(data)


def parse(page: str | None) -> list[dict]:
    """The interleaved sequence of a page."""
    p = _Interleaver()
    p.feed(page or "")
    p.close()
    p.flush()
    return [x | {"position": k} for k, x in enumerate(p.out)]


_SEQ = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, sequence) for every page."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                seqs = [parse(x) for x in b.column(1).slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 256), pa.array(seqs, _SEQ)], names=["id", "sequence"])

    return pages.select(id_col, html_col).mapInArrow(run, f"id {id_type}, sequence {SEQUENCE}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each element of each sequence, in ``position`` order, with the row of ``media`` (unique by
    ``digest``) as a struct for references it holds; other elements have null there."""
    items = sequences.select("id", F.explode("sequence").alias("e")).select("id", "e.*")
    by_digest = F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    table = media.select(F.col("digest").alias("_digest"), F.struct(*[media[c] for c in media.columns]).alias("media"))
    return items.join(table, by_digest == F.col("_digest"), "left").drop("_digest")


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8")
    size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    return data + bytes(size - len(data)), len(data)


def store(payload: bytes) -> bytes:
    """A WAV file of one channel of 8-bit samples."""
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return f.getvalue()


def read_back(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def features(samples: bytes) -> str:
    """Mean, mean square and zero crossings about the centre, in whole numbers: equal on any machine."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"n={n};mean_milli={int(x.sum()) * 1000 // n};square={int((x * x).sum()) // n};crossings={crossings}"


def _per_row(df: DataFrame, make, schema: str, names: list[str]) -> DataFrame:
    """Rows made from the values of each row, a few at a time, as payloads may be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                rows = [make(*r) for r in zip(*[c.to_pylist() for c in b.slice(a, 64).columns], strict=True)]
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}, schema=types)

    types = to_arrow_schema(T._parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def stored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, n_bytes, media): the payload of each text in its stored form, keyed by the text's digest."""

    def make(text: str | None) -> tuple:
        payload, n = padded(text)
        return digest_of(payload, n), n, store(payload)

    return _per_row(docs.select(text_col), make, "digest string, n_bytes long, media binary", ["digest", "n_bytes", "media"])


def described(table: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored bytes."""

    def make(digest: str, n: int, media: bytes) -> tuple:
        back = read_back(media)
        return digest, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(back)

    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["string", "long", "long", "string", "long", "long", "string", "string"]
    return _per_row(table.select("digest", "n_bytes", "media"), make, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), names)


def one_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that hold every text of the table, nearly all of them once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = rows.groupBy(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).agg(F.min("id").alias("id"))
    return key_filter(rows, "id", first.select("id"))


def digest_of(payload: bytes, n: int) -> str:
    """Digest of a text's bytes: payloads of texts that differ only in bytes 0 at the end stay apart."""
    return hashlib.sha256(memoryview(payload)[:n]).hexdigest()


def as_page(doc_text: Column) -> Column:
    """A page of a text: its lines as paragraphs, and after the first a figure with its payload, captioned with its size."""
    text = F.coalesce(doc_text, F.lit(""))
    data = text.cast("binary")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    figure = [F.lit('<figure><img src="' + SCHEME), F.sha2(data, 256), F.lit('"><figcaption>'), F.length(data).cast("string"), F.lit(" bytes</figcaption></figure>")]
    first, rest = F.substring_index(text, "\n", 1), F.replace(text, F.lit("\n"), F.lit("</p><p>"))
    after = F.substring(rest, F.length(first) + len("</p><p>") + 1, F.length(rest))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), *figure, F.lit("<p>"), after, F.lit("</p></article>"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also position: of the payload in its document's sequence; n_items: elements of the sequence; caption."""
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "media")
    table = scratch.keep(stored(one_each(docs, "doc_id", "text")), "media")
    known = described(table)
    known = scratch.keep(known.groupBy("digest").agg(*[F.first(c).alias(c) for c in known.columns[1:]]), "described")
    sequences = interleave(docs.select("doc_id", as_page(F.col("text")).alias("html")), "doc_id", "html")
    references = sequences.select("id", F.size("sequence").alias("n_items"), F.filter("sequence", lambda e: e["kind"] == "media").alias("sequence"))
    out = resolve(references.select(F.struct("id", "n_items").alias("id"), "sequence"), known)
    return out.select(F.col("id.id").alias("doc_id"), *[f"media.{c}" for c in known.columns[1:]], "position", F.col("id.n_items").alias("n_items"), "caption")
