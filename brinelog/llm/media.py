"""Media columns: HTML to ordered text and media references, payloads resolved by digest, captions kept in place."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, tidy

#: Payloads are padded to multiples of so many samples.
UNIT = 192
PAD = 32
RATE = 8000

_MEDIA = ("img", "audio", "video", "source", "embed")
_SKIP = ("script", "style", "template", "noscript")
_BREAK = ("p", "br", "div", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "figure", "figcaption", "title", "body", "head", "blockquote", "pre")


class _Reader(HTMLParser):
    """Collects (kind, text, reference, caption) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.skip = 0
        self.figures: list[tuple[list[int], list[str]]] = []  # of each open figure: its media, and its caption
        self.caption: list[str] | None = None

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.items.append(["text", said, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _BREAK:
            self.flush()
        if tag == "figure":
            self.told()
            self.figures.append(([], []))
        if tag == "figcaption" and self.figures:
            self.told()
            self.caption = []
        if tag in _MEDIA and not self.skip:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self.items.append(["media", None, found["src"], found.get("alt") or None])

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag == "figcaption" and self.caption is not None:
            self.told()
        elif tag in _BREAK:
            self.flush()
        if tag == "figure" and self.figures:
            self.told()
            self.closed()

    def told(self) -> None:
        """Ends an open caption."""
        if self.caption is not None:
            self.figures[-1][1].append("".join(self.caption))
            self.caption = None

    def closed(self) -> None:
        """Ends a figure: its caption goes to its media, those of figures within it without one too; without a caption they are left to the figure around it."""
        media, said = self.figures.pop()
        caption = " ".join(" ".join(said).split())
        for i in media if caption else []:
            self.items[i][3] = caption
        if self.figures and not caption:
            self.figures[-1][0].extend(media)

    def parse_html_declaration(self, i):
        """Comments and the document type as they are; any other "<!", well formed or not, is left out up to the next ">"."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[tuple]:
    """Ordered (position, kind, text, reference, caption) of a page. A figure's caption belongs to its media, not to the text."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption:  # never closed
        reader.text.extend(reader.caption)
    while reader.figures:
        reader.closed()
    reader.flush()
    return [(i, *item) for i, item in enumerate(reader.items)]


SEQUENCE = "array<struct<position:int,kind:string,text:string,reference:string,caption:string>>"
_SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``sequence``, the page's ordered text and media references. Null and empty html give an empty sequence."""

    @F.arrow_udf(SEQUENCE)
    def run(source: pa.Array) -> pa.Array:
        names = [f.name for f in _SEQUENCE.value_type]
        return pa.array([[dict(zip(names, item, strict=True)) for item in parse(t)] for t in source.to_pylist()], _SEQUENCE)

    return pages.withColumn("sequence", run(html))


def to_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file, without loss."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(samples), "NONE", ""))
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def describe(samples: bytes) -> str:
    """Mean, root mean square around it, crossings of it per sample, and the share of samples in eight ranges."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean()
    above = x > mean
    ranges = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"mean={mean:.3f};rms={x.std():.3f};cross={np.count_nonzero(above[1:] != above[:-1]) / len(x):.4f};ranges={','.join(map(str, ranges))}"


STORED = "digest string, n_bytes long, media binary"
FIGURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: A digest to which at least this share of all references point is resolved by a broadcast of its one row; there are 1 / HOT such digests at most.
HOT = 0.001


def _batches(rows: Iterator[tuple], ddl: str, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of about limit bytes of media at most."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*((n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))), strict=True)
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += 1000 + (len(row[-1]) if types[-1] == pa.binary() else 0)
        if size > limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def store_media(texts: DataFrame, name: str = "media") -> DataFrame:
    """A table (digest, n_bytes, media) in the shared folder of the texts (text) as WAV files; digest: SHA-256 of the text's UTF-8.

    The payload is the text with bytes PAD up to a positive multiple of UNIT. Null text counts as empty. A task writes
    a digest once, so a text that stands in several tasks' rows may be there several times; its rows are then equal. No
    payload is shuffled. An empty table gives an empty one; more columns are left out.
    """

    def build(batches):
        seen: set[bytes] = set()

        def rows():
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    raw = raw or b""
                    digest = hashlib.sha256(raw)
                    if digest.digest() not in seen:
                        seen.add(digest.digest())
                        yield digest.hexdigest(), len(raw), to_wav(raw + bytes([PAD]) * (-len(raw) % UNIT or UNIT * (not raw)))

        yield from _batches(rows(), STORED)

    made = lean(texts.select(F.col("text").cast("binary").alias("text"))).mapInArrow(tidy(build), STORED)
    return stored(made, name, compression="zstd")


def figures(media: DataFrame) -> DataFrame:
    """A row per digest of media (digest, n_bytes, media): figures and features of the payload that the stored bytes hold.

    Rows of null media are left out; of rows with one digest any counts, as they should be equal.
    """

    def read(batches):
        def rows():
            for batch in batches:
                for digest, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    back = from_wav(raw)
                    yield digest, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(back)

        yield from _batches(rows(), FIGURES)

    rows = lean(media.where("media IS NOT NULL").select("digest", "n_bytes", "media")).mapInArrow(tidy(read), FIGURES)
    return rows.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in (part.split()[0] for part in FIGURES.split(", ")[1:])])


def resolve(sequences: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """A row per item of sequences (key, sequence), in place, media items with the columns of their row of store (digest, ...).

    References are ``sha256:`` and a digest; items that the store lacks, text items and items without a reference get
    nulls, and a null or empty sequence gives one row without an item. Rows of repeated keys are resolved each. store has
    one narrow row a digest, no payloads; its columns must differ from key and the items' names. Digests that very many items
    share (see HOT) are joined by broadcast, so that no task gets them all; the others are shuffled. Items are written once.
    """
    if clash := ({c.lower() for c in store.columns} - {"digest"}) & {key.lower(), *(f.name for f in _SEQUENCE.value_type)}:
        raise ValueError(f"store has columns of the items' names: {', '.join(sorted(clash))}")
    digest = F.when(F.col("reference").startswith("sha256:"), F.substring("reference", 8, 64))
    items = stored(sequences.select(key, F.inline_outer("sequence")).withColumn("digest", digest), "items")
    total = items.select(F.count("digest")).first()[0]
    sizes = items.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    hot = [r["digest"] for r in sizes.where(F.col("n") >= max(2, HOT * total)).select("digest").collect()]
    if not hot:
        return items.join(store, "digest", "left")
    first = F.coalesce(F.col("digest").isin(hot), F.lit(False))
    store_first = store.where(F.col("digest").isin(hot))
    return items.where(first).join(F.broadcast(store_first), "digest", "left").unionByName(items.where(~first).join(store, "digest", "left"))


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """Each document as a page that shows its text as a media file between two paragraphs, with the payload resolved by digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))
    page = F.concat(F.lit("<p>Before "), name, F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), name, F.lit("</figcaption></figure><p>After "), name, F.lit("</p>"))
    told = figures(store_media(docs.select("text")))
    rows = resolve(interleave(docs.select("doc_id", page.alias("html"))), stored(told, "figures"), "doc_id").where("kind = 'media'")
    return rows.select("doc_id", "position", "caption", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
