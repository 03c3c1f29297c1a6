"""Media columns: interleaved document sequences with payloads held apart, by digest.

HTML becomes an ordered sequence of text and media-reference structs. Payloads are kept once per
digest as 8-bit grey images (PGM, 64 samples a row); a digest join resolves the references, and a
reference keeps its position and caption whether or not its payload is found. Texts never move in that join.

What the parser makes of HTML: a figure's caption goes to all media of the figure, before or after it,
and stands over their alternative text; a caption that is not closed ends with the figure, or where a block begins
once it has words. A `source` counts for the audio, video or picture around it that names none itself, and is no item
of its own. Nothing inside script, style, noscript or template counts; the head ends where the body or its first other
element begins, closed or not. What is open at the end of a page ends there.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes; equal texts share one
payload and so all values; a reference without payload, or with another source than a digest, keeps its place with null
payload fields; null html has no items; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, released, splittable_join, table

WIDTH = 64
SEQUENCE = "array<struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>>"
_ITEM = pa.struct([("pos", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "src", "digest", "caption")]])
#: Parts that references without a digest are dealt in.
UNNAMED = 64
FEATURES = (
    "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)
_FEATURES = pa.schema(
    [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in FEATURES.split(", "))]
)


class _Sequence(HTMLParser):
    """Collects blocks of text and media references in document order."""

    BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "article", "section", "br", "ul", "ol", "table", "body"}
    UNSEEN = {"script", "style", "noscript", "template"}
    #: What a head may hold; anything else ends it.
    IN_HEAD = {"title", "meta", "link", "base", "head", *UNSEEN}
    MEDIA = {"img": "image", "audio": "audio", "video": "video"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[tuple[int, list[str]]] = []  # first item of an open figure, and its captions
        self.players: list[tuple[str, dict | None]] = []  # open audio, video or picture, and the item that it is
        self.unseen: list[str] = []
        self.head = False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is not None:
            self.figures[-1][1].append(" ".join("".join(self.caption).split()))
            self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        first, captions = self.figures.pop()
        if text := " ".join(filter(None, captions)):
            for item in self.items[first:]:
                if item["kind"] != "text":
                    item["caption"] = text

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if self.unseen or tag in self.UNSEEN:
            if tag in self.UNSEEN:
                self.unseen.append(tag)
            return
        self.head = tag == "head" or (self.head and tag in self.IN_HEAD)
        if tag in self.MEDIA:
            self.flush()
            item = {"kind": self.MEDIA[tag], "text": None, "src": named.get("src") or None, "caption": named.get("alt") or None}
            self.items.append(item)
            if tag != "img":
                self.players.append((tag, item))
        elif tag == "picture":
            self.players.append((tag, None))
        elif tag == "source":
            if self.players and (item := self.players[-1][1]) is not None and item["src"] is None:
                item["src"] = named.get("src") or None
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append((len(self.items), []))
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in self.BLOCKS:
            if self.caption is not None and "".join(self.caption).strip():
                self.end_caption()
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
        elif tag == "head":
            self.head = False
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in ("audio", "video", "picture") and any(t == tag for t, _ in self.players):
            while self.players.pop()[0] != tag:
                pass
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.unseen and not self.head:
            (self.words if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.figures:
            self.end_figure()
        self.flush()
        return self.items


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered items of one page; null html has none."""
    parser = _Sequence()
    parser.feed(html or "")
    out = []
    for k, item in enumerate(parser.finish()):
        kind, _, digest = (item["src"] or "").partition(":")
        out.append({"pos": k, **item, "digest": digest if kind == "sha256" else None})
    return out


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sequence) of pages."""
    kind = pages.schema[key].dataType

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = pa.array([parse_sequence(x) for x in b.column(1).to_pylist()], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([b.column(0), parsed], [key, "sequence"])

    arrow_batches(pages.sparkSession)
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind.simpleString()}, sequence {SEQUENCE}")


def resolve(seqs: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """One row per media reference of (key, sequence): the item, the number of items on its page, and the columns of
    payloads(digest, ...), null where there is none. Only references move."""
    own = F.filter("sequence", lambda x: x["kind"] != "text")
    items = seqs.select(key, F.size("sequence").alias("n_items"), F.explode(own).alias("item")).select(key, "n_items", "item.*")
    # a reference without a digest meets nothing, but not in one place
    unnamed = F.concat(F.lit("none "), F.pmod(F.xxhash64(key, "pos"), F.lit(UNNAMED)))
    items = items.withColumn("__digest", F.coalesce("digest", unnamed)).drop("text")
    named = payloads.withColumnRenamed("digest", "__digest")
    return splittable_join(items, named, ["__digest"], "left").drop("__digest")


def payload(raw: bytes, width: int = WIDTH) -> bytes:
    """raw, with zero bytes up to a positive multiple of width."""
    return raw + b"\0" * (max(width, -(-len(raw) // width) * width) - len(raw))


def store(data: bytes, width: int = WIDTH) -> bytes:
    """Samples as a binary PGM image, `width` to a row."""
    return b"P5\n%d %d\n255\n" % (width, len(data) // width) + data


def load(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored image."""
    kind, dims, top, samples = media.split(b"\n", 3)
    width, height = map(int, dims.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return width, height, samples


def feature(width: int, height: int, samples: bytes) -> str:
    """Size, mean, deviation and a 16-step histogram of the samples."""
    a = np.frombuffer(samples, np.uint8)
    steps = np.bincount(a >> 4, minlength=16)
    return f"{width}x{height}:{a.mean():.6f}:{a.std():.6f}:" + ",".join(map(str, steps))


def described(text: str | None) -> tuple:
    """A row of FEATURES: what reading the stored form of a text back gives."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = store(payload(raw))
    width, height, samples = load(media)
    return (
        hashlib.sha256(raw).hexdigest(), len(raw), len(samples), hashlib.sha256(samples).hexdigest(),
        zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(width, height, samples),
    )


def describe(texts: DataFrame) -> DataFrame:
    """FEATURES of the payload of every row of texts(text)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [described(x.as_py()) for x in b.column(0)]
            cols = list(zip(*rows)) if rows else [[]] * len(_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FEATURES)], schema=_FEATURES)

    arrow_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, FEATURES)


def text_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page: (doc_id, html). Its first line stands before a figure that names its payload by
    digest, the others after it as paragraphs."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    plain = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(plain, "\n", 1)
    rest = F.replace(F.substring(plain, F.length(first) + 2, F.length(plain)), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(
        F.lit("<article><p>"), first, F.lit("</p><figure><img src='sha256:"), digest, F.lit("'><figcaption>"), caption,
        F.lit("</figcaption></figure><p>"), rest, F.lit("</p></article>"),
    )
    return docs.select("doc_id", html.alias("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    payloads = describe(docs).dropDuplicates(["digest"])
    items = resolve(sequences(text_pages(docs), "doc_id", "html"), payloads, "doc_id")
    return items.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "feature", "caption", "pos", "n_items",
    )
