"""Language ID by compression: the dictionary that makes a text smallest names its language.

Each language gets a zstandard raw-content dictionary from a bounded sample of its training texts
(about SAMPLE different ones, DICT_BYTES in all; with over MANY languages each gets its share of what MANY have):
every text of the sample gives the same number of bytes, or all it
has, in pieces spread from its beginning to its end. A text, in lower case, is compressed in blocks under every
dictionary and goes to the language with the smallest total. A margin below MIN_MARGIN marks the prediction as rejected.

Defined cases: a null text, or one without a letter, is `und` with score 0; equal sizes go to the
language first in order; with no training rows every text is `und`; repeated rows get equal results and
are learned once; of over MANY * SAMPLE languages a share is learned, by hash; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, hash_sample, materialise, released, remainder, remainder_col, table

SAMPLE, DICT_BYTES = 400, 110_000
#: Bytes of the pieces that long texts are learned by.
PIECE = 128
#: Lazy parsing that finds matches of four bytes.
PARSING = {"search_log": 4, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
#: Languages that get full dictionaries: these are broadcast, MANY * DICT_BYTES at most (28 MB).
MANY = 256
BLOCK = 4096
MIN_MARGIN = 0.01
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def level(sizes: list[int], most: int = DICT_BYTES) -> int:
    """The most bytes that each text may give so that all, a byte between them, are within `most`."""
    left = most - len(sizes)
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(0, left // (len(sizes) - k))
        left -= n
    return most


def pieces(text: str, most: int) -> bytes:
    """The text in lower case, or `most` bytes of it in pieces evenly spaced from its beginning to its end."""
    raw = text.lower().encode()
    if len(raw) <= most:
        return raw
    n = max(1, most // PIECE)
    size = (most - n + 1) // n
    starts = [k * (len(raw) - size) // max(1, n - 1) for k in range(n)]
    return b"\n".join(raw[i : i + size] for i in starts)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Raw-content dictionaries by language, at most DICT_BYTES each, the commonest language first."""
    texts = docs.select("doc_id", "lang", F.xxhash64("text").alias("__h"), "text").where("text is not null and lang is not null")
    rows = texts.select("doc_id", "lang", "__h").where(remainder_col(F.col("doc_id")) != 0).distinct()
    common = materialise(rows.groupBy("lang").count())
    most = max(MANY, common.count())
    chosen = materialise(hash_sample(rows, "lang", ["doc_id", "__h"], sample * MANY / most))
    # about MANY * SAMPLE rows at most (4 MB), however many languages; of copies under one id one is learned
    texts = texts.join(F.broadcast(chosen), ["doc_id", "lang", "__h"])
    texts = materialise(texts.dropDuplicates(["doc_id", "lang", "__h"]))
    sizes: dict[str, list[int]] = {}
    for r in texts.select("lang", F.octet_length(F.lower("text")).alias("n")).toLocalIterator():
        sizes.setdefault(r["lang"], []).append(r["n"])
    levels = {k: level(v, DICT_BYTES * MANY // most) for k, v in sizes.items()}

    @released
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [pieces(t, levels[k]) for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.binary())], ["lang", "doc_id", "part"])

    arrow_batches(docs.sparkSession)
    found = texts.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = found.mapInArrow(thin, "lang string, doc_id long, part binary").toArrow().to_pylist()
    by: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["part"])):
        by.setdefault(r["lang"], []).append(r["part"])
    often = {r["lang"]: r["count"] for r in common.where(F.col("lang").isin(list(by))).collect()}
    order = sorted(by, key=lambda k: (-often[k], k))
    return {k: b"\n".join(by[k]) for k in order}


class Classifier:
    def __init__(self, dicts: dict[str, bytes]) -> None:
        self.langs = list(dicts)
        self.packers = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # a window and tables that hold dictionary and block
            log = (len(dicts[k]) + BLOCK).bit_length()
            plan = zstandard.ZstdCompressionParameters(
                **PARSING, window_log=log, chain_log=log, hash_log=log, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            d.precompute_compress(compression_params=plan)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=plan))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin (share of the second-best size that is saved), rejected."""
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(p.compress(b)) for b in blocks) for p in self.packers]
        best, *rest = sorted(zip(sizes, range(len(sizes))))
        if not rest:
            return self.langs[best[1]], 1.0, 1.0, False
        margin = 1 - best[0] / max(1, rest[0][0])
        return self.langs[best[1]], 0.5 + 0.5 * margin, margin, margin < MIN_MARGIN


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
     ("margin", pa.float64()), ("rejected", pa.bool_())]
)


def predict(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """A row for each row of docs(doc_id, text); the dictionaries are broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dicts)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [model.predict(t.as_py()) for t in b.column(1)]
            cols = [ids, [remainder(i) == 0 for i in ids], *([f[k] for f in found] for k in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    arrow_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
