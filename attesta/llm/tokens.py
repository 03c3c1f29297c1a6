"""Offset-mapped token counts: whole documents are encoded once, then tokens are joined to sections.

A token's span is its place in the text's UTF-8 bytes (spans follow each other without gaps, so
characters map to them one way). Sections are given as spans too; an interval join by binary search
attributes tokens to sections. Rule for a token that crosses a boundary: it counts for the section
that holds most of its bytes, the earlier one on a tie; it is counted as crossing once.

The query's sections are lines; a line break belongs to the line that it ends.

Defined cases: a null or empty text has no tokens and no sections; empty sections get no tokens;
repeated rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, released, table

_ENCODERS: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and each id's number of bytes; kept by worker."""
    if path not in _ENCODERS:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[path] = own, sizes
    return _ENCODERS[path]


def token_ends(text: str, path: str) -> np.ndarray:
    """End of each token, in bytes; it begins where the one before ends."""
    own, sizes = encoder(path)
    return np.cumsum(sizes[np.array(own.encode_ordinary(text), np.int64)])


def line_ends(raw: bytes) -> np.ndarray:
    """Ends of lines; the last line needs no break."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return breaks if not len(raw) or (len(breaks) and breaks[-1] == len(raw)) else np.append(breaks, len(raw))


def attribute(tokens: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens per section and tokens that cross a boundary, from ends of both (each covers the text)."""
    counts = np.zeros(len(sections), np.int64)
    if not len(tokens) or not len(sections):
        return counts, 0
    begins = np.concatenate([[0], tokens[:-1]])
    first = np.searchsorted(sections, begins, "right")
    last = np.searchsorted(sections, tokens - 1, "right")
    inside = first == last
    counts += np.bincount(first[inside], minlength=len(sections))
    for b, e, f, z in zip(begins[~inside], tokens[~inside], first[~inside], last[~inside]):
        edges = np.concatenate([[b], sections[f:z], [e]])
        counts[f + int(np.argmax(np.diff(edges)))] += 1  # argmax: the earliest of equals
    return counts, int((~inside).sum())


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()),
     ("section_tokens", pa.list_(pa.int32()))]
)


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing and tokens by section, in order, of docs(doc_id, text)."""
    path = path or default_tokenizer()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                ends = token_ends(text, path)
                by, crossing = attribute(ends, line_ends(text.encode("utf-8", "surrogatepass")))
                rows.append((len(ends), len(by), crossing, by))
            cols = [b.column(0), *(zip(*rows) if rows else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
