"""Identities: what two texts, documents or collections are compared by."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T


def bytes_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def text_hash(c: Column) -> Column:
    """Hash of a Markdown or text file: newlines alike, leading `---` block off."""
    return bytes_hash(T.body_of(T.newlines(c)))


def file_hash(name: Column, content: Column) -> Column:
    """text_hash of .md and .txt files, bytes_hash of others; content is binary."""
    as_text = F.make_valid_utf8(content.cast("string"))  # bytes that are no text must not be an error
    return F.when(T.suffix(name).isin(".md", ".txt"), text_hash(as_text)).otherwise(bytes_hash(content))


def self_hash(title: Column, abstract: Column, body: Column) -> Column:
    empty = F.lit("")
    parts = [F.coalesce(title, empty), F.coalesce(abstract, empty), T.strip(F.coalesce(body, empty))]
    return bytes_hash(F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")))


def git_blob(content: Column) -> Column:
    head = F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.concat(F.lit("git-blob:"), F.sha1(F.concat(head, content.cast("binary"))))


def claim_fingerprint(pairs: Column, claim_hash: Column) -> Column:
    """Identity of a staged claim: its sorted source:hash lines and its own hash; pairs: array<struct<id, hash>>."""
    lines = F.array_sort(F.transform(pairs, lambda p: F.concat(p["id"], F.lit(":"), F.coalesce(p["hash"], F.lit("")))))
    return bytes_hash(F.concat(F.array_join(lines, "\n"), F.lit("\n"), claim_hash))


def fingerprint(rows: DataFrame, key: str, value: str) -> str:
    """Hash of all `key TAB value` lines in order.

    Rows are sorted by range on the executors and streamed through one digest, a partition at a time:
    the definition is sequential, so memory is bounded and time is one pass over the hashes.
    """
    line = F.concat(F.col(key), F.lit("\t"), F.col(value))
    digest, first = hashlib.sha256(), True
    for r in rows.select(line.alias("line")).orderBy("line").toLocalIterator(prefetchPartitions=True):
        digest.update((r["line"] if first else "\n" + r["line"]).encode())
        first = False
    return "sha256:" + digest.hexdigest()
