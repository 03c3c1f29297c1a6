"""Importance resampling against a plain version, and against SQL."""

import glob
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from attesta.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, grams):
    w = WORD.findall(low(text))
    return [" ".join(w[i : i + g]) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]


def brute(rows, target, percent=10, least=20, grams=1, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, grams))
    s, t = count(x for _, x in rows), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        own = [zlib.crc32(f.encode()) % buckets for f in features(text, grams)]
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = [k for k, (_, text) in enumerate(rows) if len(WORD.findall(low(text))) >= least]
    may.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0]))
    for rank, k in enumerate(may[: percent * len(may) // 100], 1):
        out[k][4] = rank
    return [tuple(r) for r in out]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("grams,percent", [(1, 10), (2, 50), (3, 100)])
def test_edge_rows(spark, edge, edge_rows, grams, percent):
    target = ["a b c abc", None, "", "é d é d e f"]
    own = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    found = resampling.resample(edge, own, percent=percent, grams=grams)
    wanted = brute([(r[0], r[1]) for r in edge_rows], target, percent, grams=grams)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(wanted, key=key)


def test_words_of_awkward_signs(spark):
    texts = ["A\0B\x7fC", "ÀÉ İ ß ΑΒΓ", "x_y[z]`{a}|~", "1a2   漢字 😀", "\x80\x9f", "it's a-b"]
    rows = list(enumerate(texts))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    found = resampling.resample(own, own.selectExpr("doc_id as item_id", "text"), percent=50, least=0)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, texts, 50, 0))


def test_empty_tables(spark, edge, edge_rows, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, nothing).count() == 0
    wanted = brute([(r[0], r[1]) for r in edge_rows], [])
    assert sorted((tuple(r) for r in resampling.resample(edge, nothing).collect()), key=key) == sorted(wanted, key=key)


def test_sql_agrees(spark, small):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1].removesuffix('.parquet')} as select * from '{f}'")
    out = resampling.query(spark, small)
    wanted = con.execute(f"select {', '.join(out.columns)} from ({resampling.ORACLE})").fetchall()
    found = [tuple(r) for r in out.collect()]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(found, key=key) == sorted(brute(rows, texts), key=key)
