"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Benchmark items are cut into windows of WINDOW template words (shorter items: one window) and put in
a hash table; every window of every document is looked up. Hits at most an item's length apart are one
stretch of a text; the longest chain of hits in it that follow each other in both texts is an occurrence, as
are shorter ones that may agree better. One counts if it holds COVER of the item's windows and its slots agree: each value of the item stands for one value in the document and the other way round. Equal values are
a verbatim leak, others a re-parameterised question.

A capital word at the start of a sentence may be a name or not, so both are tried; windows of the words
themselves, in any case, are tried too and find copies whose names changed case (reported as verbatim).

Windows with fewer than two plain words say nothing, so they are not looked up as templates; an item that
has no others is matched by its literal words alone. The hash table is broadcast, of at most BLOCK words at a time:
a larger benchmark takes several passes over the documents, each exact.

Defined cases: null or wordless texts and items match nothing; repeated items are reported once each
under their ids, a null item id as null; repeated rows get equal results; an empty benchmark or table
leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, released, table

WINDOW, COVER = 5, 0.8
#: Words of one broadcast table's items (three windows a word, about 40 bytes each).
BLOCK = 500_000
#: Words a worker remembers before it starts anew.
MEMORY = 500_000

PLAIN, NUMBER, UNIT, CAPITAL = 0, 1, 2, 3
#: Placeholders' hashes by kind; a capital word inside a sentence is a name.
SIGNS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
BASE = np.uint64(0xD6E8FEB86659FD93)
NUMBERS = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
#: Units that are placeholders after a number.
UNITS = set(
    "% $ € £ ° cm dollar dollars euro euros feet foot ft g gram grams h hour hours inch inches kg km kmh "
    "l lb lbs liter liters litre litres m meter meters metre metres mg mile miles min minute minutes ml mm mph "
    "pound pounds s sec second seconds day days week weeks month months year years".split()
)
EDGES = "\"'.,;:!?()[]{}<>|*#&$%-_/\\…«»“”‘’¿¡"


def bare(word: str) -> str:
    return word.strip(EDGES) or word


def kind_of(word: str) -> tuple[str, int, bool]:
    """The plain word in lower case, its kind, and whether a sentence ends here."""
    own = bare(word)
    low = own.lower()
    kind = NUMBER if NUMBERS.fullmatch(own) else UNIT if low in UNITS else CAPITAL if own[0].isupper() else PLAIN
    return low, kind, word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")


class Words(dict):
    """Numbers the words a worker meets, with the hash and kind of each and whether it ends a sentence."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.kinds = array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        if word.isalpha():  # most words; they end no sentence
            low = word.lower()
            kind = UNIT if low in UNITS else CAPITAL if word[0].isupper() else PLAIN
        else:
            low, kind, end = kind_of(word)
            kind |= end << 2
        self[word] = k = len(self.kinds)
        self.hashes.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.kinds.append(kind)
        return k

    def forget(self) -> None:
        if len(self) > MEMORY:
            self.clear()
            Words.__init__(self)

    def of(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Hashes, kinds and sentence ends of the words."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        kinds = np.array(self.kinds, np.uint8)[at]
        return np.array(self.hashes, np.uint64)[at], kinds & 3, kinds > 3

    @staticmethod
    def value(word: str) -> str:
        return bare(word).lower()


def readings(words: list[str], memory: Words, starts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words' hashes and kinds as used (PLAIN where a word stands for itself), read in three ways: a capital
    word at the start of a sentence stands for itself; it is a name; every word, in any case, stands for itself.

    The words may be those of several texts, which begin at `starts`.
    """
    literal, kind, end = memory.of(words)
    after_end = np.concatenate([[True], end[:-1]])[: len(words)]
    after_number = np.concatenate([[False], kind[:-1] == NUMBER])[: len(words)]
    if starts is not None:
        after_end[starts], after_number[starts] = True, False
    names = np.where((kind == UNIT) & ~after_number, PLAIN, kind)
    inner = np.where((names == CAPITAL) & after_end, PLAIN, names)
    out = [(np.where(k == PLAIN, literal, SIGNS[k]), k) for k in (inner, names)]
    return [*out, (literal, np.zeros(len(words), kind.dtype))]


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    if len(tokens) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(tokens) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ tokens[k : len(tokens) - size + 1 + k]) * BASE
        out ^= out >> np.uint64(29)
    return out


def chains(hits: list[tuple], least: float, far: int) -> list[list[tuple]]:
    """Chains of at least `least` hits (place, place in item, size) that follow each other in both texts, at most `far` apart.

    The longest of every stretch is among them. Hits on one diagonal (place less place in item) are a chain. A hit that no hit precedes directly on
    its diagonal continues the longest chain that any diagonal holds open, which stays open for others too.
    """
    nodes: list[tuple] = []  # hit, previous node, hits so far
    last: dict[int, int] = {}  # the latest node of a diagonal
    own: dict[int, list[tuple]] = {}
    ends = set()
    for _, p, q, size in hits:
        d = p - q
        own.setdefault(d, []).append((p, q, size))
        before = last.get(d)
        if before is None or nodes[before][0][0] != p - 1:
            for k in [k for k, i in last.items() if p - nodes[i][0][0] > far]:
                del last[k]
            fits = [i for i in last.values() if nodes[i][0][0] < p and nodes[i][0][1] < q]
            # of the longest, the one whose distance in both texts is most alike
            before = max(fits, key=lambda i: (nodes[i][2], -abs(nodes[i][0][0] - nodes[i][0][1] - d)), default=None)
        ends.discard(before)
        ends.add(len(nodes))
        last[d] = len(nodes)
        nodes.append(((p, q, size), before, 1 if before is None else nodes[before][2] + 1))
    out = [c for c in [*stretches(hits, far), *own.values()] if len(c) >= least]
    for i in sorted(ends):
        if nodes[i][2] >= least:
            chain, at = [], i
            while at is not None:
                chain.append(nodes[at][0])
                at = nodes[at][1]
            out.append(chain[::-1])
    return out


def stretches(hits: list[tuple], far: int) -> Iterator[list[tuple]]:
    """The longest chain of each stretch: hits in order of place, none over `far` from the one before."""
    hits = sorted((p, q, size) for _, p, q, size in hits)
    cuts = [k for k in range(1, len(hits)) if hits[k][0] - hits[k - 1][0] > far]
    for a, b in zip([0, *cuts], [*cuts, len(hits)]):
        # least last place in the item of chains by length; equal places in the text come last first, so one is taken
        ends: list[int] = []
        at: list[int] = []
        before: dict[int, int | None] = {}
        for k in sorted(range(a, b), key=lambda k: (hits[k][0], -hits[k][1])):
            n = bisect_left(ends, hits[k][1])
            before[k] = at[n - 1] if n else None
            ends[n:], at[n:] = [hits[k][1], *ends[n + 1 :]], [k, *at[n + 1 :]]
        one, k = [], at[-1] if at else None
        while k is not None:
            one.append(hits[k])
            k = before[k]
        yield one[::-1]


class Index:
    """Hash table of a block of items' windows."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW) -> None:
        memory = Words()
        # by reading: (item id, windows, values, kinds)
        self.items: list[list[tuple]] = [[], [], []]
        rows = []  # hash, item, place, size, reading
        for item_id, text in items:
            words = (text or "").split()
            if not words:
                continue
            size = min(window, len(words))
            values = [memory.value(w) for w in words]
            for way, (tokens, kind) in enumerate(readings(words, memory)):
                h = window_hashes(tokens, size)
                plain = np.convolve(kind == PLAIN, np.ones(size, int), "valid") >= min(2, size)
                places = np.flatnonzero(plain)
                rows += [(int(h[p]), len(self.items[way]), int(p), size, way) for p in places]
                self.items[way].append((item_id, len(places), values, kind))
        self.tables = []
        for size, way in sorted({r[3:] for r in rows}):
            own = sorted(r[:3] for r in rows if r[3:] == (size, way))
            h = np.array([r[0] for r in own], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.tables.append((size, way, h, np.array([r[1] for r in own]), np.array([r[2] for r in own]), seen))

    def hits(self, way: int, tokens: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, place, place in item, size) of equal windows, in order; text: which one a word is of."""
        out = []
        for size, own_way, h, item, place, seen in self.tables:
            if own_way != way:
                continue
            own = window_hashes(tokens, size)
            maybe = np.flatnonzero(seen[own >> np.uint64(44)])
            maybe = maybe[text[maybe] == text[maybe + size - 1]]
            lo, hi = np.searchsorted(h, own[maybe], "left"), np.searchsorted(h, own[maybe], "right")
            for at, a, b in zip(maybe[lo < hi], lo[lo < hi], hi[lo < hi]):
                out += [(int(text[at]), int(item[j]), int(at), int(place[j]), size) for j in range(a, b)]
        return sorted(out)

    def occurrences(self, texts: list[str | None], memory: Words, cover: float = COVER) -> list[list[tuple]]:
        """For each text (item id, kind, first word, end) of the items it holds, the best place of each."""
        out: list[list[tuple]] = [[] for _ in texts]
        memory.forget()
        parts = [(t or "").split() for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        if not self.tables or not sizes.sum():
            return out
        words = list(chain.from_iterable(parts))
        begin = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(parts)), sizes)
        found: dict[tuple[int, int], tuple] = {}
        for way, (tokens, kind) in enumerate(readings(words, memory, begin[sizes > 0])):
            for at, own in groupby(self.hits(way, tokens, text), key=lambda h: h[:2]):
                # the first reading that finds an item says how it is held
                if at not in found and (one := self.best(self.items[way], [h[1:] for h in own], words, kind, memory, cover)):
                    found[at] = one
        for (k, _), (item_id, label, first, end) in sorted(found.items(), key=lambda f: f[0]):
            out[k].append((item_id, label, first - int(begin[k]), end - int(begin[k])))
        return out

    def best(self, items: list[tuple], hits: list[tuple], words: list[str], kind: np.ndarray, memory: Words, cover: float) -> tuple | None:
        item_id, n, values, item_kind = items[hits[0][0]]
        if len({q for _, _, q, _ in hits}) < cover * n:
            return None
        for chain in sorted(chains(hits, cover * n, len(values)), key=len, reverse=True):
            pairs = {(q + k, p + k) for p, q, size in chain for k in range(size)}
            there: dict = {}
            back: dict = {}
            agree, same = True, True
            for q, p in sorted(pairs):
                if item_kind[q] == PLAIN:
                    continue
                mine, theirs = (int(item_kind[q]), values[q]), (int(kind[p]), memory.value(words[p]))
                agree &= there.setdefault(mine, theirs) == theirs and back.setdefault(theirs, mine) == mine
                same &= mine == theirs
            if agree:
                label = "verbatim" if same else "reparameterised"
                return item_id, label, chain[0][0], chain[-1][0] + chain[-1][2]
        return None


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int | None, str]]]:
    """Items in runs of at most `size` words (a longer item: alone)."""
    own, total = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), "text").orderBy("i", "text").toLocalIterator():
        n = len((r["text"] or "").split())
        if own and total + n > size:
            yield own
            own, total = [], 0
        own.append((r["i"], r["text"]))
        total += n
    if own:
        yield own


HITS = "array<struct<item_id:bigint,kind:string,start:int,end:int>>"
_HIT = pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def mark(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK, cover: float = COVER) -> DataFrame:
    """docs with column __hits: the items each text holds, with kind and span in words."""
    spark = docs.sparkSession
    arrow_batches(spark)
    out = docs.withColumn("__hits", F.array().cast(HITS))
    at, hits = docs.columns.index("text"), len(docs.columns)
    for items in blocks(benchmark, size):
        shared = spark.sparkContext.broadcast(Index(items))

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memory = Words()
            for b in batches:
                found = shared.value.occurrences(b.column(at).to_pylist(), memory, cover)
                more = [
                    before.as_py() + [dict(zip(("item_id", "kind", "start", "end"), f)) for f in new]
                    for before, new in zip(b.column(hits), found)
                ]
                cols = [*b.columns[:hits], pa.array(more, pa.list_(_HIT))]
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per document: whether it holds an item, and which."""
    marked = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size)
    return marked.select(
        "doc_id",
        (F.size("__hits") > 0).alias("contaminated"),
        F.size("__hits").alias("n_items"),
        F.col("__hits.item_id").alias("item_ids"),
        F.col("__hits.kind").alias("kinds"),
        F.col("__hits.start").alias("starts"),
        F.col("__hits.end").alias("ends"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    return mark(docs, benchmark).where(F.size("__hits") == 0).drop("__hits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
