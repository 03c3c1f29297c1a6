"""Suffix-array dedup: hash-compared suffix sort over the whole corpus.

A byte is removed if a SPAN-byte string that covers it starts anywhere else too, in the same document
or another. What decides is which SPAN-byte windows occur twice.

1. Rows. Texts are written once with a row number, which alone tells rows apart.
2. Anchors. Prefix polynomial hashes give every GRAM-byte hash in one pass. Each window is owned by
   its least GRAM-byte hash (leftmost on a tie), so equal windows have equal anchors at equal places.
   Neighbouring windows with one anchor are one run; a run is written as (anchor hash, two hashes of all
   its bytes, place), about one row per (SPAN - GRAM) / 2 bytes.
3. An anchor that occurs once can repeat nothing and goes at once. The others' runs are counted by
   (anchor, bytes) and by anchor, with partial aggregation. A run that occurs twice is repeated in whole.
   What is left are different runs around one anchor: the ends of repeated passages. Bytes are told apart here by 96 bits
   of independent hashes beside the anchor's 64, so of p pairs of different runs at one anchor p / 2**96
   are expected to be taken for equal (10**18 pairs: about 10**-11).
4. Of those, one run of each content goes to the anchor's bucket. There the suffixes that begin at
   the anchor, and the prefixes that end at it, are sorted by mergesort. Two suffixes are compared by
   binary search for their common extension on prefix hashes, so in a logarithmic number of steps;
   the extensions found between neighbours are verified byte by byte. A window is repeated if another
   run of the bucket shares at least its part before the anchor and its part after it, which the two
   orders and their common extensions tell for all runs of a bucket at once.
5. A bucket of over HOT runs is split: windows that begin far before the anchor share more bytes before
   it, the others more bytes after it. Each half is dealt by those bytes too, so it is steps 3 and 4 again
   with a longer anchor; after eight halvings an anchor is a whole window. So no bucket is unbounded and
   the sort decides them all.

Defined cases: a null text is the empty text; texts under SPAN bytes lose nothing; repeated rows are
repeats of each other and get equal results, null ids included, and each carries its own ranges alone; an
empty table gives an empty result; further columns are kept by rewrite() and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, discard, materialise, released, splittable_join, table

SPAN, GRAM = 200, 64
#: Runs of one anchor that are sorted together at most.
HOT = 1024
#: Bytes hashed at once; longer texts are cut in overlapping pieces.
CHUNK = 1 << 18
#: Bytes of runs sorted at once.
SORTED = 1 << 20
#: Bits that hold a place in what is hashed at once (CHUNK and one text's overlap): the same everywhere, so that ties are.
PLACE = CHUNK.bit_length() + 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Prefix polynomial hashes modulo 2**64 of a buffer; equal bytes hash equally anywhere."""

    _POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, seed: int = 0) -> None:
        values, up, down = self.powers(seed, len(buf) + 1)
        self.down = down
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * up[: len(buf)], dtype=np.uint64, out=self.prefix[1:])

    @classmethod
    def powers(cls, seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A random number for each byte, powers of an odd base and of its inverse."""
        have = cls._POWERS.get(seed)
        if have is None or len(have[1]) < n:
            n = 1 << (n - 1).bit_length()
            rng = np.random.default_rng(seed)
            values = rng.integers(1 << 63, dtype=np.uint64) * np.uint64(2) + rng.integers(1 << 63, size=256, dtype=np.uint64)
            base = int(rng.integers(1 << 62)) * 4 + 3
            inverse = pow(base, -1, 1 << 64)
            have = cls._POWERS[seed] = (values, cls._powers_of(base, n), cls._powers_of(inverse, n))
        return have

    @staticmethod
    def _powers_of(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[at]) * self.down[at]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours: by blocks of w, from the left and from the right."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def pieces(raws: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, first window, bytes), about CHUNK bytes each; a window lies in one piece."""
    own, total = [], 0
    for k, raw in enumerate(raws):
        for at in range(0, len(raw) - SPAN + 1, CHUNK):
            part = raw[at : at + CHUNK + SPAN - 1]
            if own and total + len(part) > CHUNK + SPAN:
                yield own
                own, total = [], 0
            own.append((k, at, part))
            total += len(part)
    if own:
        yield own


def contents(buf: np.ndarray, first: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of runs of w + 1 windows from `first`, whose anchor is d bytes on."""
    shape = (w * 1009 + d).astype(np.uint64)
    c, k = (mix(Hasher(buf, seed).of(first, first + w + SPAN) ^ shape) for seed in (0, 9))
    return c.view(np.int64), (k >> np.uint64(32)).astype(np.uint32).view(np.int32)


def runs(own: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """row, anchor hash, content hashes, first window, windows - 1, place of the anchor, of all runs."""
    buf = np.frombuffer(b"".join(p[2] for p in own), np.uint8)
    sizes = np.array([len(p[2]) for p in own])
    offsets = np.cumsum(sizes) - sizes
    hasher = Hasher(buf)
    at = np.arange(len(buf) - GRAM + 1)
    grams = mix(hasher.of(at, at + GRAM))
    bits = np.uint64(PLACE)
    least = sliding_least((grams >> bits << bits) | at.astype(np.uint64), SPAN - GRAM + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = sizes - SPAN + 1
    piece = np.repeat(np.arange(len(own)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[piece]
    anchor = anchor[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(start)]]) - 1
    first, last, place, p = start[lo], start[hi], anchor[lo], piece[lo]
    c, k = contents(buf, first, last - first, place - first)
    rows, base = np.array([x[0] for x in own]), np.array([x[1] for x in own])
    return rows[p], grams[place].view(np.int64), c, k, base[p] + first - offsets[p], last - first, place - first


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a number of the row, and the text as bytes; written once, so the numbers hold for all that follows."""
    own = docs.withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    return materialise(own.withColumn("__row", F.monotonically_increasing_id()))


ANCHORS = "__row long, h long, c long, k int, at long"
_ANCHOR_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
#: What `at` packs: first window, windows - 1, place of the anchor (both under 256).
UNPACK = {"lo": "at >> 16", "w": "int(at >> 8 & 255)", "d": "int(at & 255)"}


def anchors(docs: DataFrame) -> DataFrame:
    """The runs of all texts: anchor hash h, content hashes c and k, and `at`, which packs their place."""
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in pieces(b.column(1).to_pylist()):
                row, h, c, k, lo, w, d = runs(own)
                cols = [b.column(0).take(pa.array(row)), h, c, k, lo << 16 | w << 8 | d]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ANCHOR_TYPES)], names)

    return docs.select("__row", "text").mapInArrow(run, ANCHORS)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index within its bucket, and bucket's size, of rows that stand by bucket."""
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    begin = np.flatnonzero(first)
    size = np.diff(np.concatenate([begin, [len(bucket)]]))
    which = np.cumsum(first) - 1
    return np.arange(len(bucket)) - begin[which], size[which]


class Sorter:
    """Sorts suffixes of a buffer, by bucket, and finds common extensions of neighbours.

    at and size: the suffixes; they stand by bucket.
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray, bucket: np.ndarray, seed: int = 0) -> None:
        self.buf, self.at, self.size, self.hasher = buf, at, size, Hasher(buf, seed)
        self.order = self.merged(bucket)
        a, b = self.order[:-1], self.order[1:]
        self.common = np.concatenate([[-1], np.where(bucket[a] == bucket[b], self.extension(a, b), -1)])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, by binary search on hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        pa_, pb = self.at[a], self.at[b]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.hasher.of(pa_, pa_ + mid) == self.hasher.of(pb, pb + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(lo, mid - 1))
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        ended_a, ended_b = n >= self.size[a], n >= self.size[b]
        last = len(self.buf) - 1
        x = self.buf[np.minimum(self.at[a] + n, last)]
        y = self.buf[np.minimum(self.at[b] + n, last)]
        return np.where(ended_a | ended_b, ended_a & ~ended_b, x < y)

    def merged(self, bucket: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of all buckets at once: each row's place in a merge is its own index
        plus its rank in the other half, found by binary search."""
        order = np.arange(len(bucket))
        if not len(order):
            return order
        index, size = by_bucket(bucket)
        begin = np.arange(len(bucket)) - index
        width = 1
        while width < size.max():
            live = np.flatnonzero(size > width)
            k, n, base = index[live], size[live], begin[live]
            half = k // width
            other = half ^ 1
            lo = np.minimum(other * width, n)
            end = np.minimum(lo + width, n)
            first, stop = lo.copy(), end.copy()
            mine = order[live]
            right = half & 1 == 1
            while (open_ := lo < end).any():
                i = np.flatnonzero(open_)
                mid = (lo[i] + end[i]) // 2
                theirs = order[base[i] + mid]
                # rows of the left half go before equal ones of the right half
                before = np.where(right[i], ~self.less(mine[i], theirs), self.less(theirs, mine[i]))
                lo[i] = np.where(before, mid + 1, lo[i])
                end[i] = np.where(before, end[i], mid)
            rank = lo - first
            place = np.minimum(half, other) * width + (k - half * width) + rank
            order[base + place] = mine
            width *= 2
        return order

    def verified(self) -> bool:
        """Whether neighbours really share the bytes that their hashes say, and not the next one."""
        a, b, n = self.order[:-1], self.order[1:], np.maximum(self.common[1:], 0)
        reps = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return bool((self.buf[self.at[a][reps] + step] == self.buf[self.at[b][reps] + step]).all())

    def classes(self, depth: int) -> np.ndarray:
        """Class of each suffix among those of its bucket that share `depth` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def repeated_windows(segments: list[bytes], bucket: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each run (bytes; they stand by bucket, contents differ) which of its windows another run of
    the bucket has: rows by offset of the window's start before the anchor."""
    sizes = np.array([len(s) for s in segments])
    for seed in range(1, 9):
        text = b"".join(segments)
        buf = np.frombuffer(text, np.uint8)
        begin = np.cumsum(sizes) - sizes
        after = Sorter(buf, begin + d, sizes - d, bucket, seed)
        back = np.ascontiguousarray(buf[::-1])
        before = Sorter(back, len(buf) - (begin + d), d, bucket, seed)
        if after.verified() and before.verified():
            break
    else:
        raise RuntimeError("no seed without collisions")
    out = np.zeros((len(segments), SPAN - GRAM + 1), bool)
    for k in range(SPAN - GRAM + 1):
        own = np.flatnonzero((k <= d) & (k >= d - w))
        if len(own) < 2:
            continue
        key = after.classes(SPAN - k)[own] * (len(segments) + 1) + before.classes(k)[own]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out[own[order[twice]], k] = True
    return out


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (first, last)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


RANGE = "__row long, a long, b long"
_RANGE = pa.schema([(n, pa.int64()) for n in ("__row", "a", "b")])
SEGMENT = "h long, c long, k int, n long, m long, __row long, lo long, w int, d int, raw binary"
_SEGMENT = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("k", pa.int32()), *((n, pa.int64()) for n in ("n", "m", "__row", "lo"))]
    + [("w", pa.int32()), ("d", pa.int32()), ("raw", pa.binary())]
)
CONTENT = ["h", "c", "k"]


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted runs: one scan of the texts, moved once."""
    lists = wanted.groupBy("__row").agg(F.collect_list(F.struct(*CONTENT, "n", "m", "lo", "w", "d")).alias("runs"))
    # a document's runs: fewer than its bytes
    own = docs.select("__row", "text").join(lists, "__row")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                rows = [
                    (x["h"], x["c"], x["k"], x["n"], x["m"], i, x["lo"], x["w"], x["d"], raw[x["lo"] : x["lo"] + x["w"] + SPAN])
                    for x in found.as_py()
                ]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENT)], schema=_SEGMENT)

    return own.select("__row", "text", "runs").mapInArrow(run, SEGMENT)


def _sorted_ranges(segments: DataFrame) -> DataFrame:
    """Byte ranges [a, b) that are repeated, of runs that occur once, by sorting each anchor's bucket."""

    def flush(rows: list[dict]) -> pa.RecordBatch:
        kept = {(r["h"], r["c"], r["k"]): r for r in rows}
        rows = [kept[k] for k in sorted(kept)]
        bucket = np.array([r["h"] for r in rows], np.int64)
        w, d = np.array([r["w"] for r in rows], np.int64), np.array([r["d"] for r in rows], np.int64)
        mask = repeated_windows([r["raw"] for r in rows], bucket, w, d)
        out = []
        for r, m in zip(rows, mask):
            if r["n"] == 1 and m.any():
                at = r["lo"] + r["d"]  # the anchor's place in the text
                out += [(r["__row"], at - last, at - first + SPAN) for first, last in spans_of(m)]
        cols = list(zip(*out)) if out else [[]] * len(_RANGE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RANGE)], schema=_RANGE)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        total = 0
        for b in batches:
            for r in b.to_pylist():
                if total > SORTED and r["h"] != rows[-1]["h"]:
                    yield flush(rows)
                    rows, total = [], 0
                rows.append(r)
                total += len(r["raw"])
        if rows:
            yield flush(rows)

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(run, RANGE)


def _halves(segments: DataFrame, width: int) -> DataFrame:
    """Runs of hot anchors, each cut into windows that begin over or under the middle of `width` offsets before
    the anchor, under a new anchor: the bytes that all such windows share.

    Offsets are counted from `base`, the least that the segment's anchor allows.
    """
    half = width // 2

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            raws = b.column("raw").to_pylist()
            h, n, row, lo, w, d, base = (b.column(x).to_numpy() for x in ("h", "n", "__row", "lo", "w", "d", "base"))
            w, d, base = w.astype(np.int64), d.astype(np.int64), base.astype(np.int64)
            buf, size = np.frombuffer(b"".join(raws), np.uint8), np.array([len(x) for x in raws])
            begin, cut = np.cumsum(size) - size, base + half
            for side in (0, 1):
                # of the offsets d - w to d: those under the cut, or those from it on
                top, low = (np.minimum(d, cut - 1), d - w) if side == 0 else (d, np.maximum(d - w, cut))
                at = np.flatnonzero(top >= low)
                if not len(at):
                    continue
                least = base if side == 0 else cut
                most = cut - 1 if side == 0 else base + width - 1
                first, own_w, own_d = (begin + d - top)[at], (top - low)[at], top[at]
                place = (begin + d)[at]
                shared = Hasher(buf, 10).of(place - least[at], place - most[at] + SPAN)
                key = mix(mix(shared + np.uint64(side)) ^ h[at].view(np.uint64)).view(np.int64)
                c, k = contents(buf, first, own_w, own_d)
                own_raw = [raws[i][d[i] - top[i] : d[i] - low[i] + SPAN] for i in at]
                cols = [key, c, k, n[at] == 1, row[at], (lo + d - top)[at], own_w, own_d, least[at], own_raw]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _HALF)], schema=_HALF)

    return segments.mapInArrow(run, HALF)


HALF = "h long, c long, k int, once boolean, __row long, lo long, w int, d int, base int, raw binary"
_HALF = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("k", pa.int32()), ("once", pa.bool_()), ("__row", pa.int64()), ("lo", pa.int64())]
    + [(n, pa.int32()) for n in ("w", "d", "base")] + [("raw", pa.binary())]
)


def _hot_ranges(segments: DataFrame, hot: int) -> list[DataFrame]:
    """The same for buckets of over `hot` runs, by halving them until they are small."""
    out, own, width = [], segments.where(F.col("m") > hot).withColumn("base", F.lit(0)), SPAN - GRAM + 1
    while not own.isEmpty():
        sides = materialise(_halves(own, width))
        width -= width // 2
        counts = sides.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"))
        per_anchor = counts.groupBy("h").agg(F.count(F.lit(1)).alias("m"))
        sides = materialise(splittable_join(sides, counts.join(per_anchor, "h"), CONTENT))
        out.append(sides.where("once and n > 1").selectExpr("__row", "lo as a", f"lo + w + {SPAN} as b"))
        # one of each content; its range is only wanted if it occurs once
        one = F.min(F.struct("__row", "lo", "once")).alias("x")
        wanted = sides.where("m > 1").groupBy(*CONTENT).agg(one).select(*CONTENT, "x.__row", "x.lo")
        left = splittable_join(sides.where("m > 1"), wanted, [*CONTENT, "__row", "lo"])
        left = materialise(left.withColumn("n", F.when(F.col("once"), F.col("n")).otherwise(2).cast("long")))
        out.append(_sorted_ranges(left.where(F.col("m") <= hot).select(*_SEGMENT.names)))
        own = left.where(F.col("m") > hot)
    return out


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(__row, a, b): byte ranges to remove; they may overlap."""
    found = materialise(anchors(docs))
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("h")
    met = materialise(splittable_join(found, shared, ["h"]))
    discard(found)
    counts = met.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(counts.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h")
    rows = materialise(splittable_join(met, known, CONTENT))
    discard(met)
    whole = rows.where("n > 1").selectExpr("__row", "at >> 16 as a", f"(at >> 16) + (at >> 8 & 255) + {SPAN} as b")
    # one run of each content, of anchors with several
    first = F.min(F.struct("__row", "at")).alias("x")
    wanted = rows.where("m > 1").groupBy(*CONTENT, "n", "m").agg(first).select(*CONTENT, "n", "m", "x.*")
    wanted = wanted.selectExpr("*", *(f"{e} as {name}" for name, e in UNPACK.items())).drop("at")
    segments = materialise(_segments(docs, wanted))
    for part in (_sorted_ranges(segments.where(F.col("m") <= hot)), *_hot_ranges(segments, hot)):
        whole = whole.union(part)
    return whole


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges shrunk so that they cut no UTF-8 character."""
    out = []
    for a, b in ranges:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def kept(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in ranges:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _with_ranges(docs: DataFrame, hot: int) -> DataFrame:
    """Numbered docs with __ranges: array of (a, b), null if nothing is repeated."""
    arrow_batches(docs.sparkSession)
    docs = _numbered(docs)
    ranges = repeated_ranges(docs, hot).groupBy("__row").agg(F.collect_list(F.struct("a", "b")).alias("__ranges"))
    return docs.join(ranges, "__row", "left")


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string())]
)


def _ranges(value: pa.Scalar) -> list[tuple[int, int]]:
    return union_of([(x["a"], x["b"]) for x in value.as_py() or ()])


def digest(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans and the digest of what is kept."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = _with_ranges(own, hot).select("doc_id", "text", "__ranges")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                r = _ranges(found)
                rows.append((i, len(raw), sum(y - x for x, y in r), len(r), hashlib.sha256(kept(raw, r)).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _DIGEST)], schema=_DIGEST)

    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def rewrite(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs, all columns and rows, with repeated passages removed from the text (whole characters
    only) and n_chars, if there is one, counted anew. A null text stays null."""
    names = docs.columns
    marked = docs.withColumn("__null", F.col("text").isNull())
    own = _with_ranges(marked, hot)
    at, where = names.index("text"), len(names)
    out = own.select(*names, "__null", "__ranges")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for raw, none, found in zip(b.column(at).to_pylist(), b.column(where), b.column(where + 1)):
                text = kept(raw, whole_characters(raw, _ranges(found))).decode("utf-8", "replace")
                texts.append(None if none.as_py() else text)
                counts.append(len(text))
            cols = list(b.columns[:where])
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array(counts, cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return out.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
