"""Near copies by exact Jaccard similarity over sets of five-word shingles: all pairs, none estimated.

Texts whose sets share LEAST of their union are linked; documents reach each other through links and
one row of each group stays. Candidates come from two sides, and all are compared exactly:

1. SimHash: fingerprints over the sets' hashes, linked within two bits by the generalised pigeonhole
   principle. No radius of a 64-bit SimHash finds all pairs at 0.8 (their distance is a spread of about
   10 bits, not a bound), so this finds most links cheaply but not all.
2. Prefixes find the rest: in one order of all shingles, similar sets share a shingle among the first
   n - ceil(0.8 n) + 1 of each. Any order will do; rare shingles come first (by a count in BUCKETS), so
   that common passages aren't looked at. What two sets share from their first common shingle on is no
   more than what is left of either there, so pairs that cannot reach LEAST by that are never made.

Each set is first compared with one that shares a shingle, then with the others (HEADS of them where more
than PAIRS share it) that are not in its component yet; links between components count once, so they are as
many as the sets, not as the pairs of a large group. Where more than PAIRS sets share a shingle, sets outside the
commonest component there are compared with further heads, in ROUNDS or until a round finds nothing; after that
only sets of different components and of sizes within a factor of LEAST are compared there, so large groups of
near copies need no pairs and no link between components is missed; parities of the sets rule out most
of these first, and never a pair of near copies. Heads are sets that hold few shingles rarer than the shared one: a
group's plainest texts, that most of its others are near to; the later ones are dealt more and more by a hash.

Defined cases: texts without words are copies of each other; one to four words are one shingle; rows
without an id take part like any other; a group keeps its least doc_id (a null id last), of several
rows with that id the least text hash; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import simhash
from attesta.llm.common import arrow_batches, connected_components, materialise, released, splittable_join
from attesta.llm.decontaminate import window_hashes

SHINGLE = 5
#: Similarity from which texts are near copies, as a fraction: 0.8.
LEAST = (4, 5)
#: Sets sharing a shingle up to which all pairs are made.
PAIRS = 16
#: Sets that all others are first compared with where more share a shingle.
HEADS = 8
#: Rounds of further heads for sets that are not in the commonest component.
ROUNDS = 3
#: Counters that order shingles, and the parts they travel in.
BUCKETS, PARTS = 1 << 18, 16
#: Groups that a part's counters are summed in first.
TURNS = 32
#: Bits of a set's parity.
SKETCH = 1024
#: Base of the size classes; a little over 1 / LEAST, so that similar sets are in one class or neighbours.
CLASS = 1.26
#: Words a worker remembers before it starts anew.
MEMORY = 300_000


class Words(dict):
    """Hashes of the words a worker meets."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, memory: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of SHINGLE words, A-Z lower-cased; fewer words: all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(memory) > MEMORY:
        memory.clear()
    tokens = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    return np.unique(window_hashes(tokens, min(SHINGLE, len(words)))) if words else tokens


def class_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def bucket(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def prefix(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which every similar set has among its own first; rare ones first."""
    n = len(own)
    return own[np.lexsort((own, counts[bucket(own)]))][: n - -(-n * LEAST[0] // LEAST[1]) + 1] if n else own


def parity(own: np.ndarray) -> np.ndarray:
    """SKETCH bits: a bit is 1 if an odd number of shingles falls on it, so two sets differ in no more bits than shingles."""
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def vote(own: np.ndarray) -> int:
    """SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(own), 1 << 16):
        some = np.ascontiguousarray(own[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view(np.int64)[0])


def apart(x: str, y: str, n: Column, m: Column) -> Column:
    """Whether two parities differ in more bits than shingles that similar sets of n and m can differ in."""
    bits = sum(F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(SKETCH // 64))
    return bits * sum(LEAST) > (n + m) * (LEAST[1] - LEAST[0])


def reach(common: Column, n: Column, m: Column) -> Column:
    """Whether `common` shared shingles make sets of n and m similar: common / (n + m - common) >= LEAST."""
    return common * sum(LEAST) >= (n + m) * LEAST[0]


def marks(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, h, c, fp, odd) of every row: hash of its text, class, SimHash and parity of its shingle set; and the
    counts of shingles."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, counts = Words(), np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "h", "c", "fp", "odd", "part", "counts"]
        for b in batches:
            sets = [shingle_set(t.as_py(), memory) for t in b.column(2)]
            if sets:
                counts += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS)
            c, no = pa.array([class_of(s) for s in sets], pa.int64()), len(sets)
            fp = pa.array([vote(s) for s in sets], pa.int64())
            odd = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), c, fp, odd, pa.nulls(no, pa.int32()), pa.nulls(no, pa.binary())], names)
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(np.split(counts, PARTS)) if p.any()]  # a task's are mostly zero
        no = [pa.nulls(len(parts), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*no, pa.nulls(len(parts), pa.list_(pa.int64())), pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BUCKETS // PARTS, np.int64)
        for x in pdf["counts"]:
            out += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"part": pdf["part"][:1], "counts": [zlib.compress(out.tobytes(), 1)]})

    arrow_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    found = materialise(own.mapInArrow(run, "doc_id long, h long, c long, fp long, odd array<bigint>, part int, counts binary"))
    counts = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    # in two steps, so that no group takes the counters of all tasks
    some = found.where("part is not null").withColumn("turn", F.pmod(F.xxhash64("counts"), F.lit(TURNS)))
    some = some.groupBy("part", "turn").applyInPandas(total, "part int, counts binary").groupBy("part").applyInPandas(total, "part int, counts binary")
    for r in some.collect():
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return found.where("part is null").select("doc_id", "h", "c", "fp", "odd"), counts.ravel()


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, c, n, at): the prefix of every text's set, with the set's class and size and the place of the key.

    A task writes a class once, however many copies it meets."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = Words(), set()
        for b in batches:
            sets = unseen([shingle_set(t.as_py(), memory) for t in b.column(0)], seen)
            firsts = [prefix(s, shared.value) for s in sets]
            size = [len(f) for f in firsts]
            if not sum(size):
                continue
            c, n = np.array([class_of(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int32)
            cols = [np.concatenate(firsts).view(np.int64), np.repeat(c, size), np.repeat(n, size), np.concatenate([np.arange(k, dtype=np.int32) for k in size])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "c", "n", "at"])

    return docs.select("text").mapInArrow(run, "key long, c long, n int, at int")


def unseen(sets: list[np.ndarray], seen: set[int]) -> list[np.ndarray]:
    """The sets whose classes are new to the task; they are noted."""
    out = []
    for own in sets:
        if (c := class_of(own)) not in seen:
            seen.add(c)
            out.append(own)
    return out


def sets_of(docs: DataFrame, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, own) of the classes in wanted(c): their shingle sets."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = Words(), set()
        for b in batches:
            sets = unseen([shingle_set(t.as_py(), memory) for t in b.column(0)], seen)
            own = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), own], ["c", "own"])

    one = marked.groupBy("c").agg(F.min("h").alias("h")).join(wanted, "c").select(F.col("h").alias("__h")).distinct()
    rows = docs.select("text").join(one, text_hash() == F.col("__h"), "left_semi").select("text")
    return rows.mapInArrow(run, "c long, own array<bigint>").groupBy("c").agg(F.first("own").alias("own"))


def similar(pairs: DataFrame, docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of pairs(a, b) of classes whose sets are near copies."""
    pairs = materialise(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    sets = materialise(sets_of(docs, marked, wanted))
    both = splittable_join(pairs, sets.select(F.col("c").alias("a"), F.col("own").alias("x")), ["a"])
    both = splittable_join(both, sets.select(F.col("c").alias("b"), F.col("own").alias("y")), ["b"])
    return materialise(both.where(reach(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"))


def able(x: str, y: str) -> Column:
    """Whether sets x and y (structs c, n, at) whose first common shingle has these places can be near copies."""
    f = lambda s, k: F.col(f"{s}.{k}")
    most = F.least(f(x, "n") - f(x, "at"), f(y, "n") - f(y, "at"))
    return (f(x, "c") != f(y, "c")) & reach(most, f(x, "n"), f(y, "n"))


def heads_of(turn: int, value: str = "x") -> list[Column]:
    """HEADS values of sets x of a group: of few rarer shingles, in classes of doubling width, chosen there by a hash."""
    order = lambda k: F.struct(F.shiftright("x.at", k), F.xxhash64("x.c", F.lit(turn * HEADS + k)))
    return [F.min_by(value, order(k)) for k in range(HEADS)]


def ends(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.c", f"{y}.c").alias("a"), F.greatest(f"{x}.c", f"{y}.c").alias("b")]


def by_fingerprint(marked: DataFrame) -> DataFrame:
    """(a, b) of classes with equal or close fingerprints, as far as components need: candidates of operator 4's method."""
    own = materialise(marked.groupBy("fp").agg(F.min("c").alias("least")))
    close = simhash.links(own.select("fp"), *simhash.plan(*simhash.bit_statistics(own)))
    least = lambda of, name: own.select(F.col("fp").alias(of), F.col("least").alias(name))
    near = splittable_join(splittable_join(close, least("a", "x"), ["a"]), least("b", "y"), ["b"])
    equal = splittable_join(marked.select("fp", "c").distinct(), own, ["fp"]).where("c <> least")
    pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.union(equal.select(F.col("least").alias("a"), F.col("c").alias("b")))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")


def labelled(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """pairs(a, b) with the components x and y of their ends; a class that label lacks is its own."""
    for end, of in (("a", "x"), ("b", "y")):
        own = label.select(F.col("node").alias(end), F.col("component").alias(of))
        pairs = splittable_join(pairs, own, [end], "left").withColumn(of, F.coalesce(of, end))
    return pairs


def merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """label(node, component) when found(a, b) is linked too: of all links between two components one counts."""
    upper = materialise(connected_components(labelled(found, label).select("x", "y"), "x", "y"))
    of = upper.select(F.col("node").alias("component"), F.col("component").alias("upper"))
    rows = splittable_join(label, of, ["component"], "left").select("node", F.coalesce("upper", "component").alias("component"))
    return materialise(rows.union(upper.join(label, "node", "left_anti")))


def groups(docs: DataFrame, marked: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, component) of all classes that are near copies of another."""
    rows = prefixes(docs, counts)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    shared = shared.where("lo < hi").select("key", "rows")
    met = splittable_join(rows, shared, ["key"]).select("key", "rows", F.struct("c", "n", "at").alias("x"))
    met = materialise(met.distinct())
    heads = heads_of(0)
    few = met.where(f"rows <= {PAIRS}").groupBy("key").agg(F.collect_list("x").alias("all"), heads[0].alias("head"))
    # at most PAIRS sets in an array
    pairs = few.select(F.explode("all").alias("x"), "all", "head").select("x", F.explode("all").alias("y"), "head").where("x.c < y.c")
    hot = met.where(f"rows > {PAIRS}")
    heads = hot.groupBy("key").agg(F.array_distinct(F.array(*heads)).alias("heads"))
    heads = heads.select("key", F.explode("heads").alias("y"), F.col("heads")[0].alias("head"))
    stars = splittable_join(hot, heads, ["key"]).where(able("x", "y")).select("x", "y", "head")
    first = F.col("head.c").isin(F.col("x.c"), F.col("y.c"))
    pairs = pairs.where(able("x", "y")).union(stars).select(*ends("x", "y"), first.alias("first"))
    pairs = materialise(pairs.groupBy("a", "b").agg(F.max("first").alias("first")))
    # each set with one of those it shares a shingle with; then what that has not put together
    found = similar(by_fingerprint(marked).union(pairs.where("first").select("a", "b")), docs, marked)
    label = connected_components(found)
    found = similar(labelled(pairs.where("not first").select("a", "b"), label).where("x <> y").select("a", "b"), docs, marked)
    label = merged(label, found)
    # hot shingles: what is not in the commonest component there, against further heads, then against all of other components
    for turn in range(1, ROUNDS + 1):
        of = apart_there(hot, label, marked)
        heads = of.withColumn("z", F.struct("x", "comp", "odd")).groupBy("key", F.expr("comp = most").alias("main"))
        heads = heads.agg(F.array_distinct(F.array(*heads_of(turn, "z"))).alias("heads")).select("key", F.explode("heads").alias("z"))
        heads = heads.select("key", F.col("z.x").alias("y"), F.col("z.comp").alias("other"), F.col("z.odd").alias("odd2"))
        rest = splittable_join(of.where("comp <> most"), heads, ["key"])
        found = similar(open_pairs(rest), docs, marked)
        if found.isEmpty():
            break
        label = merged(label, found)
    else:
        of = apart_there(hot, label, marked)
    own = size_class(F.col("x.n"))
    rest = of.where("comp <> most").withColumn("size", F.explode(F.array(own - 1, own, own + 1)))
    rest = rest.select("key", "size", F.col("x").alias("y"), F.col("comp").alias("other"), F.col("odd").alias("odd2"))
    rest = splittable_join(of.withColumn("size", own), rest, ["key", "size"])
    return merged(label, similar(open_pairs(rest), docs, marked))


def apart_there(hot: DataFrame, label: DataFrame, marked: DataFrame) -> DataFrame:
    """(key, x, comp, most, odd) of hot(key, x) where sets of several components share the key: the set's component, the
    commonest one there, and the set's parity."""
    of = hot.withColumn("c", F.col("x.c")).join(label.withColumnRenamed("node", "c"), "c", "left")
    of = materialise(of.select("key", "x", F.coalesce("component", "c").alias("comp")))
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("most")).where("lo < hi")
    of = splittable_join(of, mixed.select("key", "most"), ["key"]).withColumn("c", F.col("x.c"))
    odd = marked.groupBy("c").agg(F.first("odd").alias("odd"))
    return materialise(splittable_join(of, odd, ["c"]).select("key", "x", "comp", "most", "odd"))


def open_pairs(rest: DataFrame) -> DataFrame:
    """(a, b) of rows that hold two sets x and y of different components that may be near copies."""
    rest = rest.where("comp <> other").where(able("x", "y")).where(~apart("odd", "odd2", F.col("x.n"), F.col("y.n")))
    return rest.select(*ends("x", "y"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns. The text is moved once."""
    marked, counts = marks(docs)
    found = groups(docs, marked, counts)
    group = F.coalesce("component", "c").alias("group")
    rows = marked.join(found, marked["c"] == found["node"], "left").select(group, "doc_id", "h")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("__id"), F.col("x.h").alias("__h"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__h"))
    kept = docs.join(first, own)
    place = F.row_number().over(Window.partitionBy("__id", "__h").orderBy(F.lit(0)))
    return kept.withColumn("__first", place).where("__first = 1").drop("__id", "__h", "__first")
