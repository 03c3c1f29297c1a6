"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over the XXH64 of 3-word shingles. Distinct fingerprints that
differ in RADIUS bits at most are linked; documents reach each other through links.

Candidates: correlated bits are grouped into parts, and dynamic programming gives each part a
threshold t (-1: not probed) from its estimated number of candidates, under the general principle
that thresholds summing to RADIUS - parts + 1 miss no pair. A part probes all keys within t of its
own. Rows that meet in a key are cut once more by plain pigeonhole on the remaining bits (one of
RADIUS + 1 pieces must be equal), so unrelated fingerprints rarely meet, and are then verified.

Groups: where more than PAIRS fingerprints share a key, no pairs are made. There each fingerprint is
written under itself and its 64 one-bit neighbours; two are within two bits exactly if they share
such a midpoint, so linking each row to the midpoint's smallest fingerprint gives the same
components with rows in proportion to the group (and only the links that components need).

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; one
or two words are one shingle; a null doc_id takes part in links but is never a component's id unless
all its members are null; repeated rows get equal results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, connected_components, materialise, released, splittable_join, table

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints in a key up to which all pairs are made: at most PAIRS / 2 pairs a row.
PAIRS = 32
#: Parts that dynamic programming may choose from.
PARTS = (2, 3)


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Space-joined runs of `size` words, A-Z lower-cased; fewer words: all of them; none: nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half the shingle hashes."""
    total, counts = 0, np.zeros(BITS, np.int64)
    found = shingles(text)
    for at in range(0, len(found), 1 << 16):
        some = found[at : at + (1 << 16)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in some], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    arrow_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set (64 x 64), over all fingerprints."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.array(b.column(0), np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        values = np.concatenate([[n], both.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    found = fps.select("fp").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(BITS * BITS + 1)
    for r in found:
        v[r["i"]] = r["v"]
    return int(v[0]), v[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, correlated ones together, so that parts are as independent as may be."""
    p = np.diag(both) / max(1, n)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(dev, dev)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b, own].mean(), -b))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def expected(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Estimated candidates of a part under threshold t, from the bits' frequencies and correlations."""
    if t < 0:
        return 0.0
    p = np.diag(both)[bits] / max(1, n)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = (both[np.ix_(bits, bits)] / max(1, n) - np.outer(p, p)) / np.outer(dev, dev)
    # correlated bits tell less: the number of independent bits that spread as much
    free = len(bits) / max(1.0, float((corr**2).sum() / len(bits)))
    equal = p**2 + (1 - p) ** 2
    log_same = float(np.log(equal).mean() * free)
    odds = float(((1 - equal) / equal).mean() * free)
    grow = sum(odds**k / max(1, k) for k in range(t + 1))
    return n * n / 2 * float(np.exp(log_same)) * grow


def probes(width: int, t: int) -> int:
    return 0 if t < 0 else 1 if t == 0 else 1 + width


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Cost and thresholds: the cheapest with sum radius - parts + 1, by dynamic programming over parts."""
    need = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        step: dict[int, tuple[float, list[int]]] = {}
        for (total, (cost, chosen)), t in product(best.items(), (-1, 0, 1)):
            # what is cut once more after the probe hardly counts; what is written does
            more = expected(n, both, bits, t) / 2**10 + 3.0 * n * probes(len(bits), t)
            if total + t not in step or cost + more < step[total + t][0]:
                step[total + t] = (cost + more, [*chosen, t])
        best = step
    return best[need]


def plan(n: int, both: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, the cheapest over PARTS."""
    options = []
    for m in PARTS:
        groups = group_bits(n, both, m)
        cost, chosen = allocate(n, both, groups)
        options.append((cost, groups, chosen))
    _, groups, chosen = min(options, key=lambda o: o[0])
    return groups, chosen


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(fp: Column, groups: list[list[int]], chosen: list[int]) -> Column:
    """array<struct<part, key>>: for each probed part, its own key and those within its threshold, cut
    once more by one of RADIUS + 1 pieces of the bits outside the part."""
    rows = []
    for k, (bits, t) in enumerate(zip(groups, chosen)):
        if t < 0:
            continue
        rest = [b for b in range(BITS) if b not in bits]
        size = -(-len(rest) // (RADIUS + 1))
        own = fp.bitwiseAND(F.lit(signed(mask_of(bits))))
        near = [own, *(own.bitwiseXOR(F.lit(signed(1 << b))) for b in bits if t)]
        for j in range(RADIUS + 1):
            piece = fp.bitwiseAND(F.lit(signed(mask_of(rest[j * size : (j + 1) * size]))))
            rows += [
                F.struct(F.lit(k * 4 + j).alias("part"), x.bitwiseOR(piece).alias("key"), F.lit(i > 0).alias("probe"))
                for i, x in enumerate(near)
            ]
    return F.array(*rows)


def links(fps: DataFrame, groups: list[list[int]], chosen: list[int]) -> DataFrame:
    """(a, b) of distinct fps within RADIUS: all that components need. fps has distinct values."""
    rows = fps.select("fp", F.explode(keys(F.col("fp"), groups, chosen)).alias("x")).select("fp", "x.*")
    # of two within a part's threshold one meets the other at its own key; where only probes meet, nothing is owed
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("own"))
    sizes = sizes.where("n > 1 and own > 0").drop("own")
    met = materialise(splittable_join(rows, sizes, ["part", "key"]))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    own = F.collect_set(F.when(~F.col("probe"), F.col("fp")))
    few = met.where(f"n <= {PAIRS}").groupBy("part", "key").agg(F.collect_set("fp").alias("all"), own.alias("own"))
    # at most PAIRS fingerprints in an array
    pairs = few.select(F.explode("own").alias("a"), "all").select("a", F.explode("all").alias("b"))
    pairs = pairs.where("a <> b").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hot = met.where(f"n > {PAIRS}").select("fp").distinct()
    mids = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS))]
    stars = hot.select("fp", F.explode(F.array(*mids)).alias("mid"))
    least = stars.groupBy("mid").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = splittable_join(stars, least.select("mid", "m"), ["mid"]).where("fp <> m")
    return pairs.union(stars.select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct())


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, n_group) of every row of docs(doc_id, text)."""
    marked = materialise(fingerprints(docs))
    own = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    n, both = bit_statistics(own)
    found = connected_components(links(own.select("fp"), *plan(n, both)))
    classes = own.join(found, own["fp"] == found["node"], "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("component")
    )
    classes = materialise(classes)
    # classes that are linked, by component
    head = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_group"))
    classes = splittable_join(classes.select("fp", "component"), head, ["component"])
    return splittable_join(marked, classes.select("fp", "component_id", "n_group"), ["fp"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns: the one whose id names the component.

    Of several rows with that id, the one whose text has the least hash stays. Rows without an id all
    stay, as no id can name them. The text is moved once.
    """
    found = components(docs)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.where("doc_id is not null").join(stay, F.col("doc_id").cast("long") == F.col("__id"))
    first = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("text")))
    rows = rows.withColumn("__first", first).where("__first = 1").drop("__id", "__first")
    return rows.union(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_group"
    )
