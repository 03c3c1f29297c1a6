"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label (and one length) are compared, equal ones as one class. Axes are turned to the
principal components of a sample, so that leading coordinates hold most of what tells vectors apart;
any turn of the axes keeps cosines, so the sample decides how fast this is and never what is found.

Classes are ordered by label and first component and cut into tiles. Two tiles meet unless the boxes
of their leading components lie further apart than any pair at the threshold can. In a pair of tiles,
products are summed over the leading dimensions first; the rest of a product is at most the product of
the norms of what is left (Cauchy-Schwarz), so a pair goes as soon as sum and bound together can't
reach the threshold. What stays is decided by the cosine of the vectors as they were given, in doubles.

A pair of tiles gives one row a class that has links: how many vectors it meets there, and the least
class that it reaches there. Rows therefore grow with classes and tiles that meet, never with pairs.

Work: a label of n vectors has n / TILE tiles (larger ones from TILE * SPREAD vectors on, within a bound
of numbers), and tiles that boxes can't tell apart are all compared, so time grows with the square of a
label whose vectors fill the space; there, most pairs cost the first STEPS[0] dimensions of one matrix
product. Every tile pair is a task's work of bounded size, so a hot label is spread over many tasks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those of a
null label, link with nothing and are their own component; vectors of different lengths don't link;
repeated rows and ids link like any others; a null id is a component's id only if all its ids are null;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, connected_components, materialise, numbered, released, splittable_join, table

THRESHOLD = 0.98
#: Rows of a tile at least, tiles of a label up to which tiles keep that size, and numbers in a tile at most.
TILE, SPREAD, NUMBERS = 1024, 32, 1 << 22
#: Rows of a block within a tile, and dimensions after which a sum is held against its bound.
BLOCK, STEPS = 512, (8, 16, 32)
#: Numbers in the sample that principal components are fitted on, and leading components that boxes have.
SAMPLE, LEAD = 1 << 20, 4
#: Slack of bounds for rounding; what they let through is decided exactly.
SLACK = 1e-9


def unit(rows: list[bytes]) -> np.ndarray:
    """Vectors of one length, each brought to length 1."""
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def marked(vectors: DataFrame, group: str = "label") -> DataFrame:
    """(vec_id, grp, key, vec) of every row: label and length, a digest and the numbers; null where nothing can link."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp, key, vec = [], [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2)):
                x = None if label is None or not v.is_valid or v.values.null_count else np.array(v.values, np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    out = (None, None, None)
                else:
                    raw = (x + 0.0).tobytes()  # one sign of zero
                    out = (f"{len(x)}/{label}", hashlib.blake2b(raw, digest_size=16).digest(), raw)
                for column, value in zip((grp, key, vec), out):
                    column.append(value)
            cols = [b.column(0), pa.array(grp, pa.string()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "grp", "key", "vec"])

    arrow_batches(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(group).cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return own.mapInArrow(run, "vec_id long, grp string, key binary, vec binary")


def components_of(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The commonest length and its principal axes in columns, largest first, of a sample of bounded size."""
    sizes = classes.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "bytes").first()
    width = top["bytes"] // 8
    most = max(width + 1, SAMPLE // width)
    share = (F.xxhash64("key") / F.lit(float(2**64))) + F.lit(0.5)
    some = classes.where((F.octet_length("vec") == top["bytes"]) & (share < F.lit(min(2.0, most / top["n"])))).limit(2 * most)
    x = unit([bytes(r["vec"]) for r in some.select("vec").collect()] or [np.ones(width).tobytes()])
    x = x - x.mean(axis=0)
    return width, np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def leading(classes: DataFrame, width: int, axes: np.ndarray) -> DataFrame:
    """classes with p, their leading coordinates."""
    shared = classes.sparkSession.sparkContext.broadcast(axes[:, :LEAD])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = []
            for raw in b.column("vec").to_pylist():
                x = unit([raw])[0]
                x = x @ shared.value if len(x) == width else x[:LEAD]
                p.append(np.pad(x, (0, LEAD - len(x))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64()))], [*b.schema.names, "p"])

    return classes.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in classes.dtypes)}, p array<double>")


class Forest:
    """Least class reached, by rows of two tiles."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.stack([self.root[a], self.root[b]])
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for x, y in pairs.T.tolist():
            x, y = top(x), top(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            moved = np.arange(len(self.root))
            for x in parent:
                moved[x] = top(x)
            self.root = moved[self.root]


def reaching(a: np.ndarray, b: np.ndarray, own: np.ndarray, other: np.ndarray, least: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs whose cosine is `least` or more. a, b are turned vectors, own, other the same as given, of length 1.

    upper: the blocks are one and the same; each pair is given once."""
    width, at = a.shape[1], 0
    i = j = None
    total = np.zeros((len(a), len(b)))
    for stop in (s for s in STEPS if s < width):
        if i is None:
            total += a[:, at:stop] @ b[:, at:stop].T
            rest = np.outer(np.linalg.norm(a[:, stop:], axis=1), np.linalg.norm(b[:, stop:], axis=1))
            open_ = total + rest >= least - SLACK
            if np.count_nonzero(open_) * 8 < open_.size:
                i, j = np.nonzero(open_)
                total = total[i, j]
        else:
            total = total + np.einsum("ij,ij->i", a[i, at:stop], b[j, at:stop])
            rest = np.linalg.norm(a[i, stop:], axis=1) * np.linalg.norm(b[j, stop:], axis=1)
            keep = total + rest >= least - SLACK
            i, j, total = i[keep], j[keep], total[keep]
        at = stop
        if i is not None and not len(i):
            return i, j
    if i is None:
        i, j = np.nonzero(own @ other.T >= least)
    else:
        keep = np.einsum("ij,ij->i", own[i], other[j]) >= least
        i, j = i[keep], j[keep]
    if upper:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def compare(c: np.ndarray, weight: np.ndarray, own: np.ndarray, turned: np.ndarray, first: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, vectors linked and least class reached, of those with links. first: rows of the one tile; same: there is but one."""
    order = np.argsort(c, kind="stable")  # roots are least rows, so least classes
    c, weight, own, turned, first = c[order], weight[order], own[order], turned[order], first[order]
    links, forest = np.zeros(len(c), np.int64), Forest(len(c))
    one = np.flatnonzero(first)
    two = one if same else np.flatnonzero(~first)
    for p in range(0, len(one), BLOCK):
        x = one[p : p + BLOCK]
        for q in range(p if same else 0, len(two), BLOCK):
            y = two[q : q + BLOCK]
            i, j = reaching(turned[x], turned[y], own[x], own[y], least, same and p == q)
            if len(i):
                links += np.bincount(x[i], weight[y[j]], len(c)).astype(np.int64) + np.bincount(y[j], weight[x[i]], len(c)).astype(np.int64)
                forest.join(x[i], y[j])
    hit = links > 0
    return c[hit], links[hit], c[forest.root[hit]]


def compared(met: DataFrame, width: int, axes: np.ndarray, least: float) -> DataFrame:
    """(c, links, root) of met(grp, a, b, first, c, n, vec): rows that lie together by (grp, a, b)."""
    shared = met.sparkSession.sparkContext.broadcast(axes)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = unit(t["vec"].to_pylist())
            turned = x @ shared.value if x.shape[1] == width else x
            c, n, first = (np.array(t[k]) for k in ("c", "n", "first"))
            found = compare(c, n, x, turned, first.astype(bool), now[1] == now[2], least)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["c", "links", "root"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in ("grp", "a", "b"))))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and keys[lo] != now:
                    yield out()
                    held = []
                now = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield out()

    return met.mapInArrow(run, "c long, links long, root long")


def tiled(classes: DataFrame) -> DataFrame:
    """classes of groups of two and more with their tile: runs of the order by group and first component."""
    sizes = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max(F.octet_length("vec") / 8).alias("width")).where("size > 1")
    rows = splittable_join(classes, sizes, ["grp"]).withColumn("p0", F.col("p")[0])
    rows = numbered(rows, ["grp", "p0", "c"], "rank")
    start = rows.groupBy("grp").agg(F.min("rank").alias("start"))
    height = F.greatest(F.lit(1), F.least(F.greatest(F.lit(TILE), F.ceil(F.col("size") / SPREAD)), F.floor(F.lit(NUMBERS) / F.col("width"))))
    rows = splittable_join(rows, start, ["grp"])
    return rows.select("grp", F.floor((F.col("rank") - F.col("start")) / height).alias("tile"), "c", "n", "vec", "p")


def meeting(tiles: DataFrame, least: float) -> DataFrame:
    """(grp, a, b), a <= b, of tiles whose boxes are near enough to hold a pair at the threshold."""
    boxes = tiles.groupBy("grp", "tile").agg(*[f(F.col("p")[k]).alias(f"{n}{k}") for k in range(LEAD) for n, f in (("lo", F.min), ("hi", F.max))])
    a = boxes.select("grp", *[F.col(x).alias(f"a_{x}") for x in boxes.columns[1:]])
    b = boxes.select("grp", *[F.col(x).alias(f"b_{x}") for x in boxes.columns[1:]])
    pairs = a.join(b, "grp").where("a_tile <= b_tile")
    apart = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(LEAD)]
    # vectors of length 1 with that cosine are so far apart at most
    near = sum((x * x for x in apart), F.lit(0.0)) <= 2 - 2 * least + SLACK
    return pairs.where(near).select("grp", F.col("a_tile").alias("a"), F.col("b_tile").alias("b"))


def near_duplicates(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label)."""
    rows = materialise(marked(vectors))
    good = rows.where("vec is not null")
    classes = good.groupBy("grp", "key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()))
    alone = F.lit(None).cast("long")
    if classes.isEmpty():
        found = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    else:
        width, axes = components_of(classes)
        tiles = materialise(tiled(leading(classes.select("grp", "c", "n", "vec"), width, axes)))
        pairs = materialise(meeting(tiles, least))
        left = tiles.select("grp", "tile", "c", "n", "vec")
        sides = [
            left.join(pairs.where(where).withColumn("tile", F.col(side)), ["grp", "tile"]).withColumn("first", F.lit(side == "a"))
            for side, where in (("a", "true"), ("b", "a <> b"))
        ]
        met = sides[0].unionByName(sides[1]).select("grp", "a", "b", "first", "c", "n", "vec")
        met = met.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
        arrow_batches(vectors.sparkSession)
        hits = materialise(compared(met, width, axes, least))
        links = hits.groupBy("c").agg(F.sum("links").alias("links"))
        parts = connected_components(hits.select("c", "root"), "c", "root")
        own = classes.select("grp", "key", "least", "n", "c").join(links, "c", "left")
        own = own.join(parts.select(F.col("node").alias("c"), "component"), "c", "left")
        own = materialise(own.withColumn("component", F.coalesce("component", "c")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1))
        heads = own.groupBy("component").agg(F.min("least").alias("component_id"))
        own = splittable_join(own.select("grp", "key", "n_links", "component"), heads, ["component"])
        linked = splittable_join(good.select("vec_id", "grp", "key"), own, ["grp", "key"]).select("vec_id", "n_links", "component_id")
        rest = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("vec_id", alone).alias("component_id"))
        found = linked.unionByName(rest)
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Every pair of a label, and what links reach.
ORACLE = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= {THRESHOLD}),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on l.a = r.b),
n as (select a, count(*) as n_links from l group by a), m as (select a, min(b) as low from reach group by a)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join m on m.a = vec_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
