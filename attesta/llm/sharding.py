"""Hilbert-curve ordering: quantised metadata, one curve index, equal runs.

Rows are sorted by their place on a Hilbert curve over (source, lang, size), so each shard holds a
compact box of the metadata space and file statistics prune on any of the three. DataFrame
functions only.

Defined cases: a null text has no bytes (size 8, the checksum of the empty text); null metadata goes
to cell 0; equal and repeated rows are ordered arbitrarily among themselves but each gets a slot of
its own, and however many there are they spread over tasks; an empty table gives an empty result; further
columns are ignored by shard() and kept by write_shards().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import materialise, table

DIMS, BITS, SHARDS = 3, 8, 24


def transitions(n: int = DIMS) -> list[int]:
    """Automaton of the n-dimensional Hilbert curve.

    Entry (state << n | cell) holds (next state << n | digit). A state is an entry corner and a
    direction; reflected Gray codes give the order in which a state visits its sub-cubes.
    """
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & (size - 1)

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    out = []
    for corner in range(size):
        for axis in range(n):
            for cell in range(size):
                w = rank[turn(cell ^ corner, n - (axis + 1) % n)]
                start = gray[2 * ((w - 1) // 2)] if w else 0
                step = 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
                to = (corner ^ turn(start, axis + 1)) * n + (axis + step + 1) % n
                out.append(to << n | w)
    return out


def hilbert(dims: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer columns below 2**bits."""
    n = len(dims)
    rules = F.array(*[F.lit(x) for x in transitions(n)])

    def step(acc: Column, at: Column) -> Column:
        cell = F.lit(0)
        for k, d in enumerate(dims):
            cell = cell + F.shiftleft(F.call_function("getbit", d, at), k).cast("int")
        found = F.element_at(rules, acc["state"] * F.lit(1 << n) + cell + F.lit(1))
        return F.struct(
            F.shiftright(found, n).alias("state"),
            (acc["index"] * F.lit(1 << n) + found.bitwiseAND(F.lit((1 << n) - 1))).alias("index"),
        )

    levels = F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("index"))
    return F.aggregate(levels, start, step, lambda acc: acc["index"])


def cell(c: Column) -> Column:
    """Cell of a label: 1 to 255, 0 for null."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(255)).cast("int") + 1)


def size_cell(size: Column) -> Column:
    """Eight cells an octave of bytes: fixed, so a row's place does not depend on other rows."""
    return F.least(F.lit(255), F.floor(F.log2(size + 1) * 8).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in curve order, dealt in runs whose counts differ by one at most; with the columns in `keep`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        cell(F.col("source")).alias("source_cell"),
        cell(F.col("lang")).alias("lang_cell"),
        F.monotonically_increasing_id().alias("__n"),
        *keep,
    ).withColumn("size_cell", size_cell(F.col("size")))
    curve = hilbert([F.col("source_cell"), F.col("lang_cell"), F.col("size_cell")])
    base = materialise(base.withColumn("curve", curve))
    # the number, written once, tells repeated rows apart, so ranges can cut between them
    keys = ["curve", "text_crc32", "doc_id", "__n"]
    ranged = base.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the ids number the rows of a sorted partition; written once, they hold for all that follows
    ranged = materialise(ranged.withColumn("__id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__id", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    starts = counts.selectExpr(
        "__part",
        "sum(__n) over (order by __part) - __n as __start",
        "sum(__n) over () as __all",
    )
    at = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = ranged.join(F.broadcast(starts), "__part").withColumn("__rank", at)
    out = out.withColumn("shard", F.expr(f"int(__rank * {shards} div __all)"))
    return out.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"__rank - (shard * __all + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source_cell", "lang_cell", "size_cell", "curve", *keep,
    )


CELLS = ("source_cell", "lang_cell", "size_cell")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Per shard the box of cells it covers: what a reader prunes on."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(d).alias(f"{f.__name__}_{d}") for d in CELLS for f in (F.min, F.max)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 0) -> None:
    """docs, all rows and columns, in one folder a shard: `__shard`, `__slot` and the cells, for readers that prune.

    Rows are found again by a number that is written with them, so no id need tell them apart. Tasks take runs
    of the curve (as many as shuffle partitions, or `files`), so no task holds a whole shard and each file covers a small box.
    """
    spark = docs.sparkSession
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    placed = shard(rows, shards, ("__row",))
    placed = placed.select("__row", *(F.col(c).alias(f"__{c}") for c in ("shard", "slot", *CELLS)))
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.join(placed, "__row").drop("__row").repartitionByRange(parts, "__shard", "__slot")
    out.sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
