"""Shared plumbing: scratch tables, Arrow batch limits, connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local session without it (tests) gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = named or tempfile.mkdtemp(prefix="attesta-")
        _OWN[app] = f"{base.rstrip('/')}/attesta-{app}"
        atexit.register(_clean, spark, _OWN[app] if named else base)
    return _OWN[app]


def _clean(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: nothing can be deleted through it any more
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote, when all that reads it has been written."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the batches that whole texts travel in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(run: Callable) -> Callable:
    """A batch function that gives memory back to the system as its task ends: workers serve many stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps what it has
            pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: int | None, folds: int = 5) -> int:
    """crc32 of doc_id as text, mod folds; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def remainder_col(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hash_sample(rows: DataFrame, group: str, order: list[str], bound: float) -> DataFrame:
    """About `bound` rows of each group (all rows of smaller groups), chosen by the hash of `order`.

    The rows differ in `order`. A count by group gives each group a hash threshold, so what is gathered
    does not grow with the input; a fixed seed makes the choice repeatable.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    unit = (F.xxhash64(*order) / F.lit(float(2**64))) + F.lit(0.5)
    return splittable_join(rows, counts, [group]).where(unit < F.lit(float(bound)) / F.col("__n")).drop("__n")


def splittable_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that Spark can split at a hot key of the left side.

    Joined on one bit of the keys' hash too, so that a right side already dealt by the keys (an
    aggregate) is dealt for this join alone; only then does adaptive execution split and replicate.
    """
    tag = F.xxhash64(*keys).bitwiseAND(F.lit(1)).cast("tinyint")
    return left.withColumn("__tag", tag).join(right.withColumn("__tag", tag), [*keys, "__tag"], how).drop("__tag")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their number from 0 in the order of keys, which must tell them apart; written to the shared folder.

    Ranges of the order are sorted on the executors; only one row a range is summed up to number all.
    """
    rows = materialise(rows)  # ranges are sampled and dealt from the same rows
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialise(ranged.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.selectExpr("__part", "sum(__n) over (order by __part) - __n as __start")
    at = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, at).drop("__part", "__start", "__id")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: rounds grow with the logarithm of the component
    size, each round is one aggregate and one join, and every round is written to the shared folder.
    """
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        least = least.select("u", F.least("u", "m").alias("m"))
        big = splittable_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        down = splittable_join(big, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(down.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
