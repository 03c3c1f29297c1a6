"""A parsed base that is kept: a listing is held against it, and only what changed is read and parsed.

The store (see storage) is a folder of its own on any Hadoop file system. A generation is a Parquet table of
the files that changed (parsed) or went (`gone`); of a path its last generation counts. After KEPT generations a
refresh writes them as one.

A file counts as changed by its time or its size; nothing is read to find out. What the store says is never
the authority: it can be deleted at any time, and the next refresh builds it anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attesta.sources import base, storage

#: Generations up to which refreshes add one.
KEPT = 8


def _generation(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(f"{base.ENTRY}, gone boolean").parquet(f"{store}/{name}")


def _held(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    """The last row of each path, those that are gone left out: generations are few, and later ones are taken off by path."""
    parts = []
    for k, name in enumerate(names):
        rows = _generation(spark, store, name)
        later = [_generation(spark, store, n).select("path") for n in names[k + 1 :]]
        parts.append(rows.join(reduce(DataFrame.unionByName, later), "path", "left_anti") if later else rows)
    if not parts:
        return spark.createDataFrame([], base.ENTRY)
    return reduce(DataFrame.unionByName, parts).where("not gone").drop("gone")


def entries(spark: SparkSession, store: str) -> DataFrame:
    """What the store holds now, as base.parsed gives it."""
    return _held(spark, store, storage.generations(spark, store)[1])


def refresh(spark: SparkSession, root: str, store: str) -> dict[str, int | str]:
    """Bring the store up to the base: {status, parsed, gone, docs}.

    The listing has no contents. Of the changed files the earliest and the latest time and the sizes bound what the
    second reading opens (the source leaves others closed), and a semi join keeps exactly the changed ones.
    """
    number, names = storage.generations(spark, store)
    held = _held(spark, store, names)
    now = base.carriers(spark, root).drop("content")
    both = now.join(held.select("path", F.col("mtime").alias("was"), F.col("length").alias("had")), "path", "full_outer")
    same = F.col("was").eqNullSafe(F.col("mtime")) & F.col("had").eqNullSafe(F.col("length"))
    todo = both.where(~same).select("path", "mtime", "length", F.col("length").isNull().alias("gone")).persist()
    try:
        bounds = todo.where("not gone").agg(*[f(c).alias(f"{n}_{c}") for c in ("mtime", "length") for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).first()
        gone = todo.where("gone").count()
        docs = now.count()
        if not bounds["n"] and not gone:
            return {"status": "current", "parsed": 0, "gone": 0, "docs": docs}
        seen = Observation()
        if bounds["n"]:
            own = base.carriers(spark, root)
            for c in ("mtime", "length"):
                own = own.where((F.col(c) >= F.lit(bounds[f"lo_{c}"])) & (F.col(c) <= F.lit(bounds[f"hi_{c}"])))
            fresh = base.parsed(own.join(todo.where("not gone").select("path"), "path", "left_semi")).observe(seen, F.count(F.lit(1)).alias("n"))
        else:
            fresh = spark.createDataFrame([], base.ENTRY)
        went = todo.where("gone").select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh.schema[1:]])
        delta = fresh.withColumn("gone", F.lit(False)).unionByName(went.withColumn("gone", F.lit(True)))
        name = storage.name_of(number + 1)
        delta.write.option("compression", "zstd").parquet(f"{store}/{name}")
        names = [*names, name]
    finally:
        todo.unpersist()
    if len(names) > KEPT:
        one = storage.name_of(number + 1)
        _held(spark, store, names).withColumn("gone", F.lit(False)).write.option("compression", "zstd").parquet(f"{store}/{one}")
        names = [one]
    storage.advance(spark, store, number + 1, names)
    return {"status": "refreshed", "parsed": seen.get["n"] if bounds["n"] else 0, "gone": gone, "docs": docs}


def load(spark: SparkSession, root: str, store: str) -> base.Relations:
    """base.load through the store: only what changed since the last one is parsed."""
    refresh(spark, root, store)
    return base.load(spark, root, entries(spark, store))
