"""Cutting the lineage of iterative plans so that it survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, shared by all executors; a local session without one gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A folder of its own in there, for what is written by name."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    folder(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their number from 0 in an order that tells them apart: ranges are sorted on the executors, one row a range is summed up."""
    ranged = cut(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.selectExpr("__part", "sum(__n) over (order by __part) - __n as __start")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), "__part").select(*rows.columns, place.alias(name))
