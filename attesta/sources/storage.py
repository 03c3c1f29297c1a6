"""Small files on any Hadoop file system: read whole, written so that they appear whole or not at all.

A store is a folder of generations, each a folder of tables, and of numbered heads, each naming the generations that hold,
oldest first. A head appears whole, so a reader sees one state, a lost job leaves only a folder that nobody names,
and of two writers one is told to try again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer was first."""


def _at(spark: SparkSession, path: str):  # noqa: ANN202  a JVM file system and path
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; nothing if there is none."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def plain(spark: SparkSession, fs):  # noqa: ANN001, ANN201  a JVM file system
    """The file system without checksum files beside its own: others edit these files too."""
    if fs.getUri().getScheme() != "file":
        return fs
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).getRawFileSystem()


def publish(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write a file under a hidden name beside its place and rename it there; without replace, Conflict if there is one."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs, p = _at(spark, path)
    aside = jvm.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    own = plain(spark, fs) if replace else fs
    out = own.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        move(spark, aside.toString(), path)
        return
    rename = jvm.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(p), how)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(path) from e
        raise


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over whatever stands at the target, in one step where the file system has one."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs, a = _at(spark, source)
    b = jvm.Path(target)
    fs.mkdirs(b.getParent())
    own = plain(spark, fs)
    if fs.getUri().getScheme() != "file":
        how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        how[0] = jvm.Options.Rename.OVERWRITE
        jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(a), fs.makeQualified(b), how)
    elif not own.rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def shorten(spark: SparkSession, path: str) -> None:
    """Take the last byte off a file."""
    fs, p = _at(spark, path)
    plain(spark, fs).truncate(p, fs.getFileStatus(p).getLen() - 1)


def join(spark: SparkSession, parts: list[str], target: str) -> None:
    """Put files one after the other into a new one: by the file system where it can, else streamed, a buffer at a time."""
    jvm = spark.sparkContext._jvm
    fs, p = _at(spark, target)
    own = plain(spark, fs)
    own.create(p).close()
    paths = [jvm.org.apache.hadoop.fs.Path(x) for x in parts]
    try:
        if paths:
            given = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths))
            for k, x in enumerate(paths):
                given[k] = x
            fs.concat(p, given)
        return
    except UnsupportedOperationException:
        pass  # a file system that can't
    out = own.create(p)
    try:
        for x in paths:
            stream = own.open(x)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
    finally:
        out.close()


def append(spark: SparkSession, path: str, text: str) -> None:
    """Add to the end of a file, which is made if need be."""
    fs, p = _at(spark, path)
    own = plain(spark, fs)
    out = own.append(p) if fs.exists(p) else own.create(p)
    out.write(bytearray(text.encode()))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def generations(spark: SparkSession, store: str) -> tuple[int, list[str]]:
    """Number of the last head (0: none) and the generations it names."""
    numbers = [int(f.removeprefix("head-")) for f in folders(spark, store) if f.startswith("head-")]
    if not numbers:
        return 0, []
    return max(numbers), json.loads(read(spark, f"{store}/head-{max(numbers):08d}"))


def name_of(number: int) -> str:
    """A folder for the generation of that number that no other writer has."""
    return f"generation-{number:08d}-{uuid.uuid4().hex[:8]}"


def advance(spark: SparkSession, store: str, number: int, names: list[str]) -> None:
    """Publish the head of that number, or Conflict; what neither it nor the one before names is deleted."""
    before = generations(spark, store)[1]
    publish(spark, f"{store}/head-{number:08d}", json.dumps(names))
    for f in folders(spark, store):
        old = f.startswith("head-") and int(f.removeprefix("head-")) < number - 1
        if old or (f.startswith("generation-") and f not in {*names, *before} and int(f.split("-")[1]) < number):
            remove(spark, f"{store}/{f}")
