"""Reads a real base directory into the engine's relations.

A base holds `sources/<id>/meta.yml` with the source's files beside it, Markdown documents with a YAML
head in one folder a type, `projects/`, `decisions/`, and the ledgers. Files are read by Spark's binary
source; YAML heads are parsed by an Arrow-batched function; everything after that is relational.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.operators import ledger
from attesta.sources import storage
from attesta.sources.extract import extracted
from attesta.sources.relations import Relations

#: The folders of derived documents.
FOLDERS = ["summaries", "entities", "concepts", "questions", "insights"]
META = (
    "id string, type string, origin struct<system:string,ref:string,captured_by:string,recoverable:boolean,upstream_ref:string>, "
    "capture string, capture_reason string, captured_at string, content_hash string, version int, "
    "history array<struct<version:int,content_hash:string,captured_at:string,file:string,text_aid:string,extracted_by:string,"
    "supersedes:int,upstream_identity:string,anchored_at:string>>, tags array<string>"
)
PAIR = "array<struct<id:string,hash:string,version:int>>"
HEAD = (
    f"id string, type string, title string, abstract string, sources {PAIR}, evidence {PAIR}, see_also array<string>, "
    "members array<string>, status string, superseded_by string, superseded_at string, supersede_reason string, derivation string, "
    "scope string, as_of string, date string, derived_at string, authored_by string, self_hash string, tags array<string>, connectors array<struct<system:string,ref:string>>"
)
#: List fields whose entries may be bare ids.
_PAIRED = ("sources", "evidence")


def _json(text: str | None) -> str | None:
    """A YAML mapping as JSON; null if it is none. Bare ids in source lists become structs."""
    import yaml

    try:
        found = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None
    for k in _PAIRED:
        if isinstance(found.get(k), list):
            found[k] = [{"id": x} if isinstance(x, str) else {**x, "hash": x.get("hash") or x.get("content_hash")} if isinstance(x, dict) else x for x in found[k]]
    return json.dumps(found, default=str, ensure_ascii=False)


def yaml_json(text: str | Column) -> Column:
    """Arrow-batched _json of a column."""

    @F.pandas_udf("string")
    def run(heads: pd.Series) -> pd.Series:
        return pd.Series([_json(h) for h in heads], dtype=object)

    return run(text)


def _part(path: Column, k: int) -> Column:
    return F.element_at(F.split(path, "/"), k)


def readable(content: Column) -> Column:
    """Bytes as text with line ends alike; what is no UTF-8 is replaced, never an error."""
    return T.newlines(F.make_valid_utf8(content.cast("string")))


def files(spark: SparkSession, folders: list[str], names: str = "*", depth: int = 1) -> DataFrame:
    """(path, mtime, length, content) of the files `depth` levels down in folders, of those that exist.

    Folders are listed by Spark; contents are read only where they are asked for, and not of files that a
    filter on time or size leaves out.
    """
    there = [f for f in folders if storage.exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "path string, mtime timestamp, length long, content binary")
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("ignoreMissingFiles", "true").load(there)
    parents = [f.rstrip("/").rsplit("/", 1)[-1] for f in there]
    # the folder's own name must stand at its place: what lies deeper is not meant
    rows = own.where(_part(F.col("path"), -1 - depth).isin(parents))
    return rows.select("path", F.col("modificationTime").alias("mtime"), "length", "content")


#: A parsed file: its path in the base, folder, name (of a source: its folder), text (of a document) and head as JSON.
ENTRY = "path string, part string, name string, mtime timestamp, length long, text string, json string"
DOCUMENTS = [*FOLDERS, "projects", "decisions"]


def carriers(spark: SparkSession, root: str) -> DataFrame:
    """(path, part, name, mtime, length, content) of the files that carry heads."""
    at = F.col("path")
    meta = files(spark, [f"{root}/sources"], "meta.yml", 2)
    meta = meta.select(F.substring_index(at, "/", -3).alias("path"), F.lit("sources").alias("part"), _part(at, -2).alias("name"), "mtime", "length", "content")
    docs = files(spark, [f"{root}/{d}" for d in DOCUMENTS], "*.md")
    stem = F.regexp_replace(_part(at, -1), r"\.md$", "")
    return meta.unionByName(docs.select(F.substring_index(at, "/", -2).alias("path"), _part(at, -2).alias("part"), stem.alias("name"), "mtime", "length", "content"))


def parsed(own: DataFrame) -> DataFrame:
    """carriers as ENTRY: the one place where YAML is parsed."""
    text = readable(F.col("content"))
    rows = own.withColumn("text", text)
    head = F.when(F.col("part") == "sources", F.col("text")).otherwise(T.header_of(F.col("text")))
    rows = rows.withColumn("json", yaml_json(head))
    return rows.select("path", "part", "name", "mtime", "length", F.when(F.col("part") != "sources", F.col("text")).alias("text"), "json")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """A base parsed anew; attesta.sources.snapshot keeps it."""
    return parsed(carriers(spark, root))


def heads(own: DataFrame) -> DataFrame:
    """Sources of ENTRY rows with their typed head, and all of it as a variant."""
    meta = own.where("part = 'sources' and json is not null")
    rows = meta.select(F.col("name").alias("folder"), F.from_json("json", META).alias("m"), F.try_parse_json("json").alias("raw"))
    return rows.select("folder", "m.*", "raw").withColumn("id", F.coalesce("id", F.concat(F.lit("?"), "folder")))


def documents(own: DataFrame, *parts: str) -> DataFrame:
    """Markdown documents of ENTRY rows with their typed head and body; those without a head are none (see unreadable)."""
    rows = own.where(F.col("part").isin(list(parts)) & F.col("json").isNotNull())
    rows = rows.select("path", "part", "name", T.body_of(F.col("text")).alias("body"), F.from_json("json", HEAD).alias("h"), F.try_parse_json("json").alias("raw"))
    return rows.select("path", "part", "name", "body", "h.*", "raw").withColumn("id", F.coalesce("id", F.concat(F.lit("?"), "name")))


def unreadable(own: DataFrame) -> DataFrame:
    """(id, detail) of files that should carry a head and don't: what the loader reports under L9."""
    return own.where("json is null").select("path", F.when(F.col("part") == "sources", "meta.yml is no mapping").otherwise("no head").alias("detail")).withColumnRenamed("path", "id")


def headless(spark: SparkSession, root: str) -> DataFrame:
    """(id, detail) of source folders without meta.yml."""
    at = F.col("path")
    inside = files(spark, [f"{root}/sources"], "*", 2).select(_part(at, -2).alias("folder"), (_part(at, -1) == "meta.yml").alias("meta"))
    bare = inside.groupBy("folder").agg(F.bool_or("meta").alias("meta")).where("not meta")
    return bare.select(F.concat(F.lit("sources/"), "folder").alias("id"), F.lit("no meta.yml").alias("detail"))


#: Names of a source's files: canonical ones and text aids.
CANONICAL, AID = "source.*", "source-text*"
#: What is read as text.
TEXTS = "source*.{[mM][dD],[tT][xX][tT]}"


def beside(spark: SparkSession, root: str, names: str) -> DataFrame:
    """(folder, file, content) of files that lie in sources' folders."""
    at = F.col("path")
    return files(spark, [f"{root}/sources"], names, 2).select(_part(at, -2).alias("folder"), _part(at, -1).alias("file"), "content")


def sources(spark: SparkSession, root: str, own: DataFrame) -> DataFrame:
    """One row a source: typed head, the text that readers see, and the hash of the bytes that are held now.

    Text is read of text files alone; the bytes of others are read only where held_hash is asked for.
    """
    meta = heads(own)
    now = F.coalesce(F.expr("filter(history, h -> h.version = version and h.file is not null)[0].file"), F.lit("source.md"))
    meta = meta.withColumn("file", now)
    held = beside(spark, root, CANONICAL)
    texts = beside(spark, root, TEXTS).select("folder", "file", readable(F.col("content")).alias("own"))
    aid = texts.where("file = 'source-text.md'").select("folder", F.col("own").alias("aid"))
    rows = meta.join(held, ["folder", "file"], "left").join(texts, ["folder", "file"], "left").join(aid, "folder", "left")
    there = F.col("content").isNotNull()
    return rows.select(
        "id", "folder", "type", F.coalesce("aid", F.when(there, F.col("own")), F.lit("")).alias("text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("origin").isNotNull().alias("has_origin"), F.col("origin.system").alias("system"), F.col("origin.ref").alias("ref"),
        "content_hash", "version", "capture", "capture_reason", "captured_at", F.col("origin.recoverable").alias("recoverable"), F.col("origin.upstream_ref").alias("upstream_ref"),
        F.when(there, F.col("file")).alias("canonical"), F.when(there, H.file_hash(F.col("file"), F.col("content"))).alias("held_hash"),
        F.coalesce(F.size("history"), F.lit(0)).alias("entries"), "history", "raw", F.concat_ws("/", F.lit("sources"), "folder", F.when(there, F.col("file"))).alias("path"),
    )


def versions(own: DataFrame) -> DataFrame:
    """The version ledger: one row an entry of sources' history."""
    return own.select("id", "folder", F.explode("history").alias("h")).select("id", "folder", "h.*")


def exploded(docs: DataFrame, field: str, *names: str) -> DataFrame:
    """A list field as a relation: the document's id, the entry's place and its fields (or the entry)."""
    rows = docs.select(F.col("id").alias("doc_id"), F.posexplode(field).alias("ord", "x"))
    return rows.select("doc_id", "ord", *[F.col(f"x.{n}").alias(n) for n in names]) if names else rows.withColumnRenamed("x", "target")


def aids(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, text) that extractors give for each source's files."""
    own = beside(spark, root, CANONICAL).select(F.col("folder").alias("id"), F.col("file").alias("name"), "content")
    return extracted(own, "content", "name").select("id", "name", "text")


def scaffold(spark: SparkSession, root: str, name: str) -> bool:
    """Create an empty base through Spark's file system; False if there is one already."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop.Path(f"{root}/base.yml")):
        return False
    for folder in ["sources", *FOLDERS, "projects", "decisions"]:
        fs.mkdirs(hadoop.Path(f"{root}/{folder}"))
    storage.publish(spark, f"{root}/base.yml", f"version: '1.2'\nname: {json.dumps(name)}\n", replace=True)
    return True


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """The queue: one row a task file, by hand-written `key: value` lines and an `inputs` list; files without id are left out."""
    rows = files(spark, [f"{root}/queue"], "*.md").select(_part(F.col("path"), -1).alias("file"), readable(F.col("content")).alias("text"))
    rows = rows.withColumn("lines", F.split(T.header_of(F.col("text")), "\n"))

    def field(key: str) -> Column:
        last = F.try_element_at(F.filter("lines", lambda x: x.rlike(rf"^{key}\s*:")), F.lit(-1))
        return F.nullif(T.strip(F.regexp_replace(last, r"^[^:]*:", "")), F.lit(""))

    inputs = F.transform(F.filter("lines", lambda x: x.startswith("  - ")), lambda x: T.strip(F.substring(x, 5, 1 << 20)))
    own = [field(k).alias(k) for k in ("id", "type", "status", "created_by", "created_at")]
    return rows.select("file", *own, inputs.alias("inputs"), T.strip(T.body_of(F.col("text"))).alias("body")).where("id is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, stamp, op, target, verdict) of the log. A drift check has a row for each pair of its `checked:` part; of other
    entries the first field is the target and the rest the verdict."""
    log = ledger.read_log(spark, path)
    pairs = F.transform(F.split(F.regexp_extract("rest", r"checked: ([^|\n]+)", 1), ","), lambda p: T.strip(p))
    pairs = F.filter(pairs, lambda p: p.contains("="))
    drift = log.where("op = 'drift-check'").select("seq", "stamp", "op", F.explode_outer(pairs).alias("p"))
    drift = drift.select("seq", "stamp", "op", T.strip(F.substring_index("p", "=", 1)).alias("target"), T.strip(F.regexp_replace("p", "^[^=]*=", "")).alias("verdict"))
    target, verdict = F.substring_index("rest", "|", 1), F.regexp_extract("rest", r"\|(.*)$", 1)
    other = log.where("op <> 'drift-check'").select("seq", "stamp", "op", T.strip(target).alias("target"), F.nullif(T.strip(verdict), F.lit("")).alias("verdict"))
    return other.unionByName(drift)


def manifest(spark: SparkSession, root: str) -> dict:
    """The base's own settings; nothing if there are none."""
    import yaml

    path = f"{root}/base.yml"
    found = yaml.safe_load(storage.read(spark, path)) if storage.exists(spark, path) else None
    return found if isinstance(found, dict) else {}


def load(spark: SparkSession, root: str, own: DataFrame | None = None) -> Relations:
    """A real base as the relations that all operators work on; a base need not have every folder. own: its ENTRY rows,
    if they are known already."""
    own = entries(spark, root) if own is None else own
    held = sources(spark, root, own)
    docs, views, decided = documents(own, *FOLDERS), documents(own, "projects"), documents(own, "decisions")
    no = F.lit(None).cast("bigint").alias("num")
    texts = beside(spark, root, TEXTS).select("folder", "file", readable(F.col("content")).alias("text"))
    history = versions(held.select("id", "folder", "history")).join(texts, ["folder", "file"], "left")
    there = files(spark, [f"{root}/sources"], "source*", 2)
    there = there.select(_part(F.col("path"), -2).alias("folder"), _part(F.col("path"), -1).alias("file"))
    there = there.join(heads(own).select("folder", "id"), "folder").where("startswith(file, 'source-text') or startswith(file, 'source.')")
    usage = ledger.read_usage(spark, f"{root}/usage.jsonl") if storage.exists(spark, f"{root}/usage.jsonl") else spark.createDataFrame([], ledger.USAGE)
    if storage.exists(spark, f"{root}/log.md"):
        log = read_log(spark, f"{root}/log.md")
    else:
        log = spark.createDataFrame([], "seq int, stamp string, op string, target string, verdict string")
    numbered = usage.withColumn("seq", F.monotonically_increasing_id())
    listed = lambda c: F.coalesce(F.size(c), F.lit(0))
    return Relations(
        sources=held.select("id", no, "text", F.array_join("tags", " ").alias("lang"), "system", "ref", "content_hash", "version", "canonical", "capture", "capture_reason", "captured_at", "recoverable", "upstream_ref", "type", "has_origin", "entries", "held_hash", "path", "tags"),
        versions=history.select("id", "version", "content_hash", "text", F.lit(None).cast("string").alias("captured_by"), "file", "supersedes", "text_aid", "upstream_identity", "anchored_at"),
        files=there.select("id", "file"),
        derived=docs.select("id", no, "type", "title", "abstract", "body", "status", "superseded_by", "derivation", "authored_by",
                            F.element_at("see_also", 1).alias("see_also"), F.array_join("tags", " ").alias("tag"), "derived_at", "superseded_at", "supersede_reason", "as_of",
                            listed("sources").alias("n_sources"), "path", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")),
        provenance=exploded(docs, "sources", "id", "hash").select("doc_id", "ord", F.col("id").alias("source_id"), "hash"),
        see_also=exploded(docs, "see_also").select("doc_id", "target"),
        projects=views.select("id", "title", "scope", "type", F.col("members").isNotNull().alias("has_members"), "path"),
        members=views.select(F.col("id").alias("project_id"), F.posexplode("members").alias("ord", "member_id")),
        decisions=decided.select("id", no, "title", "body", "status", F.col("date").alias("dated"), "authored_by", "type", "path"),
        evidence=exploded(decided, "evidence", "id", "version").select(F.col("doc_id").alias("decision_id"), F.col("id").alias("source_id"), "version", "ord"),
        connectors=exploded(docs, "connectors", "system", "ref").select("doc_id", "system", "ref"),
        usage=numbered.select("seq", "op", F.substring("ts", 1, 10).alias("day"), F.explode_outer("ids").alias("doc_id"), "duration_ms", "bytes_in", "bytes_out", "tokens"),
        log=log,
    )
