"""The catalogue: a kept word index of all documents, brought up to date by what changed.

A generation (see storage) holds two tables. `docs`: id, ident (what tells whether a document changed), kind, type, status and
number of words, or that it is gone. `postings`: of every word of a document its places, in folders by a hash of
the word, sorted by word, so that a query opens only the folders of its own words and skips to them inside. Of a
document its last generation counts. A phrase is found by shifting and intersecting places; texts are never read again.

Defined cases: a null text has no words; a query without a word finds nothing; words are runs of letters and digits in
lower case; repeated ids count as one document (the one of the greatest ident).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import retrieve as V
from attesta.sources import storage
from attesta.sources.relations import Relations

#: Folders that words are dealt to, and generations before they are written as one.
BUCKETS, KEPT = 64, 8
#: Changed documents up to which their ids go to the texts; with more, texts go to them.
FEW = 100_000
#: Bytes of one Arrow batch of words.
BATCH_BYTES = 8 << 20
DOC = "id string, ident string, kind string, rank int, type string, status string, length int, gone boolean"
POSTING = "token string, id string, places array<int>, bucket int"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({V.WORD}+)"), F.lit(1))


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def documents(r: Relations, idents: DataFrame | None = None) -> DataFrame:
    """(id, ident, kind, rank, type, status, text) of all documents, for refresh. idents(id, ident): what tells a change where files
    are known (attesta.sources.snapshot); else a hash of what is said."""
    rows = V.catalog(r).withColumn("type", F.when(F.col("kind") != "source", F.col("type")))
    text = F.concat_ws(" ", "identity", "mention")
    rows = rows.select("id", "kind", "rank", "type", "status", text.alias("text"))
    if idents is None:
        return rows.withColumn("ident", F.sha2(F.to_json(F.struct("kind", "type", "status", "text")), 256))
    return rows.join(idents.select("id", "ident"), "id", "left").withColumn("ident", F.coalesce("ident", F.lit("")))


def _docs(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    """Documents that hold, with the generation they stand in."""
    parts = []
    for k, name in enumerate(names):
        rows = spark.read.schema(DOC).parquet(f"{store}/{name}/docs").withColumn("generation", F.lit(k))
        later = [spark.read.schema(DOC).parquet(f"{store}/{n}/docs").select("id") for n in names[k + 1 :]]
        parts.append(rows.join(reduce(DataFrame.unionByName, later), "id", "left_anti") if later else rows)
    if not parts:
        return spark.createDataFrame([], f"{DOC}, generation int")
    return reduce(DataFrame.unionByName, parts).where("not gone")


def docs(spark: SparkSession, store: str) -> DataFrame:
    return _docs(spark, store, storage.generations(spark, store)[1])


def _postings(spark: SparkSession, store: str, names: list[str], tokens: list[str] | None = None) -> DataFrame:
    """Postings that hold, of all words or of those given; only the given words' folders are opened."""
    parts, held = [], _docs(spark, store, names)
    for k, name in enumerate(names):
        rows = spark.read.schema(POSTING).parquet(f"{store}/{name}/postings")
        if tokens is not None:
            own = reduce(Column.__or__, [(F.col("bucket") == bucket_of(F.lit(t))) & (F.col("token") == t) for t in tokens], F.lit(False))
            rows = rows.where(own)
        if k < len(names) - 1:  # what a later generation has is of no account here
            rows = rows.join(held.where(F.col("generation") == k).select("id"), "id", "left_semi")
        parts.append(rows.select("token", "id", "places", "bucket"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], POSTING)


def _write(rows: DataFrame, at: str) -> None:
    """Postings by folder. A folder is split where it is large, so no word's documents need meet in one task, and what a task sorts
    does not grow with the index; the folders alone fix how many files a task writes before that, whatever the session's partitions."""
    parted = rows.hint("rebalance", BUCKETS, "bucket")
    parted.sortWithinPartitions("bucket", "token", "id").write.option("compression", "zstd").partitionBy("bucket").parquet(at)


def each_word(rows: DataFrame) -> DataFrame:
    """(id, token, places) of rows(id, words): a document's words and where they stand, in one pass where the document is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = b.column(1).flatten().dictionary_encode()
            code, doc = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
            place = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            key = doc * max(1, len(words.dictionary)) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            lead = order[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(place[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[lead])), words.dictionary.take(pa.array(code[lead])), places], ["id", "token", "places"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.select("id", "words").mapInArrow(run, "id string, token string, places array<int>")


def refresh(own: DataFrame, store: str) -> dict[str, int | str]:
    """Bring the index up to documents(): {status, indexed, pruned, docs}.

    `own` is read three times: for its idents, for the rows of `docs` and for postings. Where few documents changed, only those are cut
    into words; where many did, words are counted where the texts are, and texts move once, for postings. Where all did, none moves.
    """
    spark = own.sparkSession
    number, names = storage.generations(spark, store)
    held = _docs(spark, store, names).select("id", F.col("ident").alias("had"))
    now = own.groupBy("id").agg(F.max("ident").alias("ident"), F.count(F.lit(1)).alias("rows"))
    both = now.join(held, "id", "full_outer").where(~F.col("had").eqNullSafe(F.col("ident"))).select("id", "ident", "rows").persist()
    try:
        n = both.agg(F.count("ident").alias("changed"), F.count_if(F.col("ident").isNull()).alias("gone"), F.count_if(F.col("rows") > 1).alias("repeated")).first()
        total = now.count()
        if not n["changed"] and not n["gone"]:
            return {"status": "current", "indexed": 0, "pruned": 0, "docs": total}
        name = storage.name_of(number + 1)
        wanted = both.where("ident is not null")

        def changed(rows: DataFrame) -> DataFrame:
            if n["changed"] == total and not n["repeated"]:
                return rows
            found = rows.join(F.broadcast(wanted) if n["changed"] <= FEW else wanted, ["id", "ident"])
            # only repeated ids are looked at for a row to choose
            return found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["id"])) if n["repeated"] else found

        size = F.size(words_of(F.col("text"))).alias("length")
        narrow = ["id", "ident", "kind", "rank", "type", "status"]
        rows = changed(own).select(*narrow, size) if n["changed"] <= FEW else changed(own.select(*narrow, size))
        rows = rows.select(*narrow, "length", F.lit(False).alias("gone"))
        went = both.where("ident is null").select("id", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:-1]], F.lit(True).alias("gone"))
        rows.unionByName(went).write.option("compression", "zstd").parquet(f"{store}/{name}/docs")
        each = each_word(changed(own.select("id", "ident", "text")).select("id", words_of(F.col("text")).alias("words")))
        _write(each.withColumn("bucket", bucket_of(F.col("token"))), f"{store}/{name}/postings")
    finally:
        both.unpersist()
    names = [*names, name]
    if len(names) > KEPT:
        one = storage.name_of(number + 1)
        _docs(spark, store, names).drop("generation").write.option("compression", "zstd").parquet(f"{store}/{one}/docs")
        _write(_postings(spark, store, names), f"{store}/{one}/postings")
        names = [one]
    storage.advance(spark, store, number + 1, names)
    return {"status": "refreshed", "indexed": n["changed"], "pruned": n["gone"], "docs": total}


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


def ranked(spark: SparkSession, store: str, query: str, where: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents (of docs() that pass `where`) that hold every term of the query, phrases as such, as bm25 scores them."""
    terms = V.phrases(query)
    words = sorted({w for t in terms for w in t})
    names = storage.generations(spark, store)[1]
    every = _docs(spark, store, names)
    every = every if where is None else every.where(where)
    total = every.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    hits = _postings(spark, store, names, words).join(every.select("id", "length"), "id")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # at most a row a word of the query
    long = [t for t in terms if len(t) > 1]
    if long:
        places = [F.max(F.when(F.col("token") == w, F.col("places"))).alias(f"w{k}") for k, w in enumerate(words)]
        own = hits.groupBy("id").agg(*places)
        for t in long:
            # where the phrase would begin, by each of its words
            starts = [_shifted(F.col(f"w{words.index(w)}"), j) for j, w in enumerate(t)]
            own = own.where(F.size(reduce(F.array_intersect, starts)) > 0)
        hits = hits.join(own.select("id"), "id", "left_semi")
    tf = F.size("places")
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    rows = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(total))
    return rows.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).drop("n")


@dataclass
class Answer:
    """hits(id, kind, type, status); via says which surface answered, dropped which filters it could not apply."""

    via: str
    hits: DataFrame
    dropped: list[str]


def query(
    r: Relations, store: str, *, words: str | None = None, type_: str | None = None, kind: str | None = None, cites: str | None = None,
    system: str | None = None, status: str | None = None, limit: int = 50, project: str | None = None,
) -> Answer:
    """Documents that pass every filter, from the index; where there is none that can be read, find answers what it can."""
    spark = r.sources.sparkSession
    filters = {"kind": kind, "cites": cites, "system": system, "status": status}
    limit = max(1, min(500, limit))
    try:
        names = storage.generations(spark, store)[1]
        if not names:
            raise FileNotFoundError(store)
        rows = _docs(spark, store, names)
        for c, v in (("type", type_), ("kind", kind), ("status", status)):
            if v is not None:
                rows = rows.where(F.col(c) == v)
        if cites is not None:
            rows = rows.join(r.provenance.where(F.col("source_id") == cites).select(F.col("doc_id").alias("id")), "id", "left_semi")
        if system is not None:
            rows = rows.join(r.sources.where(F.col("system") == system).select("id"), "id", "left_semi")
        order = ["rank", "id"]
        if words is not None:
            rows, order = rows.join(ranked(spark, store, words), "id"), [F.desc(F.round("score", 9)), "id"]
        rows = rows.orderBy(*order).limit(limit)
        answer = Answer("catalog", rows, [])
    except (AnalysisException, FileNotFoundError):
        found = V.find(r, words or "", type_=type_).limit(limit)
        answer, order = Answer("find", found.withColumn("status", F.lit(None).cast("string")), sorted(k for k, v in filters.items() if v is not None)), ["id"]
    if project is not None:
        answer.hits = answer.hits.join(V.in_scope(r, project), "id", "left_semi").orderBy(*order)
    answer.hits = answer.hits.select("id", "kind", "type", "status")
    return answer


def info(spark: SparkSession, store: str) -> DataFrame:
    """One row: documents by kind, different words, occurrences and generations of an index."""
    names = storage.generations(spark, store)[1]
    own = _docs(spark, store, names)
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_docs") for k in V.RANK]
    counts = own.agg(F.count(F.lit(1)).alias("docs"), *kinds, F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
    different = _postings(spark, store, names).select("token").distinct().agg(F.count(F.lit(1)).alias("different_words"))
    return counts.crossJoin(F.broadcast(different)).withColumn("generations", F.lit(len(names)))
