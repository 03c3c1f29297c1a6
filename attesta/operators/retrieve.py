"""Finding documents: literal terms, facets, ranked words, vectors, and their union."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.sources.relations import Relations

RANK = {"source": 0, "derived": 1, "project": 2, "decision": 3}


def catalog(r: Relations) -> DataFrame:
    """One row a document: id, kind, type, status, identity (what names it) and mention (all it says), lower case."""
    none = F.lit(None).cast("string")
    low = lambda *c: F.lower(F.concat_ws(" ", *c))
    # what is held is part of a source's name, unless it is the base's own format
    end = T.suffix(F.col("canonical"))
    form = F.when(~end.isin("", ".md", ".markdown"), end)
    rows = [
        ("source", r.sources, F.lit("source"), none, low("id", "lang", "ref", "upstream_ref", form), low("text")),
        ("derived", r.derived, F.col("type"), F.col("status"), low("id", "title", "tag"), low("abstract", "body")),
        ("project", r.projects, none, none, low("id", "title"), low("scope")),
        ("decision", r.decisions, none, F.col("status"), low("id", "title"), low("body")),
    ]
    parts = [
        df.select("id", F.lit(kind).alias("kind"), F.lit(RANK[kind]).alias("rank"), t.alias("type"), s.alias("status"), i.alias("identity"), m.alias("mention"))
        for kind, df, t, s, i, m in rows
    ]
    return reduce(DataFrame.unionByName, parts)


def in_scope(r: Relations, project: str) -> DataFrame:
    """(id) of the members of a project and of all global views; a project that is not there is an error."""
    if r.projects.where(F.col("id") == project).isEmpty():
        raise ValueError(f"no such project: {project}")
    global_ = r.projects.where("scope = 'global'").select(F.col("id").alias("project_id"))
    own = r.members.where(F.col("project_id") == project).unionByName(r.members.join(global_, "project_id", "left_semi"))
    return own.select(F.col("member_id").alias("id")).distinct()


def find(r: Relations, query: str, type_: str | None = None, include_superseded: bool = False, project: str | None = None) -> DataFrame:
    """Documents that hold every term; those that hold more of them in their name come first.

    A term is any run without white space, found as a substring. No term matches everything.
    """
    words = T.terms(query)
    hay = F.concat_ws("\n", "identity", "mention")
    rows = catalog(r)
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    if not include_superseded:
        rows = rows.where(~F.coalesce(F.col("status") == "superseded", F.lit(False)))
    for w in words:
        rows = rows.where(F.contains(hay, F.lit(w)))
    named = reduce(Column.__add__, [F.contains(F.col("identity"), F.lit(w)).cast("int") for w in words], F.lit(0))
    rows = rows.withColumn("named_terms", named)
    matched = F.when((F.col("named_terms") == len(words)) & F.lit(bool(words)), "name").otherwise("mention")
    if project is not None:
        rows = rows.join(in_scope(r, project), "id", "left_semi")
    out = rows.select("id", "kind", "type", "named_terms", matched.alias("matched"), "rank")
    return out.orderBy(F.desc("named_terms"), "rank", "id").drop("rank")


WORD = r"[\p{L}\p{N}]"


def phrases(query: str) -> list[list[str]]:
    """The words of each term of a query: a term of several words is a phrase; one without any says nothing."""
    cut = lambda t: re.findall(r"[^\W_]+", t)
    return [w for t in T.terms(query) if (w := cut(t))]


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold every term of the query, phrases as such. Other words go before rows are made of them."""
    terms = phrases(query)
    words = sorted({w for t in terms for w in t})
    low = F.lower(F.coalesce(text, F.lit("")))
    docs = docs.select(key, low.alias(text))
    for t in terms:
        if len(t) > 1:
            docs = docs.where(F.col(text).rlike(f"(?<!{WORD})" + r"[^\p{L}\p{N}]+".join(t) + f"(?!{WORD})"))
    own = docs.select(key, F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1)).alias("all"))
    own = own.select(key, F.size("all").alias("len"), F.filter("all", lambda t: t.isin(words)).alias("hits"))
    total = own.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    index = own.select(key, "len", F.explode("hits").alias("token")).groupBy("token", key, "len").agg(F.count(F.lit(1)).alias("tf"))
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # at most a row a word of the query
    rows = index.join(F.broadcast(df), "token").crossJoin(F.broadcast(total))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).drop("n")


def facets(
    r: Relations, *, words: str | None = None, type_: str | None = None, kind: str | None = None, cites: str | None = None,
    system: str | None = None, status: str | None = None, limit: int = 50, project: str | None = None,
) -> DataFrame:
    """Documents that pass every given filter. Sources have no type here; the scope applies after the limit."""
    rows = catalog(r).withColumn("type", F.when(F.col("kind") != "source", F.col("type")))
    for c, v in (("type", type_), ("kind", kind), ("status", status)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if cites is not None:
        rows = rows.join(r.provenance.where(F.col("source_id") == cites).select(F.col("doc_id").alias("id")), "id", "left_semi")
    if system is not None:
        rows = rows.join(r.sources.where(F.col("system") == system).select("id"), "id", "left_semi")
    order = ["rank", "id"]
    if words is not None:
        scored = bm25(rows.withColumn("all", F.concat_ws(" ", "identity", "mention")), "id", "all", words)
        rows, order = rows.join(scored, "id"), [F.desc(F.round("score", 9)), "id"]
    rows = rows.orderBy(*order).limit(max(1, min(500, limit)))
    if project is not None:
        rows = rows.join(in_scope(r, project), "id", "left_semi").orderBy(*order)
    return rows.select("id", "kind", "type", "status")


def cosine(vectors: DataFrame, query: list[float], vec: str = "embedding") -> DataFrame:
    """vectors with their cosine to the query; vectors of length 0 are left out. JVM-side, one pass."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    lit = F.array(*[F.lit(x) for x in q])
    v = F.transform(vec, lambda x: x.cast("double"))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(v, lit, lambda a, b: a * b), zero, lambda acc, x: acc + x)
    own = F.sqrt(F.aggregate(v, zero, lambda acc, x: acc + x * x))
    if norm == 0:
        return vectors.withColumn("score", F.lit(0.0)).where("false")
    return vectors.withColumn("__own", own).where("__own > 0").withColumn("score", dot / (F.col("__own") * norm)).drop("__own")


def search(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id") -> DataFrame:
    """The k nearest: a bounded heap a task, then one merge."""
    return cosine(vectors, query).select(key, "score").orderBy(F.desc(F.round("score", 9)), key).limit(k)


def union_of(literal: DataFrame, near: DataFrame) -> DataFrame:
    """Tiers: named by the query, found both ways, other literal, near only.

    literal(id, kind, matched, named_terms), near(id, kind, sem_rank). Hits found near are in that order within their
    tier, others in find's, which named_terms, kind and id give: literal hits need no numbers, so no single task.
    """
    rows = literal.join(near.withColumnRenamed("kind", "__kind"), "id", "full_outer")
    found, close = F.col("matched").isNotNull(), F.col("sem_rank").isNotNull()
    tier = F.when(F.col("matched") == "name", 0).when(found & close, 1).when(found, 2).otherwise(3)
    via = F.when(~close, "find").when(~found, "semantic").otherwise("both")
    return rows.select("id", F.coalesce("kind", "__kind").alias("kind"), tier.alias("tier"), via.alias("via"), "named_terms", "sem_rank")


def ranked() -> list[Column]:
    """The order of union_of's rows."""
    kind = F.array_position(F.array(*map(F.lit, RANK)), F.col("kind"))
    near = F.when(F.col("tier").isin(1, 3), F.col("sem_rank"))
    return [F.col("tier"), near, F.desc("named_terms"), kind, F.col("id")]


def retrieve(
    r: Relations, vectors: DataFrame | None, query: str, vector: list[float] | None = None, k: int = 10,
    type_: str | None = None, project: str | None = None, outside: int = 5,
) -> DataFrame:
    """find and search as one list, of all kinds; k bounds what is near, literal hits are never cut.

    vectors(id, embedding); without them, or without the query's vector, find answers alone (via says so). With a project,
    its members come first (in_scope) and then the first `outside` of the others.
    """
    literal = find(r, query, type_=type_).select("id", "kind", "matched", "named_terms")
    if vectors is None or vector is None:
        near = literal.where("false").select("id", "kind", F.lit(0).alias("sem_rank"))
    else:
        # k rows
        place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id"))
        near = search(vectors, vector, k, "id").select("id", place.alias("sem_rank"))
        near = catalog(r).select("id", "kind").join(F.broadcast(near), "id")
    rows = union_of(literal, near)
    if project is None:
        return rows.orderBy(*ranked())
    scope = in_scope(r, project)
    inside = rows.join(scope, "id", "left_semi").withColumn("in_scope", F.lit(True))
    others = rows.join(scope, "id", "left_anti").orderBy(*ranked()).limit(outside).withColumn("in_scope", F.lit(False))
    return inside.unionByName(others).orderBy(F.desc("in_scope"), *ranked())


def embed(docs: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """(id, embedding) by hashed words: a stand-in for an embedding service, which reindex takes instead.

    A word adds its count, with a sign, to one of dim cells; where all cells come to 0, each cell that was met counts 1.
    Vectors have length 1, of texts without words length 0."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    cells = hashed(docs.select("id", F.explode(words).alias("word")), dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "weight"))).alias("m"))
    none = F.forall(F.map_values("m"), lambda w: w == 0)
    every = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.when(none, F.map_contains_key("m", k).cast("double")).otherwise(F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("double")))
    rows = docs.select("id").join(cells, "id", "left").select("id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(every).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("float")).alias("embedding"))


def hashed(words: DataFrame, dim: int) -> DataFrame:
    """(id, cell, weight) of words(id, word): the first hex digits of a word's MD5 choose its cell, the last its sign."""
    digest = F.md5(F.col("word").cast("binary"))
    cell = (F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % dim).alias("cell")
    sign = F.when(F.substring(digest, 32, 1) < "8", 1).otherwise(-1)
    return words.select("id", cell, sign.alias("s")).groupBy("id", "cell").agg(F.sum("s").alias("weight"))


def reindex(current: DataFrame, stored: DataFrame, embedder: Callable[[DataFrame], DataFrame] = embed) -> DataFrame:
    """The index (id, content_hash, embedding) of current(id, content_hash, text): only what changed is embedded."""
    todo = index_diff(current.select("id", "content_hash"), stored.select("id", "content_hash"))
    kept = stored.join(todo.where("action = 'fresh'").select("id"), "id", "left_semi").select("id", "content_hash", "embedding")
    changed = current.join(todo.where("action = 'embed'").select("id"), "id", "left_semi")
    return kept.unionByName(changed.select("id", "content_hash").join(embedder(changed.select("id", "text")), "id"))


def degraded(r: Relations, *, words: str | None = None, type_: str | None = None, limit: int = 50, **filters: str | None) -> tuple[DataFrame, list[str]]:
    """What find can answer of a facets call where there is no catalogue, and the filters it leaves out."""
    return find(r, words or "", type_=type_).limit(max(1, min(500, limit))), sorted(k for k, v in filters.items() if v is not None)


def index_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """What an index must embed or prune: (id, action) from (id, content_hash) on both sides."""
    rows = current.join(stored.withColumnRenamed("content_hash", "held"), "id", "full_outer")
    same = F.col("held").eqNullSafe(F.col("content_hash"))
    action = F.when(F.col("content_hash").isNull(), "prune").when(same, "fresh").otherwise("embed")
    return rows.select("id", action.alias("action"))
