"""Views and their pages: index records, markers, members, connectors, repository coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.ledger import NEAR
from attesta.operators.lint import documents, stale_pairs
from attesta.operators.retrieve import RANK, in_scope
from attesta.sources.relations import Relations
from attesta.sources.repository import named_surfaces


def json_of(c: Column) -> Column:
    """A value as JSON; nulls inside lists of structs stay."""
    return F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"^\[|\]$", "")


def json_line(**fields: Column) -> Column:
    """One compact JSON object, keys in order; fields that are null, empty or an empty list are left out."""
    pairs = [F.concat(F.lit(f'"{k}":'), F.nullif(F.nullif(json_of(v), F.lit('""')), F.lit("[]"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(~F.endswith(p, F.lit(":null")), p) for p in pairs]), F.lit("}"))


def index_records(r: Relations) -> DataFrame:
    """(rank, id, line): one compact JSON object a document: every value as its head says it, keys in order."""
    line = lambda df, kind, **k: df.select(F.lit(RANK[kind]).alias("rank"), "id", json_line(id=F.col("id"), kind=F.lit(kind), path=F.col("path"), **k).alias("line"))
    c = F.col
    some = lambda x: F.nullif(c(x), F.lit(""))
    origin = F.from_json(F.to_json(F.struct(some("ref").alias("ref"), some("system").alias("system"), some("upstream_ref").alias("upstream_ref"))), "map<string,string>")
    s = line(r.sources, "source", origin=F.when(F.size(origin) > 0, origin), tier=c("capture"), content_hash=c("content_hash"), version=c("version"), tags=c("tags"))
    cited = r.provenance.groupBy(c("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "source_id", "hash"))).alias("p"))
    cited = cited.select("id", F.transform("p", lambda x: F.struct(x["hash"].alias("hash"), x["source_id"].alias("id"))).alias("provenance"))
    d = line(r.derived.join(cited, "id", "left"), "derived", **{k: c(k) for k in ("type", "title", "abstract", "status", "derivation", "as_of", "tags", "provenance")})
    p = line(r.projects, "project", type=c("type"), title=c("title"), scope=c("scope"))
    e = r.evidence.groupBy(c("decision_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "source_id"))).alias("e"))
    e = e.select("id", c("e.source_id").alias("evidence"))
    decided = line(r.decisions.join(e, "id", "left"), "decision", **{k: c(k) for k in ("type", "title", "status", "evidence")})
    return s.unionByName(d).unionByName(p).unionByName(decided).orderBy("rank", "id")


def index_markers(r: Relations) -> DataFrame:
    """(id, markers) of derived documents: way, number of sources, and the one exception that matters."""
    n = r.provenance.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    stale = stale_pairs(r).select(F.col("doc_id").alias("id")).distinct().withColumn("changed", F.lit(True))
    rows = r.derived.join(n, "id", "left").join(stale, "id", "left")
    sources = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " source").otherwise(" sources")))
    end = F.when(F.col("status") == "superseded", "superseded").when(F.col("changed") | (F.col("status") == "stale"), "stale")
    return rows.select("id", F.concat_ws(" · ", F.coalesce("derivation", F.lit("extracted")), sources, end).alias("markers"))


def cover(r: Relations) -> DataFrame:
    """(source_id, doc_id): the document that covers each source, a summary before others, then by id."""
    kinds = r.derived.select(F.col("id").alias("doc_id"), "type")
    best = F.min(F.struct((F.col("type") != "summary").alias("other"), F.col("doc_id"))).alias("x")
    return r.provenance.join(kinds, "doc_id").groupBy("source_id").agg(best).select("source_id", F.col("x.doc_id").alias("doc_id"))


def blurbs(r: Relations) -> DataFrame:
    """(id, blurb) of sources, borrowed from what covers them; without one the source's ref."""
    text = r.derived.select(F.col("id").alias("doc_id"), F.concat_ws(" — ", "title", F.nullif("abstract", F.lit(""))).alias("blurb"))
    own = cover(r).join(text, "doc_id").select(F.col("source_id").alias("id"), "blurb")
    return r.sources.join(own, "id", "left").select("id", F.coalesce("blurb", "ref").alias("blurb"))


def page(r: Relations) -> DataFrame:
    """(project_id, ord, member_id, blurb): member lists of all views, in their order."""
    known = blurbs(r).withColumnRenamed("id", "member_id")
    return r.members.join(known, "member_id", "left").select("project_id", "ord", "member_id", "blurb").orderBy("project_id", "ord")


def resolve(r: Relations, project: str | None = None) -> DataFrame:
    """(id) of what a view shows; without one, of everything."""
    return (documents(r).select("id").distinct() if project is None else in_scope(r, project)).orderBy("id")


def updated_members(held: DataFrame, changes: DataFrame) -> DataFrame:
    """(project_id, members) after changes(project_id, add, remove): order kept, added at the end, then taken out."""
    empty = F.array().cast("array<string>")
    lists = held.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "member_id"))), lambda x: x["member_id"]).alias("own"))
    rows = lists.join(changes, "project_id", "full_outer")
    every = F.array_union(F.coalesce("own", empty), F.coalesce("add", empty))
    return rows.select("project_id", F.array_except(every, F.coalesce("remove", empty)).alias("members"))


def connectors(r: Relations, project: str) -> DataFrame:
    """(system, ref, ids) that a view's members come from or assert; outside systems only."""
    members = in_scope(r, project)
    own = r.sources.where(~F.col("system").isin(NEAR)).select("id", "system", "ref")
    said = r.connectors.select(F.col("doc_id").alias("id"), "system", "ref")
    rows = own.unionByName(said).join(members, "id", "left_semi")
    return rows.groupBy("system", F.coalesce("ref", F.lit("")).alias("ref")).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def repo_coverage(captured: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Per repository: captured files, surface paths, and those not captured.

    captured(ref): `repo#path`; surfaces(repo, path). Paths are compared without case and slash style.
    """
    held = captured.select(T.locator(F.col("ref")).alias("repo"), T.repo_path(F.regexp_extract("ref", "#(.*)$", 1)).alias("path")).distinct()
    wanted = surfaces.where("path <> 'topology'").select("repo", T.repo_path(F.col("path")).alias("path")).distinct()
    rows = wanted.join(held.withColumn("held", F.lit(1)), ["repo", "path"], "left")
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("surfaces"), F.count("held").alias("covered"), (F.count(F.lit(1)) - F.count("held")).alias("uncaptured"))


def footprint(r: Relations) -> DataFrame:
    """(repo, part, id, path) of what is held about each repository: its constitution (the source whose ref is the locator itself),
    the files captured from it, the documents that rest on any of these, and the paths its constitution names that nothing was captured of."""
    own = r.sources.where("system = 'repo' and ref <> ''").select("id", "text", T.locator(F.col("ref")).alias("repo"), F.regexp_extract("ref", "#(.*)$", 1).alias("region"), F.contains("ref", F.lit("#")).alias("inside"))
    none = F.lit(None).cast("string")
    head = own.where("not inside").groupBy("repo").agg(F.max_by(F.struct("id", "text"), "id").alias("x")).select("repo", "x.id", "x.text")
    files = own.where("inside").select("repo", "id", F.substring_index("region", "#", 1).alias("path"))
    named = head.select("repo", F.explode(named_surfaces(F.col("text"))).alias("s")).where("s.label <> 'topology'").select("repo", F.col("s.path").alias("path"))
    named = named.groupBy("repo", T.repo_path(F.col("path")).alias("key")).agg(F.min("path").alias("path"))
    lacking = named.join(files.select("repo", T.repo_path(F.col("path")).alias("key")), ["repo", "key"], "left_anti")
    parts = [
        head.select("repo", F.lit("constitution").alias("part"), "id", none.alias("path")), files.select("repo", F.lit("covered").alias("part"), "id", "path"),
        docs_by_repo(r).select("repo", F.lit("concept").alias("part"), F.col("doc_id").alias("id"), none.alias("path")),
        lacking.select("repo", F.lit("not captured").alias("part"), none.alias("id"), "path"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def docs_by_repo(r: Relations) -> DataFrame:
    """(repo, doc_id): derived documents by the repositories of the sources they rest on, each once."""
    repos = r.sources.where("system = 'repo'").select(F.col("id").alias("source_id"), T.locator(F.col("ref")).alias("repo"))
    return r.provenance.join(repos, "source_id").join(r.derived.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("repo", "doc_id").distinct()
