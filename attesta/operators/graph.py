"""Lineage: edges from recorded facts, and bounded walks over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.lineage import cut, numbered
from attesta.operators.lint import documents
from attesta.sources.relations import Relations

#: Relations, and those that have no direction.
RELATIONS = ["grounded_by", "see_also", "member_of", "evidence", "superseded_by", "excerpt_of", "from_repo"]
UNDIRECTED = ["see_also"]
DIRECTIONS = ["both", "out", "in"]


def stated(r: Relations) -> DataFrame:
    """All edges that documents state: relation, source, target, stale; targets may not exist."""
    no = F.lit(False)
    edge = lambda df, rel, a, b, stale=no: df.select(F.lit(rel).alias("relation"), F.col(a).alias("source"), F.col(b).alias("target"), stale.alias("stale"))
    current = r.sources.select(F.col("id").alias("source_id"), "content_hash")
    grounded = r.provenance.join(current, "source_id", "left")
    changed = F.coalesce(F.col("hash") != F.col("content_hash"), no)
    first = r.sources.where("ref <> ''").groupBy("ref").agg(F.min("id").alias("whole"))
    excerpts = r.sources.where("upstream_ref is not null").select("id", F.col("upstream_ref").alias("ref")).join(first, "ref")
    # a file of a repository names it before `#`; the whole is the source whose own ref is that
    part = r.sources.where("system = 'repo' and contains(ref, '#')").select("id", T.locator(F.col("ref")).alias("ref"))
    from_repo = part.join(first, "ref")
    parts = [
        edge(grounded, "grounded_by", "doc_id", "source_id", changed), edge(r.see_also, "see_also", "doc_id", "target"),
        edge(r.members, "member_of", "member_id", "project_id"), edge(r.evidence, "evidence", "decision_id", "source_id"),
        edge(r.derived.where("superseded_by is not null"), "superseded_by", "id", "superseded_by"),
        edge(excerpts, "excerpt_of", "id", "whole"), edge(from_repo, "from_repo", "id", "whole"),
    ]
    return reduce(DataFrame.unionByName, parts).where("source <> target")


def edges(r: Relations) -> DataFrame:
    """Stated edges between documents that exist, each once."""
    ids = documents(r).select("id").distinct()
    rows = stated(r).groupBy("relation", "source", "target").agg(F.bool_or("stale").alias("stale"))
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return rows.select("relation", "source", "target", (~F.col("relation").isin(UNDIRECTED)).alias("directed"), "stale")


def dangling(r: Relations) -> DataFrame:
    """Stated edges of which an end is nothing: what a walk can't follow."""
    ids = documents(r).select("id").distinct()
    ends = [stated(r).join(ids.withColumnRenamed("id", end), end, "left_anti").select("relation", "source", "target") for end in ("source", "target")]
    return ends[0].unionByName(ends[1]).distinct()


def degree(all_edges: DataFrame) -> DataFrame:
    ends = all_edges.select(F.col("source").alias("id")).unionAll(all_edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def adjacency(all_edges: DataFrame, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(from_id, relation, to_id); relations without direction go both ways in every mode."""
    rows = all_edges if relations is None else all_edges.where(F.col("relation").isin(relations))
    ahead = rows.select(F.col("source").alias("from_id"), "relation", F.col("target").alias("to_id"), "directed")
    back = rows.select(F.col("target").alias("from_id"), "relation", F.col("source").alias("to_id"), "directed")
    if direction == "out":
        back = back.where("not directed")
    elif direction == "in":
        ahead = ahead.where("not directed")
    return ahead.unionByName(back).select("from_id", "relation", "to_id").distinct()


@dataclass
class Walk:
    """nodes(id, depth); ways(id, from_id, relation): every parent of the layer before and what leads from it; frontier(id,
    remaining): nodes with edges that a cap kept from being followed; complete: no cap was met."""

    nodes: DataFrame
    ways: DataFrame
    frontier: DataFrame
    complete: bool


def first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that tells rows apart."""
    return numbered(rows, "__place", *order).where(F.col("__place") < n).drop("__place")


def explore(adjacent: DataFrame, centers: list[str], depth: int = 1, max_nodes: int | None = None) -> Walk:
    """What is within `depth` steps of the centers, layer by layer.

    A layer's new nodes are found in order of (least parent, id); a cap stops inside the layer, at the same node as a loop
    over sorted parents and neighbours would. What stands on the edge then is what can be asked for next. Each layer is one join
    against the adjacency and is written, so lineage doesn't grow with depth.
    """
    spark = adjacent.sparkSession
    adjacent = cut(adjacent.select("from_id", "relation", "to_id"))
    layer = cut(spark.createDataFrame([(c,) for c in sorted(set(centers))], "id string"))
    total, complete = len(set(centers)), True
    nodes, ways = [layer.withColumn("depth", F.lit(0))], []
    seen = nodes[0].select("id")
    edge = layer
    for d in range(1, depth + 1):
        step = adjacent.join(layer.withColumnRenamed("id", "from_id"), "from_id")
        fresh = cut(step.join(seen.withColumnRenamed("id", "to_id"), "to_id", "left_anti"))
        new = fresh.groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("parent"))
        n = new.count()
        if max_nodes is not None and n > max(0, max_nodes - total):
            room, complete = max(0, max_nodes - total), False
            new = first(new, room, "parent", "id") if room else new.where("false")
            n = room
        new = cut(new.select("id"))
        nodes.append(new.withColumn("depth", F.lit(d)))
        ways.append(fresh.withColumnRenamed("to_id", "id").join(new, "id", "left_semi").select("id", "from_id", "relation"))
        seen, total, edge = seen.unionByName(new), total + n, layer.unionByName(new)
        if not complete or not n:
            break
        layer = new
    if complete:
        frontier = spark.createDataFrame([], "id string, remaining long")
    else:
        out = adjacent.join(edge.withColumnRenamed("id", "from_id"), "from_id").join(seen.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        frontier = out.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("remaining"))
    none = spark.createDataFrame([], "id string, from_id string, relation string")
    return Walk(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, ways, none), frontier, complete)


def walk(adjacent: DataFrame, centers: list[str], depth: int = 1, max_nodes: int | None = None) -> DataFrame:
    """(id, depth, reached_from, reached_by) of what explore finds; of several ways to a node the first by (parent, relation)."""
    found = explore(adjacent, centers, depth, max_nodes)
    way = found.ways.groupBy("id").agg(F.min(F.struct("from_id", "relation")).alias("way"))
    return found.nodes.join(way, "id", "left").select("id", "depth", F.col("way.from_id").alias("reached_from"), F.col("way.relation").alias("reached_by"))


def all_ways(found: Walk) -> DataFrame:
    """(id, depth, reached_from, reached_by) with all parents and all relations of each node as lists, in the order they are met.

    A node's lists are as long as its parents are many; found.ways has the same as rows, for walks without a cap.
    """
    pairs = F.array_sort(F.collect_list(F.struct("from_id", "relation")))
    lists = found.ways.groupBy("id").agg(pairs.alias("all"))
    lists = lists.select("id", F.array_distinct("all.from_id").alias("reached_from"), F.array_distinct("all.relation").alias("reached_by"))
    none, seed = F.array().cast("array<string>"), F.array(F.lit("seed"))
    return found.nodes.join(lists, "id", "left").select("id", "depth", F.coalesce("reached_from", none).alias("reached_from"), F.coalesce("reached_by", seed).alias("reached_by"))


@dataclass
class Graph:
    """nodes and edges of a projection; what caps left out, and edges that lead nowhere."""

    nodes: DataFrame
    edges: DataFrame
    walk: Walk | None
    complete: bool
    limited_by: str | None
    omitted_edges: int
    unresolved: DataFrame


def project(r: Relations, centers: list[str] | None = None, depth: int = 1, direction: str = "both", relations: list[str] | None = None,
            kinds: list[str] | None = None, max_nodes: int | None = None, max_edges: int | None = None, scope: str | None = None) -> Graph:
    """The graph of recorded facts, or the neighbourhood of centers. Relations are chosen before the walk, kinds after it (centers
    stay); caps keep the first nodes and edges in a stable order; a scope marks nodes and takes none away.

    Unknown centers, relations and directions are errors.
    """
    from attesta.operators.retrieve import in_scope

    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    if unknown := sorted(set(relations or []) - set(RELATIONS)):
        raise ValueError(f"unknown relations: {unknown}")
    docs = documents(r)
    known = {x["id"] for x in docs.where(F.col("id").isin(list(centers or []))).select("id").distinct().collect()}
    if missing := sorted(set(centers or []) - known):
        raise ValueError(f"unknown centers: {missing}")
    all_edges = cut(edges(r))
    kept = all_edges if relations is None else all_edges.where(F.col("relation").isin(relations))
    found, nodes = None, docs
    if centers:
        found = explore(adjacency(kept, direction), centers, depth, max_nodes)
        nodes = all_ways(found).join(docs, "id")
    labels = r.sources.select("id", F.col("ref").alias("label")).unionByName(r.derived.select("id", F.col("title").alias("label")))
    labels = labels.unionByName(r.projects.select("id", F.col("title").alias("label"))).unionByName(r.decisions.select("id", F.col("title").alias("label")))
    nodes = nodes.join(labels, "id", "left").join(degree(all_edges), "id", "left").na.fill(0, ["degree"])
    if kinds is not None:
        nodes = nodes.where(F.col("kind").isin(kinds) | F.col("id").isin(list(centers or [])))
    if scope is not None:
        nodes = nodes.join(in_scope(r, scope).withColumn("in_scope", F.lit(True)), "id", "left").na.fill(False, ["in_scope"])
    for end in ("source", "target"):
        kept = kept.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    kept = kept.withColumn("id", F.concat_ws(":", "relation", "source", "target"))
    complete = found is None or found.complete
    limited, omitted = None if complete else "max_nodes", 0
    if max_edges is not None:
        omitted = max(0, kept.count() - max_edges)
        if omitted:
            kept, complete, limited = first(kept, max_edges, "id"), False, limited or "max_edges"
    return Graph(nodes, kept.orderBy("id"), found, complete, limited, omitted, dangling(r))


def subgraph(r: Relations, centers: list[str], depth: int = 1, **options: object) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of project."""
    found = project(r, centers, depth, **options)
    return found.nodes, found.edges
