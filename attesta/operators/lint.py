"""Integrity rules: each is one plan from relations to findings(rule, severity, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.operators.reading import strip_targets
from attesta.sources.relations import Relations

#: The enumerations documents may use, and the operations a log entry may name.
DERIVED_TYPES = ["summary", "entity", "concept", "question", "insight"]
DERIVATIONS = ["extracted", "model-read", "synthesis"]
SCOPES = ["project", "global"]
DECISION_STATUS = ["proposed", "accepted"]
CAPTURES = ["full", "reference"]
LOG_VERBS = [
    "anchor", "capture", "challenge", "decision", "decline-candidate", "derive", "drift-check", "fold-candidate", "init",
    "lint", "map", "project", "promote-candidate", "reextract", "retier", "review", "stage-candidate", "supersede",
]
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
IDENTITY = r"^(git-blob:[0-9a-f]{40}|sha256:[0-9a-f]{64})$"
#: Source characters under which a summary may be longer than what it sums up.
COMPRESS_FLOOR = 500


def found(df: DataFrame, rule: str, severity: str, id_: str | Column, detail: str | Column) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), as_col(id_).alias("id"), as_col(detail).alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def documents(r: Relations) -> DataFrame:
    """(id, kind, type) of everything that can be referred to."""
    none = F.lit(None).cast("string")
    return union([
        r.sources.select("id", F.lit("source").alias("kind"), F.lit("source").alias("type")),
        r.derived.select("id", F.lit("derived").alias("kind"), "type"),
        r.projects.select("id", F.lit("project").alias("kind"), none.alias("type")),
        r.decisions.select("id", F.lit("decision").alias("kind"), none.alias("type")),
    ])


def unresolved(refs: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    return refs.join(docs.select(F.col("id").alias(key)), key, "left_anti").where(F.col(key).isNotNull())


def stale_pairs(r: Relations) -> DataFrame:
    """Provenance whose recorded hash is not the source's current one: (doc_id, source_id, status)."""
    current = r.sources.select(F.col("id").alias("source_id"), "content_hash")
    changed = r.provenance.join(current, "source_id").where(F.col("hash") != F.col("content_hash"))
    return changed.join(r.derived.select(F.col("id").alias("doc_id"), "status"), "doc_id").select("doc_id", "source_id", "status")


def l1(r: Relations) -> DataFrame:
    none = r.derived.join(r.provenance.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return found(none, "L1", "error", "id", F.lit("no sources"))


def l2(r: Relations) -> DataFrame:
    other = documents(r).where("kind <> 'source'").select(F.col("id").alias("source_id"))
    return found(r.provenance.join(other, "source_id", "left_semi"), "L2", "error", "doc_id", "source_id")


def l3(r: Relations) -> DataFrame:
    return found(unresolved(r.provenance, "source_id", documents(r)), "L3", "error", "doc_id", "source_id")


def l4(r: Relations) -> DataFrame:
    open_ = ~F.coalesce(F.col("status"), F.lit("")).isin("stale", "superseded")
    return found(stale_pairs(r).where(open_), "L4", "error", "doc_id", "source_id")


def l5(r: Relations) -> DataFrame:
    """Recorded hash of a source against that of the file it holds now."""
    return found(r.sources.where(F.col("content_hash") != F.col("held_hash")), "L5", "error", "id", "canonical")


def l6(ids: DataFrame) -> DataFrame:
    """All but one of the documents that share an id: one row each."""
    many = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = many.select("id", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("copy"))
    return found(rows, "L6", "error", "id", F.col("copy").cast("string"))


def l7(r: Relations) -> DataFrame:
    return found(unresolved(r.see_also, "target", documents(r)), "L7", "error", "doc_id", "target")


def l8(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents that are no link label of the index; index(text), a row a line."""
    labels = index.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]\("), F.lit(1))).alias("id"))
    return found(docs.join(labels, "id", "left_anti"), "L8", "error", "id", F.lit("not in the index"))


def flagged(df: DataFrame, rule: str, checks: list[tuple[str, Column, str | Column]]) -> DataFrame:
    """Findings of several checks (severity, condition, detail) in one pass over df."""
    one = lambda severity, detail: F.struct(F.lit(severity).alias("severity"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    hits = F.filter(F.array(*[F.when(holds, one(severity, detail)) for severity, holds, detail in checks]), lambda x: x.isNotNull())
    rows = df.select("id", F.explode(hits).alias("x"))
    return rows.select(F.lit(rule).alias("rule"), F.col("x.severity").alias("severity"), "id", F.col("x.detail").alias("detail"))


def l9(r: Relations) -> DataFrame:
    """Required fields of every kind that are null or empty, values outside their enumeration, sources without a file."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    lacks = lambda *names: [("error", empty(c), c) for c in names]
    return union([
        flagged(r.sources, "L9", [
            ("error", (F.col("capture") == "reference") & empty("capture_reason"), "capture_reason"),
            ("error", ~F.col("capture").isin(CAPTURES), F.col("capture")),
            *lacks("id", "type", "capture", "captured_at", "content_hash", "version"),
            ("error", ~F.col("has_origin"), "origin"), ("error", F.col("entries") == 0, "history"),
            ("error", F.col("canonical").isNull(), "canonical"),
        ]),
        flagged(r.derived, "L9", [
            *lacks("id", "type", "title", "derived_at", "status"), ("error", F.col("n_sources") == 0, "sources"),
            ("warn", ~F.coalesce("type", F.lit("?")).isin(DERIVED_TYPES), F.coalesce("type", F.lit("?"))),
        ]),
        flagged(r.projects, "L9", [*lacks("id", "type", "title"), ("error", ~F.col("has_members"), "members")]),
        flagged(r.decisions.withColumnRenamed("dated", "date"), "L9", lacks("id", "type", "title", "status", "date")),
    ])


def l10(r: Relations) -> DataFrame:
    tier = r.sources.select(F.col("id").alias("source_id"), "capture")
    own = r.provenance.join(tier, "source_id", "left").groupBy("doc_id").agg(
        F.bool_and(F.coalesce(F.col("capture") == "reference", F.lit(False))).alias("only"), F.count(F.lit(1)).alias("n")
    )
    return found(own.where("only"), "L10", "warn", "doc_id", F.col("n").cast("string"))


def l11(r: Relations) -> DataFrame:
    return found(unresolved(r.members, "member_id", documents(r)), "L11", "error", "project_id", "member_id")


def l12(manifest: DataFrame) -> DataFrame:
    """manifest(version): one row, or none."""
    n = manifest.where("version is not null").agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found(n, "L12", "error", F.lit("__manifest__"), F.lit("no version"))


def l13(r: Relations) -> DataFrame:
    """Files and text aids that the ledger names and that aren't there, and those that are there and it doesn't name."""
    named = r.versions.select("id", F.explode(F.array(F.struct("file", F.lit("").alias("kind")), F.struct(F.col("text_aid").alias("file"), F.lit("aid ").alias("kind")))).alias("x"))
    named = named.select("id", "x.*").where("coalesce(file, '') <> ''").distinct().withColumn("listed", F.lit(1))
    held = r.files.select("id", "file", F.when(F.col("file").startswith("source-text"), "aid ").otherwise("").alias("kind"), F.lit(1).alias("held"))
    both = named.join(held, ["id", "file", "kind"], "full_outer")
    why = F.when(F.col("held").isNull(), "missing ").when(F.col("listed").isNull(), "unlisted ")
    return found(both.where(why.isNotNull()), "L13", "error", "id", F.concat(why, "kind", "file"))


def l14(r: Relations) -> DataFrame:
    return found(r.derived.where(~F.col("derivation").isin(DERIVATIONS)), "L14", "error", "id", "derivation")


def l15(r: Relations) -> DataFrame:
    summaries = r.derived.where("type = 'summary'").select(F.col("id").alias("doc_id"))
    covered = r.provenance.join(summaries, "doc_id", "left_semi").select(F.col("source_id").alias("id"))
    return found(r.sources.join(covered, "id", "left_anti"), "L15", "error", "id", F.lit("no summary"))


def l16(r: Relations) -> DataFrame:
    return found(r.projects.where(~F.col("scope").isin(SCOPES)), "L16", "error", "id", "scope")


def l17(r: Relations) -> DataFrame:
    kinds = documents(r).select(F.col("id").alias("source_id"), "kind")
    cited = r.evidence.join(kinds, "source_id", "left")
    current = r.sources.select(F.col("id").alias("source_id"), F.col("version").alias("now"))
    return union([
        found(r.decisions.where(~F.col("status").isin(DECISION_STATUS)), "L17", "error", "id", "status"),
        found(cited.where("kind is null or kind <> 'source'"), "L17", "error", "decision_id", "source_id"),
        found(r.evidence.join(current, "source_id").where("now > version"), "L17", "warn", "decision_id", "source_id"),
    ])


def l18(r: Relations) -> DataFrame:
    """Summaries, abstract and body, longer than the sources they sum up; targets of citations don't count."""
    sizes = r.sources.select(F.col("id").alias("source_id"), F.length("text").alias("n"))
    held = r.provenance.join(sizes, "source_id").groupBy("doc_id").agg(F.sum("n").alias("n"))
    # documents whose sources are too short to matter, or that can't be too long, are not stripped
    head = F.length(F.coalesce("abstract", F.lit("")))
    own = r.derived.where("type = 'summary'").select(F.col("id").alias("doc_id"), head.alias("head"), F.coalesce("body", F.lit("")).alias("text"))
    own = own.join(held, "doc_id").where(f"n >= {COMPRESS_FLOOR}").where(F.col("head") + F.length("text") > F.col("n"))
    bare = strip_targets(own.withColumnRenamed("doc_id", "id"), documents(r))
    own = bare.select("id", "n", (F.col("head") + F.length("text")).alias("own"))
    return found(own.where("own > n"), "L18", "warn", "id", F.concat_ws("/", "own", "n"))


def l19(derived: DataFrame) -> DataFrame:
    """derived(id, title, abstract, body, self_hash) whose stamp is out of date."""
    own = H.self_hash(F.col("title"), F.col("abstract"), F.col("body"))
    return found(derived.where(F.col("self_hash") != own), "L19", "error", "id", F.lit("self_hash"))


def l20(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Anchors that don't hold together, and declared excerpts that have none at their current version.

    versions(id, version, upstream_identity, anchored_at), a row an entry of the ledger; sources(id, version, upstream_ref).
    """
    whole = sources.select("id", F.col("version").alias("now"), F.nullif("upstream_ref", F.lit("")).alias("whole"))
    rows = versions.select("id", "version", "upstream_identity", "anchored_at").join(whole, "id")
    given = F.col("upstream_identity").isNotNull()
    anchored = versions.where(given).select("id", F.col("version").alias("now"))
    bare = whole.where("whole is not null").join(anchored, ["id", "now"], "left_anti")
    checks = flagged(rows, "L20", [
        ("error", given & ~F.col("upstream_identity").rlike(IDENTITY), "form"), ("error", given & F.col("whole").isNull(), "upstream_ref"),
        ("error", ~given & (F.coalesce("anchored_at", F.lit("")) != ""), "identity"),
    ])
    return checks.unionByName(found(bare, "L20", "error", "id", F.lit("unanchored")))


def l21(r: Relations) -> DataFrame:
    """Endings that don't cohere: a closed document without stamp, or without successor and reason, a successor that is
    nothing or itself, and fields of an ending where there is none."""
    known = documents(r).select(F.col("id").alias("superseded_by"), F.lit(True).alias("known")).distinct()
    d = r.derived.join(known, "superseded_by", "left")
    closed = F.coalesce(F.col("status") == "superseded", F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    by = F.col("superseded_by")
    left = [("error", ~closed & F.col(c).isNotNull(), F.concat(F.lit("not closed: "), F.lit(c))) for c in ("superseded_by", "superseded_at", "supersede_reason")]
    return flagged(d, "L21", [
        ("error", closed & blank("superseded_at"), "superseded_at"), ("error", closed & by.isNull() & blank("supersede_reason"), "no successor"),
        ("error", closed & (by == F.col("id")), "itself"), ("error", closed & (by != F.col("id")) & F.col("known").isNull(), by), *left,
    ])


def l22(rendered: DataFrame, index: DataFrame) -> DataFrame:
    """Index lines that a new rendering would not write, or would add; both have (line)."""
    extra = index.exceptAll(rendered).select("line", F.lit("stale line").alias("why"))
    lacking = rendered.exceptAll(index).select("line", F.lit("missing line").alias("why"))
    return found(extra.unionByName(lacking), "L22", "error", F.get_json_object("line", "$.id"), "why")


def l23(r: Relations) -> DataFrame:
    entry = F.col("seq").cast("string")
    log = r.log.select("seq", "stamp", "op").distinct()  # a check of several sources is one entry
    return union([
        found(log.where(~F.col("stamp").rlike(STAMP)), "L23", "warn", entry, "stamp"),
        found(log.where(~F.col("op").isin(LOG_VERBS) & (F.col("op") != "")), "L23", "warn", entry, "op"),
    ])


def l24(r: Relations) -> DataFrame:
    return found(r.derived.where(T.is_path(F.col("body"))), "L24", "warn", "id", F.lit("path as body"))


def l25(r: Relations) -> DataFrame:
    """Authored fields that look twice encoded, the first of each document."""
    field = F.when(T.garbled(F.col("title")), "title")
    derived = field.when(T.garbled(F.col("abstract")), "abstract").when(T.garbled(F.col("body")), "body")
    decided = field.when(T.garbled(F.col("body")), "body")
    rows = union([
        r.derived.select("id", derived.alias("field")), r.decisions.select("id", decided.alias("field")), r.projects.select("id", field.alias("field")),
    ])
    return found(rows.where("field is not null"), "L25", "warn", "id", "field")


def l26(r: Relations) -> DataFrame:
    return union([
        found(r.derived.where("authored_by <> 'adapter'"), "L26", "warn", "id", "authored_by"),
        found(r.decisions.where("authored_by <> 'operator'"), "L26", "warn", "id", "authored_by"),
    ])


RULES = {
    "L1": l1, "L2": l2, "L3": l3, "L4": l4, "L5": l5, "L7": l7, "L9": l9, "L10": l10, "L11": l11, "L13": l13, "L14": l14,
    "L15": l15, "L16": l16, "L17": l17, "L18": l18, "L21": l21, "L23": l23, "L24": l24, "L25": l25, "L26": l26,
}


def registered(r: Relations) -> DataFrame:
    """Ids as they were registered: a source once a version."""
    return documents(r).select("id").unionByName(r.versions.select("id"))


def findings(r: Relations, ids: DataFrame | None = None) -> DataFrame:
    """All findings; ids(id), once a registration, are those that may stand twice: documents(r) for a real base."""
    return union([*(rule(r) for rule in RULES.values()), l6(registered(r) if ids is None else ids)])


def ordered(rows: DataFrame) -> DataFrame:
    """Errors first, then by the rule's name as text."""
    return rows.orderBy(F.col("severity") != "error", "rule", "id", "detail")


def summary(r: Relations, ids: DataFrame | None = None) -> DataFrame:
    counts = findings(r, ids).agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings")
    )
    return counts.crossJoin(documents(r).agg(F.count(F.lit(1)).alias("docs")))


def entry_due(runs: DataFrame, payload: DataFrame) -> DataFrame:
    """payload(payload), one row, if it is not that of the last of runs(seq, payload)."""
    last = runs.agg(F.max_by("payload", "seq").alias("last"))
    return payload.crossJoin(last).where("not (payload <=> last)").select("payload")
