"""Writing to a real base: capture, derive, supersede, stamp, relink, views and the index, as files.

What is to be written is a table (path, text). Executors write it to a hidden folder inside the base, a file a path; when all of
it is there a marker is published, and then files are renamed to their places, those that carry heads last. A lost task or
executor is Spark's to repeat and leaves nothing behind; a lost driver leaves either a folder without a marker, which is
dropped, or one with it, which `resume` puts in place: renaming again does no harm. Names of the files that change pass the driver,
their contents don't. There is one writer.

Heads keep fields this engine doesn't know, in their order. Operations return what came of each row (id, outcome), decided
before anything is written; what is refused changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.functions.lineage import cut
from attesta.operators import capture as C
from attesta.operators import lint
from attesta.operators import project as P
from attesta.operators import reading as R
from attesta.sources import base, repository, storage
from attesta.sources.relations import Relations

#: The folder of each type of derived document, and the types whose quotations are always checked.
FOLDER = {"summary": "summaries", "entity": "entities", "concept": "concepts", "question": "questions", "insight": "insights"}
QUOTED = ["entity", "concept", "question", "insight"]
STAGING = ".staging-"


def _dumped(head: str | None, patch: str | None) -> str:
    """A head as YAML after a patch: null takes a field away, anything else sets it."""
    import yaml

    own = json.loads(head or "{}")
    for k, v in json.loads(patch or "{}").items():
        if v is None:
            own.pop(k, None)
        else:
            own[k] = v
    return yaml.safe_dump(own, allow_unicode=True, sort_keys=False)


def head_text(head: Column, patch: Column) -> Column:
    """Arrow-batched _dumped."""

    @F.pandas_udf("string")
    def run(heads: pd.Series, patches: pd.Series) -> pd.Series:
        return pd.Series([_dumped(h, p) for h, p in zip(heads, patches)], dtype=object)

    return run(head, patch)


def document(head: Column, patch: Column, body: Column) -> Column:
    """A document's whole text: its head between rules, and its body with a line end."""
    ended = F.when(F.endswith(body, F.lit("\n")), body).otherwise(F.concat(body, F.lit("\n")))
    return F.concat(F.lit("---\n"), head_text(head, patch), F.lit("---\n"), ended)


def patch_of(**fields: Column) -> Column:
    """A patch as JSON: nulls stay, and take fields away."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def write(spark: SparkSession, root: str, rows: DataFrame, aside: list[tuple[str, str]] | None = None) -> int:
    """Put rows(path, text) in place, paths relative to the base and each once; how many files. aside: files to be renamed first,
    unless what they are renamed to is there already."""
    staging = f"{root}/{STAGING}{uuid.uuid4().hex}"
    # the writer ends every row with a line end: it is taken off where the text has none
    bare = ~F.endswith("text", F.lit("\n"))
    text = F.when(bare, F.col("text")).otherwise(F.expr("left(text, length(text) - 1)"))
    place = F.concat("path", F.when(bare, "!").otherwise(""))
    rows.select(text.alias("value"), place.alias("path")).repartition("path").write.partitionBy("path").text(f"{staging}/files")
    storage.publish(spark, f"{staging}/ready", json.dumps(aside or []))
    return _place(spark, root, staging)


def _place(spark: SparkSession, root: str, staging: str) -> int:
    for old, new in json.loads(storage.read(spark, f"{staging}/ready")):
        if storage.exists(spark, f"{root}/{old}") and not storage.exists(spark, f"{root}/{new}"):
            storage.move(spark, f"{root}/{old}", f"{root}/{new}")
    found = [f for f in storage.folders(spark, f"{staging}/files") if f.startswith("path=")]
    for f in sorted(found, key=lambda f: (f.endswith("meta.yml"), f)):
        parts = [x for x in storage.folders(spark, f"{staging}/files/{f}") if x.startswith("part-")]
        if parts:  # else it was put in place before the driver was lost
            at, target = f"{staging}/files/{f}/{parts[0]}", unquote(f.removeprefix("path="))
            if target.endswith("!"):
                target = target.removesuffix("!")
                bare = f"{staging}/bare-{uuid.uuid4().hex}"
                storage.move(spark, at, bare)
                storage.shorten(spark, bare)
                at = bare
            storage.move(spark, at, f"{root}/{target}")
    storage.remove(spark, staging)
    return len(found)


def resume(spark: SparkSession, root: str) -> dict[str, int]:
    """Finish or drop what a lost driver left: {placed, dropped}."""
    done = {"placed": 0, "dropped": 0}
    for f in storage.folders(spark, root):
        if f.startswith(STAGING):
            if storage.exists(spark, f"{root}/{f}/ready"):
                _place(spark, root, f"{root}/{f}")
                done["placed"] += 1
            else:
                storage.remove(spark, f"{root}/{f}")
                done["dropped"] += 1
    return done


def log(spark: SparkSession, root: str, now: str, lines: DataFrame) -> None:
    """Append entries, lines(line) in their order, to the operations log."""
    own = "".join(f"## [{now}] {r['line']}\n" for r in lines.orderBy("line").toLocalIterator())
    if own:
        storage.append(spark, f"{root}/log.md", own if storage.exists(spark, f"{root}/log.md") else "# Log\n" + own)


def operation(name: str) -> Callable:
    """An operation that writes: refused in a read-only session, and after what a lost one left has been put in order."""

    def wrap(run: Callable) -> Callable:
        def guarded(spark: SparkSession, root: str, *args: object, **options: object) -> DataFrame:
            C.guard(spark, name)
            resume(spark, root)
            return run(spark, root, *args, **options)

        guarded.__doc__ = run.__doc__
        return guarded

    return wrap


def _first(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(holds, reason) for holds, reason in checks])


@operation("derive")
def derive(spark: SparkSession, root: str, drafts: DataFrame, now: str) -> DataFrame:
    """Write derived documents; drafts(id, type, title, abstract, body, sources array<string>, derivation, as_of, see_also array<string>,
    connectors array<struct<system, ref>>, tags array<string>). (id, outcome): derived, or why not.

    Every source must be one; hashes are those it has now. Quotations of all types but summaries, and of summaries that are
    written anew, must stand in what they cite. A closed document is not written over.
    """
    own = base.entries(spark, root)
    r = base.load(spark, root, own)
    drafts = cut(drafts)
    held = base.documents(own, *base.FOLDERS).select("id", F.lit(True).alias("held"), (F.col("status") == "superseded").alias("closed"))
    prov = drafts.select("id", F.posexplode("sources").alias("ord", "source_id")).join(r.sources.select(F.col("id").alias("source_id"), F.col("content_hash").alias("hash"), F.lit(True).alias("known")), "source_id", "left")
    lists = prov.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id", "hash"))), lambda x: F.struct(x["source_id"].alias("id"), x["hash"].alias("hash"))).alias("pairs"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("grounded"),
    )
    texts = r.sources.select("id", "text")
    bad = R.quote_gate(drafts.select("id", F.col("body").alias("text")), prov.select(F.col("id").alias("doc_id"), "source_id"), texts).where("not ok").select("id", F.lit(True).alias("misquotes")).distinct()
    rows = drafts.join(held, "id", "left").join(lists, "id", "left").join(bad, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = _first(
        (~T.is_id(F.col("id")), "bad id"), (~F.coalesce(F.col("type").isin(list(FOLDER)), F.lit(False)), "unknown type"), (F.coalesce("title", F.lit("")) == "", "no title"),
        (F.coalesce(F.size("sources"), F.lit(0)) < 1, "no sources"), (F.col("derivation").isNotNull() & ~F.col("derivation").isin(lint.DERIVATIONS), "unknown derivation"),
        (~no("grounded"), "unknown source"), ((F.col("type").isin(QUOTED) | no("held")) & no("misquotes"), "misquotes"), (no("closed"), "superseded"),
    )
    rows = cut(rows.withColumn("outcome", F.coalesce(reason, F.lit("derived"))))
    good = rows.where("outcome = 'derived'")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    fields = [
        "id", "type", "title", F.lit("adapter").alias("authored_by"), F.nullif("abstract", F.lit("")).alias("abstract"), F.col("pairs").alias("sources"), F.lit(now).alias("derived_at"),
        F.nullif("as_of", F.lit("")).alias("as_of"), some("see_also").alias("see_also"), some("connectors").alias("connectors"), F.lit("current").alias("status"), "derivation", some("tags").alias("tags"),
        H.self_hash(F.col("title"), F.col("abstract"), F.col("body")).alias("self_hash"),
    ]
    folder = F.element_at(F.create_map(*[F.lit(x) for kv in FOLDER.items() for x in kv]), F.col("type"))
    text = document(F.to_json(F.struct(*fields)), F.lit("{}"), F.coalesce("body", F.lit("")))
    write(spark, root, good.select(F.concat_ws("/", folder, F.concat("id", F.lit(".md"))).alias("path"), text.alias("text")))
    log(spark, root, now, good.select(F.concat(F.lit("derive | "), "type", F.lit(" | "), "id", F.lit(" <- "), F.array_join("sources", ", ")).alias("line")))
    return rows.select("id", "outcome")


@operation("supersede")
def supersede(spark: SparkSession, root: str, changes: DataFrame, now: str) -> DataFrame:
    """Close documents, or open them again with lift; changes(id, by, reason, lift). (id, outcome): superseded, lifted, unchanged, or why not.

    Only the fields of the ending change. A document needs a successor or a reason; the successor must be there, and be another.
    """
    own = base.entries(spark, root)
    docs = base.documents(own, *base.FOLDERS).select("id", "path", "body", "status", "superseded_by", "supersede_reason").join(own.select("path", "json"), "path")
    known = lint.documents(base.load(spark, root, own)).where("kind in ('derived', 'decision')").select(F.col("id").alias("by"), F.lit(True).alias("known")).distinct()
    rows = changes.select("id", "by", F.nullif(T.strip(F.coalesce("reason", F.lit(""))), F.lit("")).alias("reason"), F.coalesce("lift", F.lit(False)).alias("lift"))
    rows = rows.join(docs, "id", "left").join(known, "by", "left")
    closed = F.coalesce(F.col("status") == "superseded", F.lit(False))
    same = closed & F.col("superseded_by").eqNullSafe(F.col("by")) & F.col("supersede_reason").eqNullSafe(F.col("reason"))
    outcome = (
        F.when(F.col("path").isNull(), "unknown document").when(F.col("lift"), F.when(closed, "lifted").otherwise("unchanged"))
        .when(F.col("by").isNull() & F.col("reason").isNull(), "no successor and no reason").when(F.col("by") == F.col("id"), "itself")
        .when(F.col("by").isNotNull() & F.col("known").isNull(), "unknown successor").when(same, "unchanged").otherwise("superseded")
    )
    rows = cut(rows.withColumn("outcome", outcome))
    none = F.lit(None).cast("string")
    ended = patch_of(status=F.lit("superseded"), superseded_by=F.coalesce("by", "superseded_by"), superseded_at=F.lit(now), supersede_reason=F.coalesce("reason", "supersede_reason"))
    opened = patch_of(status=F.lit("current"), superseded_by=none, superseded_at=none, supersede_reason=none)
    good = rows.where("outcome in ('superseded', 'lifted')")
    write(spark, root, good.select("path", document(F.col("json"), F.when(F.col("lift"), opened).otherwise(ended), F.col("body")).alias("text")))
    line = F.when(F.col("lift"), F.concat(F.lit("supersede | lifted | "), "id")).otherwise(F.concat(F.lit("supersede | "), "id", F.coalesce(F.concat(F.lit(" -> "), "by"), F.lit("")), F.coalesce(F.concat(F.lit(" ("), "reason", F.lit(")")), F.lit(""))))
    log(spark, root, now, good.select(line.alias("line")))
    return rows.select("id", "outcome")


def _rewritten(spark: SparkSession, root: str, own: DataFrame, rows: DataFrame, patch: Column) -> int:
    """Write documents rows(path, body, ...) anew with a patch of their heads."""
    return write(spark, root, cut(rows.join(own.select("path", "json"), "path").select("path", document(F.col("json"), patch, F.col("body")).alias("text"))))


@operation("stamp")
def stamp(spark: SparkSession, root: str) -> int:
    """Stamp derived documents that have no stamp; how many."""
    own = base.entries(spark, root)
    rows = base.documents(own, *base.FOLDERS).where("self_hash is null")
    return _rewritten(spark, root, own, rows, patch_of(self_hash=H.self_hash(F.col("title"), F.col("abstract"), F.col("body"))))


@operation("relink")
def relink(spark: SparkSession, root: str) -> int:
    """Make bare citations of known ids in derived documents and decisions into links, and put stamps anew; how many documents changed."""
    own = base.entries(spark, root)
    rows = base.documents(own, *base.FOLDERS, "decisions")
    held = base.sources(spark, root, own)
    aid = F.element_at(F.expr("filter(history, h -> h.version = version)"), 1)["text_aid"]
    paths = held.where("canonical is not null").select("id", F.concat_ws("/", F.lit("sources"), "folder", F.coalesce(aid, F.col("canonical"))).alias("path"))
    paths = paths.unionByName(base.documents(own, *base.DOCUMENTS).select("id", "path"))
    new = R.relinked(rows.select("id", "title", "abstract", "body", "self_hash"), paths).select("id", F.col("body").alias("new"), F.col("self_hash").alias("stamp"))
    rows = rows.join(new, "id").where(F.col("new") != F.col("body")).withColumn("body", F.col("new"))
    keep = F.when(F.col("stamp").isNotNull(), F.to_json(F.struct(F.col("stamp").alias("self_hash")))).otherwise("{}")
    return _rewritten(spark, root, own, rows, keep)


@operation("project")
def project(spark: SparkSession, root: str, changes: DataFrame, now: str) -> DataFrame:
    """Make or change views; changes(id, title, scope, description, add array<string>, remove array<string>). (id, outcome).

    Members keep their order, new ones follow, and then those to remove go. Nulls change nothing. The page lists members by what
    covers or names them.
    """
    own = base.entries(spark, root)
    r = base.load(spark, root, own)
    views = base.documents(own, "projects")
    views = views.join(own.select("path", "json"), "path").select("id", F.col("title").alias("old_title"), F.col("scope").alias("old_scope"), F.col("members").alias("old"), "json", F.variant_get("raw", "$.description", "string").alias("old_description"))
    rows = changes.join(views, "id", "left")
    rows = rows.select("id", F.coalesce("title", "old_title").alias("title"), F.coalesce("scope", "old_scope", F.lit("project")).alias("scope"), F.coalesce("description", "old_description").alias("description"), "old", "add", "remove", F.coalesce("json", F.lit("{}")).alias("json"))
    none = F.array().cast("array<string>")
    members = F.array_except(F.array_union(F.coalesce("old", none), F.coalesce("add", none)), F.coalesce("remove", none))
    reason = _first((~T.is_id(F.col("id")), "bad id"), (F.coalesce("title", F.lit("")) == "", "no title"), (~F.col("scope").isin(lint.SCOPES), "unknown scope"))
    rows = cut(rows.withColumn("members", members).withColumn("outcome", F.coalesce(reason, F.lit("written"))))
    good = rows.where("outcome = 'written'")
    blurbs = P.blurbs(r).unionByName(r.derived.select("id", F.concat_ws(" — ", "title", F.nullif("abstract", F.lit(""))).alias("blurb")))
    blurbs = blurbs.unionByName(r.decisions.select("id", F.col("title").alias("blurb"))).unionByName(r.projects.select("id", F.col("title").alias("blurb")))
    each = good.select("id", F.posexplode("members").alias("ord", "member_id")).join(blurbs.select(F.col("id").alias("member_id"), "blurb"), "member_id", "left")
    line = F.concat(F.lit("- ["), "member_id", F.lit("]"), F.coalesce(F.concat(F.lit(" — "), "blurb"), F.lit("")))
    lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    body = F.concat_ws("\n\n", F.nullif("description", F.lit("")), F.concat(F.lit("## Members\n\n"), F.coalesce(F.array_join("lines.line", "\n"), F.lit("(none)"))))
    patch = F.struct("id", F.lit("project").alias("type"), "title", F.nullif("description", F.lit("")).alias("description"), "members", F.when(F.col("scope") != "project", F.col("scope")).alias("scope"))
    text = document(F.col("json"), F.to_json(patch), body)
    write(spark, root, good.join(lists, "id", "left").select(F.concat(F.lit("projects/"), "id", F.lit(".md")).alias("path"), text.alias("text")))
    log(spark, root, now, good.select(F.concat(F.lit("project | "), "id", F.lit(" <- "), F.coalesce(F.nullif(F.array_join("members", ", "), F.lit("")), F.lit("(empty)"))).alias("line")))
    return rows.select("id", "outcome")


#: Formats whose bytes are text, and the only ones that are taken in here.
PLAIN = [".md", ".txt"]


@operation("capture")
def capture(spark: SparkSession, root: str, batch: DataFrame, now: str, force_new: bool = False, allow_large: bool = False) -> DataFrame:
    """Take texts in as sources, in order of seq; batch(seq, id, system, ref, filename, text, tier, reason). What C.capture says of each row
    (seq, id, action, target, version); a row that may not be captured at all is refused.

    Each version's bytes stay: those that a newer one replaces are kept as `source.v<n>`, whether they lay in the base or
    came with the same batch. The head, with the whole ledger, is put in place last.
    """
    own = base.entries(spark, root)
    held = base.sources(spark, root, own)
    end = T.suffix(F.col("filename"))
    rows = batch.withColumn("end", end).withColumn("tier", F.coalesce("tier", F.lit("full")))
    bad = _first((~T.is_id(F.col("id")), "bad id"), (~end.isin(PLAIN), "no text format"), (~F.col("tier").isin(lint.CAPTURES), "unknown tier"),
                 ((F.col("tier") == "reference") & (F.coalesce("reason", F.lit("")) == ""), "no reason"))
    rows = rows.withColumn("bad", bad).withColumn("hash", H.text_hash(F.col("text"))).withColumn("size", F.when(F.col("tier") == "full", F.octet_length("text")).otherwise(0))
    rows = cut(rows)
    found = cut(C.capture(rows.where("bad is null"), held.select("id", "ref", F.col("content_hash").alias("hash"), "version"), force_new, allow_large))
    taken = rows.join(found.where("action in ('created', 'versioned')").select("seq", "version"), "seq")
    last = taken.groupBy("id").agg(F.max("version").alias("last"))
    taken = taken.join(last, "id")
    name = F.when(F.col("version") == F.col("last"), F.concat(F.lit("source"), "end")).otherwise(F.concat(F.lit("source.v"), "version", "end"))
    taken = taken.withColumn("file", name)
    before = held.select("id", "folder", "canonical", F.col("version").alias("was")).join(last, "id").where("canonical is not null")
    before = cut(before.withColumn("kept", F.concat(F.lit("source.v"), "was", T.suffix(F.col("canonical")))))
    # names alone
    aside = [(f"sources/{x['folder']}/{x['canonical']}", f"sources/{x['folder']}/{x['kept']}") for x in before.toLocalIterator()]
    entry = F.struct("version", F.col("hash").alias("content_hash"), F.lit(now).alias("captured_at"), "file", F.when(F.col("version") > 1, F.col("version") - 1).alias("supersedes"))
    new = taken.groupBy("id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max_by("hash", "version").alias("hash"), F.min_by(F.struct("system", "ref", "tier", "reason"), "version").alias("made"), F.max("version").alias("version"),
    )
    old = own.where("part = 'sources'").select(F.col("name").alias("folder"), "json").join(held.select("id", "folder"), "folder")
    heads = new.join(old, "id", "left").join(before.select("id", "was", "kept"), "id", "left")
    ledger = F.from_json("json", "history array<map<string,string>>")["history"]
    first = F.struct(
        "id", F.lit("source").alias("type"), F.struct(F.col("made.system").alias("system"), F.col("made.ref").alias("ref"), F.lit(True).alias("recoverable")).alias("origin"),
        F.col("made.tier").alias("capture"), F.col("made.reason").alias("capture_reason"),
    )
    heads = heads.select("id", F.coalesce("folder", "id").alias("folder"), F.coalesce("json", F.to_json(first)).alias("json"), "was", "kept", "hash", "version", F.to_json("entries").alias("entries"), ledger.isNotNull().alias("older"))
    text = ledger_text(F.col("json"), F.to_json(F.struct(F.lit(now).alias("captured_at"), F.col("hash").alias("content_hash"), "version")), F.col("entries"), F.col("was"), F.col("kept"))
    files = taken.join(heads.select("id", "folder"), "id").select(F.concat_ws("/", F.lit("sources"), "folder", "file").alias("path"), "text")
    files = files.unionByName(heads.select(F.concat_ws("/", F.lit("sources"), "folder", F.lit("meta.yml")).alias("path"), text.alias("text")))
    write(spark, root, cut(files), aside)
    refused = rows.where("bad is not null").select("seq", "id", F.lit("refused").alias("action"), F.col("bad").alias("target"), F.lit(None).cast("int").alias("version"))
    out = found.unionByName(refused)
    line = F.when(F.col("action") == "created", F.concat(F.lit("capture | created | "), "id")).when(F.col("action") == "versioned", F.concat(F.lit("capture | version "), "version", F.lit(" | "), "id")).otherwise(F.concat(F.lit("capture | dedup | "), "target"))
    log(spark, root, now, out.where("action <> 'refused'").select(line.alias("line")))
    return out


@operation("record-decision")
def decide(spark: SparkSession, root: str, changes: DataFrame, now: str) -> DataFrame:
    """Record decisions, or amend them; changes(id, title, body, status, evidence array<string>, amend). (id, outcome): recorded, amended, or why not.

    Evidence is the source at its version now; what a decision cites already stays at its version, its date stays, and an amendment
    stands on top of what was said.
    """
    own = base.entries(spark, root)
    held = base.documents(own, "decisions").join(own.select("path", "json"), "path")
    held = held.select("id", F.col("title").alias("old_title"), F.col("status").alias("old_status"), F.col("date").alias("old_date"), F.col("body").alias("old_body"), F.col("evidence").alias("old"), "json")
    now_at = base.heads(own).select(F.col("id").alias("source_id"), F.coalesce("version", F.lit(1)).alias("version"))
    cited = changes.select("id", F.posexplode("evidence").alias("ord", "source_id")).join(now_at, "source_id", "left")
    cited = cited.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id", "version"))), lambda x: F.struct(x["source_id"].alias("id"), x["version"].alias("version"))).alias("new"), F.count_if(F.col("version").isNull()).alias("unknown"))
    rows = changes.withColumn("amend", F.coalesce("amend", F.lit(False))).join(held, "id", "left").join(cited, "id", "left")
    there, amend = F.col("json").isNotNull(), F.col("amend")
    rows = rows.withColumn("title", F.coalesce("title", F.when(amend, F.col("old_title")))).withColumn("status", F.coalesce("status", F.when(amend, F.col("old_status")), F.lit("accepted")))
    reason = _first(
        (~T.is_id(F.col("id")), "bad id"), (amend & ~there, "nothing to amend"), (~amend & there, "there already"), (F.coalesce("unknown", F.lit(0)) > 0, "unknown evidence"),
        (F.coalesce("title", F.lit("")) == "", "no title"), (~F.col("status").isin(lint.DECISION_STATUS), "unknown status"),
    )
    rows = cut(rows.withColumn("outcome", F.coalesce(reason, F.when(amend, "amended").otherwise("recorded"))))
    good = rows.where("outcome in ('recorded', 'amended')")
    pair = "array<struct<id:string,version:int>>"
    old = F.transform(F.coalesce("old", F.array().cast(base.PAIR)), lambda x: F.struct(x["id"].alias("id"), x["version"].alias("version"))).cast(pair)
    fresh = F.filter(F.coalesce(F.col("new").cast(pair), F.array().cast(pair)), lambda x: ~F.coalesce(F.array_contains(F.col("old.id"), x["id"]), F.lit(False)))
    evidence = F.concat(old, fresh)
    day = F.lit(now[:10])
    head = F.struct("id", F.lit("decision").alias("type"), "title", "status", F.coalesce("old_date", day).alias("date"), F.lit("operator").alias("authored_by"), F.when(F.size(evidence) > 0, evidence).alias("evidence"))
    body = F.when(amend, F.concat(F.lit(f"**AMENDED ({now[:10]}):** "), T.strip(F.col("body")), F.lit("\n\n"), F.regexp_replace("old_body", r"^\n+", ""))).otherwise(F.col("body"))
    write(spark, root, good.select(F.concat(F.lit("decisions/"), "id", F.lit(".md")).alias("path"), document(F.coalesce("json", F.lit("{}")), F.to_json(head), body).alias("text")))
    log(spark, root, now, good.select(F.concat(F.lit("decision | "), "outcome", F.lit(" | "), "id").alias("line")))
    return rows.select("id", "outcome")


@operation("promote-candidate")
def fold(spark: SparkSession, root: str, candidates: DataFrame, now: str) -> DataFrame:
    """Fold candidates into documents; candidates(id, into, body, sources array<string>, derivation, as_of). (id, outcome): folded, or why not.

    A document gets the blocks of its candidates at its end, their new sources at the hashes they have now (its own stay as
    recorded: folding heals nothing), the weakest of the derivations, and a new stamp. A dated candidate is refused: its date would be the whole document's.
    """
    own = base.entries(spark, root)
    docs = base.documents(own, *base.FOLDERS).join(own.select("path", "json"), "path")
    docs = docs.select(F.col("id").alias("into"), "path", "json", "title", "abstract", F.col("body").alias("old_body"), F.col("derivation").alias("old_derivation"), F.col("sources").alias("old"), F.lit(True).alias("held"))
    current = base.heads(own).select(F.col("id").alias("source_id"), F.col("content_hash").alias("hash"), F.lit(True).alias("known"))
    each = candidates.select("id", "into", F.posexplode_outer("sources").alias("ord", "source_id")).join(current, "source_id", "left")
    bad = each.where("source_id is not null and known is null").select("id").distinct().withColumn("ungrounded", F.lit(True))
    rows = candidates.join(docs.select("into", "held"), "into", "left").join(bad, "id", "left")
    reason = _first(
        (F.col("held").isNull(), "unknown document"), (F.coalesce("as_of", F.lit("")) != "", "dated"), (F.col("ungrounded").isNotNull(), "unknown source"),
        (F.col("derivation").isNotNull() & ~F.col("derivation").isin(lint.DERIVATIONS), "unknown derivation"),
    )
    rows = cut(rows.withColumn("outcome", F.coalesce(reason, F.lit("folded"))))
    good = rows.where("outcome = 'folded'")
    blocks = good.groupBy("into").agg(F.array_sort(F.collect_list(F.struct("id", T.strip(F.col("body")).alias("block")))).alias("blocks"), C.weakest(F.col("derivation")).alias("rung"), F.count("derivation").alias("rungs"))
    new = each.join(good.select("id"), "id", "left_semi").where("source_id is not null").join(docs.select("into", F.explode("old.id").alias("source_id")), ["into", "source_id"], "left_anti")
    new = new.groupBy("into", "source_id", "hash").agg(F.min(F.struct("id", "ord")).alias("first")).groupBy("into").agg(F.array_sort(F.collect_list(F.struct("first", "source_id", "hash"))).alias("new"))
    pair = "array<struct<id:string,hash:string>>"
    old = F.transform("old", lambda x: F.struct(x["id"].alias("id"), x["hash"].alias("hash"))).cast(pair)
    more = F.transform("new", lambda x: F.struct(x["source_id"].alias("id"), x["hash"].alias("hash"))).cast(pair)
    out = docs.join(blocks, "into").join(new, "into", "left")
    body = F.concat(F.regexp_replace("old_body", r"\n+$", ""), F.lit("\n\n"), F.array_join("blocks.block", "\n\n"), F.lit("\n"))
    rank = F.array(*[F.lit(d) for d in C.DERIVATION_RANK])
    # the later of the two in the order of derivations is the weaker
    weaker = F.element_at(rank, F.greatest(F.array_position(rank, F.coalesce("old_derivation", F.lit("extracted"))), F.array_position(rank, F.col("rung"))).cast("int"))
    rung = F.when((F.col("rungs") > 0) | F.col("old_derivation").isNotNull(), weaker)
    out = out.withColumn("text", body).withColumn("derivation", rung)
    patch = F.struct(F.concat(F.coalesce(old, F.array().cast(pair)), F.coalesce(more, F.array().cast(pair))).alias("sources"), "derivation", F.lit(now).alias("derived_at"), H.self_hash(F.col("title"), F.col("abstract"), F.col("text")).alias("self_hash"))
    write(spark, root, out.select("path", document(F.col("json"), F.to_json(patch), F.col("text")).alias("text")))
    log(spark, root, now, good.select(F.concat(F.lit("fold-candidate | "), "id", F.lit(" -> "), "into").alias("line")))
    return rows.select("id", "outcome")


@operation("queue-create")
def enqueue(spark: SparkSession, root: str, tasks: DataFrame, now: str) -> DataFrame:
    """Write task files; tasks(seq, type, outcome, inputs array<string>, created_by). (seq, id, outcome): created, or why not. Ids come from the
    time and the type; those that are taken, here or in the queue, get the next free number."""
    stamp = F.concat(F.lit(f"task-{now[:10].replace('-', '')}-{now[11:19].replace(':', '')}-"), "type")
    reason = _first((~F.coalesce(F.col("type").isin(C.TASK_TYPES), F.lit(False)), "unknown type"), (T.strip(F.coalesce("outcome", F.lit(""))) == "", "no outcome"))
    rows = tasks.select("seq", "type", T.strip(F.col("outcome")).alias("wanted"), "inputs", F.coalesce("created_by", F.lit("core")).alias("by"), stamp.alias("stem"), F.coalesce(reason, F.lit("created")).alias("outcome"))
    held = base.files(spark, [f"{root}/queue"], "task-*.md").select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("name"))
    # a stem's taken numbers: none is 1
    taken = held.join(rows.select("stem").distinct(), F.col("name").startswith(F.col("stem"))).select("stem", F.coalesce(F.regexp_extract("name", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("n"), F.col("name") == F.col("stem"))
    top = taken.groupBy("stem").agg(F.max("n").alias("top"))
    good = rows.where("outcome = 'created'").join(top, "stem", "left")
    n = F.row_number().over(Window.partitionBy("stem").orderBy("seq")) + F.coalesce("top", F.lit(0))
    good = good.withColumn("id", F.concat("stem", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")))
    given = F.filter(F.transform(F.coalesce("inputs", F.array().cast("array<string>")), lambda x: T.strip(x)), lambda x: x != "")
    lines = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("type: "), "type"), F.lit("status: pending"), F.concat(F.lit("created_by: "), "by"), F.lit(f"created_at: {now}"),
                        F.when(F.size(given) > 0, F.concat(F.lit("inputs:\n  - "), F.array_join(given, "\n  - "))), F.lit("---"), F.lit(""), "wanted", F.lit(""),
                        F.lit("Results are staged for review; the task writes nothing to the base itself."), F.lit(""), F.lit("## Log"), F.concat(F.lit(f"- {now} created ("), "by", F.lit(")")), F.lit(""))
    good = cut(good.withColumn("text", lines))
    write(spark, root, good.select(F.concat(F.lit("queue/"), "id", F.lit(".md")).alias("path"), "text"))
    return rows.join(good.select("seq", "id"), "seq", "left").select("seq", "id", "outcome")


#: What a challenge or a review may come to.
OUTCOMES = {"challenge": ["survived", "weakened", "refuted"], "review": ["clean", "findings-surfaced"]}


def passed(spark: SparkSession, root: str, kind: str, now: str, target: str | None = None, outcome: str | None = None, counts: dict[str, int] | None = None, detail: str | None = None) -> str:
    """Record a challenge (of a target), a review or a map pass (of a scope) in the log; the line."""
    C.guard(spark, f"{kind}-log")
    if kind in OUTCOMES and outcome not in OUTCOMES[kind]:
        raise ValueError(f"not an outcome of a {kind}: {outcome}")
    scope = (target or "").strip()
    if kind == "challenge" and not scope:
        raise ValueError("a challenge needs a target")
    numbers = "".join(f" {k}={(counts or {}).get(k, 0)}" for k in ("entities", "concepts", "questions"))
    said = {"challenge": f"{scope}: {outcome}", "review": f"scope={scope or 'base'}: {outcome}", "map": f"scope={scope or 'base'}{numbers}"}[kind]
    line = f"{kind} | {said}" + (f" | {detail}" if detail else "")
    log(spark, root, now, spark.createDataFrame([(line,)], "line string"))
    return line


def capture_repo(spark: SparkSession, root: str, id_: str, repo: str, ref: str, now: str, head: str | None = None, surfaces: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Take a repository's constitution in as a source of the reference tier: what the repository says about itself, not its content."""
    C.guard(spark, "capture-repo")
    text = repository.manifest(repository.surfaces(spark, repo, surfaces), head)
    row = text.select(F.lit(0).alias("seq"), F.lit(id_).alias("id"), F.lit("repo").alias("system"), F.lit(ref).alias("ref"), F.lit("constitution.md").alias("filename"), "text",
                      F.lit("reference").alias("tier"), F.lit("constitution of a repository that lives elsewhere").alias("reason"))
    return capture(spark, root, row, now)


def _ledger(head: str, patch: str, entries: str, was: float | None, kept: str | None) -> str:
    """A source's head with new entries; the one that was current names the file its bytes are kept in."""
    import yaml

    own = json.loads(head) | json.loads(patch)
    history = own.get("history") or []
    for e in history:
        if isinstance(e, dict) and kept is not None and e.get("version") == int(was or 0) and e.get("file"):
            e["file"] = kept
    own["history"] = history + json.loads(entries)
    return yaml.safe_dump(own, allow_unicode=True, sort_keys=False)


def ledger_text(*columns: Column) -> Column:
    """Arrow-batched _ledger."""

    @F.pandas_udf("string")
    def run(head: pd.Series, patch: pd.Series, entries: pd.Series, was: pd.Series, kept: pd.Series) -> pd.Series:
        rows = zip(head, patch, entries, was, kept)
        return pd.Series([_ledger(h, p, e, None if pd.isna(w) else w, k if isinstance(k, str) else None) for h, p, e, w, k in rows], dtype=object)

    return run(*columns)


#: Headings of the index, in order.
GROUPS = {"source": "Sources", "summary": "Summaries", "entity": "Entities", "concept": "Concepts", "question": "Questions", "insight": "Insights", "project": "Projects", "decision": "Decisions"}


def index_lines(r: Relations) -> DataFrame:
    """(place, id, line) of the readable index: sources with what covers them, documents by type with their markers, views, decisions."""
    place = {k: n for n, k in enumerate(GROUPS)}
    c, dash = F.col, F.lit(" — ")
    entry = lambda *tail: F.concat(F.lit("- ["), "id", F.lit("]("), "path", F.lit(")"), dash, *tail)
    titles = r.derived.select(c("id").alias("doc_id"), F.coalesce("title", "id").alias("cover"))
    covers = P.cover(r).join(titles, "doc_id").select(c("source_id").alias("id"), "cover")
    s = r.sources.join(covers, "id", "left").withColumn("path", F.when(c("canonical").isNull(), F.concat("path", F.lit("/"))).otherwise(c("path")))
    ref = F.nullif("ref", F.lit(""))
    said = F.when(c("cover").isNotNull(), F.concat_ws(" — ", "cover", ref)).otherwise(F.concat(F.lit("(source; "), F.coalesce(ref, "system", F.lit("not yet summarized")), F.lit(")")))
    s = s.select(F.lit(place["source"]).alias("place"), "id", entry(said, F.when(c("capture") == "reference", " · reference").otherwise("")).alias("line"))
    d = r.derived.where(c("type").isin(list(FOLDER))).join(P.index_markers(r), "id", "left")
    at = F.element_at(F.create_map(*[F.lit(x) for k in FOLDER for x in (k, place[k])]), c("type"))
    d = d.select(at.alias("place"), "id", entry(F.concat_ws(" — ", F.coalesce("title", "id"), F.nullif("abstract", F.lit(""))), F.coalesce(F.concat(F.lit("  · "), F.nullif("markers", F.lit(""))), F.lit(""))).alias("line"))
    p = r.projects.select(F.lit(place["project"]).alias("place"), "id", entry(F.coalesce("title", "id"), F.when(c("scope") == "global", "  · global").otherwise("")).alias("line"))
    e = r.decisions.select(F.lit(place["decision"]).alias("place"), "id", entry(F.coalesce("title", "id")).alias("line"))
    rows = s.unionByName(d).unionByName(p).unionByName(e)
    names = F.array(*[F.lit(x) for x in GROUPS.values()])
    first = F.min_by("id", "id").alias("id")
    # a group's heading goes with its first entry, a blank line before all but the first group
    heads = rows.groupBy("place").agg(first)
    heads = heads.select("place", "id", F.concat(F.lit("\n## "), F.element_at(names, c("place") + 1), F.lit("\n")).alias("head"))
    return rows.join(heads, ["place", "id"], "left").select("place", "id", F.concat(F.coalesce("head", F.lit("")), "line").alias("line"))


def _joined(spark: SparkSession, root: str, name: str, lines: DataFrame, order: list[str], head: str = "") -> None:
    """A file of sorted lines: ranges are sorted and written by the executors, and their files put together."""
    staging = f"{root}/{STAGING}{uuid.uuid4().hex}"
    lines.orderBy(*order).select(F.col("line").alias("value")).write.text(f"{staging}/files")
    storage.publish(spark, f"{staging}/head", head)
    parts = [f"{staging}/files/{f}" for f in storage.folders(spark, f"{staging}/files") if f.startswith("part-")]
    storage.join(spark, [f"{staging}/head", *parts] if head else parts, f"{staging}/{name}")
    storage.move(spark, f"{staging}/{name}", f"{root}/{name}")
    storage.remove(spark, staging)


@operation("index")
def index(spark: SparkSession, root: str) -> dict[str, int]:
    """Write index.jsonl, index.md and llms.txt as what the documents' heads say; {documents}."""
    r = base.load(spark, root)
    records = cut(P.index_records(r).select("rank", "id", "line"))
    _joined(spark, root, "index.jsonl", records, ["rank", "id"])
    _joined(spark, root, "index.md", cut(index_lines(r)), ["place", "id"], "# Index\n")
    name = base.manifest(spark, root).get("name") or "knowledge base"
    storage.publish(
        spark, f"{root}/llms.txt",
        f"# {name}\n\n> Captured sources and documents derived from them, as plain Markdown with content hashes.\n\n"
        "- [index.md](index.md): every document, sources first\n- index.jsonl: the same, a JSON object a line\n"
        "- sources/ is what counts: where a document and its source differ, the source is right\n",
        replace=True,
    )
    return {"documents": records.count()}


def stale_index(spark: SparkSession, root: str) -> DataFrame:
    """Findings of L22: lines of index.jsonl that rendering it now would not give, and the other way round."""
    path = f"{root}/index.jsonl"
    held = spark.read.text(path).withColumnRenamed("value", "line") if storage.exists(spark, path) else spark.createDataFrame([], "line string")
    return lint.l22(P.index_records(base.load(spark, root)).select("line"), held)
