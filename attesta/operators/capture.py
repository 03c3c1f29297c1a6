"""Taking documents in: dedup ladder, versions, tiers, anchors, derived documents, staging, queue.

Writes are table transforms: each returns the new rows of a table, and the caller writes them. Batches
are taken in order of `seq`; there is one writer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.functions.lineage import cut, numbered
from attesta.sources.extract import extracted

#: Bytes from which a capture must be allowed by name.
LARGE = 25 << 20
#: A task's states, what may follow each, and their order in a list.
TRANSITIONS = {
    "pending": ["done", "declined", "blocked", "cancelled"], "blocked": ["pending", "done", "declined", "cancelled"],
    "done": [], "declined": [], "cancelled": [],
}
STATUS_ORDER = ["pending", "blocked", "done", "declined", "cancelled"]
TASK_TYPES = ["ingest", "synthesize", "map", "explore", "drift-check", "ask", "review", "other"]
DERIVATION_RANK = {"extracted": 0, "model-read": 1, "synthesis": 2}


def _first_by(held: DataFrame, key: str, name: str) -> DataFrame:
    return held.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__{key}")).agg(F.min("id").alias(name))


def matches(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """incoming(id, ref, hash, ...) with the held source that has its hash, its id, its ref: three hash joins.

    held(id, ref, hash): current versions; the first id of several wins.
    """
    by_hash, by_id, by_ref = _first_by(held, "hash", "hash_match"), _first_by(held, "id", "id_match"), _first_by(held, "ref", "ref_match")
    rows = incoming.join(by_hash, F.col("hash") == F.col("__hash"), "left").drop("__hash")
    rows = rows.join(by_id, F.col("id") == F.col("__id"), "left").drop("__id")
    return rows.join(by_ref, F.col("ref") == F.col("__ref"), "left").drop("__ref")


def dedup_check(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """What taking each row in would find: (id, status, method, match_id); nothing is written.

    incoming(id, ref, hash, text); held(id, ref, hash, text). A row without hash is asked by ref alone. Changed text that differs in
    line ends only is told apart; where both sides have (path, content), so are files of which an extractor reads the same text.
    """
    rows = matches(incoming, held)
    near = F.coalesce("id_match", "ref_match")
    rows = rows.withColumn("near", near)
    files = {"path", "content"} <= {*incoming.columns} and {"path", "content"} <= {*held.columns}
    more = [F.col("content").alias("__held_bytes"), F.col("path").alias("__held_path")] if files else []
    other = held.select(F.col("id").alias("near"), F.col("text").alias("held_text"), *more)
    plain = lambda c: F.regexp_replace(T.newlines(c), "^\ufeff+", "")
    rows = rows.join(other, "near", "left")
    only_lines = plain(F.col("held_text")) == plain(F.col("text"))
    same_text = F.lit(False)
    if files:
        # only files that changed are read
        fetched, kept = F.when(F.col("near").isNotNull() & F.col("hash_match").isNull(), F.col("content")), F.col("__held_bytes")
        rows = extracted(extracted(rows.withColumn("__bytes", fetched), "__bytes", "__held_path", "__now"), "__held_bytes", "__held_path", "__then")
        same_text = F.coalesce(~T.suffix(F.col("__held_path")).isin(".md", ".txt") & (T.newlines(F.col("__now")) == T.newlines(F.col("__then"))) & kept.isNotNull(), F.lit(False))
    changed = F.when(only_lines, "same-after-newline-normalization").when(same_text, "same-after-extraction").otherwise("changed")
    status = (
        F.when(F.col("hash").isNull(), F.when(F.col("ref_match").isNotNull(), "already-captured").otherwise("new"))
        .when(F.col("hash_match").isNotNull(), "already-captured").when(F.col("near").isNotNull(), changed).otherwise("new")
    )
    by_ref = F.col("hash").isNull() | (F.col("hash_match").isNull() & F.col("id_match").isNull() & F.col("ref_match").isNotNull())
    match = F.when(F.col("hash").isNull(), F.col("ref_match")).otherwise(F.coalesce("hash_match", "near"))
    return rows.select("id", status.alias("status"), F.when(by_ref, "origin.ref").otherwise("content-hash").alias("method"), match.alias("match_id"))


#: Ranges of places that _as_of deals a key's rows to.
BLOCKS = 1024


def _as_of(points: DataFrame, events: DataFrame, key: str, span: tuple[int, int], value: Callable[[Column], Column], later: bool = False) -> DataFrame:
    """points(seq, key, ...) with `found`: value (F.min or F.max) over v of events(key, at, v) of its key that stand before it, or later.

    A key's rows are summed up by ranges of places first, so a key of many rows is no single task's."""
    low, width = span[0], max(1, -(-(span[1] - span[0] + 1) // BLOCKS))
    rows = events.select(F.col(key).alias("__k"), F.col("at").cast("long").alias("__at"), F.col("v").alias("__v"), F.lit(False).alias("__point"))
    rows = rows.unionByName(points.select(F.col(key).alias("__k"), F.col("seq").cast("long").alias("__at"), F.lit(None).alias("__v"), F.lit(True).alias("__point")))
    rows = rows.where("__k is not null").withColumn("__block", F.floor((F.col("__at") - low) / width))
    way = (lambda c: F.desc(c)) if later else F.asc
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("__near", value("__v").over(before("__k", "__block").orderBy(way("__at"), F.desc("__point")))).where("__point")
    far = rows.groupBy("__k", "__block").agg(value("__v").alias("__v")).withColumn("__far", value("__v").over(before("__k").orderBy(way("__block"))))
    both = near.select("__k", "__block", "__at", "__near").join(far.select("__k", "__block", "__far"), ["__k", "__block"])
    best = F.least("__near", "__far") if value is F.min else F.greatest("__near", "__far")
    return points.join(both.select(F.col("__at").alias("__seq"), best.alias("found")), F.col("seq") == F.col("__seq"), "left").drop("__seq")


def _leaves(held: DataFrame, takes: DataFrame) -> DataFrame:
    """held(id, ref, hash) with the first place at which the id gets other content."""
    return held.join(takes.groupBy("id").agg(F.min("seq").alias("leave")), "id", "left")


def _outlook(rows: DataFrame, held: DataFrame, takes: DataFrame, span: tuple[int, int], force_new: bool) -> DataFrame:
    """rows with what the changes known so far make of each at its place: outcome, `new` (its id is not there yet) and first_leave, the
    first place at which an undecided row may take its content away from a source.

    takes(seq, id, ref, hash, created, until): changes, each with the place of its id's next one.
    """
    at = F.col("seq")
    left = _leaves(held, takes)
    first = left.groupBy(F.col("hash").alias("__h")).agg(F.bool_or(F.col("leave").isNull()).alias("stays"), F.max("leave").alias("last"))
    seen = rows.join(first, F.col("hash") == F.col("__h"), "left").drop("__h")
    # what the batch itself brought is taken in where no source has it, so of these at most one holds a content at a time: the last
    seen = _as_of(seen, takes.select("hash", F.col("seq").alias("at"), F.struct("seq", "until").alias("v")), "hash", span, F.max)
    own = F.coalesce(F.col("stays") | (F.col("last") >= at), F.lit(False)) | (F.col("found").isNotNull() & F.coalesce(F.col("found.until") >= at, F.lit(True)))
    seen = seen.select("seq", "id", "ref", "hash", own.alias("known"))
    made = takes.where("created")
    there = lambda c: held.where(F.col(c).isNotNull()).select(F.col(c).alias("__k"), F.lit(None).cast(dict(rows.dtypes)["seq"]).alias("seq")).unionByName(made.where(F.col(c).isNotNull()).select(F.col(c).alias("__k"), "seq"))
    for c in ("id", "ref"):
        since = there(c).groupBy("__k").agg(F.bool_or(F.col("seq").isNull()).alias("always"), F.min("seq").alias("since"))
        seen = seen.join(since, F.col(c) == F.col("__k"), "left")
        seen = seen.withColumn(f"{c}_there", F.coalesce(F.col("always") | (F.col("since") < at), F.lit(False))).drop("__k", "always", "since")
    # per id the first undecided row, and the first with other content than that one's
    per = rows.groupBy("id", "hash").agg(F.min("seq").alias("seq"))
    one = per.groupBy("id").agg(F.min(F.struct("seq", "hash")).alias("one"))
    two = per.join(one, "id").where(~F.col("hash").eqNullSafe(F.col("one.hash"))).groupBy("id").agg(F.min("seq").alias("two"))
    asks = one.join(two, "id", "left")
    holds = left.select("id", "hash", F.lit(None).cast(dict(rows.dtypes)["seq"]).alias("since"), F.col("leave").alias("until"))
    holds = holds.unionByName(takes.select("id", "hash", F.col("seq").alias("since"), "until")).join(asks, "id")
    other = F.when(F.col("one.hash").eqNullSafe(F.col("hash")), F.col("two")).otherwise(F.col("one.seq"))
    holds = holds.withColumn("leave", F.when(other.isNotNull(), F.greatest(other, "since"))).where("leave is not null and (until is null or leave < until)")
    seen = seen.join(holds.groupBy(F.col("hash").alias("__l")).agg(F.min("leave").alias("first_leave")), F.col("hash") == F.col("__l"), "left").drop("__l")
    outcome = (
        F.when(F.col("known"), "deduped").when(F.col("id_there"), "versioned")
        .when(F.col("ref_there") & F.lit(not force_new), "refused").otherwise("created")
    )
    return seen.select("seq", "id", "ref", "hash", outcome.alias("outcome"), (~F.col("id_there")).alias("new"), "first_leave")


def _settled(seen: DataFrame, force_new: bool) -> DataFrame:
    """seen with `settled`: no undecided row before it can change its outcome.

    Each condition compares a row's place with the first place at which some other row could matter, so keys are summed up
    before anything is joined, and a key that many rows share is one row.
    """
    at = F.col("seq")
    # a row of a new id that is not refused may create it; refusals stay, as sources never go
    maker = F.when(F.col("new") & (F.col("outcome") != "refused"), at)
    by_hash = seen.groupBy(F.col("hash").alias("__h")).agg(F.min("seq").alias("first_hash"))
    by_id = seen.groupBy(F.col("id").alias("__i")).agg(F.min(maker).alias("first_maker"))
    by_ref = seen.where("ref is not null").groupBy(F.col("ref").alias("__r")).agg(F.min(maker).alias("first_ref"))
    rows = seen.join(by_hash, F.col("hash") == F.col("__h"), "left").join(by_id, F.col("id") == F.col("__i"), "left").join(by_ref, F.col("ref") == F.col("__r"), "left")
    unless_before = lambda c: F.coalesce(F.col(c) >= at, F.lit(True))
    fresh = unless_before("first_hash")
    settled = (
        F.when(F.col("outcome") == "deduped", unless_before("first_leave")).when(F.col("outcome") == "versioned", fresh)
        .when(F.col("outcome") == "refused", fresh & unless_before("first_maker"))
        .otherwise(fresh & unless_before("first_maker") & (F.lit(force_new) | unless_before("first_ref")))
    )
    return rows.select("seq", "id", "ref", "hash", "outcome", settled.alias("settled"))


def capture(incoming: DataFrame, held: DataFrame, force_new: bool = False, allow_large: bool = False) -> DataFrame:
    """(seq, id, action, target, version) of a batch incoming(seq, id, ref, hash, size), as if taken in one by one in order of seq.

    A known hash is deduped; a known id gets its next version; a new id on a known ref is refused unless forced; anything else
    is created. held(id, ref, hash, version) are current versions. Rows see what earlier rows of the batch have made: a content
    or id that they created, a ref they took, a content that a new version replaced. target is the source whose content, id or ref
    it is (of a forced row: one it splits from). seq is a whole number.

    Rounds: every row that no undecided row before it can affect is decided. Changes are kept with their places, so a row is held
    against what was there at its place, whenever it is decided; a change need not wait for rows before it. The first undecided row
    can always be decided; rounds are as many as the longest chain of rows that hang on each other in turn, not as rows on one
    key. seq tells rows apart.
    """
    large = F.lit(False) if allow_large else F.col("size") >= LARGE
    rows = cut(incoming.select("seq", "id", "ref", "hash", large.alias("large")))
    held = cut(held.select("id", "ref", "hash", "version"))
    span = rows.agg(F.min("seq").cast("long"), F.max("seq").cast("long")).first()
    span = (span[0] or 0, span[1] or 0)
    done = [rows.where("large").select("seq", "id", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("hash"), F.lit("refused").alias("action"))]
    takes = rows.where("false").select("seq", "id", "ref", "hash", F.lit(True).alias("created"), F.col("seq").alias("until"))
    rows = rows.where("not large").drop("large")
    while not rows.isEmpty():
        seen = cut(_settled(_outlook(rows, held, takes, span, force_new), force_new))
        ready = seen.where("settled")
        done.append(ready.select("seq", "id", "ref", "hash", F.col("outcome").alias("action")))
        fresh = ready.where("outcome in ('versioned', 'created')").select("seq", "id", "ref", "hash", (F.col("outcome") == "created").alias("created"))
        # ranges of (id, seq) number the changes, so an id of many rows is no single task's
        every = cut(numbered(takes.drop("until").unionByName(fresh), "__n", "id", "seq"))
        after = every.select("id", (F.col("__n") - 1).alias("__n"), F.col("seq").alias("until"))
        takes = cut(every.join(after, ["id", "__n"], "left").select("seq", "id", "ref", "hash", "created", "until"))
        rows = seen.where("not settled").select("seq", "id", "ref", "hash")
    out = reduce(DataFrame.unionByName, done)
    # of the sources that have a content or ref at a row's place the first: those that keep it, those that leave it later, those made before
    left = _leaves(held, takes).where("hash is not null")
    twins = out.where("action = 'deduped'").select("seq", "hash")
    stay = left.where("leave is null").groupBy(F.col("hash").alias("__h")).agg(F.min("id").alias("stays"))
    twins = twins.join(stay, F.col("hash") == F.col("__h"), "left").select("seq", "hash", "stays")
    twins = _as_of(twins, left.where("leave is not null").select("hash", F.col("leave").alias("at"), F.col("id").alias("v")), "hash", span, F.min, later=True)
    twins = twins.select("seq", "hash", F.least("stays", "found").alias("first"))
    twins = _as_of(twins, takes.select("hash", F.col("seq").alias("at"), F.struct("seq", "id").alias("v")), "hash", span, F.max)
    twins = twins.select("seq", F.coalesce("first", "found.id").alias("target"))
    refs = out.where("action in ('refused', 'created') and ref is not null").select("seq", "ref")
    refs = refs.join(_first_by(held, "ref", "first"), F.col("ref") == F.col("__ref"), "left").drop("__ref")
    refs = _as_of(refs, takes.where("created").select("ref", F.col("seq").alias("at"), F.col("id").alias("v")), "ref", span, F.min)
    refs = refs.select("seq", F.least("first", "found").alias("target"))
    out = out.join(twins.unionByName(refs), "seq", "left").withColumn("target", F.when(F.col("action") == "versioned", F.col("id")).otherwise(F.col("target")))
    # versions count on from the held one in order of seq
    takes = numbered(takes.select("id", "seq"), "__n", "id", "seq")
    start = takes.groupBy("id").agg(F.min("__n").alias("__start"))
    takes = takes.join(start, "id").join(held.select("id", F.col("version").alias("__v")), "id", "left")
    takes = takes.select("seq", (F.coalesce("__v", F.lit(0)) + F.col("__n") - F.col("__start") + 1).cast("int").alias("version"))
    return out.join(takes, "seq", "left").select("seq", "id", "action", "target", "version")


def current_versions(versions: DataFrame) -> DataFrame:
    """The highest version of each source."""
    most = F.max_by(F.struct("version", "content_hash", "file"), "version").alias("x")
    return versions.groupBy("id").agg(most).select("id", "x.*")


def supersedes(versions: DataFrame) -> DataFrame:
    """Each version with the one before it and whether the ledger says so."""
    before = F.lag("version").over(Window.partitionBy("id").orderBy("version"))
    rows = versions.select("id", "version", "supersedes", before.alias("previous"))
    return rows.withColumn("agrees", F.col("supersedes").eqNullSafe(F.col("previous")))


def retier(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """sources with tier, reason and recoverable corrected by changes(id, capture, capture_reason, recoverable).

    Nulls change nothing; reference needs a reason, else the row stays as it is.
    """
    c = changes.select("id", *[F.col(x).alias(f"__{x}") for x in ("capture", "capture_reason", "recoverable")])
    rows = sources.join(c, "id", "left")
    bad = (F.col("__capture") == "reference") & F.coalesce("__capture_reason", "capture_reason").isNull()
    out = {x: F.when(F.coalesce(bad, F.lit(False)), F.col(x)).otherwise(F.coalesce(f"__{x}", x)) for x in ("capture", "capture_reason", "recoverable")}
    return rows.withColumns(out).select(*sources.columns)


def reextract(sources: DataFrame, aids: DataFrame, known: list[str]) -> DataFrame:
    """What a backfill of text aids would do: (id, outcome); sources(id, canonical), aids(id)."""
    rows = sources.join(aids.select("id", F.lit(1).alias("__aid")), "id", "left")
    end = T.suffix(F.col("canonical"))
    outcome = (
        F.when(F.col("__aid").isNotNull(), "has text").when(F.col("canonical").isNull(), "no bytes")
        .when(end.isin(".md", ".txt"), "is text").when(end.isin(known), "extract").otherwise("no extractor")
    )
    return rows.select("id", outcome.alias("outcome"))


def anchor_check(rows: DataFrame) -> DataFrame:
    """Verdict on each anchored excerpt: rows(id, body, upstream, recorded); upstream is the text fetched now."""
    raw = F.col("upstream").cast("binary")
    now = F.when(F.col("recorded").startswith("git-blob:"), H.git_blob(raw)).otherwise(H.bytes_hash(F.col("upstream")))
    verdict = (
        F.when(F.col("recorded").isNull(), "unanchored").when(now == F.col("recorded"), "upstream-unchanged")
        .when(F.col("body").isNull(), "region-uncheckable")
        .when(T.holds_all(F.col("upstream"), T.chunks(F.col("body"))), "upstream-changed-region-intact").otherwise("region-drifted")
    )
    return rows.select("id", verdict.alias("verdict"))


def derive(drafts: DataFrame, sources: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted provenance (doc_id, source_id, hash) and rejects (doc_id, reason) of drafts(doc_id, source_id).

    Every source must exist, hashes are the current ones, closed documents aren't written over;
    held(id, status).
    """
    current = sources.select(F.col("id").alias("source_id"), F.col("content_hash").alias("hash"))
    rows = drafts.join(current, "source_id", "left")
    closed = held.where("status = 'superseded'").select(F.col("id").alias("doc_id"), F.lit(True).alias("closed"))
    rows = rows.join(closed, "doc_id", "left")
    per = rows.groupBy("doc_id").agg(F.bool_or(F.col("hash").isNull()).alias("lacks"), F.bool_or(F.coalesce("closed", F.lit(False))).alias("closed"))
    bad = per.where("lacks or closed").select("doc_id", F.when(F.col("closed"), "superseded").otherwise("unknown source").alias("reason"))
    return rows.join(bad, "doc_id", "left_anti").select("doc_id", "source_id", "hash"), bad


def stamp(derived: DataFrame) -> DataFrame:
    """derived with self_hash where there is none yet."""
    own = H.self_hash(F.col("title"), F.col("abstract"), F.col("body"))
    return derived.withColumn("self_hash", F.coalesce("self_hash", own))


def supersede(derived: DataFrame, changes: DataFrame) -> DataFrame:
    """derived(id, status, superseded_by) closed or, with lift, opened again by changes(id, by, lift).

    A document can't be closed by itself or by one that doesn't exist; such changes do nothing.
    """
    known = derived.select(F.col("id").alias("by"), F.lit(True).alias("__known"))
    c = changes.join(known, "by", "left").select(F.col("id").alias("__i"), "by", "lift", "__known")
    rows = derived.join(c, F.col("id") == F.col("__i"), "left")
    lift = F.coalesce("lift", F.lit(False))
    close = ~lift & F.coalesce(F.col("__known"), F.lit(False)) & (F.col("by") != F.col("id"))
    status = F.when(lift, "current").when(close, "superseded").otherwise(F.col("status"))
    by = F.when(lift, F.lit(None)).when(close, F.col("by")).otherwise(F.col("superseded_by"))
    return rows.withColumn("status", status).withColumn("superseded_by", by).select(*derived.columns)


def weakest(derivation: Column) -> Column:
    """Aggregate: the least deterministic way among documents; none is extracted, an unknown one is an error."""
    known = F.coalesce(*[F.when(derivation == d, F.lit(k)) for d, k in DERIVATION_RANK.items()])
    refused = F.raise_error(F.concat(F.lit("unknown derivation: "), derivation)).cast("int")
    rank = F.when(known.isNotNull() | derivation.isNull(), F.coalesce(known, F.lit(0))).otherwise(refused)
    names = F.array(*[F.lit(d) for d in DERIVATION_RANK])
    return F.element_at(names, F.coalesce(F.max(rank), F.lit(0)) + 1)


def stage(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """(id, outcome) of candidates (id, fingerprint) against held(fingerprint, status); declines stick."""
    seen = held.groupBy("fingerprint").agg(F.bool_or(F.col("status") == "declined").alias("declined"))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("id")) == 1
    rows = incoming.withColumn("__first", first).join(seen, "fingerprint", "left")
    outcome = F.when(F.col("declined"), "declined before").when(F.col("declined").isNotNull() | ~F.col("__first"), "pending already").otherwise("staged")
    return rows.select("id", outcome.alias("outcome"))


def fold(held: DataFrame, candidate: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Provenance with a candidate's sources added: what is held stays as it is. Both (source_id, hash), or more keys."""
    return held.unionByName(candidate.join(held.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def restatus(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, status, outcome) of changes(id, status) to tasks(id, status): moved, noop, illegal or unknown."""
    steps = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, b)).cast("array<string>"))])
    rows = changes.select("id", F.col("status").alias("to")).join(tasks, "id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "unknown").when(F.col("to") == F.col("status"), "noop")
        .when(F.array_contains(F.try_element_at(steps, F.col("status")), F.col("to")), "moved").otherwise("illegal")
    )
    return rows.select("id", F.when(outcome == "moved", F.col("to")).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))


def queue_list(tasks: DataFrame) -> DataFrame:
    """Tasks by state, then id."""
    order = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return tasks.orderBy(order, "id")


def queue_ids(tasks: DataFrame) -> DataFrame:
    """Ids of new tasks from their stamp (one second of one writer); those of one stamp get a number."""
    n = F.row_number().over(Window.partitionBy("stamp").orderBy("seq"))
    return tasks.withColumn("id", F.concat(F.lit("task-"), "stamp", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")))


def amend(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Decision bodies with dated amendments, changes(id, dated, body), on top; what stood there stays."""
    c = changes.select("id", F.concat(F.lit("**AMENDED ("), "dated", F.lit("):** "), T.strip(F.col("body")), F.lit("\n\n")).alias("__add"))
    body = F.when(F.col("__add").isNotNull(), F.concat("__add", F.regexp_replace("body", r"^\n+", ""))).otherwise(F.col("body"))
    return decisions.join(c, "id", "left").withColumn("body", body).drop("__add")


def decline(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """candidates(id, status, reason) after changes(id, reason): what is pending is declined, and a decline stays as it was."""
    c = changes.groupBy(F.col("id").alias("__i")).agg(F.min("reason").alias("__reason"))
    rows = candidates.join(c, F.col("id") == F.col("__i"), "left")
    hit = F.col("__i").isNotNull() & (F.col("status") == "pending")
    rows = rows.withColumn("reason", F.when(hit, F.col("__reason")).otherwise(F.col("reason")))
    return rows.withColumn("status", F.when(hit, "declined").otherwise(F.col("status"))).select(*candidates.columns)


def anchor(held: DataFrame, changes: DataFrame) -> DataFrame:
    """What anchoring excerpts to their wholes gives: (id, outcome, upstream_ref, upstream_identity, anchored_at).

    held(id, body, upstream_ref, upstream_identity, anchored_at); changes(id, upstream_ref, upstream, form, force, reason, at),
    upstream being the whole's text. An excerpt must stand in its whole; force passes that with a reason. What is refused
    or the same already keeps what it has.
    """
    c = changes.select("id", *[F.col(x).alias(f"__{x}") for x in ("upstream_ref", "upstream", "form", "force", "reason", "at")])
    rows = c.join(held.withColumn("__held", F.lit(True)), "id", "left")
    raw = F.col("__upstream").cast("binary")
    rows = rows.withColumn("__identity", F.when(F.col("__form") == "git-blob", H.git_blob(raw)).otherwise(H.bytes_hash(F.col("__upstream"))))
    blank = lambda x: T.strip(F.coalesce(x, F.lit(""))) == ""
    inside = F.coalesce(T.holds_all(F.col("__upstream"), T.chunks(F.col("body"))), F.lit(False))
    same = F.col("upstream_identity").eqNullSafe(F.col("__identity")) & F.col("upstream_ref").eqNullSafe(F.col("__upstream_ref"))
    outcome = (
        F.when(blank("__upstream_ref"), "no upstream_ref").when(F.col("__held").isNull(), "unknown source").when(same, "unchanged")
        .when(inside, "anchored").when(~F.coalesce("__force", F.lit(False)), "not contained").when(blank("__reason"), "no reason").otherwise("forced")
    )
    rows = rows.withColumn("outcome", outcome)
    done = F.col("outcome").isin("anchored", "forced")
    new = {"upstream_ref": "__upstream_ref", "upstream_identity": "__identity", "anchored_at": "__at"}
    return rows.select("id", "outcome", *[F.when(done, F.col(n)).otherwise(F.col(x)).alias(x) for x, n in new.items()])


def amend_evidence(evidence: DataFrame, changes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence (decision_id, source_id, version) with changes(decision_id, source_id) at the versions held now, and
    those of changes that name no source. What a decision cites already stays at its version."""
    now = sources.select(F.col("id").alias("source_id"), F.coalesce("version", F.lit(1)).alias("version"))
    rows = changes.select("decision_id", "source_id").join(now, "source_id", "left")
    own = evidence.select("decision_id", "source_id", "version")
    return fold(own, rows.where("version is not null"), ("decision_id", "source_id")), rows.where("version is null").select("decision_id", "source_id")


def same_extract(pairs: DataFrame) -> DataFrame:
    """(id, same) of pairs(id, path, held, fetched), files as bytes: whether an extractor reads the same text from both.

    Null where it has nothing to say: text files, and files that no extractor reads."""
    both = extracted(extracted(pairs, "held", "path", "__held"), "fetched", "path", "__fetched")
    same = T.newlines(F.col("__held")) == T.newlines(F.col("__fetched"))
    return both.select("id", F.when(~T.suffix(F.col("path")).isin(".md", ".txt"), same).alias("same"))


#: Operations that write.
WRITES = [
    "anchor", "capture", "capture-repo", "challenge-log", "decline-candidate", "derive", "drift-log", "index", "init", "map-log",
    "project", "promote-candidate", "queue-create", "queue-restatus", "record-decision", "reextract", "refresh", "reindex", "relink",
    "reproject", "retier", "review-log", "stage-candidate", "stamp", "supersede", "usage-log",
]


def guard(spark: SparkSession, operation: str) -> None:
    """Refuses an operation that writes while the session's attesta.read_only is true."""
    if operation in WRITES and spark.conf.get("attesta.read_only", "false").lower() in ("1", "true", "yes"):
        raise ValueError(f"read-only session: {operation} writes")
