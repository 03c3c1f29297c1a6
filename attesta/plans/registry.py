"""Queries over the stand-in relations, each with an independent SQL statement.

One entry: the plan, and DuckDB SQL over the same relations (they come as CTEs in front of it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.functions.lineage import scratch
from attesta.operators import capture as C
from attesta.operators import catalog as KB
from attesta.operators import graph as G
from attesta.operators import ledger as L
from attesta.operators import lint
from attesta.operators import project as P
from attesta.operators import reading as R
from attesta.operators import retrieve as V
from attesta.sources import extract
from attesta.sources.relations import AS_OF, Relations, duckdb_ctes, stand_in
from attesta.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ALL_DOCS = """(select id, 'source' as kind, 'source' as type from sources union all select id, 'derived', type from derived
  union all select id, 'project', null from projects union all select id, 'decision', null from decisions)"""


def over(name: str, sql: str | None = None) -> Callable:
    """Registers a plan over relations."""

    def add(plan: Callable[[Relations], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: plan(stand_in(spark, sf_dir))
        if sql:
            _SQL[name] = duckdb_ctes() + "\n" + sql
        return plan

    return add


def raw(name: str, sql: str | None = None) -> Callable:
    """Registers a plan over the tables themselves."""

    def add(plan: Query) -> Query:
        _QUERIES[name] = plan
        if sql:
            _SQL[name] = sql
        return plan

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- identities ---------------------------------------------------------------------------------

over("content_hash", "select id, concat('sha256:', sha256(text)) as hash, content_hash = concat('sha256:', sha256(text)) as holds from sources")(
    lambda r: r.sources.select("id", H.bytes_hash(F.col("text")).alias("hash"), (F.col("content_hash") == H.bytes_hash(F.col("text"))).alias("holds"))
)

_VARIANT = """case num % 4 when 0 then text when 1 then replace(text, '{n}', '{rn}')
  when 2 then concat('---{n}title: x{n}---{n}', text) else concat('---{n}open{n}', text) end"""


@over(
    "text_hash",
    f"""select id, concat('sha256:', sha256(case when starts_with(t, '---' || chr(10)) and strpos(substr(t, 5), chr(10) || '---' || chr(10)) > 0
      then substr(t, 4 + strpos(substr(t, 5), chr(10) || '---' || chr(10)) + 5) else t end)) as hash
    from (select id, regexp_replace(v, '\\r\\n?', chr(10), 'g') as t
      from (select id, {_VARIANT.replace("'{n}'", "chr(10)").replace("'{rn}'", "chr(13) || chr(10)").replace("'---{n}title: x{n}---{n}'", "'---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10)").replace("'---{n}open{n}'", "'---' || chr(10) || 'open' || chr(10)")} as v from sources))""",
)
def text_hash(r: Relations) -> DataFrame:
    t, k = F.col("text"), F.col("num") % 4
    v = (
        F.when(k == 0, t).when(k == 1, F.replace(t, F.lit("\n"), F.lit("\r\n")))
        .when(k == 2, F.concat(F.lit("---\ntitle: x\n---\n"), t)).otherwise(F.concat(F.lit("---\nopen\n"), t))
    )
    return r.sources.select("id", H.text_hash(v).alias("hash"))


over(
    "self_hash",
    """select id, concat('sha256:', sha256(concat(coalesce(title, ''), chr(10), chr(10), coalesce(abstract, ''), chr(10), chr(10),
      regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g'), chr(10)))) as hash from derived""",
)(lambda r: r.derived.select("id", H.self_hash(F.col("title"), F.col("abstract"), F.col("body")).alias("hash")))

over("git_blob", "select id, concat('git-blob:', sha1(concat('blob ', strlen(text), chr(0), text))) as identity from sources")(
    lambda r: r.sources.select("id", H.git_blob(F.col("text").cast("binary")).alias("identity"))
)


@over(
    "base_fingerprint",
    "select concat('sha256:', sha256(string_agg(line, chr(10) order by line))) as fingerprint, count(*) as n from (select concat(id, chr(9), content_hash) as line from sources)",
)
def base_fingerprint(r: Relations) -> DataFrame:
    value = H.fingerprint(r.sources, "id", "content_hash")
    return r.sources.agg(F.lit(value).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


# --- taking in ----------------------------------------------------------------------------------

over("dedup_exact", "select content_hash, count(*) as n, min(id) as first_id from sources group by 1 having count(*) > 1")(
    lambda r: r.sources.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
)

#: An incoming batch made of the sources: the same text, changed text under an old id, under an old
#: ref, with other line ends, asked by ref only, or all new.
_INCOMING = """select num as seq, case when k in (1, 3) then id else concat('new-', num) end as id,
  case when k in (0, 1, 2, 4) then ref else concat('else/', num) end as ref,
  case k when 4 then null else concat('sha256:', {sha}) end as hash, text, length(text) as size
from (select num, id, ref, num % 6 as k, case num % 6 when 0 then text when 3 then replace(text, {n}, {r}) else concat(text, ' !', num) end as text from sources) v"""


def incoming(r: Relations) -> DataFrame:
    sql = _INCOMING.replace("{sha}", "sha2(text, 256)").replace("{n}", "char(10)").replace("{r}", "concat(char(13), char(10))")
    return r.sources.sparkSession.sql(sql.replace("from sources", "from {sources}"), sources=r.sources)


def held(r: Relations) -> DataFrame:
    return r.sources.select("id", "ref", F.col("content_hash").alias("hash"), "version", "text")


_HELD = f""", inc as ({_INCOMING.replace("{sha}", "sha256(text)").replace("{n}", "chr(10)").replace("{r}", "chr(13) || chr(10)")}),
 bh as (select content_hash as hash, min(id) as hm from sources group by 1), br as (select ref, min(id) as rm from sources group by 1),
 m as (select inc.*, hm, s.id as im, rm from inc left join bh on inc.hash = bh.hash left join sources s on s.id = inc.id left join br on br.ref = inc.ref)
"""

over(
    "dedup_check_ladder",
    _HELD + """select m.id, case when hash is null then case when rm is not null then 'already-captured' else 'new' end
      when hm is not null then 'already-captured'
      when coalesce(im, rm) is not null then case when regexp_replace(m.text, '\\r\\n?', chr(10), 'g') = regexp_replace(h.text, '\\r\\n?', chr(10), 'g')
        then 'same-after-newline-normalization' else 'changed' end else 'new' end as status,
      case when hash is null or (hm is null and im is null and rm is not null) then 'origin.ref' else 'content-hash' end as method,
      case when hash is null then rm else coalesce(hm, im, rm) end as match_id
    from m left join sources h on h.id = coalesce(im, rm)""",
)(lambda r: C.dedup_check(incoming(r), held(r)))

#: A batch whose rows hang on each other: an id made two rows before, a ref taken in the batch, the twin of a row that was refused, a
#: content that a new version has replaced, one that the batch brought itself, a file that is too large.
_BATCH = """select num as seq, case when num % 12 in (1, 3, 10) then id when num % 12 = 6 then concat('new-', num - 1) else concat('new-', num) end as id,
  case when num % 12 in (0, 1, 2) then ref when num % 12 = 7 then concat('else/', num - 2) else concat('else/', num) end as ref,
  case num % 12 when 0 then content_hash when 8 then concat('h-', num - 1) when 9 then before when 10 then concat('h-', num - 5) else concat('h-', num) end as hash,
  case when num % 12 = 11 then 26214400 else 10 end as size
from (select s.num, s.id, s.ref, s.content_hash, coalesce(p.content_hash, 'h-none') as before from sources s left join sources p on p.num = s.num - 8) v"""


def batch(r: Relations) -> DataFrame:
    return r.sources.sparkSession.sql(_BATCH.replace("sources s", "{sources} s").replace("sources p", "{sources} p"), sources=r.sources)


over(
    "capture_batch",
    f""", b as (select row_number() over (order by seq) as i, * from ({_BATCH})),
    steps as (with recursive s as (
      select 0::bigint as i, (select list({{'id': id, 'ref': ref, 'hash': content_hash, 'v': version::int}}) from sources) as held, null::bigint as seq, null::varchar as id, null::varchar as action, null::varchar as target, null::int as version
      union all
      select b.i, case action2 when 'created' then list_append(held, {{'id': b.id, 'ref': b.ref, 'hash': b.hash, 'v': 1}})
          when 'versioned' then list_transform(held, lambda x: {{'id': x.id, 'ref': x.ref, 'hash': case when x.id = b.id then b.hash else x.hash end, 'v': case when x.id = b.id then x.v + 1 else x.v end}}) else held end,
        b.seq, b.id, action2, case action2 when 'deduped' then hm when 'versioned' then b.id when 'refused' then case when b.size < 26214400 then rm end end,
        case action2 when 'created' then 1 when 'versioned' then own + 1 end
      from (select s.held, b.*, list_min(list_transform(list_filter(s.held, lambda x: x.hash = b.hash), lambda x: x.id)) as hm,
          list_min(list_transform(list_filter(s.held, lambda x: x.ref = b.ref), lambda x: x.id)) as rm, list_max(list_transform(list_filter(s.held, lambda x: x.id = b.id), lambda x: x.v)) as own
        from s join b on b.i = s.i + 1) b,
        lateral (select case when b.size >= 26214400 then 'refused' when hm is not null then 'deduped' when own is not null then 'versioned' when rm is not null then 'refused' else 'created' end as action2) q
    ) select * from s)
    select seq, id, action, target, version from steps where i > 0""",
)(lambda r: C.capture(batch(r), held(r).drop("text")))

over("version_current", "select id, version, content_hash, file from (select *, row_number() over (partition by id order by version desc) as n from versions) where n = 1")(
    lambda r: C.current_versions(r.versions)
)
over(
    "version_supersedes",
    "select id, version, supersedes, previous, supersedes is not distinct from previous as agrees from (select *, lag(version) over (partition by id order by version) as previous from versions)",
)(lambda r: C.supersedes(r.versions))

#: Excerpts of sources against what stands upstream now: the same, other text around, other text inside, none recorded.
_ANCHORED = """select id, case when num % 7 = 6 then null else substr(text, 1, 60) end as body, case when num % 5 = 0 then text when num % 5 = 1 then concat('new ', text) else concat('x', substr(text, 3)) end as upstream,
  case when num % 11 = 0 then null when num % 2 = 0 then concat('git-blob:', {blob}) else content_hash end as recorded from sources"""


@over(
    "anchor_check",
    f"""select id, case when recorded is null then 'unanchored'
      when recorded = case when starts_with(recorded, 'git-blob:') then concat('git-blob:', sha1(concat('blob ', strlen(upstream), chr(0), upstream))) else concat('sha256:', sha256(upstream)) end then 'upstream-unchanged'
      when body is null then 'region-uncheckable' when contains(upstream, body) then 'upstream-changed-region-intact' else 'region-drifted' end as verdict
    from ({_ANCHORED.replace("{blob}", "sha1(concat('blob ', strlen(text), chr(0), text))")})""",
)
def anchor_check(r: Relations) -> DataFrame:
    own = r.sources.withColumn("blob", F.substring(H.git_blob(F.col("text").cast("binary")), 10, 40))
    rows = r.sources.sparkSession.sql(_ANCHORED.replace("{blob}", "blob").replace("from sources", "from {sources}"), sources=own)
    return C.anchor_check(rows)


_RETIER = "select id, case when num % 4 = 0 then 'reference' when num % 4 = 1 then 'full' end as capture, case when num % 8 = 0 then 'asked' end as capture_reason, case when num % 3 = 2 then true end as recoverable from sources"
over(
    "retier",
    f"""select s.id, case when bad then s.capture else coalesce(c.capture, s.capture) end as capture,
      case when bad then s.capture_reason else coalesce(c.capture_reason, s.capture_reason) end as capture_reason,
      case when bad then s.recoverable else coalesce(c.recoverable, s.recoverable) end as recoverable
    from sources s join ({_RETIER}) c on c.id = s.id,
      lateral (select coalesce(c.capture = 'reference' and coalesce(c.capture_reason, s.capture_reason) is null, false) as bad)""",
)(
    lambda r: C.retier(r.sources, r.sources.sparkSession.sql(_RETIER.replace("from sources", "from {s}"), s=r.sources)).select("id", "capture", "capture_reason", "recoverable")
)

over(
    "derive_provenance",
    """select p.doc_id, p.source_id, s.content_hash as hash from provenance p join sources s on s.id = p.source_id
    where p.doc_id not in (select doc_id from provenance where source_id not in (select id from sources))
      and p.doc_id not in (select id from derived where status = 'superseded')""",
)(lambda r: C.derive(r.provenance.select("doc_id", "source_id"), r.sources, r.derived.select("id", "status"))[0])

over(
    "derive_rejects",
    """select doc_id, case when bool_or(d.status = 'superseded') then 'superseded' else 'unknown source' end as reason
    from provenance p left join sources s on s.id = p.source_id left join derived d on d.id = p.doc_id
    group by 1 having bool_or(s.id is null) or bool_or(coalesce(d.status = 'superseded', false))""",
)(lambda r: C.derive(r.provenance.select("doc_id", "source_id"), r.sources, r.derived.select("id", "status"))[1])

over(
    "supersede",
    """select d.id, case when num % 6 = 0 then 'current' when num % 6 = 1 and k.id is not null then 'superseded' else status end as status,
      case when num % 6 = 0 then null when num % 6 = 1 and k.id is not null then concat('sum-doc-', num + 2) else superseded_by end as superseded_by
    from derived d left join (select id from derived) k on k.id = concat('sum-doc-', num + 2)""",
)(
    lambda r: C.supersede(
        r.derived.select("id", "status", "superseded_by"),
        r.derived.where("num % 6 < 3").select("id", F.when(F.col("num") % 6 == 2, F.col("id")).otherwise(F.concat(F.lit("sum-doc-"), F.col("num") + 2)).alias("by"), (F.col("num") % 6 == 0).alias("lift")),
    )
)

over(
    "weakest_derivation",
    """select p.source_id, case max(case d.derivation when 'model-read' then 1 when 'synthesis' then 2 else 0 end) when 2 then 'synthesis' when 1 then 'model-read' else 'extracted' end as weakest
    from provenance p join derived d on d.id = p.doc_id where d.derivation <> 'ocr' group by 1""",
)(lambda r: r.provenance.join(r.derived.where("derivation <> 'ocr'").select(F.col("id").alias("doc_id"), "derivation"), "doc_id").groupBy("source_id").agg(C.weakest(F.col("derivation")).alias("weakest")))

over(
    "candidates_dedup",
    """, c as (select d.id, concat('sha256:', sha256(concat(p.source_id, ':', coalesce(p.hash, ''), chr(10), d.tag))) as fp, d.num from derived d
      join provenance p on p.doc_id = d.id and p.source_id = concat('src-doc-', d.num)),
    k as (select fp, bool_or(num % 2 = 0) as declined from c where num % 3 = 0 group by 1)
    select c.id, case when k.declined then 'declined before' when k.declined is not null or row_number() over (partition by c.fp order by c.id) > 1 then 'pending already' else 'staged' end as outcome
    from c left join k on k.fp = c.fp""",
)(
    lambda r: (
        lambda c: C.stage(
            c.select("id", "fingerprint"),
            c.where("num % 3 = 0").select("fingerprint", F.when(F.col("num") % 2 == 0, "declined").otherwise("pending").alias("status")),
        )
    )(
        r.derived.join(r.provenance.withColumnRenamed("doc_id", "id"), "id")
        .where(F.col("source_id") == F.concat(F.lit("src-doc-"), "num"))
        .select("id", "num", H.claim_fingerprint(F.array(F.struct(F.col("source_id").alias("id"), "hash")), F.col("tag")).alias("fingerprint"))
    )
)

_TASKS = "select concat('task-', seq) as id, case seq % 5 when 0 then 'pending' when 1 then 'blocked' when 2 then 'done' when 3 then 'declined' else 'cancelled' end as status, case seq % 3 when 0 then 'done' when 1 then 'pending' else 'blocked' end as wanted from log"


@over(
    "queue_transitions",
    f"""select id, case when outcome = 'moved' then wanted else status end as status, outcome from (select *, case when wanted = status then 'noop'
      when (status = 'pending' and wanted in ('done', 'blocked')) or (status = 'blocked' and wanted in ('pending', 'done')) then 'moved' else 'illegal' end as outcome from ({_TASKS}))""",
)
def queue_transitions(r: Relations) -> DataFrame:
    rows = r.log.sparkSession.sql(_TASKS.replace("from log", "from {log}"), log=r.log)
    return C.restatus(rows.select("id", "status"), rows.select("id", F.col("wanted").alias("status")))


over("queue_counts", f"select status, count(*) as n from ({_TASKS}) group by 1")(
    lambda r: C.queue_list(r.log.sparkSession.sql(_TASKS.replace("from log", "from {log}"), log=r.log)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
)

# --- integrity ----------------------------------------------------------------------------------

_F = lambda rule, severity, id_, detail, rest: f"select '{rule}' as rule, '{severity}' as severity, {id_} as id, {detail} as detail {rest}"
_DANGLES = lambda c: f"where {c} not in (select id from {ALL_DOCS})"
_GARBLED = lambda c: "(" + " or ".join(f"contains({c}, '{m}')" for m in T.MOJIBAKE) + ")"
_LINT_SQL = {
    "L1": _F("L1", "error", "id", "'no sources'", "from derived where id not in (select doc_id from provenance)"),
    "L2": _F("L2", "error", "doc_id", "source_id", f"from provenance where source_id in (select id from {ALL_DOCS} where kind <> 'source')"),
    "L3": _F("L3", "error", "doc_id", "source_id", f"from provenance {_DANGLES('source_id')}"),
    "L4": _F("L4", "error", "p.doc_id", "p.source_id", "from provenance p join sources s on s.id = p.source_id join derived d on d.id = p.doc_id where p.hash <> s.content_hash and d.status not in ('stale', 'superseded')"),
    "L6": _F("L6", "error", "id", "cast(n as varchar)", f"from (select id, row_number() over (partition by id) as n from (select id from {ALL_DOCS} union all select id from versions)) where n > 1"),
    "L7": _F("L7", "error", "doc_id", "target", f"from see_also {_DANGLES('target')}"),
    "L9": " union all ".join([
        _F("L9", "error", "id", "'capture_reason'", "from sources where capture = 'reference' and coalesce(capture_reason, '') = ''"),
        _F("L9", "error", "id", "capture", "from sources where capture not in ('full', 'reference')"),
        *[_F("L9", "error", "id", f"'{f}'", f"from {t} where {f} is null") for t, fields in {"sources": ["type", "canonical"], "derived": ["derived_at"], "projects": ["type"], "decisions": ["type"]}.items() for f in fields],
        _F("L9", "error", "id", "'origin'", "from sources where not has_origin"), _F("L9", "error", "id", "'history'", "from sources where entries = 0"),
        _F("L9", "error", "id", "'sources'", "from derived where id not in (select doc_id from provenance)"),
        _F("L9", "error", "id", "'members'", "from projects where not has_members"),
        _F("L9", "warn", "id", "type", "from derived where type not in ('summary', 'entity', 'concept', 'question', 'insight')"),
    ]),
    "L10": _F("L10", "warn", "doc_id", "cast(count(*) as varchar)", "from provenance p left join sources s on s.id = p.source_id group by doc_id having bool_and(coalesce(s.capture = 'reference', false))"),
    "L11": _F("L11", "error", "project_id", "member_id", f"from members {_DANGLES('member_id')}"),
    "L5": _F("L5", "error", "id", "canonical", "from sources where held_hash <> concat('sha256:', sha256(text))"),
    "L13": " union all ".join([
        _F("L13", "error", "id", f"concat('{why} {kind}', file)", f"from ({a} except {b})")
        for kind, listed, held in (
            ("", "select id, file from versions", "select id, file from files where not starts_with(file, 'source-text')"),
            ("aid ", "select id, text_aid as file from versions where text_aid is not null", "select id, file from files where starts_with(file, 'source-text')"),
        )
        for why, a, b in (("missing", listed, held), ("unlisted", held, listed))
    ]),
    "L14": _F("L14", "error", "id", "derivation", "from derived where derivation not in ('extracted', 'model-read', 'synthesis')"),
    "L15": _F("L15", "error", "id", "'no summary'", "from sources where id not in (select source_id from provenance p join derived d on d.id = p.doc_id where d.type = 'summary')"),
    "L16": _F("L16", "error", "id", "scope", "from projects where scope not in ('project', 'global')"),
    "L17": " union all ".join([
        _F("L17", "error", "id", "status", "from decisions where status not in ('proposed', 'accepted')"),
        _F("L17", "error", "decision_id", "source_id", "from evidence where source_id not in (select id from sources)"),
        _F("L17", "warn", "decision_id", "source_id", "from evidence e join sources s on s.id = e.source_id where s.version > e.version"),
    ]),
    "L18": _F("L18", "warn", "doc_id", "concat(own, '/', n)", """from (select d.id as doc_id, length(coalesce(d.abstract, '')) + length(d.body) as own, sum(length(s.text))::bigint as n
      from derived d join provenance p on p.doc_id = d.id join sources s on s.id = p.source_id where d.type = 'summary' group by d.id, d.abstract, d.body) where n >= 500 and own > n"""),
    "L21": " union all ".join([
        _F("L21", "error", "id", "'superseded_at'", "from derived where status = 'superseded' and superseded_at is null"),
        _F("L21", "error", "id", "'no successor'", "from derived where status = 'superseded' and superseded_by is null and supersede_reason is null"),
        _F("L21", "error", "id", "superseded_by", f"from derived where status = 'superseded' and superseded_by not in (select id from {ALL_DOCS})"),
        *[_F("L21", "error", "id", f"'not closed: {f}'", f"from derived where status <> 'superseded' and {f} is not null") for f in ("superseded_by", "superseded_at", "supersede_reason")],
    ]),
    "L23": " union all ".join([
        _F("L23", "warn", "cast(seq as varchar)", "stamp", "from log where stamp like '%noon'"),
        _F("L23", "warn", "cast(seq as varchar)", "op", "from log where op = 'note'"),
    ]),
    "L24": _F("L24", "warn", "id", "'path as body'", "from derived where regexp_matches(body, '^(\\.\\.?|~)?/\\S+$')"),
    "L25": _F("L25", "warn", "id", "'body'", f"from (select id, body from derived union all select id, body from decisions) where {_GARBLED('body')}"),
    "L26": " union all ".join([
        _F("L26", "warn", "id", "authored_by", "from derived where authored_by <> 'adapter'"),
        _F("L26", "warn", "id", "authored_by", "from decisions where authored_by <> 'operator'"),
    ]),
}
for _rule, _sql in _LINT_SQL.items():
    if _rule == "L6":
        over("lint_L6", _sql)(lambda r: lint.l6(lint.registered(r)))
    else:
        over(f"lint_{_rule}", _sql)(lambda r, rule=lint.RULES[_rule]: rule(r))
_EVERY = " union all ".join(f"({s})" for s in _LINT_SQL.values())
over("lint_findings", f"select * from ({_EVERY})")(lambda r: lint.ordered(lint.findings(r)))
over(
    "lint_summary",
    f"select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warn') as warnings, (select count(*) from {ALL_DOCS}) as docs from ({_EVERY})",
)(lint.summary)
over(
    "status_stale",
    "select distinct p.doc_id from provenance p join sources s on s.id = p.source_id join derived d on d.id = p.doc_id where p.hash <> s.content_hash and d.status <> 'stale'",
)(lambda r: lint.stale_pairs(r).where("status <> 'stale'").select("doc_id").distinct())

# --- finding ------------------------------------------------------------------------------------

_CATALOG = """(select id, 'source' as kind, 0 as rank, 'source' as type, null as status, lower(concat_ws(' ', id, lang, ref, upstream_ref, case when canonical = 'source.pdf' then '.pdf' end)) as identity, lower(text) as mention from sources
  union all select id, 'derived', 1, type, status, lower(concat_ws(' ', id, title, tag)), lower(concat_ws(' ', abstract, body)) from derived
  union all select id, 'project', 2, null, null, lower(concat_ws(' ', id, title)), lower(scope) from projects
  union all select id, 'decision', 3, null, status, lower(concat_ws(' ', id, title)), lower(body) from decisions)"""


def _find_sql(words: list[str], where: str = "", keep_closed: bool = False) -> str:
    hay = "concat_ws(chr(10), identity, mention)"
    named = " + ".join(f"contains(identity, '{w}')::int" for w in words) or "0"
    holds = " and ".join(f"contains({hay}, '{w}')" for w in words) or "true"
    closed = "" if keep_closed else "and coalesce(status, '') <> 'superseded'"
    return f"""select id, kind, type, {named} as named_terms, case when {len(words)} > 0 and {named} = {len(words)} then 'name' else 'mention' end as matched
      from {_CATALOG} where {holds} {closed} {where}"""


_SCOPE = lambda p: f"(select distinct member_id from members where project_id = '{p}' or project_id in (select id from projects where scope = 'global'))"
over("find_documents", _find_sql(["en", "the", "12"]))(lambda r: V.find(r, "EN the 12"))
over("find_by_type", _find_sql(["doc", "la"], "and type = 'summary'", True))(lambda r: V.find(r, "doc la", "summary", include_superseded=True))
over("find_scoped", _find_sql(["the"], f"and id in {_SCOPE('view-1')}"))(lambda r: V.find(r, "the", project="view-1"))
over("find_held_format", _find_sql(["pdf", "src"]))(lambda r: V.find(r, "pdf SRC"))
over("find_why", _find_sql(["the", "re"], "and kind = 'decision'").replace("'decision', 3, null,", "'decision', 3, null,"))(lambda r: V.find(r, "the re").where("kind = 'decision'"))
over("query_facets", f"select id, kind, type, status from (select *, row_number() over (order by rank, id) as n from {_CATALOG} where kind = 'derived' and type = 'summary' and status = 'superseded') where n <= 50")(
    lambda r: V.facets(r, kind="derived", type_="summary", status="superseded")
)
over("query_system", f"select id, kind, null as type, status from {_CATALOG} where id in (select id from sources where system = 'src1') order by id limit 500")(
    lambda r: V.facets(r, system="src1", limit=500)
)
#: A source that some document cites, at every scale of the tables.
_CITED = "(select min(source_id) from provenance where source_id like 'src-doc-%')"
over("query_cites", f"select id, kind, type, status from {_CATALOG} where id in (select doc_id from provenance where source_id = {_CITED}) order by rank, id limit 50")(
    lambda r: V.facets(r, cites=r.provenance.where("source_id like 'src-doc-%'").agg(F.min("source_id")).first()[0])
)
over(
    "query_scope_after_limit",
    f"select id, kind, null as type, status from (select * from {_CATALOG} where kind = 'source' order by rank, id limit 100) where id in {_SCOPE('view-2')}",
)(lambda r: V.facets(r, kind="source", limit=100, project="view-2"))

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}]+)', 1)"
over(
    "query_words_bm25",
    f""", t as (select id, {_TOKENS} as w from sources), k as (select id, len(w) as len, unnest(['en', 'the']) as token, len(list_filter(w, lambda x: x = 'en')) as a, len(list_filter(w, lambda x: x = 'the')) as b from t),
    p as (select id, len, token, case token when 'en' then a else b end as tf from k where case token when 'en' then a else b end > 0),
    df as (select token, count(*) as df from p group by 1), g as (select count(*) as n, avg(len(w)) as mean from t)
    select id, round(sum(ln((g.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) as score
    from p join df using (token), g group by id having count(*) = 2""",
)(lambda r: V.bm25(r.sources, "id", "text", "the EN").select("id", F.round("score", 6).alias("score")))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_COSINE = "round(list_cosine_similarity(e.embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6)"


@raw("search_topk", f"select vec_id, {_COSINE} as score from embeddings e order by round(list_cosine_similarity(e.embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 9) desc, vec_id limit 10")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.search(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("src-doc-"), "vec_id").alias("id"), "embedding")


def _union_sql(terms: list[str], more: str = "") -> str:
    return f"""sem as (select n.id, sr, d.kind from (select id, row_number() over (order by s desc, id) as sr
      from (select concat('src-doc-', vec_id) as id, round(list_cosine_similarity(e.embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 9) as s from embeddings e)
      order by s desc, id limit 10) n join {ALL_DOCS} d on d.id = n.id),
    lit as ({_find_sql(terms, more)}),
    merged as (select coalesce(lit.id, sem.id) as id, coalesce(lit.kind, sem.kind) as kind, case when matched = 'name' then 0 when matched is not null and sr is not null then 1 when matched is not null then 2 else 3 end as tier,
      case when sr is null then 'find' when matched is null then 'semantic' else 'both' end as via, named_terms, sr as sem_rank from lit full join sem on lit.id = sem.id)"""


_QUERIES["retrieve_union"] = lambda spark, d: V.retrieve(stand_in(spark, d), vectors(spark, d), "en 12", _query_vector(spark, d), type_="source")
_SQL["retrieve_union"] = duckdb_ctes() + ", " + _union_sql(["en", "12"], "and type = 'source'") + " select * from merged"
_QUERIES["retrieve_scoped"] = lambda spark, d: V.retrieve(stand_in(spark, d), vectors(spark, d), "en 2", _query_vector(spark, d), project="view-1")
_SQL["retrieve_scoped"] = duckdb_ctes() + ", " + _union_sql(["en", "2"]) + f"""
select *, true as in_scope from merged where id in {_SCOPE('view-1')} union all select *, false from (select * from merged where id not in {_SCOPE('view-1')}
  order by tier, case when tier in (1, 3) then sem_rank end nulls first, named_terms desc nulls last, list_position(['source', 'derived', 'project', 'decision'], kind), id limit 5)"""
over("retrieve_without_vectors", f"select id, kind, case matched when 'name' then 0 else 2 end as tier, 'find' as via, named_terms, null as sem_rank from ({_find_sql(['en', '2', 'sum'])})")(
    lambda r: V.retrieve(r, None, "en 2 sum")
)


over("index_diff", "select coalesce(s.id, h.id) as id, case when s.id is null then 'prune' when h.hash = s.content_hash then 'fresh' else 'embed' end as action from sources s full join (select doc_id as id, hash from (select concat('src-doc-', num + 3) as doc_id, content_hash as hash from sources where num % 3 = 0 union all select id, content_hash from sources where num % 3 = 1)) h on h.id = s.id")(
    lambda r: V.index_diff(
        r.sources.select("id", "content_hash"),
        r.sources.where("num % 3 = 0").select(F.concat(F.lit("src-doc-"), F.col("num") + 3).alias("id"), "content_hash").unionByName(r.sources.where("num % 3 = 1").select("id", "content_hash")),
    )
)

# --- lineage ------------------------------------------------------------------------------------

_STATED = """(select 'grounded_by' as relation, p.doc_id as source, p.source_id as target, coalesce(p.hash <> s.content_hash, false) as stale from provenance p left join sources s on s.id = p.source_id
  union all select 'see_also', doc_id, target, false from see_also union all select 'member_of', member_id, project_id, false from members
  union all select 'evidence', decision_id, source_id, false from evidence union all select 'superseded_by', id, superseded_by, false from derived where superseded_by is not null
  union all select 'excerpt_of', s.id, (select min(w.id) from sources w where w.ref = s.upstream_ref), false from sources s where s.upstream_ref in (select ref from sources)
  union all select 'from_repo', s.id, (select min(w.id) from sources w where w.ref = split_part(s.ref, '#', 1)), false from sources s
    where s.system = 'repo' and contains(s.ref, '#') and split_part(s.ref, '#', 1) in (select ref from sources))"""
_EDGES = f"(select relation, source, target, relation <> 'see_also' as directed, bool_or(stale) as stale from {_STATED} where source <> target and source in (select id from {ALL_DOCS}) and target in (select id from {ALL_DOCS}) group by 1, 2, 3, 4)"
over("graph_edges", f"select * from {_EDGES}")(G.edges)
over("graph_dangling", f"select distinct relation, source, target from {_STATED} where source <> target and (target not in (select id from {ALL_DOCS}) or source not in (select id from {ALL_DOCS}))")(G.dangling)
over("graph_degree", f"select id, count(*) as degree from (select source as id from {_EDGES} union all select target from {_EDGES}) group by 1")(lambda r: G.degree(G.edges(r)))
over(
    "graph_bfs_depth2",
    f""", adj as (select source as f, relation, target as t from {_EDGES} union select target, relation, source from {_EDGES}),
    d0 as (select 'view-1' as id),
    d1 as (select t as id, min((f, relation)) as way from adj join d0 on f = d0.id where t not in (select id from d0) group by 1),
    d2 as (select t as id, min((f, relation)) as way from adj join d1 on f = d1.id where t not in (select id from d0 union select id from d1) group by 1)
    select id, 0 as depth, null as reached_from, null as reached_by from d0
    union all select id, 1, way[1], way[2] from d1 union all select id, 2, way[1], way[2] from d2""",
)(lambda r: G.walk(G.adjacency(G.edges(r)), ["view-1"], 2))
over(
    "graph_out_relations",
    f""", adj as (select source as f, relation, target as t from {_EDGES} where relation in ('see_also', 'grounded_by') union select target, relation, source from {_EDGES} where relation = 'see_also'),
    d0 as (select 'sum-doc-1' as id union select 'sum-doc-2'),
    d1 as (select t as id, min((f, relation)) as way from adj join d0 on f = d0.id where t not in (select id from d0) group by 1)
    select id, 0 as depth, null as reached_from, null as reached_by from d0 union all select id, 1, way[1], way[2] from d1""",
)(lambda r: G.walk(G.adjacency(G.edges(r), "out", ["see_also", "grounded_by"]), ["sum-doc-1", "sum-doc-2"], 1))

_NEAR = f"""d0 as (select 'view-1' as id), adj as (select source as f, relation, target as t from {_EDGES} union select target, relation, source from {_EDGES}),
    d1 as (select t as id, min((f, relation)) as way from adj join d0 on f = d0.id where t not in (select id from d0) group by 1),
    near as (select id, 0 as depth, null as reached_from, null as reached_by from d0 union all select id, 1, way[1], way[2] from d1)"""
_LABELS = """(select id, ref as label from sources union all select id, title from derived union all select id, title from projects union all select id, title from decisions)"""
_SEEN = "list_sort(list_distinct(list(f)))"
over(
    "graph_subgraph_nodes",
    f""", {_NEAR}, lists as (select t as id, {_SEEN} as reached_from, list_sort(list_distinct(list(relation))) as reached_by from adj where f = 'view-1' and t <> 'view-1' group by 1)
    select near.id, depth, coalesce(lists.reached_from, []) as reached_from, coalesce(lists.reached_by, ['seed']) as reached_by, kind, type, label, coalesce(degree, 0) as degree, near.id in {_SCOPE('view-1')} as in_scope
    from near join {ALL_DOCS} d on d.id = near.id join {_LABELS} l on l.id = near.id left join lists on lists.id = near.id
    left join (select id, count(*) as degree from (select source as id from {_EDGES} union all select target from {_EDGES}) group by 1) g on g.id = near.id""",
)(lambda r: G.subgraph(r, ["view-1"], scope="view-1")[0])
over(
    "graph_subgraph_edges",
    f""", {_NEAR} select *, concat(relation, ':', source, ':', target) as id from {_EDGES} where source in (select id from near) and target in (select id from near)""",
)(lambda r: G.subgraph(r, ["view-1"], scope="view-1")[1])

#: A walk that its cap stops inside the second layer: layers in order of (least parent, id), as many of a layer as there is room for.
_CAP = 12
_CAPPED = f"""adj as (select source as f, relation, target as t from {_EDGES} union select target, relation, source from {_EDGES}),
    d0 as (select 'view-1' as id), n1 as (select t as id, min(f) as p from adj join d0 on f = d0.id where t not in (select id from d0) group by 1),
    d1 as (select id from n1 order by p, id limit {_CAP - 1}), s1 as (select id from d0 union select id from d1),
    n2 as (select t as id, min(f) as p from adj join d1 on f = d1.id where t not in (select id from s1) and (select count(*) from n1) <= {_CAP - 1} group by 1),
    d2 as (select id from n2 order by p, id limit (select {_CAP} - count(*) from s1)),
    every as (select id, 0 as depth from d0 union all select id, 1 from d1 union all select id, 2 from d2)"""
over(
    "graph_capped",
    f""", {_CAPPED}, w as (select e.id, f, relation from every e join adj on t = e.id join every p on p.id = f where p.depth = e.depth - 1)
    select every.id, depth, coalesce({_SEEN.replace("list(f)", "list(f) filter (f is not null)")}, []) as reached_from,
      case when depth = 0 then ['seed'] else list_sort(list_distinct(list(relation))) end as reached_by from every left join w on w.id = every.id group by 1, 2""",
)(lambda r: G.all_ways(G.explore(G.adjacency(G.edges(r)), ["view-1"], 2, _CAP)).withColumn("reached_by", F.array_sort("reached_by")))
over(
    "graph_frontier",
    f""", {_CAPPED} select f as id, count(*) as remaining from adj where f in (select id from d1 union select id from d2) and t not in (select id from every) group by 1""",
)(lambda r: G.explore(G.adjacency(G.edges(r)), ["view-1"], 2, _CAP).frontier)
over(
    "graph_edges_capped",
    f"""select *, (select greatest(0, count(*) - 40) from {_EDGES} where relation in ('member_of', 'evidence')) as omitted from
      (select *, concat(relation, ':', source, ':', target) as id from {_EDGES} where relation in ('member_of', 'evidence') order by id limit 40)""",
)(lambda r: (lambda g: g.edges.withColumn("omitted", F.lit(g.omitted_edges).cast("long")))(G.project(r, relations=["member_of", "evidence"], max_edges=40)))

#: Two words that follow each other in some document, at every scale of the tables.
_PAIR = "(select min(regexp_extract(lower(body), '([a-z]{3,} [a-z]{3,}) ', 1)) from decisions where regexp_matches(lower(body), '[a-z]{3,} [a-z]{3,} '))"
_EVERYTHING = "lower(concat_ws(' ', identity, mention))"


@over(
    "query_phrase",
    f"""select id, kind, type, status from {_CATALOG}, (select {_PAIR} as p)
    where kind = 'decision' and regexp_matches({_EVERYTHING}, concat('(^|[^\\p{{L}}\\p{{N}}])', replace(p, ' ', '[^\\p{{L}}\\p{{N}}]+'), '($|[^\\p{{L}}\\p{{N}}])'))""",
)
def query_phrase(r: Relations) -> DataFrame:
    own = r.decisions.select(F.regexp_extract(F.lower("body"), "([a-z]{3,} [a-z]{3,}) ", 1).alias("p")).where("p <> ''")
    return V.facets(r, words=own.agg(F.min("p")).first()[0].replace(" ", "-"), kind="decision", limit=500)


def parked(rows: DataFrame) -> DataFrame:
    """rows written once, so that what reads them several times doesn't join again."""
    at = scratch(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def indexed(rows: DataFrame) -> str:
    """An index in two generations: of documents by turns older and as they are now."""
    store = scratch(rows.sparkSession)
    old = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    KB.refresh(rows.where("id not like '%7'").withColumn("text", F.when(old, F.lit("old words")).otherwise(F.col("text"))).withColumn("ident", F.when(old, "old").otherwise(F.col("ident"))), store)
    KB.refresh(rows, store)
    return store


@over("catalog_words", _SQL["query_words_bm25"].split(duckdb_ctes())[1])
def catalog_words(r: Relations) -> DataFrame:
    rows = r.sources.select("id", F.lit("source").alias("kind"), F.lit(0).alias("rank"), "type", F.lit(None).cast("string").alias("status"), "text", F.col("content_hash").alias("ident"))
    return KB.ranked(rows.sparkSession, indexed(rows), "the EN").select("id", F.round("score", 6).alias("score"))


@over("catalog_phrase", _SQL["query_phrase"].split(duckdb_ctes())[1])
def catalog_phrase(r: Relations) -> DataFrame:
    own = r.decisions.select(F.regexp_extract(F.lower("body"), "([a-z]{3,} [a-z]{3,}) ", 1).alias("p")).where("p <> ''")
    phrase = own.agg(F.min("p")).first()[0].replace(" ", "-")
    return KB.query(r, indexed(parked(KB.documents(r))), words=phrase, kind="decision", limit=500).hits


over("catalog_info", f"""select count(*) as docs, count(*) filter (kind = 'source') as source_docs, count(*) filter (kind = 'derived') as derived_docs, count(*) filter (kind = 'project') as project_docs,
      count(*) filter (kind = 'decision') as decision_docs, sum(len(w)) as words, (select count(distinct t) from (select unnest({_TOKENS.replace('text', "concat_ws(' ', identity, mention)")}) as t from {_CATALOG})) as different_words, 2 as generations
    from (select kind, {_TOKENS.replace('text', "concat_ws(' ', identity, mention)")} as w from {_CATALOG})""")(lambda r: KB.info(r.sources.sparkSession, indexed(parked(KB.documents(r)))))

over("embed_hashed", f"""select id, ('0x' || substr(md5(w), 1, 6))::int % 16 as cell, sum(case when substr(md5(w), 32, 1) < '8' then 1 else -1 end)::bigint as weight
    from (select id, unnest({_TOKENS}) as w from sources) group by 1, 2""")(
    lambda r: V.hashed(r.sources.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\\p{L}\\p{N}]+)".replace("\\\\", "\\")), F.lit(1))).alias("word")), 16)
)


@over("reindex", "select id, content_hash, true as unit, num % 5 <> 0 and num % 4 <> 0 as kept from sources")
def reindex(r: Relations) -> DataFrame:
    """An index that lacks every fifth source, holds an old hash of every fourth, and one that is gone; kept rows have a vector of their own."""
    # of length 1, and no counts of words stand in this proportion
    own = F.array(F.cos(F.lit(1.0)), F.sin(F.lit(1.0)), *[F.lit(0.0)] * 62).cast("array<float>")
    held = r.sources.where("num % 5 <> 0").select("id", F.when(F.col("num") % 4 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), own.alias("embedding"))
    gone = held.sparkSession.range(1).select(F.lit("src-gone").alias("id"), F.lit("x").alias("content_hash"), own.alias("embedding"))
    rows = V.reindex(r.sources.select("id", "content_hash", "text"), held.unionByName(gone))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select("id", "content_hash", (F.abs(size - 1) < 1e-5).alias("unit"), (F.col("embedding") == own).alias("kept"))


# --- ledgers ------------------------------------------------------------------------------------

over(
    "usage_report",
    """select op, count(*) as n, sum(bytes_in)::bigint as bytes_in, sum(bytes_out)::bigint as bytes_out, sum(tokens)::bigint as tokens, count(tokens) as tokens_n, count(duration_ms) as timed_n,
      round(sum(duration_ms::decimal(20, 4)), 1)::double as total_ms, round(quantile_disc(duration_ms, 0.5), 1) as p50_ms, round(quantile_disc(duration_ms, 0.95), 1) as p95_ms from usage group by op""",
)(lambda r: L.cost(r.usage))
over("usage_underreported", "select count(*) filter (op in ('ask', 'review', 'synthesize')) as reasoning, count(*) filter (op = 'find') as lookups, count(*) filter (op in ('ask', 'review', 'synthesize')) = 0 and count(*) filter (op = 'find') >= 5 as underreported from (select case when op = 'view' then 'find' else op end as op from usage)")(
    lambda r: L.underreported(r.usage.withColumn("op", F.when(F.col("op") == "view", "find").otherwise(F.col("op"))))
)
_ATTENTION = """(select s.id, strlen(s.text) as bytes, coalesce(strong, 0) as strong, coalesce(weak, 0) as weak, last_strong, last_touch from sources s left join
  (select doc_id, count(*) filter (op in ('purchase', 'click')) as strong, count(*) filter (op not in ('purchase', 'click')) as weak,
    max(day) filter (op in ('purchase', 'click')) as last_strong, max(day) as last_touch from usage group by 1) u on u.doc_id = s.id)"""


def attention(r: Relations) -> DataFrame:
    return L.attention(r.usage, r.sources.select("id", F.octet_length("text").cast("long").alias("bytes")), ["purchase", "click"])


over("attention_docs", f"select * from {_ATTENTION}")(lambda r: L.by_last_touch(attention(r)))
over(
    "attention_windows",
    f"""select days, count(*) filter (idle) as docs, coalesce(sum(bytes) filter (idle), 0)::bigint as bytes, round(count(*) filter (idle) * 100.0 / count(*), 1)::double as pct,
      (select date '{AS_OF}' - min(day)::date from usage) >= days as meaningful
    from (select *, last_touch is null or last_touch < strftime(date '{AS_OF}' - days, '%Y-%m-%d') as idle from {_ATTENTION}, (values (30), (60), (90)) v(days)) group by days""",
)(lambda r: L.dormancy(attention(r), r.usage, AS_OF).withColumn("pct", F.col("pct").cast("double")))
over("scope_bytes", "select sum(coalesce(strlen(text), 0))::bigint as bytes, count(*) as n from usage u left join sources s on s.id = u.doc_id")(
    lambda r: L.scope_bytes(r.usage.select(F.col("doc_id").alias("id")), r.sources.select("id", F.octet_length("text").cast("long").alias("bytes")))
)
over("captures_since_op", "select op, (select count(*) from log c where c.op = 'capture' and c.seq > l.last) as captures from (select op, max(seq) as last from log where op <> 'capture' group by 1) l")(
    lambda r: L.captures_since(r.log)
)
_VERDICTS = "(select target as id, verdict, stamp as checked from (select *, row_number() over (partition by target order by seq desc) as n from log where op = 'drift-check') where n = 1)"
over("last_verdict", f"select * from {_VERDICTS}")(lambda r: L.last_verdict(r.log))
over("verdict_tally", "select count(*) filter (verdict like 'same%') as same, count(*) filter (verdict = 'changed') as changed, count(*) filter (verdict = 'unreachable') as unreachable from log where op = 'drift-check'")(
    lambda r: L.verdict_tally(r.log)
)
over(
    "unreachable_streak",
    "select target as id, count(*) as streak from log l where op = 'drift-check' and not exists (select 1 from log m where m.op = 'drift-check' and m.target = l.target and m.seq >= l.seq and m.verdict <> 'unreachable') group by 1",
)(lambda r: L.unreachable_streak(r.log))
_WORK = f"""(select s.id, system, verdict, greatest(captured_at, coalesce(checked, '')) as last_contact from sources s left join {_VERDICTS} v on v.id = s.id
  where system not in ('file', 'chat', 'inbox') and (recoverable is true or upstream_ref is not null))"""
over("drift_worklist", f"select * from {_WORK} where last_contact < '2024-01-24T00:00:00Z'")(lambda r: L.drift_worklist(r, AS_OF, older_than="1w"))
over("drift_worklist_36h", f"select * from {_WORK} where last_contact < '2024-01-29T12:00:00Z'")(lambda r: L.drift_worklist(r, AS_OF, older_than="36h"))
over("drift_worklist_noon", f"select * from {_WORK} where last_contact < '2024-01-29T22:48:00Z' and id in {_SCOPE('view-1')}")(
    lambda r: L.drift_worklist(r, "2024-01-31T10:48:00Z", "view-1", "1.5d")
)
over(
    "drift_counts",
    f"""select count(*) filter (s and last_contact < '2024-01-17T00:00:00Z') as in_scope, count(*) filter (not s) as outside_scope, count(*) filter (s and last_contact >= '2024-01-17T00:00:00Z') as age_filtered
    from (select *, id in {_SCOPE('view-1')} as s from {_WORK})""",
)(lambda r: L.worklist_counts(r, AS_OF, "view-1", "14"))
_GLOBAL = "(select member_id from members where project_id in (select id from projects where scope = 'global'))"
_UNCOVERED = f"""(select distinct system from sources where system not in ('file', 'chat', 'inbox')
  except select system from sources where id in {_GLOBAL} except select system from connectors where doc_id in {_GLOBAL})"""
over("uncovered_systems", f"select system from {_UNCOVERED}")(L.uncovered_systems)
over("status_aged", f"select id, as_of, (date '{AS_OF}' - as_of::date)::int as days_old from derived where date '{AS_OF}' - as_of::date > 10")(lambda r: L.aged(r, AS_OF, 10))
over(
    "status_summary",
    f"""select (select count(*) from sources) as sources, (select count(*) from sources where recoverable and system not in ('file', 'chat', 'inbox')) as recoverable,
      (select count(*) from derived where date '{AS_OF}' - as_of::date > 10) as aged,
      (select count(*) from derived where type = 'entity') as entity_docs, (select count(*) from derived where type = 'concept') as concept_docs, (select count(*) from derived where type = 'question') as question_docs,
      (select arg_max(stamp, seq) from log where op = 'drift-check') as last_drift_check, (select arg_max(stamp, seq) from log where op = 'map') as last_map,
      (select count(*) from log where op = 'capture' and seq > (select max(seq) from log where op = 'map')) as captures_since_map,
      (select count(*) from derived) as derived, (select count(*) from derived where status = 'superseded') as superseded,
      (select count(distinct p.doc_id) from provenance p join sources s on s.id = p.source_id join derived d on d.id = p.doc_id where p.hash <> s.content_hash and d.status <> 'stale') as stale,
      (select count(*) from {_UNCOVERED}) as uncovered_systems,
      (select count(*) from log where op = 'capture' and seq > (select max(seq) from log where op = 'lint')) as captures_since_lint""",
)(lambda r: L.status(r, AS_OF, 10))

# --- views --------------------------------------------------------------------------------------

over("index_markers", """, n as (select doc_id, count(*) as n, bool_or(coalesce(p.hash <> s.content_hash, false)) as changed from provenance p left join sources s on s.id = p.source_id group by 1)
    select id, concat_ws(' · ', derivation, case when n > 0 then concat(n, case when n = 1 then ' source' else ' sources' end) end,
      case when status = 'superseded' then 'superseded' when changed or status = 'stale' then 'stale' end) as markers from derived left join n on n.doc_id = id""")(P.index_markers)
_LINE = lambda *parts: "concat('{', concat_ws(',', " + ", ".join(parts) + "), '}')"
_KEY = lambda k, v=None: f"""case when {v or k} is not null then concat('"{k}":', to_json({v or k})) end"""
_LIST = lambda k, v: f"""case when len({v}) > 0 then concat('"{k}":', to_json({v})) end"""
_IS = lambda kind: "'" + f'"kind":"{kind}"' + "'"
over(
    "index_records",
    f"""select 0 as rank, id, {_LINE(_KEY('content_hash'), _KEY('id'), _IS('source'), "concat('" + '"origin":' + "', " + _LINE(_KEY('ref'), _KEY('system'), _KEY('upstream_ref')) + ")", _KEY('path'), _LIST('tags', 'tags'), _KEY('tier', 'capture'), _KEY('version'))} as line from sources
    union all select 1, id, {_LINE(_KEY('abstract', "nullif(abstract, '')"), _KEY('as_of'), _KEY('derivation'), _KEY('id'), _IS('derived'), _KEY('path'), "case when p is not null then concat('" + '"provenance":[' + "', p, ']') end", _KEY('status'), _LIST('tags', 'tags'), _KEY('title'), _KEY('type'))}
      from derived left join (select doc_id, string_agg(concat('{{"hash":', coalesce(to_json(hash), 'null'), ',"id":', to_json(source_id), '}}'), ',' order by ord) as p from provenance group by 1) on doc_id = id
    union all select 2, id, {_LINE(_KEY('id'), _IS('project'), _KEY('path'), _KEY('scope'), _KEY('title'), _KEY('type'))} from projects
    union all select 3, id, {_LINE("case when e is not null then concat('" + '"evidence":' + "', to_json(e)) end", _KEY('id'), _IS('decision'), _KEY('path'), _KEY('status'), _KEY('title'), _KEY('type'))}
      from decisions left join (select decision_id, list(source_id order by ord) as e from evidence group by 1) on decision_id = id""",
)(lambda r: P.index_records(r))
#: Repositories: constitutions that name files, files captured under those names in other spelling, and documents on either.
_HELD_REPOS = """select id, concat('repo-', num % 7, case when num % 5 > 0 then concat('#Dir/f', num % 50, '.md', case when num % 3 = 0 then '#part' else '' end) else '' end) as ref,
  case when num % 5 = 0 then concat('# Repository constitution', {n}, {n}, '- readme: README.md — sha256:0', {n}, '- adrs: dir/F', num % 50 + 1, '.md, dir/none.md — sha256:1', {n}, '- topology: (top-level shape) — sha256:2', {n}, '---', {n}, '- no: after.md — sha256:3') else text end as text,
  'repo' as system from sources where num % 2 = 0"""


@over(
    "repo_footprint",
    f""", s as ({_HELD_REPOS.replace('{n}', 'chr(10)')}), h as (select split_part(ref, '#', 1) as repo, max(id) as id from s where not contains(ref, '#') group by 1),
    f as (select split_part(ref, '#', 1) as repo, id, split_part(ref, '#', 2) as path from s where contains(ref, '#')),
    n as (select repo, unnest(['README.md', regexp_extract(text, 'dir/F[0-9]+.md'), 'dir/none.md']) as path from h join s using (id))
    select repo, 'constitution' as part, id, null as path from h union all select repo, 'covered', id, path from f
    union all select distinct split_part(ref, '#', 1), 'concept', d.id, null from provenance p join s on s.id = p.source_id join derived d on d.id = p.doc_id
    union all select repo, 'not captured', null, path from n where not exists (select * from f where f.repo = n.repo and lower(f.path) = lower(n.path))""",
)
def repo_footprint(r: Relations) -> DataFrame:
    own = r.sources.sparkSession.sql(_HELD_REPOS.replace("from sources", "from {s}").replace("{n}", "char(10)"), s=r.sources)
    return P.footprint(replace(r, sources=own))


over("cover_map", "select source_id, doc_id from (select p.source_id, d.id as doc_id, row_number() over (partition by p.source_id order by d.type <> 'summary', d.id) as n from provenance p join derived d on d.id = p.doc_id) where n = 1")(P.cover)
_BLURBS = """(select s.id, coalesce(b.blurb, s.ref) as blurb from sources s left join (select source_id, concat_ws(' — ', title, nullif(abstract, '')) as blurb from
  (select p.source_id, d.title, d.abstract, row_number() over (partition by p.source_id order by d.type <> 'summary', d.id) as n from provenance p join derived d on d.id = p.doc_id) where n = 1) b on b.source_id = s.id)"""
over("index_blurbs", f"select * from {_BLURBS}")(P.blurbs)
over("project_page", f"select project_id, ord, member_id, blurb from members left join {_BLURBS} b on b.id = member_id")(P.page)
over("resolve_scope", f"select member_id as id from {_SCOPE('view-3')}")(lambda r: P.resolve(r, "view-3"))
over(
    "project_update",
    "select project_id, array_to_string(list_concat(list(member_id order by ord) filter (ord % 2 = 0), ['new-1']), ',') as members from members group by 1",
)(
    lambda r: P.updated_members(
        r.members,
        r.members.groupBy("project_id").agg(F.array(F.lit("new-1"), F.lit("new-1")).alias("add"), F.collect_list(F.when(F.col("ord") % 2 == 1, F.col("member_id"))).alias("remove")),
    ).select("project_id", F.array_join("members", ",").alias("members"))
)
over(
    "connectors_roster",
    f"""select system, coalesce(ref, '') as ref, string_agg(distinct id, ',' order by id) as ids from
    (select id, system, ref from sources where system not in ('file', 'chat') union all select doc_id, system, ref from connectors) where id in {_SCOPE('view-1')} group by 1, 2""",
)(lambda r: P.connectors(r, "view-1"))


_URL = "split_part(split_part(url, '://', 2), '/', 1)"


@raw(
    "repo_coverage",
    f"""with p as (select page_id, {_URL} as repo, concat('docs/', page_id % 7, '.MD') as path from pages),
    w as (select distinct repo, lower(path) as path from p), h as (select distinct repo, lower(path) as path from p where page_id % 3 = 0)
    select w.repo, count(*) as surfaces, count(h.path) as covered, count(*) - count(h.path) as uncaptured from w left join h on h.repo = w.repo and h.path = w.path group by 1""",
)
def repo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    p = read(spark, sf_dir, "pages").select("page_id", host.alias("repo"), F.concat(F.lit("docs/"), F.col("page_id") % 7, F.lit(".MD")).alias("path"))
    captured = p.where("page_id % 3 = 0").select(F.concat("repo", F.lit("#\\"), F.replace("path", F.lit("/"), F.lit("\\"))).alias("ref"))
    return P.repo_coverage(captured, p.select("repo", "path").unionByName(p.select("repo", F.lit("topology").alias("path"))))


# --- reading ------------------------------------------------------------------------------------

over("read_page", "select id, substr(text, 501, 300) as text, length(text)::int as total, case when length(text) > 800 then 800 end as next from sources")(
    lambda r: R.page(r.sources, 500, 300)
)
over(
    "read_many_budget",
    """select ord, id, greatest(0, least(n, 20000 - before))::bigint as taken, greatest(0, least(n, 20000 - before)) > 0 or (n = 0 and before < 20000) as read
    from (select ord, id, length(text) as n, coalesce(sum(length(text)) over (order by ord rows between unbounded preceding and 1 preceding), 0) as before
      from members join sources on id = member_id)""",
)(lambda r: R.read_many(r.members.select("ord", F.col("member_id").alias("id")), r.sources, 20_000))
over(
    "find_text",
    """select id, p - 1 as "at", substr(text, greatest(1, p - 150), p + 3 + 150 - greatest(1, p - 150)) as around from
    (select id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = 'tht')[1:20]) as p from sources)""",
)(lambda r: R.find_text(r.sources, "tht").withColumn("at", F.col("at").cast("long")))


@over("section_slice", "select id, concat('## Two', chr(10), reverse(left(text, 40)), chr(10), '### Deep', chr(10), 'x') as text from (select id, regexp_replace(text, '\\s', ' ', 'g') as text from sources)")
def section_slice(r: Relations) -> DataFrame:
    flat = F.regexp_replace("text", r"[ \t\n\x0b\f\r]", " ")
    text = F.concat(F.lit("# One\n"), F.left(flat, F.lit(30)), F.lit("\n## Two\n"), F.reverse(F.left(flat, F.lit(40))), F.lit("\n### Deep\nx\n## Three two\nend"))
    return R.section(r.sources.select("id", text.alias("text")), "two")


#: Texts cut into lines: every fifth word begins one, some lines are list items or blank.
_LINED = "array_to_string(list_transform(range(0, len(w)), lambda i: concat(case when i = 0 then '' when i % 20 = 15 then chr(10) || chr(10) when i % 5 = 0 then chr(10) else ' ' end, case when i % 35 = 30 then '- ' else '' end, w[i + 1])), '')"
over(
    "logical_lines",
    f""", t as (select id, {_LINED} as text from (select id, regexp_extract_all(text, '[A-Za-z0-9]+') as w from sources)),
    l as (select id, n, trim(line) as line, trim(line) = '' as blank, starts_with(line, '- ') as opens from (select id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from t)),
    g as (select *, sum(case when blank or opens or before then 1 else 0 end) over (partition by id order by n) as unit
      from (select *, coalesce(lag(blank) over (partition by id order by n), true) as before from l)),
    u as (select id, unit, string_agg(line, ' ' order by n) as line from g where not blank group by 1, 2)
    select id, (row_number() over (partition by id order by unit) - 1)::int as ord, line as unit from u""",
)(lambda r: R.units(lined(r)))


def lined(r: Relations) -> DataFrame:
    start = lambda i: F.when(i == 0, "").when(i % 20 == 15, "\n\n").when(i % 5 == 0, "\n").otherwise(" ")
    words = F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return r.sources.select("id", F.array_join(F.transform(words, lambda w, i: F.concat(start(i), F.when(i % 35 == 30, "- ").otherwise(""), w)), "").alias("text"))


@over(
    "quote_gate",
    """, d as (select d.num, concat('sum-doc-', d.num) as id, substr(regexp_replace(s.text, '\\s+', ' ', 'g'), 11, 40) as q from derived d join sources s on s.num = d.num join provenance p on p.doc_id = d.id and p.source_id = s.id)
    select id, 0 as ord, trim(q) as span, true as ok from d where length(trim(q)) >= 15
    union all select id, 1, 'quite made up words here', false from d where true""",
)
def quote_gate(r: Relations) -> DataFrame:
    own = r.sources.select("num", F.substring(F.regexp_replace("text", r"[ \t\n\x0b\f\r]+", " "), 11, 40).alias("q"))
    cite = F.concat(F.lit(" [src-doc-"), "num", F.lit("]"))
    text = F.concat(F.lit('As “'), "q", F.lit('”\n'), cite, F.lit('\n\n- "quite made up\nwords here"'), cite, F.lit('\n- "short"'), cite, F.lit('\n- "never checked as it cites nothing"'))
    drafts = r.derived.join(own, "num").select("id", text.alias("text"))
    return R.quote_gate(drafts, r.provenance, r.sources)


over(
    "benchmark_mentions",
    """select d.num as query_id, s.id from decisions d join sources s on contains(
      trim(regexp_replace(translate(s.text, '“”‘’', '""'''''), '\\s+', ' ', 'g')), trim(regexp_replace(translate(d.body, '“”‘’', '""'''''), '\\s+', ' ', 'g')))""",
)(lambda r: R.mentions(r.decisions.select(F.col("num").alias("query_id"), F.col("body").alias("text")), r.sources))
over(
    "containment_chunks",
    "select id, 2 as chunks, num % 3 <> 0 as contained from sources",
)(
    lambda r: R.containment(
        r.sources.select(
            "id",
            F.concat(F.lit("intro\n```\n"), F.left("text", F.lit(20)), F.lit("\n```\nmore\n```md\n"), F.when(F.col("num") % 3 == 0, F.lit("\x01absent")).otherwise(F.substring("text", 30, 20)), F.lit("\n```\n")).alias("body"),
            F.concat(F.lit("﻿"), F.col("text")).alias("whole"),
        )
    ).select("id", "chunks", "contained")
)
over("legible_text", "select id, concat_ws(chr(10) || chr(10), nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(coalesce(abstract, ''), '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), '')) as text from derived")(
    lambda r: r.derived.select("id", R.legible(F.col("title"), F.col("abstract"), F.col("body")).alias("text"))
)
over("relink", "select id, concat('see [sum-doc-', num, '](summaries/sum-doc-', num, '.md), [unknown] and [sum-doc-', num, '](x)') as text from derived")(
    lambda r: R.relink(
        r.derived.select("id", F.concat(F.lit("see ["), "id", F.lit("], [unknown] and ["), "id", F.lit("](x)")).alias("text")),
        r.derived.select("id", F.concat(F.lit("summaries/"), "id", F.lit(".md")).alias("path")),
    )
)


over("source_status", "select id, capture as tier, version, num % 5 <> 0 and num % 67 <> 0 as has_bytes, recoverable, ref as origin_ref, system as origin_system from sources")(
    lambda r: R.source_status(replace(r, sources=r.sources.withColumn("canonical", F.expr("case when num % 5 <> 0 then canonical end"))))
)
over(
    "strip_targets",
    """select id, concat('[', id, '] and [', case when num % 2 = 0 then concat('sum-doc-', num, ' p. 3]') else concat('sum-doc-', num, 'x](y)') end, ' [RFC-8259](u) [', id, ' (', id, ')]') as text from derived""",
)(
    lambda r: R.strip_targets(
        r.derived.select("id", F.concat(F.lit("["), "id", F.lit("](a/b.md) and ["), "id", F.when(F.col("num") % 2 == 0, " p. 3](").otherwise("x]("), F.lit("y) [RFC-8259](u) ["), "id", F.lit(" ("), "id", F.lit(")](z)")).alias("text")),
        r.derived.select("id"),
    )
)


@raw("html_extract")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.lit("page.html").alias("path"), F.col("html").alias("content"))
    return extract.extracted(pages).select("page_id", "text", F.length("text").alias("n"))


# --- upkeep -------------------------------------------------------------------------------------

over("lint_L8", _F("L8", "error", "id", "'not in the index'", f"from {ALL_DOCS} where id not in (select id from sources where num % 5 <> 0)"))(
    lambda r: lint.l8(lint.documents(r), r.sources.where("num % 5 <> 0").select(F.concat(F.lit("- ["), "id", F.lit("](sources/"), "id", F.lit("/source.md) held")).alias("text")))
)
over("lint_L12", "select 'L12' as rule, 'error' as severity, '__manifest__' as id, 'no version' as detail where not exists (select * from projects where title = 'NOWHERE')")(
    lambda r: lint.l12(r.projects.where("title = 'NOWHERE'").select(F.col("title").alias("version")))
)


def stamped(r: Relations) -> DataFrame:
    """Derived documents with stamps that are wrong, right, or not there."""
    own = H.self_hash(F.col("title"), F.col("abstract"), F.col("body"))
    stamp = F.when(F.col("num") % 3 == 0, F.lit("sha256:old")).when(F.col("num") % 3 == 1, own)
    return r.derived.select("id", "num", "title", "abstract", "body").withColumn("self_hash", stamp)


over("lint_L19", _F("L19", "error", "id", "'self_hash'", "from derived where num % 3 = 0"))(lambda r: lint.l19(stamped(r)))
over(
    "stamp",
    """select id, case when num % 3 = 0 then 'sha256:old' else concat('sha256:', sha256(concat(coalesce(title, ''), chr(10), chr(10), coalesce(abstract, ''), chr(10), chr(10),
      regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g'), chr(10)))) end as self_hash from derived""",
)(lambda r: C.stamp(stamped(r)).select("id", "self_hash"))
#: Ledgers of sources: an entry at the current version with an anchor of a known form or another, one without, or an older one.
_LEDGER = """select id, case when num % 9 = 8 then 0 else 1 end as version,
  case num % 6 when 1 then 'md5:0' when 5 then null when 4 then concat('git-blob:', repeat('a', 40)) else content_hash end as upstream_identity,
  case when num % 4 = 1 then captured_at end as anchored_at from sources"""
over("lint_L20", f", g as ({_LEDGER}) " + " union all ".join([
    _F("L20", "error", "id", "'form'", "from g where upstream_identity = 'md5:0'"),
    _F("L20", "error", "g.id", "'upstream_ref'", "from g join sources using (id) where upstream_identity is not null and upstream_ref is null"),
    _F("L20", "error", "id", "'identity'", "from g where upstream_identity is null and anchored_at is not null"),
    _F("L20", "error", "id", "'unanchored'", "from sources s where upstream_ref is not null and not exists (select * from g where g.id = s.id and g.version = s.version and upstream_identity is not null)"),
]))(lambda r: lint.l20(r.sources.sparkSession.sql(_LEDGER.replace("from sources", "from {s}"), s=r.sources), r.sources))
over("lint_L22", _F("L22", "error", "id", "why", "from (select id, 'missing line' as why from projects where scope <> 'project' union all select id, 'stale line' from projects where scope = 'global')"))(
    lambda r: lint.l22(
        r.projects.select(F.to_json(F.struct("id", "scope", "title")).alias("line")),
        r.projects.where("scope <> 'regional'").select(F.to_json(F.struct("id", F.expr("case scope when 'global' then 'old' else scope end").alias("scope"), "title")).alias("line")),
    )
)
over("lint_entry_due", "select payload from (select 'errors=1' as payload) where 'errors=1' is distinct from (select arg_max(verdict, seq) from log where op = 'lint')")(
    lambda r: lint.entry_due(r.log.where("op = 'lint'").select("seq", F.col("verdict").alias("payload")), r.log.sparkSession.range(1).select(F.lit("errors=1").alias("payload")))
)
over(
    "reextract",
    """select id, case when num % 4 = 0 then 'has text' when num % 7 = 6 then 'no bytes' when num % 7 in (0, 1) then 'is text'
      when num % 7 in (2, 3) then 'extract' else 'no extractor' end as outcome from sources""",
)(
    lambda r: C.reextract(
        r.sources.select("id", F.expr("case num % 7 when 0 then 'source.md' when 1 then 'source.TXT' when 2 then 'a.b.html' when 3 then 'x.csv' when 6 then null else 'scan.tiff' end").alias("canonical")),
        r.sources.where("num % 4 = 0").select("id"),
        [".html", ".csv"],
    )
)
over("decision_amend", "select id, case when num % 3 = 0 then concat('**AMENDED (', dated, '):** Now ', status, '.', chr(10), chr(10), ltrim(body, chr(10))) else body end as body from decisions")(
    lambda r: C.amend(r.decisions, r.decisions.where("num % 3 = 0").select("id", "dated", F.concat(F.lit("Now "), "status", F.lit(".")).alias("body"))).select("id", "body")
)
over(
    "candidate_fold",
    """select doc_id, source_id, hash from provenance union all
    select doc_id, source_id, hash from (select concat('sum-doc-', num + num % 2) as doc_id, id as source_id, content_hash as hash from sources) c
    where not exists (select * from provenance p where p.doc_id = c.doc_id and p.source_id = c.source_id)""",
)(
    lambda r: C.fold(
        r.provenance.select("doc_id", "source_id", "hash"),
        r.sources.select(F.expr("concat('sum-doc-', num + num % 2)").alias("doc_id"), F.col("id").alias("source_id"), F.col("content_hash").alias("hash")),
        ("doc_id", "source_id"),
    )
)
_CANDIDATES = "select concat('cand-', num) as id, case when num % 4 = 0 then 'declined' else 'pending' end as status, case when num % 4 = 0 then 'before' end as reason from derived"
_DECLINED = f"select c.id, case when num % 3 = 0 then 'declined' else c.status end as status, case when c.status = 'pending' and num % 3 = 0 then 'weak' else c.reason end as reason from ({_CANDIDATES}) c join derived d on c.id = concat('cand-', d.num)"


def candidates(r: Relations) -> DataFrame:
    rows = r.derived.sparkSession.sql(_CANDIDATES.replace("from derived", "from {derived}"), derived=r.derived)
    return C.decline(rows, r.derived.where("num % 3 = 0").select(F.concat(F.lit("cand-"), "num").alias("id"), F.lit("weak").alias("reason")))


over("candidate_decline", _DECLINED)(candidates)
over("candidate_counts", f"select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'declined') as declined from ({_DECLINED})")(
    lambda r: candidates(r).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "declined").alias("declined"))
)
over("declined_index", f"select id, reason from ({_DECLINED}) where status = 'declined'")(lambda r: candidates(r).where("status = 'declined'").select("id", "reason").orderBy("id"))
over("queue_ids", "select seq, concat('task-', stamp, case when n > 1 then concat('-', n) else '' end) as id from (select seq, stamp, row_number() over (partition by stamp order by seq) as n from log)")(
    lambda r: C.queue_ids(r.log.select("seq", "stamp")).select("seq", "id")
)
over(
    "usage_log",
    """select e.seq, e.op, case when e.seq % 2 = 0 then 7 else coalesce(sum(s.bytes), 0)::bigint end as bytes_in
    from (select distinct ord as seq, title as op, m.project_id from members m join projects p on p.id = m.project_id) e
    left join members m on m.project_id = e.project_id left join (select id, strlen(text) as bytes from sources) s on s.id = m.member_id group by 1, 2""",
)(
    lambda r: L.spent(
        r.members.select(F.col("ord").alias("seq"), "project_id")
        .join(r.members.groupBy("project_id").agg(F.collect_list("member_id").alias("ids")), "project_id")
        .join(r.projects.select(F.col("id").alias("project_id"), F.col("title").alias("op")), "project_id")
        .select("seq", "op", "ids", F.expr("case when seq % 2 = 0 then 7L end").alias("bytes_in")),
        r.sources.select("id", F.octet_length("text").alias("bytes")),
    ).select("seq", "op", "bytes_in")
)
over("log_lines", "select seq, concat('## [', stamp, '] ', op, ' | ', target, case when verdict = 'same' then '' else concat(' | ', verdict) end) as line from log")(
    lambda r: r.log.select("seq", L.log_line(F.col("stamp"), F.col("op"), F.col("target"), F.expr("nullif(verdict, 'same')")).alias("line"))
)
over("id_guard", "select num, num % 6 = 0 as good from sources")(
    lambda r: r.sources.select("num", F.expr("case num % 6 when 0 then id when 1 then upper(id) when 2 then concat(id, '..x') when 3 then concat(id, '.') when 4 then 'con.md' else concat('-', id) end").alias("id"))
    .select("num", T.is_id(F.col("id")).alias("good"))
)

#: Excerpts: the middle of a text, or something else; every fifth is anchored already, some are forced, some have no whole to name.
_WHOLE = "concat('sha256:', sha256(text))"


@over(
    "anchor",
    f"""select id, outcome, case when outcome in ('anchored', 'forced', 'unchanged') then upstream end as upstream_ref, case when outcome in ('anchored', 'forced', 'unchanged') then {_WHOLE} end as upstream_identity,
      case when outcome in ('anchored', 'forced') then '{AS_OF}' when outcome = 'unchanged' then 'before' end as anchored_at
    from (select id, text, concat('up-', num) as upstream, case when num % 7 = 6 then 'no upstream_ref' when num % 5 = 0 then 'unchanged' when num % 3 <> 0 then 'anchored'
      when num % 2 = 0 then 'not contained' when num % 7 in (1, 2) then 'no reason' else 'forced' end as outcome from sources) where outcome <> 'no upstream_ref'
    union all select id, 'no upstream_ref', case when num % 5 = 0 then concat('up-', num) end, case when num % 5 = 0 then {_WHOLE} end, case when num % 5 = 0 then 'before' end from sources where num % 7 = 6
    union all select 'src-nowhere', 'unknown source', null, null, null""",
)
def anchor(r: Relations) -> DataFrame:
    fifth = lambda c: F.when(F.col("num") % 5 == 0, c)
    held = r.sources.select(
        "id", F.when(F.col("num") % 3 == 0, F.lit("\x01other")).otherwise(F.substring("text", 3, 30)).alias("body"), fifth(F.concat(F.lit("up-"), "num")).alias("upstream_ref"),
        fifth(H.bytes_hash(F.col("text"))).alias("upstream_identity"), fifth(F.lit("before")).alias("anchored_at"),
    )
    changes = r.sources.select(
        "id", F.when(F.col("num") % 7 == 6, " ").otherwise(F.concat(F.lit("up-"), "num")).alias("upstream_ref"), F.col("text").alias("upstream"), F.lit("sha256").alias("form"),
        (F.col("num") % 2 == 1).alias("force"), F.when(~(F.col("num") % 7).isin(1, 2), "judged").alias("reason"), F.lit(AS_OF).alias("at"),
    )
    nowhere = changes.sparkSession.sql("select 'src-nowhere' as id, 'u' as upstream_ref, 't' as upstream, 'sha256' as form, false as force, '' as reason, '' as at")
    return C.anchor(held, changes.unionByName(nowhere))


#: Every decision is amended by its own source, the next one and one that is not there.
_NEW_EVIDENCE = "select id as decision_id, concat('src-doc-', num) as source_id from decisions union all select id, concat('src-doc-', num + 1) from decisions union all select id, 'src-none' from decisions"


def amended(r: Relations) -> tuple[DataFrame, DataFrame]:
    return C.amend_evidence(r.evidence, r.decisions.sparkSession.sql(_NEW_EVIDENCE.replace("from decisions", "from {decisions}"), decisions=r.decisions), r.sources)


over(
    "evidence_amend",
    f"""select decision_id, source_id, version from evidence union all select n.decision_id, n.source_id, s.version from ({_NEW_EVIDENCE}) n join sources s on s.id = n.source_id
    where not exists (select * from evidence e where e.decision_id = n.decision_id and e.source_id = n.source_id)""",
)(lambda r: amended(r)[0])
over("evidence_refused", f"select * from ({_NEW_EVIDENCE}) where source_id not in (select id from sources)")(lambda r: amended(r)[1])
#: Two systems of the stand-in as repositories, with a file in each.
_REPOS = "case when system in ('src1', 'src2') then concat('git:', system, '/', ref, '#f') else ref end"
over("docs_by_repo", f"select distinct split_part({_REPOS}, '#', 1) as repo, d.id as doc_id from provenance p join sources s on s.id = p.source_id join derived d on d.id = p.doc_id where s.system in ('src1', 'src2', 'repo')")(
    lambda r: P.docs_by_repo(replace(r, sources=r.sources.withColumn("ref", F.expr(_REPOS)).withColumn("system", F.expr("case when system in ('src1', 'src2') then 'repo' else system end"))))
)


@raw(
    "same_extract",
    "select page_id as id, case page_id % 3 when 0 then true when 1 then false end as same from pages",
)
def same_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched again: other markup and blanks, a further paragraph, or kept under a name that no extractor reads."""
    held = F.concat(F.lit("<p>"), "page_id", F.lit("</p><p>b</p>"))
    fetched = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<div class=x>"), "page_id", F.lit("</div> \t<script>1</script><p>b</p>"))).otherwise(F.concat(held, F.lit("<p>c</p>")))
    path = F.when(F.col("page_id") % 3 == 2, "p.bin").otherwise("p.html")
    pairs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), held.cast("binary").alias("held"), fetched.cast("binary").alias("fetched"))
    return C.same_extract(pairs)


# --- extension ----------------------------------------------------------------------------------

raw(
    "ext_event_windows",
    "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value::decimal(20, 6)), 2)::double as total from events group by 1, 2",
)(lambda spark, sf_dir: windows.daily(windows.with_time(read(spark, sf_dir, "events"))))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
