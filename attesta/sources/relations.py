"""The engine's relations, and a stand-in for them built from the test tables.

Real bases are read by attesta.sources.base. The stand-in maps the driver's tables onto the same
relations by plain SQL expressions that Spark and DuckDB share, defects included, so that every
operator can be held against an independent SQL statement on the same rows. It exercises operators;
it does not make those tables a knowledge base.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Fixed "now" of queries over the stand-in: the day after the last event.
AS_OF = "2024-01-31"

#: In order; each may use the tables and what comes before it. {sha} is the dialect's SHA-256.
SQL: dict[str, str] = {
    "sources": """
select concat('src-doc-', doc_id) as id, doc_id as num, text, lang, case when doc_id % 83 = 0 then 'repo' else source end as system,
  case when doc_id % 83 = 0 then concat('whole/', doc_id - doc_id % 10 + 1, '#', doc_id) when doc_id % 10 = 1 then concat('whole/', doc_id) else concat(source, '/', doc_id) end as ref,
  concat('sha256:', {sha}) as content_hash, 1 as version, case when doc_id % 67 <> 0 then case when doc_id % 91 = 0 then 'source.pdf' else 'source.md' end end as canonical,
  case when doc_id % 53 <> 0 then 'source' end as type, doc_id % 59 <> 0 as has_origin, case when doc_id % 61 = 0 then 0 else 1 end as entries,
  case when doc_id % 67 = 0 then null when doc_id % 79 = 0 then concat('sha256:', repeat('1', 64)) else concat('sha256:', {sha}) end as held_hash,
  concat('sources/src-doc-', doc_id, case when doc_id % 67 = 0 then '' when doc_id % 91 = 0 then '/source.pdf' else '/source.md' end) as path, split(lang, ' ') as tags,
  case when source in ('src3', 'src7') then 'reference' when doc_id % 97 = 0 then 'partial' else 'full' end as capture,
  case when source = 'src3' or (source = 'src7' and doc_id % 3 = 0) then 'licence' end as capture_reason,
  concat('2024-01-', lpad(cast(1 + doc_id % 28 as string), 2, '0'), 'T00:00:00Z') as captured_at,
  case doc_id % 3 when 0 then true when 1 then false end as recoverable,
  case when doc_id % 8 = 0 then concat('whole/', doc_id - doc_id % 10 + 1) when doc_id % 4 = 0 then concat('https://up.example/', doc_id) end as upstream_ref
from documents""",
    "versions": """
select concat('src-chat-', conv_id) as id, cast(turn + 1 as int) as version, concat('sha256:', {sha}) as content_hash,
  text, role as captured_by, concat('source.v', turn + 1, '.md') as file,
  case when (conv_id + turn) % 11 = 0 then null else cast(turn as int) end as supersedes, case when turn % 2 = 0 then concat('source-text.v', turn + 1, '.md') end as text_aid
from conversations""",
    "files": """
select concat('src-chat-', conv_id) as id, concat('source.v', turn + 1 + case when (conv_id + turn) % 7 = 0 then 100 else 0 end, '.md') as file
from conversations union all
select concat('src-chat-', conv_id), concat('source-text.v', turn + 1, '.md') from conversations where turn % 2 = case when (conv_id + turn) % 5 = 0 then 1 else 0 end""",
    "derived": """
select concat('sum-doc-', l.doc_id) as id, l.doc_id as num, case when l.doc_id % 41 = 0 then 'digest' else 'summary' end as type,
  concat('Summary of ', l.doc_id) as title, case when l.doc_id % 31 = 0 then null else substr(d.text, 1, 80) end as abstract,
  case when l.doc_id % 29 = 0 then concat('./notes/', l.doc_id, '.md') when l.doc_id % 23 = 0 then concat('cafÃ© ', substr(d.text, 1, 60))
    when l.doc_id % 5 = 0 then concat(d.text, ' ', d.text) else substr(d.text, 1, 200) end as body,
  case when l.quality = 0 then 'superseded' when l.doc_id % 37 = 0 then 'stale' else 'current' end as status,
  case when l.quality = 0 and l.doc_id % 2 = 0 then concat('sum-doc-', l.doc_id + 1) end as superseded_by,
  case d.lang when 'en' then 'extracted' when 'fr' then 'model-read' when 'de' then 'synthesis' else 'ocr' end as derivation,
  case when l.doc_id % 43 = 0 then 'operator' when l.doc_id % 2 = 0 then 'adapter' end as authored_by,
  concat('sum-doc-', l.doc_id + 1) as see_also, d.lang as tag, split(d.lang, ' ') as tags, concat('summaries/sum-doc-', l.doc_id, '.md') as path,
  case when l.doc_id % 71 <> 0 then '2024-01-20T00:00:00Z' end as derived_at,
  case when l.quality = 0 and l.doc_id % 7 <> 0 then '2024-01-25T00:00:00Z' when l.doc_id % 73 = 0 then '2024-01-26T00:00:00Z' end as superseded_at,
  case when l.quality = 0 and l.doc_id % 3 = 0 then 'merged' when l.doc_id % 89 = 0 then 'left over' end as supersede_reason,
  case when l.doc_id % 5 = 0 then concat('2024-01-', lpad(cast(1 + l.doc_id % 28 as string), 2, '0')) end as as_of,
  case when l.doc_id % 47 <> 0 then 1 else 0 end + case when l.doc_id % 17 = 0 then 1 else 0 end + case when l.doc_id % 13 = 0 then 1 else 0 end as n_sources
from labels l join documents d on l.doc_id = d.doc_id""",
    "provenance": """
select concat('sum-doc-', l.doc_id) as doc_id, 0 as ord, concat('src-doc-', l.doc_id) as source_id,
  case when l.toxic = 1 then concat('sha256:', repeat('0', 64)) else s.content_hash end as hash
from labels l join sources s on s.num = l.doc_id where l.doc_id % 47 <> 0
union all select concat('sum-doc-', doc_id), 1, concat('src-missing-', doc_id), null from labels where doc_id % 17 = 0
union all select concat('sum-doc-', doc_id), 2, concat('sum-doc-', doc_id), null from labels where doc_id % 13 = 0""",
    "see_also": "select id as doc_id, see_also as target from derived",
    "projects": """
select concat('view-', r_regionkey) as id, r_name as title,
  case r_regionkey when 0 then 'global' when 4 then 'regional' else 'project' end as scope, case when r_regionkey <> 3 then 'project' end as type,
  r_regionkey <> 4 as has_members, concat('projects/view-', r_regionkey, '.md') as path from region""",
    "members": """
select concat('view-', n_regionkey) as project_id, n_nationkey as ord,
  case when n_nationkey % 9 = 8 then concat('src-missing-', n_nationkey) else concat('src-doc-', n_nationkey) end as member_id from nation""",
    "decisions": """
select concat('dec-', item_id) as id, item_id as num, concat('Decision ', item_id) as title, text as body,
  case item_id % 4 when 0 then 'accepted' when 1 then 'proposed' when 2 then 'accepted' else 'draft' end as status,
  concat('2024-01-', lpad(cast(1 + item_id % 28 as string), 2, '0')) as dated,
  case when item_id % 6 = 0 then 'adapter' else 'operator' end as authored_by, case when item_id % 7 <> 3 then 'decision' end as type,
  concat('decisions/dec-', item_id, '.md') as path from benchmark""",
    "evidence": """
select id as decision_id, case when num % 10 = 9 then concat('src-missing-', num) when num % 10 = 8 then concat('dec-', num) else concat('src-doc-', num) end as source_id,
  case when num % 5 = 0 then 0 else 1 end as version, 0 as ord from decisions""",
    "connectors": """
select concat('sum-doc-', doc_id) as doc_id, concat('sys', doc_id % 3) as system, case when doc_id % 2 = 0 then concat('r', doc_id % 5) end as ref
from labels where doc_id % 4 = 0""",
    "usage": """
select event_id as seq, event_type as op, substr(cast(ts as string), 1, 10) as day, concat('src-doc-', user_id) as doc_id,
  case when event_id % 10 = 0 then null else round(value, 1) end as duration_ms, event_id % 1000 as bytes_in, event_id % 77 as bytes_out,
  case when event_id % 3 = 0 then event_id % 500 end as tokens from events""",
    "log": """
select event_id as seq, concat(substr(cast(ts as string), 1, 10), 'T', case when event_id % 50 = 0 then 'noon' else '12:00:00Z' end) as stamp,
  case event_type when 'view' then 'capture' when 'signup' then 'lint' when 'purchase' then 'drift-check' when 'click' then 'map' else 'note' end as op,
  concat('src-doc-', user_id) as target, case event_id % 4 when 0 then 'same-text' when 1 then 'changed' when 2 then 'unreachable' else 'same' end as verdict
from events""",
}
#: Which SHA-256 argument each relation hashes.
_HASHED = "text"


@dataclass
class Relations:
    """DataFrames of a base; see SQL for the columns."""

    sources: DataFrame
    versions: DataFrame
    files: DataFrame
    derived: DataFrame
    provenance: DataFrame
    see_also: DataFrame
    projects: DataFrame
    members: DataFrame
    decisions: DataFrame
    evidence: DataFrame
    connectors: DataFrame
    usage: DataFrame
    log: DataFrame


TABLES = ["documents", "labels", "benchmark", "conversations", "region", "nation", "events"]


def stand_in(spark: SparkSession, sf_dir: str) -> Relations:
    own = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, sql in SQL.items():
        body = sql.replace("{sha}", f"sha2({_HASHED}, 256)")
        for t in sorted(own, key=len, reverse=True):
            body = _named(body, t)
        own[name] = spark.sql(body, **{t: df for t, df in own.items() if f"{{{t}}}" in body})
    return Relations(**{f.name: own[f.name] for f in fields(Relations)})


def _named(sql: str, table: str) -> str:
    """Table names after from and join become parameters."""
    for word in ("from", "join"):
        sql = sql.replace(f"{word} {table}", f"{word} {{{table}}}") if f"{word} {table}" in sql else sql
    return sql


def duckdb_ctes() -> str:
    """The same relations as the head of a DuckDB statement."""
    return "with " + ",\n".join(f"{n} as ({s.replace('{sha}', f'sha256({_HASHED})')})" for n, s in SQL.items())
