"""Reports over the append-only ledgers: cost, attention, drift, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from attesta.functions import text as T
from attesta.operators import lint
from attesta.operators.retrieve import in_scope
from attesta.sources.relations import Relations

#: Reasoning steps that sessions report themselves, lookups around them, and how many tell.
REASONING = ["ask", "review", "synthesize"]
LOOKUPS = ["derive", "find", "retrieve", "search"]
ENOUGH = 5
#: Origins that name no system outside: of the connector roster; of drift and status.
NEAR, NEARER = ["file", "chat"], ["file", "chat", "inbox"]
AGED_DAYS = 30
WINDOWS = [30, 60, 90]

USAGE = S.StructType([
    S.StructField("ts", S.StringType()), S.StructField("op", S.StringType()), S.StructField("bytes_in", S.LongType()),
    S.StructField("bytes_out", S.LongType()), S.StructField("duration_ms", S.DoubleType()), S.StructField("tokens", S.LongType()),
    S.StructField("ids", S.ArrayType(S.StringType())), S.StructField("note", S.StringType()),
])


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; lines that are no JSON are left out."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, stamp, op, rest) of the log's entries, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    own = lines.where(F.col("line").startswith("## ["))
    rest = F.regexp_replace("line", r"^## \[[^\]]*\]?", "")
    return own.select(
        "seq", F.regexp_extract("line", r"^## \[([^\]]*)", 1).alias("stamp"),
        T.strip(F.substring_index(rest, "|", 1)).alias("op"), T.strip(F.regexp_replace(rest, r"^[^|]*\|?", "")).alias("rest"),
    )


def cost(usage: DataFrame) -> DataFrame:
    """Per operation: counts, bytes, tokens and nearest-rank percentiles of time; null where nothing was timed."""
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ms)")
    return usage.groupBy("op").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"),
        F.sum("tokens").alias("tokens"), F.count("tokens").alias("tokens_n"), F.count("duration_ms").alias("timed_n"),
        F.round(F.sum(F.col("duration_ms").cast("decimal(20,4)")), 1).cast("double").alias("total_ms"),
        F.round(rank(0.5), 1).alias("p50_ms"), F.round(rank(0.95), 1).alias("p95_ms"),
    )


def underreported(usage: DataFrame) -> DataFrame:
    """Whether lookups abound while no reasoning was reported."""
    counts = usage.agg(
        F.count_if(F.col("op").isin(REASONING)).alias("reasoning"), F.count_if(F.col("op").isin(LOOKUPS)).alias("lookups")
    )
    return counts.withColumn("underreported", (F.col("reasoning") == 0) & (F.col("lookups") >= ENOUGH))


def attention(usage: DataFrame, docs: DataFrame, strong: list[str]) -> DataFrame:
    """Per document of docs(id, bytes): strong and weak touches and the days of the last ones.

    usage(op, day, doc_id) has a row a touched document. Never touched documents are kept.
    """
    hit: Column = F.col("op").isin(strong)
    touched = usage.groupBy(F.col("doc_id").alias("id")).agg(
        F.count_if(hit).alias("strong"), F.count_if(~hit).alias("weak"),
        F.max(F.when(hit, F.col("day"))).alias("last_strong"), F.max("day").alias("last_touch"),
    )
    return docs.join(touched, "id", "left").na.fill(0, ["strong", "weak"])


def by_last_touch(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce("last_touch", F.lit("")), "id")


def dormancy(rows: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """Per window of days: documents and bytes not touched in it, and whether the ledger is that old."""
    days = F.explode(F.array(*[F.lit(d) for d in WINDOWS])).alias("days")
    age = usage.agg(F.datediff(F.lit(as_of).cast("date"), F.min("day").cast("date")).alias("age"))
    each = rows.select("last_touch", "bytes", days)
    idle = F.col("last_touch").isNull() | (F.col("last_touch") < F.date_sub(F.lit(as_of).cast("date"), F.col("days")).cast("string"))
    out = each.groupBy("days").agg(
        F.count_if(idle).alias("docs"), F.sum(F.when(idle, F.col("bytes")).otherwise(0)).alias("bytes"),
        F.round(F.count_if(idle) * 100.0 / F.count(F.lit(1)), 1).alias("pct"),
    )
    return out.crossJoin(F.broadcast(age)).select("days", "docs", "bytes", "pct", (F.col("age") >= F.col("days")).alias("meaningful"))


def scope_bytes(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of ids(id) by docs(id, bytes): unknown ids count nothing, repeated ones as often as they occur."""
    return ids.join(docs, "id", "left").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n"))


def spent(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """entries(seq, op, ids, bytes_in) with bytes_in filled, where it is null, by the bytes of ids in docs(id, bytes).

    Unknown ids count nothing, repeated ones as often as they occur.
    """
    each = entries.where("bytes_in is null").select("seq", F.explode("ids").alias("id"))
    scope = each.join(docs.select("id", "bytes"), "id").groupBy("seq").agg(F.sum("bytes").alias("__scope"))
    rows = entries.join(scope, "seq", "left")
    return rows.withColumn("bytes_in", F.coalesce("bytes_in", "__scope", F.lit(0))).select(*entries.columns)


def log_line(stamp: Column, op: Column, *parts: Column) -> Column:
    """One entry of the operations log, as read_log reads it; parts that are null are left out."""
    return F.concat(F.lit("## ["), stamp, F.lit("] "), F.concat_ws(" | ", op, *parts))


def captures_since(log: DataFrame) -> DataFrame:
    """Per operation of the log: how many capture entries stand after its last one.

    Operations are a fixed list of verbs, so the ends of all of them fit in one row; captures are counted against it in one pass."""
    ends = log.where("op <> 'capture'").groupBy("op").agg(F.max("seq").alias("last"))
    ends = ends.agg(F.collect_list(F.struct("op", "last")).alias("ends"))
    seen = log.where("op = 'capture'").select("seq").distinct()
    hits = seen.crossJoin(F.broadcast(ends)).select(F.explode("ends").alias("e"), "seq").where("seq > e.last")
    counts = hits.groupBy(F.col("e.op").alias("op")).agg(F.count(F.lit(1)).alias("captures"))
    names = log.where("op <> 'capture'").select("op").distinct()
    return names.join(counts, "op", "left").select("op", F.coalesce("captures", F.lit(0)).alias("captures"))


def last_verdict(log: DataFrame) -> DataFrame:
    """(id, verdict, checked) of each document's last drift check, in file order."""
    own = log.where("op = 'drift-check'").groupBy(F.col("target").alias("id"))
    return own.agg(F.max_by(F.struct("verdict", "stamp"), "seq").alias("x")).select(
        "id", F.col("x.verdict").alias("verdict"), F.col("x.stamp").alias("checked")
    )


def verdict_tally(log: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return log.where("op = 'drift-check'").agg(
        F.count_if(v.startswith("same")).alias("same"), F.count_if(v == "changed").alias("changed"), F.count_if(v == "unreachable").alias("unreachable")
    )


def unreachable_streak(log: DataFrame) -> DataFrame:
    """Per document the drift checks at the end of its history that all found nothing there."""
    checks = log.where("op = 'drift-check'")
    reached = F.max(F.when(F.col("verdict") != "unreachable", F.col("seq"))).over(Window.partitionBy("target"))
    tail = checks.withColumn("reached", reached).where("reached is null or seq > reached")
    return tail.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("streak"))


def eligible(r: Relations) -> DataFrame:
    """Sources whose origin can be asked again."""
    outside = ~F.col("system").isin(NEARER)
    return r.sources.where(outside & (F.col("recoverable").eqNullSafe(True) | F.col("upstream_ref").isNotNull()))


def drift_worklist(r: Relations, as_of: str, project: str | None = None, older_than: str | None = None) -> DataFrame:
    """Sources to check again, longest untouched first; contact is the stamp of capture or of the last check."""
    rows = eligible(r).select("id", "system", F.coalesce("captured_at", F.lit("")).alias("captured"))
    if project is not None:
        rows = rows.join(in_scope(r, project), "id", "left_semi")
    rows = rows.join(last_verdict(r.log), "id", "left")
    rows = rows.withColumn("last_contact", F.greatest("captured", F.coalesce("checked", F.lit(""))))
    if older_than is not None:
        rows = rows.where(F.col("last_contact") < T.before(as_of, older_than))
    return rows.select("id", "system", "verdict", "last_contact").orderBy("last_contact", "id")


def worklist_counts(r: Relations, as_of: str, project: str, older_than: str) -> DataFrame:
    """How many the scope and the age leave out."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    every, scoped = eligible(r), drift_worklist(r, as_of, project)
    aged = drift_worklist(r, as_of, project, older_than)
    out = n(every, "eligible").crossJoin(n(scoped, "scoped")).crossJoin(n(aged, "in_scope"))
    return out.selectExpr("in_scope", "eligible - scoped as outside_scope", "scoped - in_scope as age_filtered")


def uncovered_systems(r: Relations) -> DataFrame:
    """Outside systems of sources that no global view covers: by a member that came from there, or a member's connector."""
    views = r.projects.where("scope = 'global'").select(F.col("id").alias("project_id"))
    members = r.members.join(views, "project_id", "left_semi").select(F.col("member_id").alias("id")).distinct()
    mine = r.sources.where(~F.col("system").isin(NEARER)).select("id", "system")
    said = r.connectors.select(F.col("doc_id").alias("id"), "system")
    covered = mine.unionByName(said).join(members, "id", "left_semi").select("system")
    return mine.select("system").distinct().join(covered, "system", "left_anti")


def aged(r: Relations, as_of: str, days: int = AGED_DAYS) -> DataFrame:
    """(id, as_of, days_old) of derived documents whose own date lies over `days` back, the oldest first."""
    old = F.datediff(F.lit(as_of).cast("date"), F.substring("as_of", 1, 10).try_cast("date"))
    return r.derived.select("id", "as_of", old.alias("days_old")).where(F.col("days_old") > days).orderBy(F.desc("days_old"), "id")


def freshness(log: DataFrame, fingerprint: str) -> DataFrame:
    """One row: never-linted, fresh or drifted, by the fingerprint that the last lint entry of log(seq, op, rest) carries."""
    own = F.regexp_extract("rest", r"fingerprint=(\S+)", 1)
    last = log.where("op = 'lint'").agg(F.max_by(own, "seq").alias("recorded"))
    return last.select(F.when(F.coalesce("recorded", F.lit("")) == "", "never-linted").when(F.col("recorded") == fingerprint, "fresh").otherwise("drifted").alias("freshness"))


#: The types of documents whose numbers say how far a base is worked out.
ENRICHMENT = ["entity", "concept", "question"]


def status(r: Relations, as_of: str, aged_days: int = AGED_DAYS) -> DataFrame:
    """The base at a glance, one row."""
    one = lambda df, **k: df.agg(*[e.alias(n) for n, e in k.items()])
    n = F.count(F.lit(1))
    stale = lint.stale_pairs(r).where(~F.coalesce(F.col("status"), F.lit("")).isin("stale"))
    outside = F.col("recoverable") & F.col("system").isNotNull() & ~F.col("system").isin(NEARER)
    types = {f"{t}_docs": F.count_if(F.col("type") == t) for t in ENRICHMENT}
    last = lambda op: F.max_by(F.when(F.col("op") == op, F.col("stamp")), F.when(F.col("op") == op, F.col("seq")))
    since = captures_since(r.log).agg(*[F.coalesce(F.max(F.when(F.col("op") == op, F.col("captures"))), F.lit(0)).alias(f"captures_since_{op}") for op in ("lint", "map")])
    parts = [
        one(r.sources, sources=n, recoverable=F.count_if(outside)), aged(r, as_of, aged_days).agg(n.alias("aged")),
        one(r.derived, derived=n, superseded=F.count_if(F.col("status") == "superseded"), **types),
        stale.select("doc_id").distinct().agg(n.alias("stale")),
        uncovered_systems(r).agg(n.alias("uncovered_systems")),
        since, r.log.agg(last("drift-check").alias("last_drift_check"), last("map").alias("last_map")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
