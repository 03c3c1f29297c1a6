"""Link-graph propagation: trust and distrust ranks over the host graph decide what no rule decides.

Personalised PageRank runs from trusted seeds along links, and from blocked seeds against them. Each
rank is taken as a share of its sum, so it depends on the graph and not on the number of pages; a host whose
share of distrust is over THRESHOLD times its share of trust is blocked. DataFrame functions only.

Host edges: absolute links between hosts (weighted by their count), and between a host and its
registrable domain in both directions, as both are run by the same party. The registrable domain is the
last two labels, or three where the second last is one of REGISTRY under a country's domain.
Seeds: a page that an allow rule decides adds trust to its host, one that a block rule decides adds
distrust.

Ranks are sums over walks. A host without links ends a walk; to send what it holds back to the seeds, as
is usual, would multiply all of a rank by one number, so it changes no share. Walks of up to ROUNDS steps are
taken, the number after which all longer ones add less than RESIDUAL of the whole.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is
decided like a host without evidence (allow); equal shares allow; null html has no links; repeated pages
count as often as they occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import materialise, splittable_join, table

#: host, path, verdict
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING, RESIDUAL = 0.85, 0.005
ROUNDS = math.ceil(math.log(RESIDUAL) / math.log(DAMPING))
#: Times its share of trust that a host's share of distrust must be over; the last digits are for rounding.
THRESHOLD = 1.000001
#: Rounds between two writes.
STEPS = 3
#: Second-level labels that registries of countries sell names under.
REGISTRY = ["ac", "co", "com", "edu", "gov", "net", "org"]
OWN_DOMAIN = rf"([^.]+\.(?:(?:{'|'.join(REGISTRY)})\.[a-z][a-z]|[^.]+))$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""href\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) from pages(host, html)."""
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("dst"),
    ).withColumn("dst", F.translate("dst", UPPER, LOWER))
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("links"))
    hosts = pages.select("host").distinct().union(links.select("dst")).distinct()
    own = F.regexp_extract("host", OWN_DOMAIN, 1)
    up = hosts.select(F.col("host").alias("src"), own.alias("dst"), F.lit(1.0).alias("links"))
    up = up.where("src <> dst and dst <> ''")
    every = links.union(up).union(up.select("dst", "src", "links"))
    return every.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("links").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds(host, trust0, distrust0), for all hosts that are reached; not scaled.

    Both ranks walk in one pass: a row of `walk` moves trust along a link and distrust against it.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("o"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("i"))
    walk = splittable_join(edges, out, ["src"]).selectExpr("src as s", "dst as d", f"{damping}d * links / o as t", "0d as x")
    back = splittable_join(edges, into, ["dst"]).selectExpr("dst as s", "src as d", "0d as t", f"{damping}d * links / i as x")
    walk = materialise(walk.union(back).groupBy("s", "d").agg(F.sum("t").alias("t"), F.sum("x").alias("x")))
    start = seeds.selectExpr("host", "trust0 as trust", "distrust0 as distrust")
    rank = start
    for k in range(1, rounds + 1):
        sent = splittable_join(walk, rank.withColumnRenamed("host", "s"), ["s"])
        sent = sent.selectExpr("d as host", "t * trust as trust", "x * distrust as distrust")
        rank = start.union(sent).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % STEPS == 0 or k == rounds:
            rank = materialise(rank)
    return rank


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    own = own.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    seeds = own.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("found.verdict") == "allow").cast("double").alias("trust0"),
        F.count_if(F.col("found.verdict") == "block").cast("double").alias("distrust0"),
    )
    rank = propagate(materialise(seeds.where("trust0 + distrust0 > 0")), materialise(host_edges(own)), rounds)
    # one row of two sums
    total = rank.agg(F.sum("trust").alias("all_t"), F.sum("distrust").alias("all_x"))
    shares = rank.crossJoin(F.broadcast(total)).selectExpr(
        "host", "if(all_t > 0, trust / all_t, 0d) as trust", "if(all_x > 0, distrust / all_x, 0d) as distrust"
    )
    bad = shares.where(f"distrust > {threshold}d * trust").select("host", F.lit(True).alias("bad"))
    judged = splittable_join(own.drop("html"), materialise(bad), ["host"], "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle(rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, one CTE a round."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda out: "case " + " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{out(h, p, v)}'"
        for h, p, v in rules
    ) + " end"
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    sql = f"""
with raw as (
  select page_id, html, case when coalesce(strpos(url, '://'), 0) > 0
    then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut as (select page_id, html, rest, regexp_extract(rest, '^[^/?#]*', 0) as h0 from raw),
own0 as (select page_id, html, {low % "h0"} as host,
  regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*', 0) as path from cut),
own as (select *, {case(lambda h, p, v: h + p)} as rule, {case(lambda h, p, v: v)} as rv from own0),
seeds as (select host, count(*) filter (rv = 'allow')::double t, count(*) filter (rv = 'block')::double x
  from own where host <> '' group by host having count(rv) > 0),
links as (select host as src, {low % f"unnest(regexp_extract_all(html, '{link}', 1))"} as dst from own),
names as (select host from own union select dst from links),
ups as (select host as src, regexp_extract(host, '{OWN_DOMAIN}', 1) as dst from names),
every as (select * from links union all select * from ups where src <> dst and dst <> ''
  union all select dst, src from ups where src <> dst and dst <> ''),
edges as (select src, dst, count(*)::double as n from every where src <> dst and src <> '' and dst <> '' group by all),
walk as materialized (select src, dst, n / sum(n) over (partition by src) as t, n / sum(n) over (partition by dst) as x from edges),
r0 as (select * from seeds)"""
    for k in range(rounds):
        sql += f""",
r{k + 1} as materialized (select host, sum(t) as t, sum(x) as x from (select * from seeds
  union all select dst, {damping} * walk.t * r{k}.t, 0 from walk join r{k} on host = src
  union all select src, 0, {damping} * walk.x * r{k}.x from walk join r{k} on host = dst) group by host)"""
    return sql + f"""
select page_id, own.host, path, rule, coalesce(rv, case when shares.x > {threshold} * shares.t then 'block' else 'allow' end) as verdict
from own left join (select host, coalesce(t / nullif(sum(t) over (), 0), 0) as t, coalesce(x / nullif(sum(x) over (), 0), 0) as x
  from r{rounds}) shares using (host)"""


ORACLE = _oracle()
