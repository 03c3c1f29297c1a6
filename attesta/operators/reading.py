"""Reading documents: pages, budgets, literal search, sections, quotation and containment checks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.sources.relations import Relations

#: Default page, budget and hits; quotations shorter than this aren't checked.
PAGE, BUDGET, HITS, AROUND, QUOTE = 20_000, 100_000, 20, 150, 15
#: Fixed values of the format: what a quotation and a citation look like. Between curly signs straight ones are text.
SPAN = r'“[^“”]+”|["“][^"“”]+["”]'
CITED = r"\[(src-[A-Za-z0-9][A-Za-z0-9-]*)\]"


def page(docs: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """(id, text, total, next) of one page of each of docs(id, text); limit 0 is the default."""
    n = F.length("text")
    end = offset + (limit or PAGE)
    return docs.select("id", F.substring("text", offset + 1, limit or PAGE).alias("text"), n.alias("total"), F.when(n > end, F.lit(end)).alias("next"))


def read_many(wanted: DataFrame, docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(ord, id, taken, read) of wanted(ord, id) under one budget: in order, the last one cut, the rest not read."""
    rows = wanted.join(docs.select("id", F.length("text").alias("n")), "id")
    # a caller's list of ids is small; its order needs one window
    before = F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(budget) - before))
    return rows.select("ord", "id", taken.cast("long").alias("taken"), ((taken > 0) | ((F.col("n") == 0) & (before < budget))).alias("read"))


def find_text(docs: DataFrame, needle: str, cap: int = HITS) -> DataFrame:
    """(id, at, around) of a literal in docs(id, text): overlapping hits, the first `cap` of each document."""
    hits = docs.where(F.contains("text", F.lit(needle))).select("id", "text", F.explode(T.overlapping(F.col("text"), needle, cap)).alias("at"))
    begin = F.greatest(F.lit(1), F.col("at") - AROUND)
    around = F.substring(F.col("text"), begin, F.col("at") + len(needle) + AROUND - begin)
    return hits.select("id", (F.col("at") - 1).alias("at"), around.alias("around"))


def headings(docs: DataFrame) -> DataFrame:
    """(id, line, level, title, last): Markdown sections; one ends before the next heading of its level or above.

    A section is found per document by a look ahead over its headings alone.
    """
    lines = docs.select("id", F.posexplode(F.split(T.newlines(F.col("text")), "\n")).alias("line", "text"))
    last = lines.groupBy("id").agg(F.max("line").alias("end"))
    pattern = r"^(#{1,6})\s+(.*?)\s*#*$"
    heads = lines.where(F.col("text").rlike(pattern)).select(
        "id", "line", F.length(F.regexp_extract("text", pattern, 1)).alias("level"), F.regexp_extract("text", pattern, 2).alias("title")
    )
    per = heads.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "level"))).alias("all"))
    rows = heads.join(per, "id").join(last, "id")
    after = F.expr("filter(all, h -> h.line > line and h.level <= level)")
    return rows.select("id", "line", "level", "title", F.when(F.size(after) > 0, after[0]["line"] - 1).otherwise(F.col("end")).alias("last"))


def section(docs: DataFrame, name: str) -> DataFrame:
    """(id, text): the first section of each document whose heading contains the name."""
    hits = headings(docs).where(F.contains(F.lower("title"), F.lit(name.lower())))
    first = hits.groupBy("id").agg(F.min_by(F.struct("line", "last"), "line").alias("x"))
    lines = F.split(T.newlines(F.col("text")), "\n")
    return docs.join(first, "id").select("id", F.array_join(F.slice(lines, F.col("x.line") + 1, F.col("x.last") - F.col("x.line") + 1), "\n").alias("text"))


def units(docs: DataFrame) -> DataFrame:
    """(id, ord, unit): logical lines of docs(id, text)."""
    return docs.select("id", F.posexplode(T.logical_units(F.col("text"))).alias("ord", "unit"))


#: Quotations of one source that are looked for in one pass.
PATTERNS = 2000


def occurring(text: Column, parts: Column) -> Column:
    """Whether each of an array of texts occurs in a text: Arrow-batched, one automaton of all parts and one pass over the text."""

    @F.pandas_udf("array<boolean>")
    def run(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        import ahocorasick

        def one(hay: str, needles: list[str]) -> list[bool]:
            if len(needles) == 1:
                return [needles[0] in hay]
            words = ahocorasick.Automaton()
            for n in needles:
                words.add_word(n, n)
            words.make_automaton()
            found = {n for _, n in words.iter(hay)}
            return [n in found for n in needles]

        return pd.Series([one(t, list(w)) for t, w in zip(texts, wanted)], dtype=object)

    return run(text, parts)


def quote_gate(drafts: DataFrame, provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, ord, span, ok): quotations of drafts(id, text) against the sources their unit cites.

    A unit is checked if it cites a source of its document; a quotation holds if any cited source with text contains it, quotes
    and white space alike. The different quotations of a source are looked for together, PATTERNS in one pass, so its text moves
    once a pass however many drafts cite it; only cited sources are normalised.
    """
    # documents without sources and units without both signs need no look
    drafts = drafts.join(provenance.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    rows = units(drafts).where(F.contains("unit", F.lit("[")))
    spans = rows.select("id", "ord", F.explode(F.array_distinct(F.regexp_extract_all("unit", F.lit(SPAN), F.lit(0)))).alias("raw"))
    inner = F.substring("raw", F.lit(2), F.length("raw") - 2)
    spans = spans.select("id", "ord", T.quotes(inner).alias("span")).where(F.length("span") >= QUOTE)
    cited = rows.select("id", "ord", F.explode(F.array_distinct(F.regexp_extract_all("unit", F.lit(CITED), F.lit(1)))).alias("source_id"))
    cited = cited.join(provenance.select(F.col("doc_id").alias("id"), "source_id").distinct(), ["id", "source_id"])
    pairs = spans.join(cited, ["id", "ord"])
    asked = pairs.select("source_id", "span").distinct()
    many = asked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    turn = F.pmod(F.xxhash64("span"), F.ceil(F.col("n") / PATTERNS))
    batches = asked.join(many, "source_id").groupBy("source_id", turn.alias("turn")).agg(F.collect_list("span").alias("spans"))
    texts = sources.select(F.col("id").alias("source_id"), "text").join(batches, "source_id")
    texts = texts.select("source_id", "spans", T.quotes(F.coalesce("text", F.lit(""))).alias("hay")).where("hay <> ''")
    held = texts.select("source_id", F.col("spans").alias("span"), occurring(F.col("hay"), F.col("spans")).alias("ok"))
    held = held.select("source_id", F.explode(F.arrays_zip("span", "ok")).alias("x"))
    checked = pairs.join(held.select("source_id", "x.*"), ["source_id", "span"])
    return checked.groupBy("id", "ord", "span").agg(F.bool_or("ok").alias("ok"))


def mentions(queries: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """(query_id, id): texts of queries(query_id, text) that occur word for word in docs(id, text).

    Instead of comparing all pairs: the first `words` words of a query are joined by hash to the word
    windows of all documents, and only pairs that meet are compared in whole. Shorter queries are joined by
    windows of their own size, which are looked up only if there are such queries; one without words is nowhere.
    """
    size = F.size(F.filter(F.split(T.quotes(F.col("text")), " "), lambda w: w != ""))
    sized = queries.select("query_id", "text", F.least(size, F.lit(words)).alias("__n"))
    sizes = sorted(r[0] for r in sized.select("__n").distinct().collect() if r[0] > 0)  # at most `words` numbers
    parts = [_mentions(sized.where(F.col("__n") == n), docs, n) for n in sizes]
    return reduce(DataFrame.unionByName, parts or [_mentions(sized.where("false"), docs, words)])


def _mentions(queries: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The same for queries of at least `words` words."""
    split = lambda c: F.filter(F.split(T.quotes(c), " "), lambda w: w != "")
    q = queries.select("query_id", T.quotes(F.col("text")).alias("needle"), split(F.col("text")).alias("w")).where(F.size("w") >= words)
    q = q.select("query_id", "needle", F.xxhash64(*[F.col("w")[k] for k in range(words)]).alias("key"))
    d = docs.select("id", T.quotes(F.col("text")).alias("hay"), split(F.col("text")).alias("w")).where(F.size("w") >= words)
    keys = F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(words)]))
    wins = d.select("id", F.explode(F.array_distinct(keys)).alias("key"))
    pairs = wins.join(q.select("query_id", "key"), "key").select("id", "query_id").distinct()
    whole = pairs.join(q.select("query_id", "needle"), "query_id").join(d.select("id", "hay"), "id")
    return whole.where(F.contains("hay", F.col("needle"))).select("query_id", "id")


def containment(rows: DataFrame, body: str = "body", whole: str = "whole") -> DataFrame:
    """rows with `contained` and the number of chunks: an excerpt's fenced blocks, or all of it, in a whole."""
    parts = T.chunks(F.col(body))
    return rows.withColumn("chunks", F.size(parts)).withColumn("contained", T.holds_all(F.col(whole), parts))


def legible(title: Column, abstract: Column, body: Column) -> Column:
    """Title, abstract and body as one text; empty parts are left out."""
    part = lambda c: F.nullif(T.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws("\n\n", part(title), part(abstract), part(body))


def rewritten(docs: DataFrame, pattern: str, known: DataFrame, new: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, replaced, *keep) of docs(id, text) with every match of pattern put anew where its first group is an id of known.

    Texts are cut at the matches, the matches are looked up by one join, and the pieces are put together again: one pass
    over each text, whatever the number of ids. `new` is the replacement, from `hit` (the match), `target` (its id) and
    the columns of known; `replaced` counts what was put anew.
    """
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("target"))
    each = docs.select("id", *keep, F.posexplode(hits).alias("at", "x")).select("id", *keep, "at", "x.hit", "x.target")
    own = known.withColumnRenamed("id", "target").dropDuplicates(["target"]).withColumn("__known", F.lit(True))
    each = each.join(own, "target", "left").select("id", "at", F.when(F.col("__known"), new).otherwise(F.col("hit")).alias("piece"), F.col("__known").alias("new"))
    pieces = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.count("new").alias("replaced"))
    parts = F.arrays_zip(F.split("text", pattern, -1).alias("text"), F.col("pieces.piece").alias("piece"))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.coalesce(p["piece"], F.lit("")))), "")
    rows = docs.join(pieces, "id", "left")
    return rows.select("id", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce("replaced", F.lit(0)).alias("replaced"), *keep)


#: A citation that is no link yet, and one that is.
BARE = r"\[([A-Za-z0-9][A-Za-z0-9._-]*)\](?!\()"
LINKED = r"\[([A-Za-z][A-Za-z0-9._-]*)[^\]]*\]\([^)\s]*\)"


def relink(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, text) with bare `[known-id]` as links to paths(id, path); what is linked already stays."""
    new = F.concat(F.lit("["), "target", F.lit("]("), "path", F.lit(")"))
    return rewritten(docs, BARE, paths.select("id", "path"), new).select("id", "text")


def relinked(derived: DataFrame, paths: DataFrame) -> DataFrame:
    """derived(id, title, abstract, body, self_hash, ...) with the citations in bodies as links, and a stamp that stands put
    anew where the body changed. paths(id, path), relative to the base; links are relative to the folder a document lies in."""
    rows = rewritten(derived.select("id", F.coalesce("body", F.lit("")).alias("text")), BARE, paths.select("id", "path"), F.concat(F.lit("["), "target", F.lit("](../"), "path", F.lit(")")))
    rows = derived.join(rows.where("replaced > 0").select("id", F.col("text").alias("__body")), "id", "left")
    changed = F.col("__body").isNotNull()
    stamp = F.when(changed & F.col("self_hash").isNotNull(), H.self_hash(F.col("title"), F.col("abstract"), F.col("__body"))).otherwise(F.col("self_hash"))
    return rows.withColumn("self_hash", stamp).withColumn("body", F.coalesce("__body", "body")).select(*derived.columns)


def strip_targets(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(id, text, ...) with `[id more](target)` as `[id more]` for ids in known(id); other links stay."""
    bare = F.concat(F.substring_index("hit", "](", 1), F.lit("]"))
    keep = tuple(c for c in docs.columns if c not in ("id", "text"))
    return rewritten(docs, LINKED, known.select("id"), bare, keep).select(*docs.columns)


def source_status(r: Relations, id_: str | None = None) -> DataFrame:
    """What is known of sources without reading them: tier, version, whether bytes are held, where from. An unknown id is an error."""
    rows = r.sources
    if id_ is not None:
        rows = rows.where(F.col("id") == id_)
        if rows.isEmpty():
            raise ValueError(f"no such source: {id_}")
    return rows.select(
        "id", F.coalesce("capture", F.lit("full")).alias("tier"), F.coalesce("version", F.lit(1)).alias("version"),
        F.col("canonical").isNotNull().alias("has_bytes"), "recoverable", F.col("ref").alias("origin_ref"), F.col("system").alias("origin_system"),
    )
