"""The kept word index against a scan of the texts."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import catalog as KB
from attesta.operators import retrieve as V
from attesta.sources import relations, storage

ROWS = [
    ("a", "v1", "source", "One two, three one-two"), ("b", "v1", "source", "two one"), ("c", "v1", "derived", "one twofold"), ("d", "v1", "derived", "bone two"),
    ("e", "v1", "decision", None), ("f", "v1", "decision", "Größe ÉTÉ 12 12 12"), ("g", "v1", "source", "one two one two one"), ("h", "v1", "source", ""),
]
QUERIES = ["one", "one two", "one-two", "two-one-two", "-- three", "--", "", "größe", "été-12", "12-12-12", "12-12-12-12", "none", "one none"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, ident string, kind string, text string").selectExpr("*", "0 as rank", "kind as type", "cast(null as string) as status")


def same(spark, rows, store):
    docs = frame(spark, rows)
    for q in QUERIES:
        # the scan takes the phrase for the whole collection, so only plain words score alike
        plain = all(len(t) == 1 for t in V.phrases(q))
        own = lambda rows: {(r["id"], round(r["score"], 9) if plain else 0) for r in rows}
        scan = own(V.bm25(docs, "id", "text", q).collect()) if V.phrases(q) else set()
        assert own(KB.ranked(spark, store, q).collect()) == scan, q


def test_answers_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/index"
    assert KB.refresh(frame(spark, ROWS), store) == {"status": "refreshed", "indexed": 8, "pruned": 0, "docs": 8}
    same(spark, ROWS, store)
    assert KB.refresh(frame(spark, ROWS), store) == {"status": "current", "indexed": 0, "pruned": 0, "docs": 8}
    # one changed, one gone, one new; what changed without another ident is not looked at
    rows = [("a", "v2", "source", "three"), *[r for r in ROWS if r[0] not in "ab"], ("z", "v1", "source", "two two one")]
    assert KB.refresh(frame(spark, rows), store) == {"status": "refreshed", "indexed": 2, "pruned": 1, "docs": 8}
    same(spark, rows, store)
    monkeypatch.setattr(KB, "KEPT", 2)
    rows = rows[1:]
    assert KB.refresh(frame(spark, rows), store) == {"status": "refreshed", "indexed": 0, "pruned": 1, "docs": 7}
    assert len(storage.generations(spark, store)[1]) == 1
    same(spark, rows, store)
    r = KB.info(spark, store).first()
    assert (r["docs"], r["source_docs"], r["generations"]) == (7, 3, 1)


def test_only_the_words_own_folders_are_opened(spark, tmp_path):
    store = f"{tmp_path}/index"
    KB.refresh(frame(spark, ROWS), store)
    name = storage.generations(spark, store)[1][0]
    own = KB._postings(spark, store, [name], ["one", "two"])
    folders = {f.split("bucket=")[1].split("/")[0] for f in own.inputFiles()}
    wanted = {str(x[0]) for x in spark.sql("select 1").select(F.explode(F.array(*[KB.bucket_of(F.lit(t)) for t in ("one", "two")]))).collect()}
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and wanted <= folders
    # folders of other words may be gone
    for f in storage.folders(spark, f"{store}/{name}/postings"):
        if f.startswith("bucket=") and f.removeprefix("bucket=") not in wanted:
            storage.remove(spark, f"{store}/{name}/postings/{f}")
    assert {r["id"] for r in KB.ranked(spark, store, "one two").collect()} == {"a", "b", "g"}


def test_query_falls_back_and_says_so(spark, small, tmp_path):
    r = relations.stand_in(spark, small)
    none = KB.query(r, f"{tmp_path}/nowhere", words="view", cites="src-doc-1", kind=None, status="current", limit=3)
    assert (none.via, none.dropped) == ("find", ["cites", "status"]) and none.hits.columns == ["id", "kind", "type", "status"] and none.hits.count() == 3
    store = f"{tmp_path}/index"
    KB.refresh(KB.documents(r), store)
    for filters in ({"kind": "decision"}, {"type_": "summary", "status": "current"}, {"cites": "src-doc-3"}, {"system": "src3"}, {"words": "view", "project": "view-1"}, {"words": "global"}):
        own = KB.query(r, store, limit=500, **filters)
        assert own.via == "catalog" and not own.dropped
        assert {x["id"] for x in own.hits.collect()} == {x["id"] for x in V.facets(r, limit=500, **filters).collect()}, filters
    # an index whose files were taken away
    storage.remove(spark, f"{store}/{storage.generations(spark, store)[1][0]}")
    assert KB.query(r, store, words="view").via == "find"


def test_empty(spark, tmp_path):
    store = f"{tmp_path}/index"
    assert KB.refresh(frame(spark, []), store) == {"status": "current", "indexed": 0, "pruned": 0, "docs": 0}
    assert KB.ranked(spark, store, "one").count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_repeated_ids_count_once(spark, tmp_path, n):
    store = f"{tmp_path}/index{n}"
    KB.refresh(frame(spark, [("a", "v1", "source", "one"), ("a", "v2", "source", "two")][:n] * 2), store)
    assert KB.docs(spark, store).count() == 1 and KB.ranked(spark, store, "one" if n == 1 else "two").count() == 1


def test_words_are_gathered_where_the_texts_are(spark, tmp_path, monkeypatch):
    """Many changes or few: the same index, and words are not shuffled by document before they are shuffled by folder."""
    for k, few in enumerate((0, 100)):
        monkeypatch.setattr(KB, "FEW", few)
        store = f"{tmp_path}/index{k}"
        KB.refresh(frame(spark, ROWS), store)
        same(spark, ROWS, store)
        found = {r["id"]: r["length"] for r in KB.docs(spark, store).collect()}
        assert found == {"a": 5, "b": 2, "c": 2, "d": 2, "e": 0, "f": 5, "g": 5, "h": 0}
    rows = frame(spark, ROWS).select("id", KB.words_of(F.col("text")).alias("words"))
    each = KB.each_word(rows)
    assert {(r["id"], r["token"]): r["places"] for r in each.where("id in ('g', 'h')").collect()} == {("g", "one"): [0, 2, 4], ("g", "two"): [1, 3]}
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()


def test_a_large_folder_is_split_and_texts_stay_where_all_changed(spark, tmp_path, monkeypatch):
    """One word in all documents, and a session with one partition: several tasks write its folder. A first refresh looks up no text."""
    rows = frame(spark, [(f"d{k:04}", "v1", "source", f"one w{k}") for k in range(2000)]).repartition(4)
    store, at = f"{tmp_path}/index", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(KB, "FEW", 0)
    looked, each = [], KB.each_word
    monkeypatch.setattr(KB, "each_word", lambda df: looked.append("Join" in df._jdf.queryExecution().optimizedPlan().toString()) or each(df))
    spark.conf.set(at, "1k")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        KB.refresh(rows, store)
        KB.refresh(rows.where("id <> 'd0000'").withColumn("ident", F.when(F.col("id") < "d1000", "v2").otherwise("v1")), store)
    finally:
        spark.conf.unset(at)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    bucket = spark.range(1).select(KB.bucket_of(F.lit("one"))).first()[0]
    files = storage.folders(spark, f"{store}/{storage.generations(spark, store)[1][0]}/postings/bucket={bucket}")
    assert sum(f.endswith(".parquet") for f in files) > 1
    assert looked == [False, True] and KB.ranked(spark, store, "one").count() == 1999
