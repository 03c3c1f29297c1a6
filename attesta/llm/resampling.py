"""Importance resampling towards a target distribution, with hashed n-grams.

DuckDB works inside each partition: SQL splits texts into words, windows make n-grams of them, a
registered zlib CRC gives every feature its bucket, and a document's buckets are counted. The counts are
written to the shared folder as Parquet; Spark sums them over the corpus and the target, turns the two
totals of each bucket into its gain, and scores documents by the counts that lie there already, so texts
are read once. Gains are as many as there are buckets, a parameter, so they travel with the plan.

The draw is Gumbel noise on the mean gain and the highest scores, which samples without replacement in
proportion to importance. Noise hangs on the seed and the id alone. Ranks come from sorted ranges.

Defined cases: a null or wordless text has no features and weight 0 (and fewer words than may be drawn,
unless `least` is 0); a null id counts as the empty text in the noise and is last among ties; rows that
are repeated are documents of their own; an empty target gives every bucket the same prior; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, materialise, numbered, released, table

BUCKETS, GRAMS, SEED, LEAST, PERCENT = 10_000, 1, 2024, 20, 10
#: What a word is made of: anything but ASCII signs that are neither digits nor small letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB's memory in a worker; a batch of texts is far smaller.
MEMORY = "400MB"


def counting(grams: int, buckets: int) -> str:
    """SQL over batch(n, text): words and a list of (bucket, count) by row; rows without words are left out.

    The CRC is asked once a different feature."""
    runs = [
        f"select n, word{''.join(f' || chr(32) || lead(word, {k}) over w' for k in range(1, g))} as feature from words"
        + (" window w as (partition by n order by place)" if g > 1 else "")
        for g in range(1, grams + 1)
    ]
    return f"""
with words as (select n, unnest(found) as word, generate_subscripts(found, 1) as place
  from (select n, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as found from batch where text is not null)),
features as ({' union all '.join(runs)}),
counted as (select n, feature, count(*) as times from features where feature is not null group by n, feature),
hashed as (select feature, crc(feature) % {buckets} as bucket from (select distinct feature from counted)),
summed as (select n, bucket, sum(times)::bigint as times from counted join hashed using (feature) group by n, bucket)
select n, list(bucket) as bucket, list(times) as times, sum(times)::bigint as features,
  (select count(*) from words w where w.n = summed.n) as words from summed group by n"""


def _crc(words: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


def engine() -> duckdb.DuckDBPyConnection:
    """A task's own DuckDB: one thread, bounded memory, nothing on disk."""
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("words", pa.int64()), ("features", pa.int64()), ("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
)


def bucketed(docs: DataFrame, key: str = "doc_id", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, words, features, bucket, times): every row's bucket counts."""
    sql = counting(grams, buckets)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with engine() as con:
            for b in batches:
                con.register("batch", pa.table({"n": pa.array(range(b.num_rows), pa.int64()), "text": b.column(1)}))
                found = {n: rest for n, *rest in zip(*(c.to_pylist() for c in con.execute(sql).to_arrow_table().columns))}
                con.unregister("batch")
                rows = [found.get(n, ([], [], 0, 0)) for n in range(b.num_rows)]
                bucket, times, features, words = zip(*rows) if rows else ([], [], [], [])
                cols = [b.column(0), words, features, bucket, times]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    arrow_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, words long, features long, bucket array<int>, times array<long>")


def totals(rows: DataFrame) -> DataFrame:
    """(bucket, times) over all rows: at most a row a bucket."""
    each = rows.select(F.explode(F.arrays_zip("bucket", "times")).alias("x"))
    return each.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.times").alias("times"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A bucket's floored thousandfold log ratio of target to corpus, add-one smoothed."""
    s, t = totals(own).withColumnRenamed("times", "s"), totals(target).withColumnRenamed("times", "t")
    both = F.broadcast(own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))).join(s, "bucket", "left").join(t, "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    all_ = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up, down = (F.col("t") + 1) * (F.col("all_s") + buckets), (F.col("s") + 1) * (F.col("all_t") + buckets)
    # as doubles: the products may pass 64 bits
    up, down = up.cast("double"), down.cast("double")
    rows = both.crossJoin(F.broadcast(all_)).select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows)]


def noise(doc_id: str, seed: int = SEED):  # noqa: ANN201  a Column
    """Thousandfold Gumbel noise of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, grams: int = GRAMS, buckets: int = BUCKETS,
    seed: int = SEED, target_key: str = "item_id",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs(doc_id, text)."""
    rows = materialise(bucketed(docs, "doc_id", grams, buckets).withColumn("n", F.monotonically_increasing_id()))
    wanted = materialise(bucketed(target, target_key, grams, buckets))
    # a foldable expression: the plan holds one array of as many numbers as buckets
    gain = F.expr(f"cast(split('{','.join(map(str, gains(rows, wanted, buckets)))}', ',') as array<bigint>)")
    add = F.aggregate(F.zip_with("bucket", "times", lambda b, k: F.get(gain, b) * k), F.lit(0).cast("long"), lambda acc, x: acc + x)
    # integer division that goes down
    weight = F.when(F.col("features") > 0, F.expr("(__sum - pmod(__sum, features)) div features")).otherwise(0)
    scored = rows.withColumn("__sum", add).withColumn("weight", weight.cast("long"))
    scored = materialise(scored.select("n", "doc_id", "words", F.col("features").alias("n_features"), "weight", (F.col("weight") + noise("doc_id", seed)).alias("score")))
    may = scored.where(F.col("words") >= least)
    drawn = percent * may.count() // 100
    order = may.select("n", (-F.col("score")).alias("high"), F.col("doc_id").isNull().alias("last"), "doc_id")
    ranks = numbered(order, ["high", "last", "doc_id", "n"], "at").where(F.col("at") < drawn).select("n", (F.col("at") + 1).alias("rank"))
    return scored.join(ranks, "n", "left").select("doc_id", "n_features", "weight", "score", "rank")


#: The same by SQL alone; the CRC is folded over the bytes of each different word with the table that its polynomial gives.
ORACLE = f"""
with recursive poly(i, k, c) as (select i::bigint, 0, i::bigint from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from poly where k < 8),
crcs as (select list(c order by i) as steps from poly where k = 8),
words as (select 'd' as side, doc_id as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) as word from documents
  union all select 't', item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) from benchmark),
counted as (select side, id, word, count(*) as k from words group by all),
bytes as (select word, [4294967295::bigint] || list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::bigint - 1, 2))::bigint) as b
  from (select distinct word from counted)),
hashed as (select word, xor(list_reduce(b, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from bytes, crcs),
features as (select side, id, bucket, sum(k) as k from counted join hashed using (word) group by all),
sums as (select bucket, coalesce(sum(k) filter (side = 'd'), 0) as s, coalesce(sum(k) filter (side = 't'), 0) as t from features group by bucket),
alls as (select sum(s) as ss, sum(t) as tt from sums),
gains as (select bucket, floor(1000.0::double * ln(((t + 1) * (ss + {BUCKETS}))::double / ((s + 1) * (tt + {BUCKETS}))::double)) as gain from sums, alls),
docs as (select d.doc_id, coalesce(sum(k), 0)::bigint as n_features, coalesce(floor(sum(k * gain) / sum(k)), 0)::bigint as weight
  from documents d left join features f on f.side = 'd' and f.id = d.doc_id left join gains g on g.bucket = f.bucket group by d.doc_id),
scored as (select *, weight + floor(-1000.0::double * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score from docs),
may as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_features >= {LEAST})
select s.doc_id, n_features, weight, score, case when r <= {PERCENT} * n // 100 then r end as rank from scored s left join may using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
