"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, each hashed to an embedding row; a text is the
average over its words; a two-class softmax reads the average. An unseen misspelling shares most
n-grams, so most of its vector, with the words it was made from. As softmax and averages are linear
before the last step, a word's whole effect is one number, which workers keep by word.

Training uses a bounded sample (about SAMPLE different labelled texts of each class). It reads every word
of them: a text travels as its distinct words with their weights, one of over MANY words as its weights
by embedding row, of which there are BUCKETS at most. Scoring uses every word too; one of over LONG
characters counts as several, which overlap.

Defined cases: a null or wordless text gets the score of the prior alone; null labels teach nothing;
with one class or no label rows every score is 0; repeated rows get equal scores and are learned once,
a text with both labels once with each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, hash_sample, materialise, released, remainder, remainder_col, splittable_join, table

SAMPLE, MANY = 5000, 4000
BUCKETS, DIM, GRAMS = 1 << 17, 12, (3, 4, 5)
EPOCHS, BATCH, RATE, SCALE, DECAY = 10, 32, 0.5, 40.0, 1e-6
#: Steps at least, so that a small sample is learned too.
STEPS = 600
#: Start of the embeddings: near 0, so that n-grams never met say nothing.
SPREAD = 1e-3
SHARE, PRIOR = 0.005, 25.0
#: Share of the mean squared gradient that every row is taken to have met.
FLOOR = 1.0
SEED = 7
#: Words a worker remembers before it starts anew.
MEMORY = 300_000
#: Characters of a word from which it is cut into pieces, each a word: clauses without spaces, words run together.
LONG = 64
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The words in lower case; of one over LONG characters, pieces that overlap so far that no n-gram is lost."""
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    step = LONG - max(GRAMS) + 1
    return [w[i : i + LONG] for w in words for i in range(0, max(1, len(w) - LONG + step), step)]


def grams(word: str, buckets: int = BUCKETS) -> list[int]:
    """Embedding rows of a word: itself and its n-grams with marked ends."""
    w = f"<{word}>"
    parts = [w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))]
    return [zlib.crc32(p.encode()) % buckets for p in parts]


def bag(words: list[str]) -> tuple[dict[str, float], float]:
    """Each word's weight, and what they are divided by.

    A word weighs its count, up to 1 and a SHARE of all words, so that a text of one word over and
    over says no more than the word; PRIOR empty words draw short texts towards the bias.
    """
    most = 1 + SHARE * len(words)
    weights = {w: min(c, most) for w, c in Counter(words).items()}
    return weights, sum(weights.values()) + PRIOR


class Rows(dict):
    """Embedding rows of the words met."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = g = np.array(grams(word), np.int32)
        return g


Vector = tuple[np.ndarray, np.ndarray]


def vector(weights: dict[str, float], total: float, known: Rows) -> Vector:
    """A text's embedding rows and their weights: each word's average over its rows, averaged over words.

    Summed into BUCKETS cells a piece at a time, so memory does not grow with the words."""
    cells = np.zeros(BUCKETS)
    words = list(weights)
    for at in range(0, len(words), 4096):
        some = words[at : at + 4096]
        own = [known[w] for w in some]
        val = np.repeat([weights[w] * SCALE / len(g) / total for w, g in zip(some, own)], [len(g) for g in own])
        cells += np.bincount(np.concatenate(own), val, BUCKETS)
    rows = np.flatnonzero(cells)
    return rows.astype(np.int32), cells[rows].astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = SEED) -> bytes:
    known = Rows()
    return train_on([vector(*bag(words_of(t)), known) for t in texts], labels, seed)


def train_on(docs: list[Vector], labels: list[int], seed: int = SEED) -> bytes:
    """The model as bytes: one number per embedding row, and the bias; b'' if a class is missing."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return b""
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, SPREAD, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    acc_t, acc_s, acc_b = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    onehot = np.stack([1 - y, y], 1)
    # a rare class counts for more, by the root of its share: halfway to even, so that wordless texts stay with the prior
    share = 1 / np.sqrt(np.where(y == 1, y.mean(), 1 - y.mean()))
    share /= share.mean()
    epochs = max(EPOCHS, STEPS * BATCH // len(docs))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(docs[i][0]) for i in pick])
            rows = np.concatenate([docs[i][0] for i in pick])
            vals = np.concatenate([docs[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            hidden = np.stack([np.bincount(doc, vals * table_[rows, k], len(pick)) for k in range(DIM)], 1)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - onehot[pick]) * share[pick, None] / len(pick)
            g_soft, g_bias, g_hidden = hidden.T @ err, err.sum(0), err @ soft.T
            used = np.flatnonzero(np.bincount(rows, minlength=BUCKETS))
            g_rows = np.stack([np.bincount(rows, vals * g_hidden[doc, k], BUCKETS)[used] for k in range(DIM)], 1)
            g_rows += DECAY * table_[used]
            # steps shrink with a row's own gradients, but rows met once don't learn texts by heart
            acc_t[used] += (g_rows**2).mean(1)
            floor = FLOOR * acc_t[used].mean()
            table_[used] -= rate * g_rows / np.sqrt(acc_t[used] + floor)[:, None]
            for value, g, acc in ((soft, g_soft, acc_s), (bias, g_bias, acc_b)):
                acc += g**2
                value -= rate * g / np.sqrt(acc)
    effect = table_ @ (soft[:, 1] - soft[:, 0]) * SCALE
    out = io.BytesIO()
    np.savez(out, effect=effect.astype(np.float32), bias=np.float64(bias[1] - bias[0]))
    return out.getvalue()


class Scorer:
    """Scores of whole texts under a trained model."""

    def __init__(self, model: bytes) -> None:
        self.memory: dict[str, float] = {}
        self.model = np.load(io.BytesIO(model)) if model else None
        if model:
            self.effect, self.bias = self.model["effect"], float(self.model["bias"])

    def word(self, w: str) -> float:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        out = self.memory[w] = float(self.effect[grams(w)].mean(dtype=np.float64))
        return out

    def score(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        known, word = self.memory.get, self.word
        weights, total = bag(words_of(text))
        logit = self.bias
        if weights:
            effects = [word(w) if (e := known(w)) is None else e for w in weights]
            logit += float(np.dot(effects, list(weights.values()))) / total
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """Train on a bounded sample of documents(doc_id, text) with labels(doc_id, toxic)."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    marks = marks.where(remainder_col(F.col("doc_id")) != 0).distinct()
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"), "text")
    # different labelled texts; of copies under one id one is learned
    known = splittable_join(texts.select("doc_id", "__h"), marks, ["doc_id"]).distinct()
    chosen = materialise(hash_sample(known, "toxic", ["doc_id", "__h"], sample))
    # about 2 * SAMPLE rows of three numbers
    rows = texts.join(F.broadcast(chosen), ["doc_id", "__h"])

    @released
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, names = Rows(), ["doc_id", "__h", "toxic", "words", "weights"]
        for b in batches:
            words, weights = [], []
            for t in b.column(3):
                own, total = bag(words_of(t.as_py()))
                if len(own) > MANY:
                    idx, val = vector(own, total, rows_of)
                    words.append(b"\0" + idx.tobytes())
                    weights.append(val.tobytes())
                else:
                    words.append(" ".join(own).encode("utf-8", "surrogatepass"))
                    weights.append(np.array([*own.values(), total]).tobytes())
            cols = [*b.columns[:3], pa.array(words, pa.binary()), pa.array(weights, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    arrow_batches(docs.sparkSession)
    # what training gathers of a text is bounded before it moves
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "__h", "toxic", "text")
    rows = rows.mapInArrow(weigh, "doc_id long, __h long, toxic int, words binary, weights binary")
    rows = rows.dropDuplicates(["doc_id", "__h", "toxic"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "__h", "toxic"])
        return pd.DataFrame({"model": [train_on(list(unpacked(zip(pdf["words"], pdf["weights"]))), list(pdf["toxic"]))]})

    found = rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else b""


def unpacked(rows: Iterable[tuple[bytes, bytes]]) -> Iterator[Vector]:
    """Vectors of texts as they travelled: words with weights and their total, or embedding rows with weights."""
    known = Rows()
    for words, weights in rows:
        if words[:1] == b"\0":
            yield np.frombuffer(words[1:], np.int32), np.frombuffer(weights, np.float32)
        else:
            own = np.frombuffer(weights)
            yield vector(dict(zip(words.decode("utf-8", "surrogatepass").split(" "), own[:-1])), float(own[-1]), known)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the model (512 kB) is broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    own = docs.select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            s = [scorer.score(t.as_py()) for t in b.column(1)]
            cols = [ids, [remainder(i) == 0 for i in ids], s, [int(x >= 0.5) for x in s]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    arrow_batches(spark)
    return own.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def keep_clean(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            fine = pa.array([scorer.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_())
            yield b.filter(fine)

    arrow_batches(spark)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
