"""Cross-tokenizer alignment by a transducer over dangling suffixes.

Two tokenizers cut the same bytes. A state is the side that leads and the bytes by which it leads (its
dangling suffix); the side that lags gives the next token, which shortens the suffix, or turns it into
the other side's. Where nothing dangles, both end together and a group closes. Steps depend on the state
and the next token alone, so they are remembered by worker; a token that disagrees with the suffix has
no step, which is how texts whose bytes differ are found.

The last tokens of a group end together: they are a link. Of two such tokens one is a suffix of the
other, so there are at most as many different links as the vocabularies have suffixes: the table of
link counts is bounded by the vocabularies (LINKS says how) and may be broadcast, whatever the corpus.

Defined cases: a null or empty text, and one whose tokens don't spell a space and the text, has no tokens
(zeros and an empty digest); repeated rows get equal results and count as often as they stand there; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import tokens
from attesta.llm.common import arrow_batches, materialise, released, table

#: Ids of the second tokenizer fit in so many bits of a link's number.
B_BITS = 20
#: Steps that a worker remembers before it starts anew.
STEPS = 2_000_000
#: Fixed by the formats: the sign for a space, and how a piece names one byte.
SPACE, BYTE = "▁", "<0x"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """What each id of a piece model stands for."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())
    return out


class Transducer:
    """Aligns the ids of two tokenizers, given the bytes of each id."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.sides = a, b
        numbers: dict[bytes, int] = {}
        # tokens without bytes are alike to none: they go through the steps, which refuse them
        self.same = [np.array([numbers.setdefault(t, len(numbers)) if t else -1 - k for t in side], np.int64) for k, side in enumerate(self.sides)]
        self.clear()

    def clear(self) -> None:
        #: state 0: nothing dangles. Of every state the bytes, whether the first side leads, and the steps.
        self.numbers: dict[tuple[bytes, bool], int] = {(b"", False): 0}
        self.dangling: list[bytes] = [b""]
        self.leads: list[bool] = [False]
        self.steps: list[dict[int, int]] = [{}]
        self.known = 0

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side's token; -1 if its bytes disagree."""
        leads, rest = self.leads[state], self.dangling[state]
        new = self.sides[leads][token]  # the first side leads: the second one is to give
        if new.startswith(rest):
            left, side = new[len(rest) :], not leads
        elif rest.startswith(new):
            left, side = rest[len(new) :], leads
        else:
            left, side = None, leads
        if left is None or not new:
            to = -1
        else:
            key = (left, side) if left else (b"", False)
            to = self.numbers.setdefault(key, len(self.dangling))
            if to == len(self.dangling):
                self.dangling.append(left)
                self.leads.append(side)
                self.steps.append({})
        self.steps[state][token] = to
        self.known += 1
        return to

    def align(self, a: list[int], b: list[int], ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ends of the groups, as numbers of tokens of a and of b (given as arrays too) so far; None if the bytes differ.

        Where nothing dangles and both next tokens have the same bytes, a group opens and closes: tokens are numbered by
        their bytes, so these two commonest steps are one comparison. Every token is taken for the last of its group
        until a group of several says otherwise.
        """
        if self.known > STEPS:
            self.clear()
        steps, leads = self.steps, self.leads
        same_a, same_b = self.same[0][ids_a].tolist(), self.same[1][ids_b].tolist()
        i = j = 0
        n, m = len(a), len(b)
        last_a, last_b = bytearray(b"\1") * n, bytearray(b"\1") * m
        while i < n and j < m:
            if same_a[i] == same_b[j]:
                i += 1
                j += 1
                continue
            p, q, state, token = i, j, 0, a[i]
            i += 1
            while True:
                to = steps[state].get(token)
                if to is None:
                    to = self.step(state, token)
                if to < 0:
                    return None
                state = to
                if not state:
                    break
                if leads[state]:
                    if j == m:
                        return None
                    token = b[j]
                    j += 1
                else:
                    if i == n:
                        return None
                    token = a[i]
                    i += 1
            last_a[p : i - 1] = bytes(i - 1 - p)
            last_b[q : j - 1] = bytes(j - 1 - q)
        if i < n or j < m:
            return None
        return tuple(np.flatnonzero(np.frombuffer(x, np.uint8)) + 1 for x in (last_a, last_b))


class Aligner:
    """Whole texts to (n_a, n_b, n_groups, digest, links, how often each)."""

    def __init__(self, ranks: str, pieces: str) -> None:
        self.encoder, sizes = tokens.encoder(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a = [self.encoder.decode_single_token_bytes(i) if size else b"" for i, size in enumerate(sizes)]
        b = piece_bytes(self.model)
        self.transducer = Transducer(a, b)
        #: An id and what follows it: another of its side, the other side, the next group.
        self.written = np.array([f"{i}{sign}".encode() for i in range(max(len(a), len(b))) for sign in ",|;"])

    def groups(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and the groups' ends on both; nothing at all where there are no tokens."""
        if text:
            both = self.encoder.encode_ordinary(" " + text), self.model.encode(text, num_threads=1)
            a, b = (np.array(ids, np.int64) for ids in both)
            found = self.transducer.align(*both, a, b)
            if found is not None:
                return a, b, *found
        return (np.zeros(0, np.int64),) * 4

    def row(self, text: str | None) -> tuple:
        a, b, p, q = self.groups(text)
        if not len(p):
            return 0, 0, 0, "", [], []
        # every token with the sign behind it, at its place: a group's first tokens stand behind all earlier second ones
        signs = np.zeros(len(a) + len(b), np.int64)
        ids = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], q[:-1]]), np.diff(p, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(p, np.diff(q, prepend=0))
        ids[at_a], ids[at_b] = a, b
        signs[at_a[p - 1]], signs[at_b[q - 1]] = 1, 2
        text = self.written[ids * 3 + signs].tobytes().translate(None, b"\0")  # what fills short numbers goes
        link, times = np.unique(a[p - 1] << B_BITS | b[q - 1], return_counts=True)
        return len(a), len(b), len(p), hashlib.sha256(text[:-1]).hexdigest(), link, times


def most_links(ranks: str, pieces: str) -> int:
    """A bound on different links: pairs of tokens of which one ends with the other."""
    _, sizes = tokens.encoder(ranks)
    own = piece_bytes(sentencepiece.SentencePieceProcessor(model_file=pieces))
    return int(sizes.sum()) + sum(map(len, own))


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
     ("link", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def aligned(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """A row a document: sizes, digest of the groups, its different links and how often each stands in it."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ranks, pieces)
        for b in batches:
            rows = [aligner.row(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), *(zip(*rows) if rows else [[]] * (len(_OUT) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, link array<long>, times array<long>"
    )


def link_counts(rows: DataFrame) -> DataFrame:
    """(link, count, best): links of the whole corpus; best says that no link of the same second token has more."""
    own = rows.select(F.explode(F.arrays_zip("link", "times")).alias("x"))
    counts = materialise(own.groupBy(F.col("x.link").alias("link")).agg(F.sum("x.times").alias("count")))
    b = F.col("link").bitwiseAND(F.lit((1 << B_BITS) - 1))
    # one row a token of the second vocabulary
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of docs(doc_id, text)."""
    ranks, pieces = ranks or tokens.default_tokenizer(), pieces or default_pieces()
    rows = materialise(aligned(docs, ranks, pieces).withColumn("n", F.monotonically_increasing_id()))
    counts = materialise(link_counts(rows))
    if counts.count() > most_links(ranks, pieces):
        raise AssertionError("more links than the vocabularies have suffixes")
    own = rows.select("n", F.explode(F.arrays_zip("link", "times")).alias("x")).select("n", "x.link", "x.times")
    # documents aren't cut: sums are whole before they are shuffled
    sums = own.join(F.broadcast(counts), "link").groupBy("n").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count") * F.col("times")).alias("count_sum"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "n", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
