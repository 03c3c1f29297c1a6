"""BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the whole corpus are compiled into a minimal acyclic automaton that shares
suffixes; each arc carries the number of words that come before it, so a walk yields the word's index
into a table of token ids. The automaton is one flat buffer that workers map into memory. Words that
are not in it are merged exactly, by ranks.

Defined cases: a null text is the empty text (no tokens); a special token's string in a text is that
token; repeated rows get equal results; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import arrow_batches, materialise, released, table

#: Words in the lexicon at most, and bytes of a word: together they bound what is broadcast.
LEXICON, WORD_BYTES = 131_072, 48
#: Words outside the lexicon that a worker remembers before it starts anew.
MEMORY = 100_000
#: Words a task counts before it hands its counts on.
COUNTED = 300_000
#: Fixed by the tokenizer's format: contractions, letters, numbers, other signs, white space.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
WORDS = regex.compile(PATTERN)
#: The same for texts of characters whose kinds the standard matcher's classes agree on: ASCII, Latin
#: letters up to U+024F (two signs among them left out) and common punctuation.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
COMMON = re.compile(f"[\t-\r -~{LATIN[6:]}\u00a1\u00a3\u00a7\u00ab\u00b0\u00b7\u00bb\u00bf\u2010-\u2027]*")
COMMON_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")


def split_words(text: str) -> list[str]:
    return COMMON_WORDS.findall(text) if COMMON.fullmatch(text) else WORDS.findall(text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """The format's printable sign of each byte: itself where printable, else one past 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids, special strings to ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    signs = byte_signs()
    vocab = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    return vocab, {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


class Merger:
    """Exact merges of single words, and the bytes of ids."""

    def __init__(self, path: str) -> None:
        self.vocab, self.special = read_vocabulary(path)
        self.core = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=self.vocab, special_tokens={})._core_bpe
        self.bytes_of = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merge(self, word: bytes) -> list[int]:
        found = self.vocab.get(word)
        return [found] if found is not None else self.core.encode_single_piece(word)

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Runs of ordinary text (None) and special tokens (their id), in order."""
        if self.splitter is None or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self.splitter.split(text):
            if part:
                yield part, self.special.get(part)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Flat minimal automaton of the words, with their ids.

    Words are added in order; as soon as a branch can't grow any more, its state is replaced by an
    equal one that is known already. Buffer: six numbers, then states (first arc, final), arcs
    (byte, target, words before), offsets into ids, ids.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[list] = [[False, []]]  # the unfinished branch: final, arcs

    def settle(depth: int, word: bytes) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append((final, arcs))
            path[-1][1].append((word[len(path) - 1], register[key]))

    last = b""
    for w in words:
        k = 0
        while k < len(w) and k < len(last) and w[k] == last[k]:
            k += 1
        settle(k, last)
        path.extend([False, []] for _ in w[k:])
        path[-1][0] = True
        last = w
    settle(0, last)
    states.append((path[0][0], path[0][1]))
    below = []  # words that can be read from a state
    for final, arcs in states:  # targets come before sources
        below.append(int(final) + sum(below[t] for _, t in arcs))
    first, finals, arcs_out = [], [], []
    for final, arcs in states:
        first.append(len(arcs_out))
        finals.append(int(final))
        before = int(final)
        for byte, target in arcs:
            arcs_out.append((byte, target, before))
            before += below[target]
    first.append(len(arcs_out))
    ids = [entries[w] for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int32)
    flat = np.array([x for i in ids for x in i], np.int32)
    arcs_np = np.array(arcs_out, np.int32).reshape(-1, 3).T.copy()
    head = np.array([len(states), len(arcs_out), len(words), len(flat), len(states) - 1, 0], np.int32)
    parts = [head, np.array(first, np.int32), np.array(finals, np.int32), *arcs_np, offsets, flat]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Reads a compiled lexicon, mapped into memory."""

    def __init__(self, data: bytes) -> None:
        self.file = tempfile.TemporaryFile()  # has no name: it goes with the worker
        self.file.write(data)
        self.file.flush()
        view = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), np.int32)
        n, a, words, ids, self.root, _ = map(int, view[:6])
        cut, at = [], 6
        for size in (n + 1, n, a, a, a, words + 1, ids):
            cut.append(view[at : at + size])
            at += size
        first, self.final, byte, self.target, self.before, self.offset, self.ids = cut
        # arcs stand by state, then byte
        self.arcs = np.repeat(np.arange(n, dtype=np.int64), np.diff(first)) << 8 | byte

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 if it isn't in the lexicon; all words walk the automaton together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        fits = sizes <= WORD_BYTES
        width = int(sizes[fits].max(initial=0))
        flat = b"".join([w.ljust(width, b"\0") if len(w) <= width else b"\0" * width for w in words])
        letters = np.frombuffer(flat, np.uint8).reshape(len(words), width)
        state = np.where(fits, self.root, -1)
        index = np.zeros(len(words), np.int64)
        for j in range(width if len(self.arcs) else 0):
            on = np.flatnonzero((sizes > j) & (state >= 0))
            key = state[on] << 8 | letters[on, j]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            known = self.arcs[arc] == key
            index[on] += self.before[arc]
            state[on] = np.where(known, self.target[arc], -1)
        if not len(self.arcs):
            state[sizes > 0] = -1
        return np.where((state >= 0) & (self.final[state] == 1), index, -1)

    def entry(self, index: int) -> list[int]:
        return self.ids[self.offset[index] : self.offset[index + 1]].tolist()

    def ids_of(self, word: bytes) -> list[int] | None:
        """The word's ids; None if it isn't in the lexicon."""
        index = int(self.find([word])[0])
        return None if index < 0 else self.entry(index)


Entry = tuple[int, str, bytes, list[int]]


class Codec:
    """Encodes and decodes whole texts, a batch at a time.

    An entry is a word's number of ids, the ids written out, the ids decoded, and the ids. New words
    of a batch are looked up in the lexicon together, others are merged. Entries of the lexicon are
    kept; those of other words go after MEMORY of them have been met.
    """

    def __init__(self, merger: Merger, lexicon: bytes) -> None:
        self.merger, self.lexicon = merger, Lexicon(lexicon)
        self.written = [str(i) for i in range(max(merger.bytes_of) + 1)]
        # a special string is no word of the pattern, so both can be keys here
        self.memory: dict[str, Entry] = {s: self.entry([i]) for s, i in merger.special.items()}
        self.others: list[str] = []

    def entry(self, ids: list[int]) -> Entry:
        written, back = self.written, self.merger.bytes_of
        return len(ids), ",".join([written[i] for i in ids]), b"".join([back[i] for i in ids]), ids

    def learn(self, words: set[str]) -> None:
        if len(self.others) >= MEMORY:
            for w in self.others:
                del self.memory[w]
            self.others = []
        new = list(words - self.memory.keys())
        raws = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, raw, k in zip(new, raws, self.lexicon.find(raws).tolist()):
            if k >= 0:
                self.memory[w] = self.entry(self.lexicon.entry(k))
            else:
                self.memory[w] = self.entry(self.merger.merge(raw))
                self.others.append(w)

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        for part, special in self.merger.parts(text or ""):
            out += split_words(part) if special is None else [part]
        return out

    def entries(self, texts: list[str | None]) -> Iterator[list[Entry]]:
        parts = [self.words(t) for t in texts]
        self.learn(set().union(*parts))
        for p in parts:
            yield list(map(self.memory.__getitem__, p))

    def encode(self, text: str | None) -> list[int]:
        return [i for e in next(self.entries([text])) for i in e[3]]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return self.entry(ids)[2]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, texts: list[str | None], with_ids: bool = False) -> Iterator[tuple]:
        """Number of ids, sha256 of the ids written out, sha256 of the decoded text, and the ids if asked for."""
        number, written, back, ids = map(itemgetter, range(4))
        for found in self.entries(texts):
            out = (
                sum(map(number, found)),
                hashlib.sha256(",".join(map(written, found)).encode()).hexdigest(),
                hashlib.sha256(b"".join(map(back, found)).decode("utf-8", "replace").encode()).hexdigest(),
            )
            yield (*out, list(chain.from_iterable(map(ids, found)))) if with_ids else out


def count_words(docs: DataFrame, special: list[str]) -> DataFrame:
    """(word, n) over all texts; words over WORD_BYTES, and specials, are left out."""
    splitter = re.compile("|".join(map(re.escape, special))) if special else None

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if len(w.encode("utf-8", "surrogatepass")) <= WORD_BYTES}
            counts.clear()
            cols = [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["word", "n"])

        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                for part in splitter.split(text) if splitter and any(s in text for s in special) else (text,):
                    counts.update(split_words(part))
                if len(counts) >= COUNTED:
                    yield out()
        yield out()

    arrow_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = LEXICON) -> list[str]:
    """The words above the lowest count at which at most `limit` words are left.

    The cut is read from a histogram in eighths of an octave, so no table is sorted.
    """
    counts = materialise(counts)
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True)
    total, cut = 0, None
    for b, c in bins:
        total += c
        if total > limit:
            break
        cut = b
    if cut is None:
        return []
    return [r["word"] for r in counts.where(step >= cut).select("word").collect()]


def build_lexicon(docs: DataFrame, merger: Merger, limit: int = LEXICON) -> bytes:
    words = frequent_words(count_words(docs, list(merger.special)), limit)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return compile_lexicon({w: merger.merge(w) for w in raw})


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encode(docs: DataFrame, path: str | None = None, limit: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and decoded text; with_ids adds the ids themselves."""
    spark = docs.sparkSession
    path = path or default_tokenizer()
    shared = spark.sparkContext.broadcast(build_lexicon(docs, Merger(path), limit))
    schema = _OUT.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _OUT

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Merger(path), shared.value)
        for b in batches:
            rows = list(codec.digests(b.column(1).to_pylist(), with_ids))
            cols = [b.column(0), *(zip(*rows) if rows else [[]] * (len(schema) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    arrow_batches(spark)
    text = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
