"""Alignment of two tokenizers against cuts found by adding up lengths."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from attesta.llm import alignment


def brute(texts):
    """Contract columns by the libraries themselves and running lengths."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = {}
    for b in range(256):
        plain = 33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256
        signs[b] = chr(b) if plain else chr(256 + sum(not (33 <= x < 127 or 161 <= x < 173 or 174 <= x < 256) for x in range(b)))
    back = {v: k for k, v in signs.items()}
    spell_a = lambda i: bytes(back[c] for c in own.id_to_token(i))

    def spell_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    rows = []
    for t in texts:
        a = own.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(map(spell_a, a)) != raw or b"".join(map(spell_b, b)) != raw:
            rows.append(((), (), []))
            continue
        ends = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, own_ends = 0, []
            for i in ids:
                at += len(spell(i))
                own_ends.append(at)
            ends.append(own_ends)
        groups = []
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append((ends[0].index(cut) + 1, ends[1].index(cut) + 1))
        rows.append((a, b, groups))
    counts = Counter((a[p - 1], b[q - 1]) for a, b, g in rows for p, q in g)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for a, b, groups in rows:
        text, i, j = [], 0, 0
        for p, q in groups:
            text.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        links = [(a[p - 1], b[q - 1]) for p, q in groups]
        digest = hashlib.sha256(";".join(text).encode()).hexdigest() if groups else ""
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_edge_rows(edge, edge_rows):
    wanted = [(r[0], *w) for r, w in zip(edge_rows, brute([r[1] for r in edge_rows]))]
    found = [tuple(r) for r in alignment.align(edge).collect()]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    zeros = {r[0] for r in found if r[1:] == (0, 0, 0, 0, 0, 0, "")}
    assert {1, 2} <= zeros and 3 not in zeros


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    wanted = [(r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows]))]
    assert sorted(tuple(r) for r in alignment.align(docs).collect()) == sorted(wanted)


def test_texts_that_one_side_changes(spark):
    """A sign for a space, specials as plain text, bytes without a piece, spaces at the ends."""
    texts = ["a▁b", "<s> </s> <unk>", "<|endoftext|>", "\x07 𐍈 ꙮ", "  two  ", "\n\n", "x" * 3000, "ﬁ ½ é", "<0x41> <0x0A>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(tuple(r) for r in alignment.align(docs).collect())
    assert found == [(k, *w) for k, w in enumerate(brute(texts))]
    assert found[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_empty(empty):
    out = alignment.align(empty)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0


def test_steps_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "STEPS", 3)
    own = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"d"])
    align = lambda a, b: own.align(a, b, np.array(a, np.int64), np.array(b, np.int64))
    for _ in range(5):
        assert [x.tolist() for x in align([0, 1, 2], [0, 1, 0, 1])] == [[2, 3], [2, 4]]
        assert align([0], [0]) is None and align([0], [2]) is None and align([2], [0, 1, 2]) is None
    assert own.known <= 3 + 9


@pytest.mark.parametrize("a,b", [([b"", b"x"], [b"x"])])
def test_tokens_without_bytes_disagree(a, b):
    assert alignment.Transducer(a, b).align([0, 1], [0], np.array([0, 1]), np.array([0])) is None


def test_bound_holds():
    from attesta.llm import tokens

    assert alignment.most_links(tokens.default_tokenizer(), alignment.default_pieces()) < 1_000_000
