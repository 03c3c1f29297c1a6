"""Groups of near copies against brute force on all pairs; no row is lost by its id."""

import random

import corpus_pipeline
import pytest
from attesta.llm import near_copies

from tests.llm.test_documents import brute_components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


@pytest.mark.parametrize("most", [16, 3, 1])
def test_all_pairs_at_the_threshold(spark, monkeypatch, most):
    """Copies with a few edits, around the threshold, whether shingles are rare or in many texts."""
    monkeypatch.setattr(near_copies, "PAIRS", most)
    rnd = random.Random(11)
    texts = []
    for _ in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 120))]
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 3))) for _ in range(rnd.randint(1, 9))]
    common = " ".join(f"c{k}" for k in range(40))
    texts += [common + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(2, 30))) for _ in range(25)]
    texts += ["", None, "a b", "A  b", "a b c", "one two three four five", "One two three four five"]
    rnd.shuffle(texts)
    groups = brute_components([(k, shingles(t)) for k, t in enumerate(texts)], near)
    pairs = [(shingles(a), shingles(b)) for a in texts for b in texts]
    assert sum(near(a, b) and a != b for a, b in pairs) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == set(groups)


def test_one_row_of_each_group_whatever_its_ids(spark):
    """Ids on different texts, groups of the same least id, rows without an id, repeated rows."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, c + " more"), (None, c), (4, d), (4, d), (None, d)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, c int")
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "c"), (1, "a"), (1, "b"), (4, "d")]
    assert corpus_pipeline.one_of_each(spark, docs.where("false"), "").count() == 0


def test_links_grow_with_a_group_and_not_with_its_pairs(spark, monkeypatch):
    """Near copies of one text, each with an edit of its own: the links that components are made of are few for each set."""
    made, own = [], near_copies.connected_components

    def counted(edges, *names):
        made.append(edges.distinct().count())
        return own(edges, *names)

    monkeypatch.setattr(near_copies, "connected_components", counted)
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(edited(rnd, base, 1)) for _ in range(160)]
    found = {}
    for n in (80, 160):
        made.clear()
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
        assert kept == set(brute_components([(k, shingles(t)) for k, t in enumerate(texts[:n])], near))
        found[n] = sum(made)
    print("links", found)
    assert 159 <= found[160] <= 4 * 160 and found[160] < 3 * found[80], found


def test_pairs_compared_at_last_are_few_whatever_the_group(spark, monkeypatch):
    """Near copies of one text with up to seven edits each, many of which are near to none but share its shingles: heads
    put together what belongs together, so the join of what is left makes no rows by pairs."""
    made, own = [], near_copies.similar

    def counted(pairs, *rest):
        made.append(pairs.count())
        return own(pairs, *rest)

    monkeypatch.setattr(near_copies, "similar", counted)
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(edited(rnd, base, rnd.randint(0, 7))) for _ in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    want = set(brute_components([(k, shingles(t)) for k, t in enumerate(texts)], near))
    assert kept == want and 40 < len(want) < 200
    print("rows", made)
    assert made[-1] <= 24 and sum(made) <= 30 * len(texts), made
