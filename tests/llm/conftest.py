import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, component_id string, shard string, digest string, n int, h string"
)


def frame(spark, rows):
    """documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 9.0, "x", "y", "z", 5, "w") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(70), prose(9000)
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, prose(50), "en", "a", 1), (3, prose(40), "en", "a", 1),
        (4, passage, "en", "b", 1), (5, prose(30) + passage + prose(20), "en", "b", 1),
        (6, passage + passage, "en", "b", 1), (7, long, "fr", "a", 1), (8, long[:30000] + " x " + long[30000:], "fr", "a", 1),
        (None, prose(60), "en", None, 1), (None, None, "en", "a", 1), (9, "A  b\tC\nd é ü ñ 漢字 😀", "fr", "a", 1),
        (10, "x" * 700, "en", "a", 1), (11, "\0\x1f \x85\xa0 <|endoftext|> it's 12 %", "en", "a", 1), (12, "?!", "en", "a", 1),
        (13, "é" * 90 + passage + "ü" * 90, "fr", "a", 1),
    ]
    rows += [(14, passage[:199], "en", "a", 1), (14, passage[:199], "en", "a", 1), (15, passage[:200], "en", "a", 1)]
    rows += [(100 + k, passage[k : k + 210] + prose(5), "en", "hot", 1) for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
