"""Near copies of vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from attesta.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, c string, n string, grp string, key string, tile string"


def brute(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs, in the order of rows."""
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.float32(v).astype(np.float64)
            good[k] = x / np.linalg.norm(x)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    heads = {}
    for k, r in enumerate(rows):
        ids = heads.setdefault(top(k), [])
        if r[0] is not None:
            ids.append(r[0])
    low = [min(heads[top(k)], default=None) for k in range(len(rows))]
    return [(r[0], n, m, r[0] == m) for r, n, m in zip(rows, links, low)]


def check(spark, rows):
    own = [(*r, "x", "y", "z", "w", "t") for r in rows]
    found = [tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(own, SCHEMA)).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=order) == sorted(brute(rows), key=order)
    return found


def planted(seed, n, dim, labels=3, noise=0.02):
    """Random vectors, copies, chains of near copies and large groups."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        pick = rng.random()
        if out and pick < 0.5:
            base = np.array(out[rng.integers(len(out))][1])
            step = rng.normal(size=dim) * noise * rng.choice([0, 0.5, 1, 1.2])
            out.append((k, (base * rng.choice([1, 3]) + step).tolist(), int(rng.integers(labels))))
        else:
            v = rng.normal(size=dim)
            out.append((k, (v / np.linalg.norm(v)).tolist(), int(rng.integers(labels))))
    return out


@pytest.mark.parametrize("seed,dim", [(1, 64), (2, 5), (3, 20)])
def test_against_all_pairs(spark, monkeypatch, seed, dim):
    """Several tiles and blocks a label, whatever they cut apart."""
    monkeypatch.setattr(vectors, "TILE", 40)
    monkeypatch.setattr(vectors, "SPREAD", 1000)
    found = check(spark, planted(seed, 400, dim))
    assert sum(r[1] > 0 for r in found) > 50 and sum(r[3] for r in found) > 50


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [1.0, inf], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None),
        (12, [1e-30, 0.0], 1), (13, [3e38, -0.0], 1), (2, [2.0, 0.0], 1), (14, [0.0, -1.0], 1), (15, [0.1, -1.0], 1), (16, [0.3, -1.0], 1), (0, [0.2, -1.0], 1),
    ]
    found = {(r[0], r[1]): r for r in check(spark, rows)}
    assert found[14, 2][2] == 0 and found[16, 2][2] == 0  # linked through what lies between


def test_large_group_of_near_copies_gives_rows_by_class(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = [(k, (base + rng.normal(size=64) * 0.01).tolist(), 1) for k in range(500)] + [(k, base.tolist(), 1) for k in range(500, 900)]
    found = check(spark, rows)
    assert {r[1] for r in found} == {899} and {r[2] for r in found} == {0}


def test_empty_and_lone(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None, 1)])
    check(spark, [(1, [1.0, 2.0], 1)])


def test_bounds_never_drop_a_pair():
    rnd = random.Random(3)
    rng = np.random.default_rng(3)
    for _ in range(20):
        dim = rnd.choice([3, 9, 17, 40, 64])
        x = rng.normal(size=(60, dim))
        x[30:] = x[:30] + rng.normal(size=(30, dim)) * rnd.choice([0.01, 0.1, 0.2])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        i, j = vectors.reaching(x @ axes, x @ axes, x, x, 0.98, True)
        assert sorted(zip(i, j)) == [(a, b) for a in range(60) for b in range(a + 1, 60) if x[a] @ x[b] >= 0.98]


def test_sql_agrees_on_planted_vectors(spark, tmp_path):
    import duckdb

    rows = planted(7, 150, 64)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = con.execute(f"select vec_id, n_links, component_id, kept from ({vectors.ORACLE})").fetchall()
    assert sorted(wanted) == sorted(tuple(r) for r in vectors.query(spark, str(tmp_path)).collect()) == sorted(brute(rows))
