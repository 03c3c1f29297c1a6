"""Rules against brute force, ranks against power iteration on a dense matrix."""

import numpy as np
from attesta.llm import url_filter

PAGES = [
    (1, "https://a.org/x?y", '<a href="http://b.net/1">b</a><a href=\'//c.net\'>c</a>'),
    (2, "http://b.net/", "<a href=http://d.net/>d</a>"), (3, "http://c.net#f", None), (4, "http://d.net/q", "<p>"),
    (5, "HTTP://WWW.Example.ORG/es/1", "<a href='/own'>x</a>"), (6, "http://example.org/en/12", ""), (7, "http://x.com/fr/", ""),
    (8, "http://x.com/de/z", "<a href=http://>none</a>"), (9, "http://f.net/", '<a href="http://x.com">x</a>'),
    (10, None, None), (11, "no scheme", "<a href='http://d.net'>"), (12, "http://", ""), (13, "http://notorg/", ""), (14, "", ""),
    (14, "", ""), (15, "http://exampleÄ.org", ""), (16, "http://f.net/a/b?c://d", None),
]


def rule_of(host, path):
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as rule")
    found = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    wanted_hosts = {
        1: ("a.org", "/x"), 3: ("c.net", ""), 5: ("www.example.org", "/es/1"), 10: ("", ""), 11: ("", ""), 12: ("", ""),
        15: ("exampleÄ.org", ""), 16: ("f.net", "/a/b"),
    }
    for k, hp in wanted_hosts.items():
        assert (found[k]["host"], found[k]["path"]) == hp
    for r in found.values():
        rule, verdict = rule_of(r["host"], r["path"])
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict)
    # f.net links to the host of a blocked page, and no one links to it; x.com has a page of each kind
    assert found[9]["verdict"] == "block" and found[2]["verdict"] == "allow" and found[10]["verdict"] == "allow"
    assert url_filter.judge(pages).count() == len(PAGES)


def test_ranks(spark):
    rnd = np.random.default_rng(1)
    w = rnd.integers(0, 4, (7, 7)) * (rnd.random((7, 7)) < 0.4)
    np.fill_diagonal(w, 0)
    w[6] = 0
    names = [f"h{k}" for k in range(7)]
    edges = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i in range(7) for j in range(7) if w[i, j]], "src string, dst string, links double")
    t0, x0 = np.array([0.5, 0.5, 0, 0, 0, 0, 0]), np.array([0, 0, 0, 1.0, 0, 0, 0])
    seeds = spark.createDataFrame([(n, float(a), float(b)) for n, a, b in zip(names, t0, x0)], "host string, trust0 double, distrust0 double")
    found = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(seeds, edges).collect()}

    def ranks(m, seed):
        """Power iteration till it stands still; what a host without links holds returns to the seeds."""
        out, r = m.sum(1), seed
        for _ in range(400):
            share = np.where(out > 0, r / np.maximum(out, 1), 0)
            r = 0.15 * seed + 0.85 * (m.T @ share + r[out == 0].sum() * seed)
        return r

    own = np.array([found.get(n, (0, 0)) for n in names])
    own /= own.sum(0)
    wanted = np.stack([ranks(w, t0), ranks(w.T, x0)], 1)
    assert np.abs(own - wanted).sum(0).max() < 2 * url_filter.RESIDUAL


GRAPH = [(k, f"http://good{k % 3}.com/fr/{k}", f"<a href='http://near{k % 3}.net/'>") for k in range(9)]
GRAPH += [(20 + k, f"http://bad{k % 2}.com/de/{k}", "") for k in range(8)]
GRAPH += [(40 + k, f"http://spam{k}.net/", f"<a href='http://bad{k % 2}.com/'> <a href='http://deep.net'>") for k in range(5)]
GRAPH += [(60, "http://near1.net/x", ""), (61, "http://deep.net/", "<a href='http://spam0.net/'>"), (62, "http://a.b.shop.co.uk/", "")]
GRAPH += [(63, "http://shop.co.uk/", "<a href='http://bad0.com/'>"), (64, "http://other.co.uk/", ""), (65, "http://lone.net/", "")]


def test_links_between_hosts_decide_however_many_pages_there_are(spark):
    import duckdb

    for copies in (1, 50):
        rows = [(k + 1000 * c, u, h) for c in range(copies) for k, u, h in GRAPH]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
        assert all(found[k] == "block" for k in (40, 44, 61, 62, 63)), found
        assert all(found[k] == "allow" for k in (0, 60, 64, 65)), found
        con = duckdb.connect()
        con.register("pages", pages.toPandas())
        assert {r[0]: r[4] for r in con.execute(url_filter.ORACLE).fetchall()} == found


def test_own_domain(spark):
    hosts = ["a.b.example.org", "example.org", "x.shop.co.uk", "shop.co.uk", "co.uk", "localhost", "a.com.example.com", "1.2.3.de"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    found = [r[0] for r in rows.select(url_filter.F.regexp_extract("host", url_filter.OWN_DOMAIN, 1)).collect()]
    assert found == ["example.org", "example.org", "shop.co.uk", "shop.co.uk", "co.uk", "", "example.com", "3.de"]


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sql_agrees(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    wanted = sorted(con.execute(url_filter.ORACLE).fetchall(), key=str)
    assert sorted(map(tuple, url_filter.query(spark, small).collect()), key=str) == wanted
