"""Literal rows for what the test tables don't hold."""

import json
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T
from attesta.operators import capture as C
from attesta.operators import graph as G
from attesta.operators import ledger as L
from attesta.operators import lint
from attesta.operators import project as P
from attesta.operators import reading as R
from attesta.operators import retrieve as V
from attesta.sources import base, extract, relations
from attesta.streaming import windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_hash_is_alike_for_line_ends_and_heads(spark):
    texts = ["a\nb", "a\r\nb", "a\rb", "---\nk: v\n---\na\nb"]
    assert len({one(spark, t, H.text_hash) for t in texts}) == 1
    assert one(spark, "---\nopen\na\nb", H.text_hash) != one(spark, "a\nb", H.text_hash)
    assert one(spark, "abc", lambda c: H.git_blob(c.cast("binary"))) == "git-blob:f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"


@pytest.mark.parametrize(
    "text,good", [("a", True), ("a.b-c_1", True), ("A", False), ("a..b", False), ("a.", False), ("con", False), ("con.x", False), ("", False), ("a/b", False), (None, False)]
)
def test_ids(spark, text, good):
    assert one(spark, text, T.is_id) is good


def test_strip_and_paths_and_garble(spark):
    assert one(spark, "\t\n x\u00a0\u3000", T.strip) == "x" and T.terms("A\u00a0b") == ["a", "b"]
    assert [one(spark, p, T.is_path) for p in ("/a/b", "C:\\x", "\\\\h\\s", "~/x", "../y", "/a b", "word", None)] == [True] * 5 + [False] * 3
    assert [one(spark, p, T.garbled) for p in ("caf\u00c3\u00a9", "caf\u00e9", None)] == [True, False, False]


def test_ages_in_hours():
    stamps = [T.before("2024-01-31", a) for a in ("3", "2w", "1.5d", " 36H ", "0h")]
    assert stamps == ["2024-01-28T00:00:00Z", "2024-01-17T00:00:00Z", "2024-01-29T12:00:00Z", "2024-01-29T12:00:00Z", "2024-01-31T00:00:00Z"]
    assert T.before("2024-01-31T06:30:00Z", "30m".replace("m", "h")) == "2024-01-30T00:30:00Z"
    for wrong in ("", "d", "3m", "-1d", "1 d"):
        with pytest.raises(ValueError):
            T.before("2024-01-31", wrong)


def test_overlapping_hits(spark):
    assert one(spark, "aaaa é aaa", lambda c: T.overlapping(c, "aa")) == [1, 2, 3, 8, 9]
    assert one(spark, "aaaa", lambda c: T.overlapping(c, "aa", 2)) == [1, 2]
    assert [one(spark, t, lambda c: T.overlapping(c, "b")) for t in ("", "aaa", "b")] == [[], [], [1]]


def test_short_texts_are_mentioned(spark):
    docs = spark.createDataFrame([("a", "the big cat sat on a mat"), ("b", "cats"), ("c", None)], "id string, text string")
    queries = spark.createDataFrame([(1, "Cat".lower()), (2, "cat  sat"), (3, "big cat sat"), (4, "cat sat on a mat"), (5, ""), (6, "no")], "query_id long, text string")
    found = sorted((r["query_id"], r["id"]) for r in R.mentions(queries, docs).collect())
    assert found == [(1, "a"), (2, "a"), (3, "a"), (4, "a")]
    assert R.mentions(queries.where("false"), docs).count() == 0


def test_unknown_derivations_and_projects_are_refused(spark, small):
    from attesta.operators import capture, retrieve
    from attesta.sources.relations import stand_in

    rows = spark.createDataFrame([(1, "synthesis"), (1, None), (2, "model-read"), (3, None)], "k int, d string")
    weakest = lambda df: {r[0]: r[1] for r in df.groupBy("k").agg(capture.weakest(df["d"])).collect()}
    assert weakest(rows) == {1: "synthesis", 2: "model-read", 3: "extracted"}
    with pytest.raises(Exception, match="unknown derivation"):
        weakest(rows.union(spark.createDataFrame([(4, "guess")], rows.schema)))
    with pytest.raises(ValueError, match="no such project"):
        retrieve.in_scope(stand_in(spark, small), "view-99")


def test_logical_units(spark):
    text = "one\ntwo\n\n- three\n  four\n- five\n# six\n> seven"
    assert one(spark, text, T.logical_units) == ["one two", "- three four", "- five", "# six", "> seven"]


def test_quote_gate(spark):
    drafts = spark.createDataFrame([
        ("d1", 'He said “exactly these\nvery words” [src-a]'), ("d2", '"exactly those very words" [src-a]'), ("d3", '"exactly those very words" [src-a §4]'),
        ("d4", '"fourteen chars" [src-a]'), ("d5", '"exactly those very words" [src-b]'), ("d6", '"exactly those very words" [src-none]'),
    ], "id string, text string")
    prov = spark.createDataFrame([(f"d{k}", s) for k in range(1, 7) for s in ("src-a", "src-b")], "doc_id string, source_id string")
    sources = spark.createDataFrame([("src-a", "so  exactly these very\twords, yes"), ("src-b", "")], "id string, text string")
    assert {r["id"]: r["ok"] for r in R.quote_gate(drafts, prov, sources).collect()} == {"d1": True, "d2": False}


def test_quotations_that_hold_straight_signs(spark):
    """Between curly signs straight ones are text; between straight signs, or mixed ones, nothing changes."""
    drafts = spark.createDataFrame([
        ("d1", 'As “the token = "29ab41" of today” [src-a] and “once "more" of it all” [src-a]'), ("d2", '"exactly these very words" and "quite other ones here" [src-a]'), ("d3", '“exactly these very words" [src-a]'),
    ], "id string, text string")
    prov = spark.createDataFrame([(f"d{k}", "src-a") for k in range(1, 4)], "doc_id string, source_id string")
    sources = spark.createDataFrame([("src-a", 'now the token = "29ab41" of today, exactly these very words')], "id string, text string")
    assert {(r["id"], r["span"]): r["ok"] for r in R.quote_gate(drafts, prov, sources).collect()} == {
        ("d1", 'the token = "29ab41" of today'): True, ("d1", 'once "more" of it all'): False, ("d2", "exactly these very words"): True,
        ("d2", "quite other ones here"): False, ("d3", "exactly these very words"): True,
    }


def test_containment(spark):
    rows = [("a\n```\nin\r\nside\n```\nb", "\ufeffx in\nside y"), ("whole", "the whole"), ("```\nnot closed", "not closed"), ("```\nA\n```", "a")]
    found = R.containment(spark.createDataFrame(rows, "body string, whole string")).select("contained").collect()
    assert [r[0] for r in found] == [True, True, True, False]


def test_sections_and_find_text(spark):
    docs = spark.createDataFrame([("d", "# A\nx\n## B one\ny\n### C\nz\n## D\naaaa")], "id string, text string")
    assert R.section(docs, "b ONE").first()["text"] == "## B one\ny\n### C\nz"
    assert [r["at"] for r in R.find_text(docs, "aa").collect()] == [30, 31, 32]
    assert R.find_text(docs, "aa", 2).count() == 2
    assert R.page(docs, 2, 0).first()["text"].startswith("A\nx")


def test_lint_on_single_defects(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert [r["id"] for r in lint.l6(docs).collect()] == ["b"]
    index = spark.createDataFrame([("- [a](x.md)",)], "text string")
    assert {r["id"] for r in lint.l8(docs, index).collect()} == {"b"}
    assert lint.l12(spark.createDataFrame([("1.2",)], "version string")).count() == 0
    assert lint.l12(spark.createDataFrame([], "version string")).count() == 1
    d = spark.createDataFrame([("a", "t", None, " b ", None)], "id string, title string, abstract string, body string, self_hash string")
    stamped = C.stamp(d)
    assert lint.l19(stamped).count() == 0 and C.stamp(stamped).first() == stamped.first()
    assert lint.l19(stamped.withColumn("body", F.lit("c"))).count() == 1
    v = spark.createDataFrame([("a", 1, "sha256:x", None), ("b", 1, None, "t"), ("c", 1, "sha256:" + "0" * 64, "t"), ("d", 1, "sha256:" + "0" * 64, None), ("e", 2, None, None)], "id string, version int, upstream_identity string, anchored_at string")
    own = spark.createDataFrame([("a", 1, None), ("b", 1, ""), ("c", 1, "u"), ("d", 2, "u"), ("e", 2, "u"), ("f", 1, "u")], "id string, version int, upstream_ref string")
    found = sorted((r["id"], r["detail"]) for r in lint.l20(v, own).collect())
    assert found == [("a", "form"), ("a", "upstream_ref"), ("b", "identity"), ("d", "unanchored"), ("e", "unanchored"), ("f", "unanchored")]
    lines = spark.createDataFrame([('{"id":"a"}',), ('{"id":"b"}',)], "line string")
    assert lint.l22(lines, lines).count() == 0 and lint.l22(lines, lines.limit(1)).count() == 1


def test_graph_walk(spark):
    rows = [("see_also", "a", "b", False, False), ("cites", "b", "c", True, False), ("cites", "c", "a", True, False), ("cites", "c", "d", True, False)]
    edges = spark.createDataFrame(rows, "relation string, source string, target string, directed boolean, stale boolean")
    depth = lambda *a, **k: {r["id"]: r["depth"] for r in G.walk(G.adjacency(edges, *a), ["a"], **k).collect()}
    assert depth("both", depth=1) == {"a": 0, "b": 1, "c": 1}
    assert depth("out", depth=9) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert depth("in", depth=1) == {"a": 0, "b": 1, "c": 1}
    assert depth("out", depth=9, max_nodes=2) == {"a": 0, "b": 1}
    assert G.walk(G.adjacency(edges), ["a"], 0).count() == 1


def plain_capture(batch, held, force):
    """One row after the other."""
    own = {i: [ref, h, v] for i, ref, h, v in held}
    out = {}
    for seq, i, ref, h, size in sorted(batch):
        twins = sorted(k for k, v in own.items() if v[1] == h)
        there = sorted(k for k, v in own.items() if ref is not None and v[0] == ref)
        if size >= C.LARGE:
            out[seq] = ("refused", None, None)
        elif twins:
            out[seq] = ("deduped", twins[0], None)
        elif i in own:
            own[i][1:] = [h, own[i][2] + 1]
            out[seq] = ("versioned", i, own[i][2])
        elif there and not force:
            out[seq] = ("refused", there[0], None)
        else:
            own[i] = [ref, h, 1]
            out[seq] = ("created", there[0] if there else None, 1)
    return out


@pytest.mark.parametrize("seed,force,ids,refs,hashes", [(1, False, 6, 5, 8), (2, True, 6, 5, 8), (3, False, 3, 9, 30), (4, False, 12, 2, 5)])
def test_batches_are_taken_in_order(spark, seed, force, ids, refs, hashes):
    """Random batches with few ids, refs or contents, so that rows hang on each other in every way."""
    import random

    rnd = random.Random(seed)
    held = [(f"i{k}", rnd.choice([None, f"r{rnd.randint(0, refs)}"]), f"h{rnd.randint(0, hashes)}", rnd.randint(1, 4)) for k in range(0, ids, 2)]
    held = list({h[2]: h for h in held}.values())
    batch = [(k, f"i{rnd.randint(0, ids)}", rnd.choice([None, f"r{rnd.randint(0, refs)}"]), f"h{rnd.randint(0, hashes)}", C.LARGE if rnd.random() < 0.05 else 1) for k in range(40)]
    own = C.capture(spark.createDataFrame(batch, "seq int, id string, ref string, hash string, size int"), spark.createDataFrame(held, "id string, ref string, hash string, version int"), force)
    assert {r["seq"]: (r["action"], r["target"], r["version"]) for r in own.collect()} == plain_capture(batch, held, force)


def test_a_content_held_twice(spark):
    """A row that one holder's change keeps waiting is decided before the other holder changes too."""
    held = [("x", None, "h", 1), ("y", None, "h", 1)]
    batch = [(1, "x", None, "n1", 1), (2, "new", None, "h", 1), (3, "y", None, "n3", 1), (4, "late", None, "h", 1)]
    own = C.capture(spark.createDataFrame(batch, "seq int, id string, ref string, hash string, size int"), spark.createDataFrame(held, "id string, ref string, hash string, version int"))
    found = {r["seq"]: (r["action"], r["target"], r["version"]) for r in own.collect()}
    assert found == plain_capture(batch, held, False) and found[2] == ("deduped", "y", None) and found[4] == ("created", None, 1)


def test_hot_keys_of_a_batch_take_few_rounds(spark, monkeypatch):
    """A third of the rows on one content, one id or one ref: rounds don't grow with them."""
    rounds = []
    monkeypatch.setattr(C, "_settled", lambda *a, own=C._settled: rounds.append(1) or own(*a))
    batch = [(k, "same", None, f"v{k}", 1) for k in range(60)] + [(60 + k, f"n{k}", "ref", f"w{k}", 1) for k in range(60)] + [(120 + k, f"m{k}", None, "twin", 1) for k in range(60)]
    own = C.capture(spark.createDataFrame(batch, "seq int, id string, ref string, hash string, size int"), spark.createDataFrame([], "id string, ref string, hash string, version int"))
    assert {r["seq"]: (r["action"], r["target"], r["version"]) for r in own.collect()} == plain_capture(batch, [], False) and len(rounds) <= 3


def test_a_content_that_is_wanted_and_left_by_turns(spark, monkeypatch):
    """Many holders of one content, each of which leaves it between two rows that want it: rounds don't grow with them."""
    rounds = []
    monkeypatch.setattr(C, "_settled", lambda *a, own=C._settled: rounds.append(1) or own(*a))
    held = [(f"s{k:02}", f"r{k}", "h", 1) for k in range(12)]
    batch = [r for k in range(12) for r in ((3 * k, f"new{k}", None, "h", 1), (3 * k + 1, f"s{k:02}", None, f"v{k}", 1), (3 * k + 2, f"late{k}", f"r{k}", "h", 1))]
    own = C.capture(spark.createDataFrame(batch, "seq int, id string, ref string, hash string, size int"), spark.createDataFrame(held, "id string, ref string, hash string, version int"))
    assert {r["seq"]: (r["action"], r["target"], r["version"]) for r in own.collect()} == plain_capture(batch, held, False) and len(rounds) <= 4


def plain_walk(edges, seeds, depth, cap):
    """Breadth first by a loop: sorted parents, sorted neighbours, a cap that stops inside a layer."""
    adj = {}
    for a, rel, b in sorted(edges):
        adj.setdefault(a, []).append((b, rel))
    for v in adj.values():
        v.sort()
    meta = {s: (0, [], ["seed"]) for s in seeds}
    layer, frontier, complete = sorted(seeds), set(), True
    for d in range(1, depth + 1):
        new = []
        for node in layer:
            for to, rel in adj.get(node, ()):
                if to in meta:
                    if meta[to][0] == d:
                        meta[to][1].append(node)
                        meta[to][2].append(rel)
                elif cap is not None and len(meta) >= cap:
                    complete = False
                else:
                    meta[to] = (d, [node], [rel])
                    new.append(to)
        if not complete:
            frontier = {*layer, *new}
            break
        layer = sorted(new)
    unique = lambda x: list(dict.fromkeys(x))
    left = {n: sum(t not in meta for t, _ in adj.get(n, ())) for n in frontier}
    return {k: (d, unique(f), unique(b)) for k, (d, f, b) in meta.items()}, {k: n for k, n in left.items() if n}, complete


@pytest.mark.parametrize("seed", range(4))
def test_capped_walks_of_random_graphs(spark, seed):
    import random

    rnd = random.Random(seed)
    edges = {(f"n{rnd.randint(0, 25):02}", rnd.choice("ab"), f"n{rnd.randint(0, 25):02}") for _ in range(60)}
    df = spark.createDataFrame(sorted(edges), "from_id string, relation string, to_id string")
    seeds = sorted({f"n{rnd.randint(0, 25):02}" for _ in range(2)})
    for depth, cap in ((1, 5), (3, 9), (4, None), (2, 1), (3, 14)):
        found = G.explore(df, seeds, depth, cap)
        wanted, left, complete = plain_walk(edges, seeds, depth, cap)
        own = {x["id"]: (x["depth"], x["reached_from"], x["reached_by"]) for x in G.all_ways(found).collect()}
        assert (own, {x["id"]: x["remaining"] for x in found.frontier.collect()}, found.complete) == (wanted, left, complete), (depth, cap)


def test_projection_refuses_and_reports(spark, small):
    r = relations.stand_in(spark, small)
    for wrong in ({"centers": ["nobody"]}, {"relations": ["likes"]}, {"direction": "up"}):
        with pytest.raises(ValueError):
            G.project(r, **wrong)
    g = G.project(r, ["view-1"], 1, kinds=["decision"], max_nodes=3, max_edges=1)
    assert (g.complete, g.limited_by) == (False, "max_nodes") and [x["id"] for x in g.nodes.collect()] == ["view-1"]
    whole = G.project(r, relations=["member_of"])
    assert whole.complete and whole.walk is None and whole.omitted_edges == 0 and whole.nodes.count() == lint.documents(r).count()


def test_ladders_and_queue(spark):
    held = spark.createDataFrame([("s1", "r1", "h1", 3, "x")], "id string, ref string, hash string, version int, text string")
    batch = spark.createDataFrame(
        [(1, "n1", "r9", "h9", 1), (2, "n2", "r8", "h9", 1), (3, "s1", "r1", "h2", 1), (4, "s1", "r1", "h3", 1), (5, "n5", "r1", "h5", 1), (6, "n6", None, "h1", 1), (7, "n7", None, "h7", C.LARGE)],
        "seq int, id string, ref string, hash string, size int",
    )
    found = {r["seq"]: (r["action"], r["version"]) for r in C.capture(batch, held.drop("text")).collect()}
    assert found == {1: ("created", 1), 2: ("deduped", None), 3: ("versioned", 4), 4: ("versioned", 5), 5: ("refused", None), 6: ("created", 1), 7: ("refused", None)}
    assert {r["seq"]: r["action"] for r in C.capture(batch, held.drop("text"), True, True).collect()}[5] == "created"
    tasks = spark.createDataFrame([("t", "done"), ("u", "pending")], "id string, status string")
    moves = spark.createDataFrame([("t", "pending"), ("u", "blocked"), ("u", "pending"), ("w", "done")], "id string, status string")
    assert sorted(r["outcome"] for r in C.restatus(tasks, moves).collect()) == ["illegal", "moved", "noop", "unknown"]


def test_ladder_reads_files_that_changed(spark):
    """Other markup around the same text is told apart, where an extractor reads both files."""
    cols = "id string, ref string, hash string, text string, path string, content binary"
    page = lambda t: bytearray(t.encode())
    held = [("p", "r", "h1", "", "source.html", page("<p>a</p><script>1</script>")), ("q", "s", "h2", "", "source.bin", page("1")), ("t", "u", "h3", "x", "source.md", page("x"))]
    new = [("p", None, "n1", None, "p.html", page("<div>a</div>")), ("new", "r", "n2", None, "p.html", page("<p>b</p>")), ("q", None, "n3", None, "q.bin", page("1 ")), ("t", None, "n4", "y", "t.md", page("y")), ("z", None, "h1", None, "z.html", page("z"))]
    found = {r["id"]: (r["status"], r["match_id"]) for r in C.dedup_check(spark.createDataFrame(new, cols), spark.createDataFrame(held, cols)).collect()}
    assert found == {"p": ("same-after-extraction", "p"), "new": ("changed", "p"), "q": ("changed", "q"), "t": ("changed", "t"), "z": ("already-captured", "p")}


def test_dormancy_and_percentiles(spark):
    usage = spark.createDataFrame([("a", None, 1, 1, None), ("a", None, 1, 1, 5), ("b", 1.0, 1, 1, None), ("b", 2.0, 1, 1, None), ("b", 9.0, 1, 1, None)], "op string, duration_ms double, bytes_in long, bytes_out long, tokens long")
    found = {r["op"]: r for r in L.cost(usage).collect()}
    assert found["a"]["p50_ms"] is None and found["a"]["total_ms"] is None and found["a"]["tokens_n"] == 1
    assert (found["b"]["p50_ms"], found["b"]["p95_ms"]) == (2.0, 9.0)


def test_ledger_files(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"op":"find","bytes_in":3}\nnot json\n{"op":"ask"}\n')
    assert [r["op"] for r in L.read_usage(spark, str(tmp_path / "u.jsonl")).collect()] == ["find", "ask"]
    (tmp_path / "log.md").write_text("# Log\n## [2024-01-01T00:00:00Z] capture | a | deduped\ntext\n## [2024-01-02T00:00:00Z] lint | ok\n")
    rows = L.read_log(spark, str(tmp_path / "log.md")).orderBy("seq").collect()
    assert [(r["stamp"], r["op"]) for r in rows] == [("2024-01-01T00:00:00Z", "capture"), ("2024-01-02T00:00:00Z", "lint")]


def test_html_and_registry(spark):
    raw = b"<head><title>no</title></head><p>a &amp;  b</p><script>x</script><div>c<br>d</div>"
    assert extract.html(raw) == "a & b\n\nc\nd"
    pages = {
        b"": "", b"plain": "plain", b"<p> a\t b </p>\n\n<p>c": "a b \n\nc", b"x<style>y<b>z</style>w": "xw", b"a<br/><br><br>b": "a\n\nb",
        b"<template><p>no</p></template>yes</template>!": "yes!", b"a\nb &lt;c&gt;&nbsp;d": "a\nb <c>\u00a0d", b"<ul><li>1<li>2</ul>": "1\n2",
        b"\xff<!-- no --><h1>T</h1>t": "\ufffd\nT\nt", b"<script>never closed <p>x": "",
    }
    assert {p: extract.html(p) for p in pages} == pages
    files = spark.createDataFrame([("x.html", bytearray(raw)), ("x.PY", bytearray(b"\xffok")), ("x.bin", bytearray(b"1"))], "path string, content binary")
    assert [r["text"] for r in extract.extracted(files).collect()] == ["a & b\n\nc\nd", "\ufffdok", None]
    cells = spark.createDataFrame([("s", "a", "1"), ("s", "a", "x"), ("s", "a", "true"), ("s", "a", "2024-01-02")], "sheet string, column string, value string")
    r = extract.sheet_facts(cells).first()
    assert (r["n_values"], r["n_numbers"], r["n_dates"], str(r["min_date"])) == (4, 1, 1, "2024-01-02")


def test_real_base(spark, tmp_path):
    root = f"{tmp_path}/kb"
    assert base.scaffold(spark, root, "x") and not base.scaffold(spark, root, "x")
    for name, meta, files in (
        ("src-a", {"id": "src-a", "type": "source", "version": 2, "capture": "full", "origin": {"system": "web", "ref": "u", "recoverable": True}, "content_hash": "h",
                   "history": [{"version": 1, "file": "source.v1.md"}, {"version": 2, "file": "source.md"}], "new_field": [1]}, {"source.md": "now", "source.v1.md": "then"}),
        ("src-b", {"id": "src-b", "version": 1}, {"source.pdf": "x", "source-text.md": "aid"}),
    ):
        (tmp_path / "kb/sources" / name).mkdir()
        (tmp_path / f"kb/sources/{name}/meta.yml").write_text(json.dumps(meta))
        for f, t in files.items():
            (tmp_path / f"kb/sources/{name}/{f}").write_text(t)
    (tmp_path / "kb/summaries/s.md").write_text("---\nid: sum-a\ntype: summary\ntitle: T\nsources: [src-a, {id: src-b, hash: h}]\n---\nbody\n")
    (tmp_path / "kb/insights/bad.md").write_text("---\n: [\n---\nbody\n")
    parsed = base.entries(spark, root)
    own = base.sources(spark, root, parsed)
    s = {r["id"]: r for r in own.collect()}
    assert s["src-a"]["text"] == "now" and s["src-a"]["recoverable"] is True and s["src-b"]["text"] == "aid"
    assert base.versions(own).count() == 2
    d = base.documents(parsed, *base.FOLDERS)
    assert [(r["doc_id"], r["id"], r["hash"]) for r in base.exploded(d, "sources", "id", "hash").collect()] == [("sum-a", "src-a", None), ("sum-a", "src-b", "h")]
    assert [r["id"] for r in base.unreadable(parsed).collect()] == ["insights/bad.md"] and d.where("id = 'sum-a'").first()["body"] == "body\n"


def test_views(spark, small):
    r = relations.stand_in(spark, small)
    lines = [json.loads(x["line"]) for x in P.index_records(r).collect()]
    assert len(lines) == lint.documents(r).count() and all(list(x) == sorted(x) for x in lines)
    assert V.find(r, "").where("matched <> 'mention'").count() == 0


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    q = windows.stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("days").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("days").count() == windows.daily(windows.with_time(events)).count()


def test_retrieve_order_and_fallback(spark, small):
    """In scope before outside, by tier; without vectors find answers alone; an unknown view is an error."""
    r = relations.stand_in(spark, small)
    own = [tuple(x) for x in V.retrieve(r, None, "view", project="view-1").select("in_scope", "tier", "via").collect()]
    assert own == sorted(own, key=lambda x: (not x[0], x[1])) and {x[2] for x in own} == {"find"} and sum(not x[0] for x in own) <= 5
    with pytest.raises(ValueError):
        V.retrieve(r, None, "view", project="nowhere")
    found, left = V.degraded(r, words="view", limit=3, cites="a", kind=None, status="b")
    assert found.count() == 3 and left == ["cites", "status"]


def test_phrases(spark):
    docs = spark.createDataFrame([("a", "one, Two three"), ("b", "two one"), ("c", "one twofold"), ("d", "bone two"), ("e", None)], "id string, text string")
    found = lambda q: {x["id"] for x in V.bm25(docs, "id", "text", q).collect()}
    assert found("one-two") == {"a"} and found("one two") == {"a", "b"} and found("-- three") == {"a"} and found("--") == set()


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b A b"), (3, ""), (4, None), (5, "word")], "id int, text string")
    own = {x["id"]: x["embedding"] for x in V.embed(docs, dim=8).collect()}
    assert own[1] == own[2] and own[3] == own[4] == [0.0] * 8
    for k in (1, 5):
        assert abs(sum(x * x for x in own[k]) - 1) < 1e-6


def test_guard_and_status(spark, small):
    spark.conf.set("attesta.read_only", "true")
    try:
        C.guard(spark, "find")
        with pytest.raises(ValueError):
            C.guard(spark, "anchor")
    finally:
        spark.conf.unset("attesta.read_only")
    C.guard(spark, "anchor")
    r = relations.stand_in(spark, small)
    assert R.source_status(r, "src-doc-1").first()["tier"] in ("full", "reference", "partial")
    with pytest.raises(ValueError):
        R.source_status(r, "src-none")


def test_real_base_runs_operators(spark, tmp_path):
    """A base on disk as relations: lint, find, graph and the queue work on it."""
    root = f"{tmp_path}/kb"
    base.scaffold(spark, root, "x")
    write = lambda p, t: ((tmp_path / "kb" / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / "kb" / p).write_text(t))
    held = "held words of the source\n"
    digest = "sha256:" + __import__("hashlib").sha256(held.encode()).hexdigest()
    meta = {"id": "src-a", "type": "source", "origin": {"system": "web", "ref": "http://a"}, "capture": "full", "captured_at": "2024-01-01T00:00:00Z",
            "content_hash": digest, "version": 1, "history": [{"version": 1, "content_hash": digest, "file": "source.v1.md"}]}
    write("sources/src-a/meta.yml", json.dumps(meta))
    write("sources/src-a/source.v1.md", held)
    write("summaries/s.md", f"---\nid: sum-a\ntype: summary\ntitle: About words\nstatus: current\nsources: [{{id: src-a, hash: {digest}}}, {{id: src-none, hash: h}}]\nsee_also: [sum-a]\n---\nbody\n")
    write("projects/p.md", "---\nid: view\ntype: project\ntitle: V\nscope: project\nmembers: [src-a, sum-a]\n---\n")
    write("decisions/d.md", "---\nid: dec\ntype: decision\ntitle: D\nstatus: accepted\ndate: '2024-01-02'\nevidence: [{id: src-a, version: 1}]\n---\nwhy\n")
    write("log.md", "# Log\n## [2024-01-01T00:00:00Z] capture | src-a | new\n## [2024-01-02T00:00:00Z] drift-check | same=0 changed=0 unreachable=1 | checked: src-a=unreachable\n")
    write("usage.jsonl", '{"ts":"2024-01-03T00:00:00Z","op":"find","bytes_in":3,"ids":["src-a","sum-a"]}\n')
    write("queue/t.md", "---\nid: task-1\ntype: ingest\nstatus: pending\ninputs:\n  - a b\n  - c\n---\nDo it.\n")
    write("queue/none.md", "---\ntype: ingest\n---\nNo id.\n")
    r = base.load(spark, root)
    assert sorted(x["id"] for x in V.find(r, "words").collect()) == ["src-a", "sum-a"]
    assert {x["id"] for x in lint.l3(r).collect()} == {"sum-a"} and lint.l5(r).count() == 0
    edges = {(x["relation"], x["source"], x["target"]) for x in G.edges(r).collect()}
    assert {("grounded_by", "sum-a", "src-a"), ("member_of", "src-a", "view"), ("evidence", "dec", "src-a")} <= edges
    assert [(x["id"], x["verdict"]) for x in L.last_verdict(r.log).collect()] == [("src-a", "unreachable")]
    assert r.usage.select("doc_id").count() == 2 and R.source_status(r, "src-a").first()["has_bytes"]
    t = base.tasks(spark, root).collect()
    assert [(x["id"], x["status"], x["inputs"], x["body"]) for x in t] == [("task-1", "pending", ["a b", "c"], "Do it.")]
    own = {(x["rule"], x["id"]) for x in lint.findings(r, lint.documents(r)).collect()}
    assert ("L3", "sum-a") in own and not any(rule in ("L5", "L6", "L10") for rule, _ in own)
    empty = base.load(spark, f"{tmp_path}/nothing")
    assert empty.sources.count() == empty.provenance.count() == 0


def test_kept_vectors_are_told_from_embedded_ones(spark):
    """A text of one word may have the first axis for its vector; words that cancel out still give a direction."""
    from types import SimpleNamespace

    from attesta.plans import registry

    cell = lambda w: (int(md5(w.encode()).hexdigest()[:6], 16) % 64, md5(w.encode()).hexdigest()[-1] < "8")
    words = [f"w{k}" for k in range(2000)]
    axis = next(w for w in words if cell(w) == (0, True))
    pair = next(f"{a} {b}" for a in words[:200] for b in words if cell(a)[0] == cell(b)[0] != 0 and cell(a)[1] != cell(b)[1])
    rows = [("a", 5, "x1", axis), ("b", 4, "x2", pair), ("c", 3, "x3", "kept as it is"), ("d", 10, "x4", "some new words")]
    sources = spark.createDataFrame(rows, "id string, num long, content_hash string, text string")
    found = registry.reindex(SimpleNamespace(sources=sources)).collect()
    assert {(r["id"], r["unit"], r["kept"]) for r in found} == {("a", True, False), ("b", True, False), ("c", True, True), ("d", True, False)}
