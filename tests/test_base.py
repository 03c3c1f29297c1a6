"""A base on disk: what its files say, and the store that keeps it parsed."""

import hashlib
import json
import os

import pytest

from attesta.operators import graph as G
from attesta.operators import ledger as L
from attesta.operators import lint
from attesta.operators import project as P
from attesta.operators import retrieve as V
from attesta.sources import base, snapshot, storage


def digest(raw):
    return "sha256:" + hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


class Kb:
    """Writes the files of a base."""

    def __init__(self, root):
        self.root = root

    def put(self, path, content):
        at = self.root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())

    def source(self, id_, files, **meta):
        own = {"id": id_, "type": "source", "origin": {"system": "web", "ref": f"http://{id_}", "recoverable": True}, "capture": "full", "captured_at": "2024-01-01T00:00:00Z", "version": 1}
        own |= meta
        self.put(f"sources/{id_}/meta.yml", json.dumps(own))
        for name, content in files.items():
            self.put(f"sources/{id_}/{name}", content)

    def doc(self, path, body="body\n", **head):
        self.put(path, "---\n" + json.dumps(head) + "\n---\n" + body)


@pytest.fixture
def kb(spark, tmp_path):
    """Sources of every sort, documents with every list, a log with a drift check of several."""
    own = Kb(tmp_path / "kb")
    base.scaffold(spark, str(own.root), "x")
    entry = lambda h, f, **k: {"version": 1, "content_hash": h, "captured_at": "2024-01-01T00:00:00Z", "file": f, **k}
    crlf, pdf = b"---\r\nhead: 1\r\n---\r\nline one\r\nline two\r\n", b"%PDF\xff\xfe\x00 not text"
    h = digest("line one\nline two\n")
    own.source("src-crlf", {"source.md": crlf}, content_hash=h, history=[entry(h, "source.md")], tags=["red", "blue"])
    own.source("src-pdf", {"source.pdf": pdf, "source-text.md": b"read by a machine \xff"}, content_hash=digest(pdf), history=[entry(digest(pdf), "source.pdf", text_aid="source-text.md")])
    own.source("src-bad", {"source.txt": "edited", "source-text.v1.md": "stray", "source.v7.md": "stray"}, content_hash=digest("before"), history=[entry(digest("before"), "source.txt", text_aid="source-text.md")])
    own.source("src-whole", {"source.md": "w"}, content_hash=digest("w"), history=[entry(digest("w"), "source.md")], origin={"system": "repo", "ref": "r/x"})
    own.source("src-part", {"source.md": "p"}, content_hash=digest("p"), history=[entry(digest("p"), "source.md")], origin={"system": "repo", "ref": "r/x#a.md", "upstream_ref": "http://src-crlf"})
    own.put("sources/no-meta/source.md", "x")
    own.doc("summaries/s.md", id="sum-a", type="summary", title="About", status="current", derived_at="2024-01-02", tags=["green", "grey"], see_also=["sum-b", "src-pdf"], as_of="2023-12-01",
            sources=[{"id": "src-pdf", "hash": digest(pdf)}, "src-crlf"], connectors=[{"system": "web"}])
    own.doc("entities/e.md", id="sum-b", type="odd", status="superseded", sources=[{"id": "src-crlf", "content_hash": "old"}])
    own.put("concepts/plain.md", "no head\n")
    own.doc("projects/p.md", id="view", type="project", title="V", scope="global", members=["src-crlf", "sum-a", "gone"])
    own.doc("projects/q.md", id="bare", title="Q")
    own.doc("decisions/d.md", id="dec", type="decision", title="D", status="accepted", date="2024-01-02", evidence=["src-pdf", {"id": "src-crlf", "version": 0}])
    own.put("log.md", "# Log\n## [2024-01-01T00:00:00Z] capture | created | src-crlf (full)\n"
            "## [2024-01-03T00:00:00Z] drift-check | same=1 changed=1 unreachable=1 | checked: src-crlf=same, src-pdf=changed, src-bad=unreachable | note\n"
            "## [2024-01-04T00:00:00Z] drift-check | same=1 | checked: src-pdf=same-text\n## [2024-01-05T00:00:00Z] drift-check | nothing to do\n")  # fmt: skip
    return own


def test_every_sort_of_source_is_read(spark, kb):
    r = base.load(spark, str(kb.root))
    s = {x["id"]: x for x in r.sources.collect()}
    assert s["src-pdf"]["text"] == "read by a machine �" and s["src-crlf"]["text"].endswith("line one\nline two\n") and s["src-crlf"]["tags"] == ["red", "blue"]
    assert [x["id"] for x in V.find(r, "blue").collect()] == ["src-crlf"] and [x["id"] for x in V.find(r, "machine").collect()] == ["src-pdf"]
    assert [x["id"] for x in V.find(r, "grey").collect()] == ["sum-a"]
    assert {(x["id"], x["detail"]) for x in lint.l5(r).collect()} == {("src-bad", "source.txt")}
    assert {(x["id"], x["detail"]) for x in lint.l13(r).collect()} == {
        ("src-bad", "missing aid source-text.md"), ("src-bad", "unlisted aid source-text.v1.md"), ("src-bad", "unlisted source.v7.md"),
    }
    assert {(x["severity"], x["id"], x["detail"]) for x in lint.l9(r).collect()} == {
        ("error", "sum-b", "title"), ("error", "sum-b", "derived_at"), ("warn", "sum-b", "odd"), ("error", "bare", "type"), ("error", "bare", "members"),
    }
    own = base.entries(spark, str(kb.root))
    assert {(x["id"], x["detail"]) for x in base.unreadable(own).collect()} == {("concepts/plain.md", "no head")}
    assert {(x["id"], x["detail"]) for x in base.headless(spark, str(kb.root)).collect()} == {("sources/no-meta", "no meta.yml")}


def test_log_of_checks(spark, kb):
    r = base.load(spark, str(kb.root))
    found = {x["id"]: (x["verdict"], x["checked"][:10]) for x in L.last_verdict(r.log).collect() if x["id"]}
    assert found == {"src-crlf": ("same", "2024-01-03"), "src-pdf": ("same-text", "2024-01-04"), "src-bad": ("unreachable", "2024-01-03")}
    assert {x["id"]: x["streak"] for x in L.unreachable_streak(r.log).collect() if x["id"]} == {"src-bad": 1}
    assert [x["id"] for x in L.drift_worklist(r, "2024-01-31").collect()] == ["src-part", "src-bad", "src-crlf", "src-pdf"]
    assert lint.l23(r).count() == 0
    assert L.captures_since(r.log).collect() == [("drift-check", 0)]


def test_edges_of_a_base(spark, kb):
    r = base.load(spark, str(kb.root))
    edges = {(x["relation"], x["source"], x["target"]) for x in G.edges(r).collect()}
    assert ("from_repo", "src-part", "src-whole") in edges and ("excerpt_of", "src-part", "src-crlf") in edges and ("from_repo", "src-whole", "src-part") not in edges
    assert ("see_also", "sum-a", "src-pdf") in edges
    assert {(x["source"], x["target"]) for x in G.dangling(r).collect()} == {("gone", "view")}
    assert {x["system"] for x in L.uncovered_systems(r).collect()} == {"repo"}
    assert [(x["id"], x["days_old"]) for x in L.aged(r, "2024-01-31").collect()] == [("sum-a", 61)]


def test_index_says_what_heads_say(spark, kb):
    r = base.load(spark, str(kb.root))
    lines = {json.loads(x["line"])["id"]: x["line"] for x in P.index_records(r).collect()}
    pdf = json.loads(lines["src-pdf"])["content_hash"]
    assert lines["sum-a"] == (
        '{"as_of":"2023-12-01","id":"sum-a","kind":"derived","path":"summaries/s.md","provenance":[{"hash":"' + pdf + '","id":"src-pdf"},'
        '{"hash":null,"id":"src-crlf"}],"status":"current","tags":["green","grey"],"title":"About","type":"summary"}'
    )
    assert lines["dec"] == '{"evidence":["src-pdf","src-crlf"],"id":"dec","kind":"decision","path":"decisions/d.md","status":"accepted","title":"D","type":"decision"}'
    assert '"origin":{"ref":"r/x#a.md","system":"repo","upstream_ref":"http://src-crlf"},"path":"sources/src-part/source.md","tier":"full","version":1}' in lines["src-part"]


def rows(df):
    return sorted(str(r) for r in df.collect())


def same(a, b):
    for name in ("sources", "derived", "provenance", "projects", "members", "decisions", "evidence", "versions", "files", "log"):
        assert rows(getattr(a, name)) == rows(getattr(b, name)), name


def test_snapshot_parses_what_changed(spark, kb, tmp_path):
    root, store = str(kb.root), f"{tmp_path}/store"
    first = snapshot.refresh(spark, root, store)
    assert first == {"status": "refreshed", "parsed": 11, "gone": 0, "docs": 11}
    assert snapshot.refresh(spark, root, store) == {"status": "current", "parsed": 0, "gone": 0, "docs": 11}
    same(snapshot.load(spark, root, store), base.load(spark, root))
    kb.doc("summaries/s.md", id="sum-a", type="summary", title="Anew", status="current")
    assert snapshot.refresh(spark, root, store) == {"status": "refreshed", "parsed": 1, "gone": 0, "docs": 11}
    os.remove(kb.root / "decisions/d.md")
    kb.doc("insights/i.md", id="ins", type="insight", title="I")
    kb.doc("insights/j.md", id="jns", type="insight", title="J")
    assert snapshot.refresh(spark, root, store) == {"status": "refreshed", "parsed": 2, "gone": 1, "docs": 12}
    os.remove(kb.root / "insights/j.md")
    assert snapshot.refresh(spark, root, store) == {"status": "refreshed", "parsed": 0, "gone": 1, "docs": 11}
    same(base.load(spark, root, snapshot.entries(spark, store)), base.load(spark, root))


def test_snapshot_opens_no_unchanged_file(spark, kb, tmp_path):
    """The second reading leaves files of other times closed: they may even be gone from under it."""
    root, store = str(kb.root), f"{tmp_path}/store"
    old = kb.root / "entities/e.md"
    os.utime(old, (1_600_000_000, 1_600_000_000))
    snapshot.refresh(spark, root, store)
    kb.doc("summaries/s.md", id="sum-a", type="summary", title="Anew once more")
    os.chmod(old, 0)
    assert snapshot.refresh(spark, root, store)["parsed"] == 1
    plan = base.carriers(spark, root).drop("content")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_snapshot_compacts_and_keeps_one_writer(spark, kb, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "KEPT", 2)
    root, store = str(kb.root), f"{tmp_path}/store"
    for k in range(5):
        kb.doc("insights/i.md", id="ins", type="insight", title="I" * (k + 1))
        snapshot.refresh(spark, root, store)
    number, names = storage.generations(spark, store)
    assert number == 5 and len(names) <= 3 and len([f for f in storage.folders(spark, store) if f.startswith("generation")]) <= 6
    same(base.load(spark, root, snapshot.entries(spark, store)), base.load(spark, root))
    # another writer has published the next head meanwhile
    monkeypatch.setattr(storage, "generations", lambda *_: (number - 1, names))
    kb.doc("insights/i.md", id="ins", type="insight", title="late")
    with pytest.raises(storage.Conflict):
        snapshot.refresh(spark, root, store)


def test_nothing_there(spark, tmp_path):
    empty = base.load(spark, f"{tmp_path}/nothing")
    assert empty.sources.count() == empty.provenance.count() == empty.files.count() == 0
    assert snapshot.refresh(spark, f"{tmp_path}/nothing", f"{tmp_path}/store") == {"status": "current", "parsed": 0, "gone": 0, "docs": 0}


def test_publish_replaces_or_refuses(spark, tmp_path):
    at = f"{tmp_path}/f"
    storage.publish(spark, at, "one")
    with pytest.raises(storage.Conflict):
        storage.publish(spark, at, "two")
    storage.publish(spark, at, "twö", replace=True)
    assert storage.read(spark, at) == "twö" and storage.folders(spark, str(tmp_path)) == [x for x in storage.folders(spark, str(tmp_path)) if not x.endswith(".tmp")]
