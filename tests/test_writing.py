"""Bases that are written to: load, write, load again."""

import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from attesta.operators import lint
from attesta.operators import writing as W
from attesta.sources import base, storage
from tests.test_base import Kb, digest

NOW = "2024-02-01T00:00:00Z"
DRAFT = (
    "id string, type string, title string, abstract string, body string, sources array<string>, derivation string, as_of string, see_also array<string>, "
    "connectors array<struct<system:string,ref:string>>, tags array<string>"
)
BATCH = "seq int, id string, system string, ref string, filename string, text string, tier string, reason string"


@pytest.fixture
def kb(spark, tmp_path):
    own = Kb(tmp_path / "kb")
    base.scaffold(spark, str(own.root), "my base")
    return own


def capture(spark, kb, *rows, **options):
    found = W.capture(spark, str(kb.root), spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], BATCH), NOW, **options)
    return [(r["action"], r["target"], r["version"]) for r in sorted(found.collect(), key=lambda r: r["seq"])]


def draft(spark, kb, *rows):
    full = [(r.get("id"), r.get("type", "summary"), r.get("title", "T"), r.get("abstract"), r.get("body", "b"), r.get("sources", ["src-a"]), r.get("derivation"), r.get("as_of"), r.get("see_also"), None, r.get("tags")) for r in rows]
    return {r["id"]: r["outcome"] for r in W.derive(spark, str(kb.root), spark.createDataFrame(full, DRAFT), NOW).collect()}


def head(kb, path):
    text = (kb.root / path).read_text()
    return yaml.safe_load(text.split("---\n")[1]), text.split("---\n", 2)[2]


def files(kb):
    return sorted(str(p.relative_to(kb.root)) for p in kb.root.rglob("*") if p.is_file() and "queue" not in str(p))


def test_a_base_from_nothing(spark, kb):
    """Capture, derive, link, close, show: what is written is read again, and nothing is found wrong with it."""
    web = lambda i, text, ref=None, name="a.md", tier=None, reason=None: (i, "web", ref or f"http://{i}", name, text, tier, reason)
    done = capture(
        spark, kb, web("src-a", "first words of it\n"), web("src-b", "no line end", name="B.TXT"), web("src-a", "second words\r\nof it\r\n"), web("src-c", "no line end"),
        web("src-d", "x", ref="http://src-a"), web("Bad", "x"), web("src-e", "%PDF", name="e.pdf"), web("src-f", "y", tier="reference"), web("src-g", "seen", tier="reference", reason="licence"),
    )
    assert done == [("created", None, 1), ("created", None, 1), ("versioned", "src-a", 2), ("deduped", "src-b", None), ("refused", "src-a", None),
                    ("refused", "bad id", None), ("refused", "no text format", None), ("refused", "no reason", None), ("created", None, 1)]
    assert (kb.root / "sources/src-a/source.md").read_bytes() == b"second words\r\nof it\r\n" and (kb.root / "sources/src-a/source.v1.md").read_text() == "first words of it\n"
    assert (kb.root / "sources/src-b/source.txt").read_bytes() == b"no line end"
    # a later batch: the bytes that lay there are kept under their version
    assert capture(spark, kb, web("src-a", "third\n"), web("src-a", "fourth\n")) == [("versioned", "src-a", 3), ("versioned", "src-a", 4)]
    meta = yaml.safe_load((kb.root / "sources/src-a/meta.yml").read_text())
    assert [(e["version"], e["file"], e["supersedes"] if "supersedes" in e else None) for e in meta["history"]] == [(1, "source.v1.md", None), (2, "source.v2.md", 1), (3, "source.v3.md", 2), (4, "source.md", 3)]
    assert (kb.root / "sources/src-a/source.v2.md").read_bytes() == b"second words\r\nof it\r\n" and meta["content_hash"] == digest("fourth\n") and meta["version"] == 4
    got = draft(
        spark, kb, {"id": "sum-a", "body": "It says [src-a] and [nobody].\n", "abstract": "Short – ü", "tags": ["x"], "see_also": ["sum-b"]}, {"id": "sum-b", "sources": ["src-b", "src-g"]},
        {"id": "ins", "type": "insight", "body": 'He wrote "exactly no line end" [src-b]', "sources": ["src-b"]}, {"id": "ins-2", "type": "insight", "body": 'He wrote "entirely other words" [src-b]', "sources": ["src-b"]},
        {"id": "no-src", "sources": ["src-z"]}, {"id": "none", "sources": []}, {"id": "odd", "type": "essay"}, {"id": "no-title", "title": ""}, {"id": "A!"}, {"id": "rung", "derivation": "guess"},
    )
    assert got == {"sum-a": "derived", "sum-b": "derived", "ins": "misquotes", "ins-2": "misquotes", "no-src": "unknown source", "none": "no sources", "odd": "unknown type",
                   "no-title": "no title", "A!": "bad id", "rung": "unknown derivation"}
    own, body = head(kb, "summaries/sum-a.md")
    assert own["sources"] == [{"id": "src-a", "hash": digest("fourth\n")}] and own["abstract"] == "Short – ü" and own["tags"] == ["x"] and body == "It says [src-a] and [nobody].\n"
    assert list(own)[:4] == ["id", "type", "title", "authored_by"] and "as_of" not in own
    # a field that this engine doesn't know stays
    text = (kb.root / "summaries/sum-a.md").read_text().replace("status: current", "custom: {deep: [1, 2]}\nstatus: current")
    kb.put("summaries/sum-a.md", text)
    assert W.relink(spark, str(kb.root)) == 1
    own, body = head(kb, "summaries/sum-a.md")
    assert body == "It says [src-a](../sources/src-a/source.md) and [nobody].\n" and own["custom"] == {"deep": [1, 2]}
    assert W.relink(spark, str(kb.root)) == 0
    change = lambda *rows: {r["id"]: r["outcome"] for r in W.supersede(spark, str(kb.root), spark.createDataFrame(list(rows), "id string, by string, reason string, lift boolean"), NOW).collect()}
    assert change(("sum-b", "sum-a", "merged", None), ("sum-a", "sum-a", None, None), ("nobody", "sum-a", None, None), ("src-a", "sum-a", None, None)) == {
        "sum-b": "superseded", "sum-a": "itself", "nobody": "unknown document", "src-a": "unknown document",
    }
    assert change(("sum-b", "sum-a", "merged", None)) == {"sum-b": "unchanged"} and draft(spark, kb, {"id": "sum-b", "sources": ["src-b"]}) == {"sum-b": "superseded"}
    own, _ = head(kb, "summaries/sum-b.md")
    assert (own["status"], own["superseded_by"], own["superseded_at"], own["supersede_reason"]) == ("superseded", "sum-a", NOW, "merged")
    assert change(("sum-b", None, None, True)) == {"sum-b": "lifted"} and not {"superseded_by", "superseded_at", "supersede_reason"} & set(head(kb, "summaries/sum-b.md")[0])
    assert change(("sum-b", None, "over", False)) == {"sum-b": "superseded"}
    view = lambda *rows: {r["id"]: r["outcome"] for r in W.project(spark, str(kb.root), spark.createDataFrame(list(rows), "id string, title string, scope string, description string, add array<string>, remove array<string>"), NOW).collect()}
    assert view(("view", "My view", "global", "About it.", ["src-b", "src-a", "sum-a"], None), ("bare", None, None, None, None, None), ("far", "T", "universe", None, None, None)) == {"view": "written", "bare": "no title", "far": "unknown scope"}
    assert view(("view", None, None, None, ["src-g"], ["src-a"])) == {"view": "written"}
    own, body = head(kb, "projects/view.md")
    assert own == {"id": "view", "type": "project", "title": "My view", "description": "About it.", "members": ["src-b", "sum-a", "src-g"], "scope": "global"}
    assert body == "About it.\n\n## Members\n\n- [src-b] — T\n- [sum-a] — T — Short – ü\n- [src-g] — T\n"
    # nothing is wrong with what was written but that sum-b's ending has no summary of src-b and src-g beside it
    r = base.load(spark, str(kb.root))
    assert {(x["rule"], x["id"]) for x in lint.findings(r, lint.documents(r)).collect()} == set()
    assert lint.l19(base.documents(base.entries(spark, str(kb.root)), *base.FOLDERS)).count() == 0
    verbs = [line.split("] ")[1].split(" | ")[0] for line in (kb.root / "log.md").read_text().splitlines()[1:]]
    assert verbs == ["capture"] * 5 + ["capture"] * 2 + ["derive"] * 2 + ["supersede"] * 3 + ["project"] * 2
    assert W.index(spark, str(kb.root)) == {"documents": 6} and W.stale_index(spark, str(kb.root)).count() == 0
    assert (kb.root / "index.md").read_text() == (
        "# Index\n\n## Sources\n- [src-a](sources/src-a/source.md) — T — http://src-a\n- [src-b](sources/src-b/source.txt) — T — http://src-b\n"
        "- [src-g](sources/src-g/source.md) — T — http://src-g · reference\n\n## Summaries\n- [sum-a](summaries/sum-a.md) — T — Short – ü  · extracted · 1 source\n"
        "- [sum-b](summaries/sum-b.md) — T  · extracted · 2 sources · superseded\n\n## Projects\n- [view](projects/view.md) — My view  · global\n"
    )
    lines = (kb.root / "index.jsonl").read_text().splitlines()
    assert [json.loads(x)["id"] for x in lines] == ["src-a", "src-b", "src-g", "sum-a", "sum-b", "view"] and (kb.root / "llms.txt").read_text().startswith("# my base\n")
    assert lint.l8(lint.documents(r), spark.read.text(f"{kb.root}/index.md").withColumnRenamed("value", "text")).count() == 0
    kb.put("index.jsonl", "\n".join(lines[1:]) + "\n{}\n")
    assert sorted(x["detail"] for x in W.stale_index(spark, str(kb.root)).collect()) == ["missing line", "stale line"]
    assert not [f for f in files(kb) if f.startswith(".") or f.endswith(".crc")]


def test_decisions_folds_and_tasks(spark, kb):
    web = lambda i, text: (i, "web", f"http://{i}", "a.md", text, None, None)
    root = str(kb.root)
    capture(spark, kb, web("src-a", "a\n"), web("src-b", "b\n"))
    decision = "id string, title string, body string, status string, evidence array<string>, amend boolean"
    decide = lambda now, *rows: {r["id"]: r["outcome"] for r in W.decide(spark, root, spark.createDataFrame(list(rows), decision), now).collect()}
    assert decide(NOW, ("dec-1", "D", "why", None, ["src-a"], None), ("dec-2", None, "x", None, None, None), ("dec-3", "D", "x", "maybe", None, None), ("dec-4", "D", "x", None, ["src-z"], None), ("dec-5", "D", "x", None, None, True)) == {
        "dec-1": "recorded", "dec-2": "no title", "dec-3": "unknown status", "dec-4": "unknown evidence", "dec-5": "nothing to amend",
    }
    capture(spark, kb, web("src-a", "a2\n"))
    assert decide("2024-03-01T00:00:00Z", ("dec-1", None, " more ", "proposed", ["src-a", "src-b"], True)) == {"dec-1": "amended"} and decide(NOW, ("dec-1", "D", "x", None, None, None)) == {"dec-1": "there already"}
    own, body = head(kb, "decisions/dec-1.md")
    assert own["evidence"] == [{"id": "src-a", "version": 1}, {"id": "src-b", "version": 1}] and (own["date"], own["status"], own["title"]) == ("2024-02-01", "proposed", "D")
    assert body == "**AMENDED (2024-03-01):** more\n\nwhy\n"
    assert draft(spark, kb, {"id": "sum-a", "body": "base\n", "derivation": "extracted"}) == {"sum-a": "derived"}
    cand = "id string, into string, body string, sources array<string>, derivation string, as_of string"
    rows = [("cand-2", "sum-a", "two\n", ["src-b", "src-a"], "model-read", None), ("cand-1", "sum-a", " one ", ["src-b"], None, None), ("cand-3", "sum-a", "x", [], None, "2024-01-01"), ("cand-4", "nobody", "x", [], None, None), ("cand-5", "sum-a", "x", ["src-z"], None, None)]
    assert {r["id"]: r["outcome"] for r in W.fold(spark, root, spark.createDataFrame(rows, cand), NOW).collect()} == {"cand-1": "folded", "cand-2": "folded", "cand-3": "dated", "cand-4": "unknown document", "cand-5": "unknown source"}
    own, body = head(kb, "summaries/sum-a.md")
    assert body == "base\n\none\n\ntwo\n" and own["derivation"] == "model-read" and [s["id"] for s in own["sources"]] == ["src-a", "src-b"]
    assert lint.l19(base.documents(base.entries(spark, root), *base.FOLDERS)).count() == 0
    tasks = "seq int, type string, outcome string, inputs array<string>, created_by string"
    make = lambda *rows: [(r["id"], r["outcome"]) for r in sorted(W.enqueue(spark, root, spark.createDataFrame(list(rows), tasks), NOW).collect(), key=lambda r: r["seq"])]
    assert make((1, "map", "Do it", [" a ", ""], "me"), (2, "map", "Again", None, None), (3, "odd", "x", None, None), (4, "map", " ", None, None)) == [
        ("task-20240201-000000-map", "created"), ("task-20240201-000000-map-2", "created"), (None, "unknown type"), (None, "no outcome"),
    ]
    assert make((1, "map", "Third", None, None), (2, "ask", "Q", None, None)) == [("task-20240201-000000-map-3", "created"), ("task-20240201-000000-ask", "created")]
    read = {t["id"]: (t["status"], t["inputs"], t["created_by"]) for t in base.tasks(spark, root).collect()}
    assert read["task-20240201-000000-map"] == ("pending", ["a"], "me") and len(read) == 4
    assert W.passed(spark, root, "challenge", NOW, "sum-a", "weakened", detail="d") == "challenge | sum-a: weakened | d"
    assert W.passed(spark, root, "map", NOW, counts={"concepts": 2}) == "map | scope=base entities=0 concepts=2 questions=0"
    for wrong in (("review", "perfect"), ("challenge", "clean")):
        with pytest.raises(ValueError):
            W.passed(spark, root, wrong[0], NOW, "t", wrong[1])


def test_lost_drivers_leave_no_half_document(spark, kb, monkeypatch):
    root = str(kb.root)
    rows = spark.createDataFrame([("summaries/a.md", "one\n"), ("summaries/b.md", "two"), ("sources/s/meta.yml", "id: s\n"), ("sources/s/source.md", "held")], "path string, text string")
    moved = []

    def dies(spark, a, b, own=storage.move):
        if "/ready" not in b and len(moved) == 2:
            raise RuntimeError("the driver is gone")
        moved.append(b)
        own(spark, a, b)

    # before the marker: a task fails, everything is dropped
    boom = F.udf(lambda t: 1 // (t != "two") and t, "string")
    with pytest.raises(Exception):
        W.write(spark, root, rows.withColumn("text", boom("text")))
    assert files(kb) == ["base.yml"] or all(f.startswith(".staging") for f in files(kb) if f != "base.yml")
    assert W.resume(spark, root)["placed"] == 0 and files(kb) == ["base.yml"]
    os.makedirs(kb.root / ".staging-lost/files/path=summaries%2Fa.md")
    assert W.resume(spark, root) == {"placed": 0, "dropped": 1} and files(kb) == ["base.yml"]
    # after it: part of the files is in place, the rest follows
    monkeypatch.setattr(storage, "move", dies)
    with pytest.raises(RuntimeError):
        W.write(spark, root, rows)
    monkeypatch.undo()
    assert not os.path.exists(kb.root / "sources/s/meta.yml")
    assert W.resume(spark, root) == {"placed": 1, "dropped": 0}
    assert files(kb) == ["base.yml", "sources/s/meta.yml", "sources/s/source.md", "summaries/a.md", "summaries/b.md"]
    assert (kb.root / "summaries/b.md").read_text() == "two" and (kb.root / "sources/s/source.md").read_text() == "held"
    assert W.resume(spark, root) == {"placed": 0, "dropped": 0}


def test_read_only_sessions_write_nothing(spark, kb):
    spark.conf.set("attesta.read_only", "true")
    try:
        for run in (W.stamp, W.relink, W.index):
            with pytest.raises(ValueError, match="read-only"):
                run(spark, str(kb.root))
        with pytest.raises(ValueError, match="read-only"):
            draft(spark, kb, {"id": "sum-a"})
    finally:
        spark.conf.unset("attesta.read_only")
    assert files(kb) == ["base.yml"]


def test_an_empty_base_and_empty_batches(spark, kb):
    assert W.index(spark, str(kb.root)) == {"documents": 0} and (kb.root / "index.md").read_text() == "# Index\n" and (kb.root / "index.jsonl").read_text() == ""
    assert capture(spark, kb) == [] and draft(spark, kb) == {} and W.stamp(spark, str(kb.root)) == 0 and W.relink(spark, str(kb.root)) == 0
