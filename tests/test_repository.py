"""A small repository's constitution, and what a base holds of it."""

import hashlib

from attesta.operators import project as P
from attesta.operators import writing as W
from attesta.sources import base, repository
from tests.test_base import Kb

sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()


def make(root):
    kb = Kb(root)
    for path, text in {
        "README.md": "# Hi\r\nthere\n", "docs/adr/0002.md": "two\n", "docs/adr/0001.md": "one", "docs/decisions/z.md": "z", ".github/CODEOWNERS": "* @a\n", "pyproject.toml": "[x]\n",
        "svc/Chart.yaml": "c: 1\n", "main.tf": "t", "src/deep/README.md": "no", "node_modules/x.json": "{}", "LICENSE": "l",
    }.items():
        kb.put(path, text)
    return kb


def test_constitution(spark, tmp_path):
    repo = make(tmp_path / "r")
    own = {r["label"]: r for r in repository.surfaces(spark, str(repo.root), [("law", ["LICENSE"]), ("nothing", ["*.none"])]).collect()}
    assert own["readme"]["content"] == "<!-- file: README.md -->\n# Hi\nthere\n" and own["readme"]["hash"] == sha(own["readme"]["content"])
    assert own["adrs"]["paths"] == ["docs/decisions/z.md", "docs/adr/0001.md", "docs/adr/0002.md"]
    assert own["adrs"]["content"] == "<!-- file: docs/decisions/z.md -->\nz\n<!-- file: docs/adr/0001.md -->\none\n<!-- file: docs/adr/0002.md -->\ntwo\n"
    assert own["manifest"]["paths"] == ["pyproject.toml", ".github/CODEOWNERS"] and own["deploy"]["paths"] == ["svc/Chart.yaml", "main.tf"]
    assert own["topology"]["content"] == ".github/\nLICENSE\nREADME.md\ndocs/\nmain.tf\npyproject.toml\nsrc/\nsvc/\n"
    assert [r["label"] for r in sorted(own.values(), key=lambda r: r["place"])] == ["readme", "adrs", "manifest", "deploy", "law", "topology"]
    # what happens inside changes nothing, what a surface says changes that surface alone
    repo.put("src/deep/more.py", "x")
    repo.put("README.md", "# Ho\n")
    now = {r["label"]: r["hash"] for r in repository.surfaces(spark, str(repo.root)).collect()}
    assert {k for k in now if now[k] != own[k]["hash"]} == {"readme"}
    (tmp_path / "bare").mkdir()
    assert [(r["label"], r["content"]) for r in repository.surfaces(spark, str(tmp_path / "bare")).collect()] == [("topology", "\n")]


def test_captured_and_read_back(spark, tmp_path):
    repo, kb = make(tmp_path / "r"), Kb(tmp_path / "kb")
    base.scaffold(spark, str(kb.root), "x")
    put = lambda *a: W.capture_repo(spark, str(kb.root), "src-r", str(repo.root), "host/r", "2024-02-01T00:00:00Z", *a).first()
    assert put("abc")["action"] == "created"
    text = (kb.root / "sources/src-r/source.md").read_text()
    assert text.startswith("# Repository constitution\n\ninferred-at-commit: abc\nsurfaces: 5\n\n- readme: README.md — sha256:") and "\n---\n\n<!-- ═════ constitution surface: readme ═════ -->\n<!-- file: README.md -->\n# Hi\nthere\n\n" in text
    repo.put("src/other.py", "new")
    assert put("abc")["action"] == "deduped"
    repo.put("README.md", "changed\n")
    assert (put("def")["action"], put("def")["action"]) == ("versioned", "deduped")
    kb.source("src-f", {"source.md": "one"}, origin={"system": "repo", "ref": "host/r#Docs\\adr\\0001.md#x"})
    kb.doc("concepts/c.md", id="c", type="concept", title="C", sources=["src-f"])
    found = {(r["part"], r["id"], r["path"]) for r in P.footprint(base.load(spark, str(kb.root))).collect()}
    assert {x[:2] for x in found if x[0] != "not captured"} == {("constitution", "src-r"), ("covered", "src-f"), ("concept", "c")}
    assert {x[2] for x in found if x[0] == "not captured"} == {"README.md", "docs/decisions/z.md", "docs/adr/0002.md", "pyproject.toml", ".github/CODEOWNERS", "svc/Chart.yaml", "main.tf"}
