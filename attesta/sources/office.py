"""Text of office files: both formats are zip archives of XML, read as a stream with the standard library.

A document's paragraphs come first, then its tables, a row a line and cells by tabs; merged cells say what they say in
each place. A workbook is a heading a sheet, one line of facts over all of its cells, and a table of its first rows
that says where it stops. Values are those that were last calculated, never formulas.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

#: Rows of a sheet that are shown.
SHOWN = 500
#: Number formats of the format's own list that show dates or times.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def bare(tag: str) -> str:
    """An element's name without its namespace: strict and transitional files differ in that alone."""
    return tag.rpartition("}")[2]


def said(node: ElementTree.Element) -> str:
    """Text of a paragraph: runs, with tabs and breaks."""
    signs = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    out = []
    for x in node.iter():
        name = bare(x.tag)
        out.append((x.text or "") if name == "t" else signs.get(name, ""))
    return "".join(out)


def children(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node if bare(x.tag) == name)


def attribute(node: ElementTree.Element | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if bare(k) == name), None)


def table(node: ElementTree.Element) -> list[str]:
    """A table's rows, cells by tabs: a cell over several columns stands in each, one over several rows in each row."""
    lines: list[str] = []
    above: list[str] = []
    for row in children(node, "tr"):
        cells: list[str] = []
        for cell in children(row, "tc"):
            text = "\n".join(map(said, children(cell, "p")))
            own = {bare(x.tag): x for p in children(cell, "tcPr") for x in p}
            if "vMerge" in own and attribute(own["vMerge"], "val") != "restart" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * int(attribute(own.get("gridSpan"), "val") or 1)
        lines.append("\t".join(cells))
        above = cells
    return lines


def docx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next(children(root, "body"))
    lines = [said(p) for p in children(body, "p")]
    for t in children(body, "tbl"):
        lines += table(t)
    return "\n".join(lines)


def shows_date(code: str) -> bool:
    """Whether a number format shows a date or time: signs of them outside quotations, colours and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[(?![hms]+\])[^\]]*\]|\\.|_.', "", code.lower()))) and code.lower() != "general"


class Workbook:
    """Sheets of a workbook and what their cells refer to."""

    def __init__(self, z: zipfile.ZipFile) -> None:
        self.z, names = z, set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = []
        for s in (x for g in children(book, "sheets") for x in g):
            target = rels.get(attribute(s, "id")) or ""
            self.sheets.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        settings = next(children(book, "workbookPr"), None)
        self.epoch = datetime(1904, 1, 1) if attribute(settings, "date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                # readings of signs are no part of the text
                self.strings.append("".join(t.text or "" for r in si for t in ([r] if bare(r.tag) == "t" else children(r, "t") if bare(r.tag) == "r" else [])))
        self.dated: list[bool] = []
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") or "" for g in children(root, "numFmts") for f in g}
            for xf in (x for g in children(root, "cellXfs") for x in g):
                k = int(xf.get("numFmtId") or 0)
                self.dated.append(shows_date(own[k]) if k in own else k in DATES)

    def value(self, c: ElementTree.Element) -> object:
        kind, v = c.get("t") or "n", next(children(c, "v"), None)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if bare(t.tag) == "t")
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind == "d":
            return datetime.fromisoformat(v.text.removesuffix("Z"))
        if kind != "n":
            return v.text
        style = int(c.get("s") or 0)
        if style < len(self.dated) and self.dated[style]:
            at = self.epoch + timedelta(microseconds=round(float(v.text) * 86_400_000) * 1000)
            return at.time() if 0 <= float(v.text) < 1 else at
        return float(v.text) if re.search("[.eE]", v.text) else int(v.text)

    def rows(self, path: str) -> Iterator[tuple[int, dict[int, object]]]:
        """(row, {column: value}) of a sheet, both from 1, as they stand in the file; (0, size) first if the sheet says it."""
        at = 0
        with self.z.open(path) as f:
            for _, node in ElementTree.iterparse(f):
                name = bare(node.tag)
                if name == "dimension":
                    end = (node.get("ref") or "").rpartition(":")[2]
                    yield 0, {0: place(end)}
                elif name == "row":
                    at, cells, k = int(node.get("r") or at + 1), {}, 0
                    for c in children(node, "c"):
                        k = place(c.get("r"))[1] if c.get("r") else k + 1
                        cells[k] = self.value(c)
                    yield at, cells
                    node.clear()


def place(name: str) -> tuple[int, int]:
    """Row and column of a cell's name."""
    letters, digits = re.fullmatch(r"([A-Z]*)(\d*)", name.upper()).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(digits or 0), column


def cell(value: object) -> str:
    return "" if value is None else re.sub(r"[\n\r]", " ", str(value).replace("|", "\\|"))


def sheet(book: Workbook, name: str, path: str) -> list[str]:
    rows = columns = n_days = n_numbers = last = 0
    days: list[date] = []
    numbers: list[float] = []
    grid: list[dict[int, object]] = []
    for at, cells in book.rows(path):
        if at == 0:
            rows, columns = cells[0]
            continue
        while last + 1 < at and len(grid) < SHOWN:
            grid.append({})
            last += 1
        last = at
        if len(grid) < SHOWN:
            grid.append(cells)
        rows, columns = max(rows, at), max([columns, *cells])
        for v in cells.values():
            if isinstance(v, datetime):
                n_days += 1
                days = [min([*days, v.date()]), max([*days, v.date()])]
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                n_numbers += 1
                numbers = [min([*numbers, v]), max([*numbers, v])]
    facts = [f"{rows} rows x {columns} cols"]
    facts += [f"{n_days} date cells spanning {days[0].isoformat()}..{days[1].isoformat()}"] if days else []
    facts += [f"{n_numbers} numeric cells in [{numbers[0]:g}, {numbers[1]:g}]"] if numbers else []
    out = [f"## {name}", "", "*(sheet facts: " + "; ".join(facts) + ")*", ""]
    if not grid:
        return [*out, "*(empty sheet)*", ""]
    line = lambda cells: "| " + " | ".join(cell(cells.get(k)) for k in range(1, columns + 1)) + " |"
    out += [line(grid[0]), "|" + "---|" * columns, *map(line, grid[1:])]
    if last > len(grid):
        out += ["", f"*(first {len(grid)} of {rows} rows: the file itself holds the rest)*"]
    return [*out, ""]


def xlsx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        book = Workbook(z)
        lines = [line for name, path in book.sheets if "worksheet" in path for line in sheet(book, name, path)]
    return "\n".join([*lines, "*(values as last calculated, not formulas)*"])
