"""Office files made by hand, and quotations looked for together."""

import io
import zipfile

from attesta.operators import reading as R
from attesta.sources import extract, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
L = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_documents():
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{''.join(map(paragraph, text.split('/')))}</w:tc>"
    body = (
        "<w:p><w:pPr><w:tabs><w:other/></w:tabs></w:pPr><w:r><w:t>One &amp; </w:t><w:t>two</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
        f"<w:tbl><w:tr>{cell('a')}{cell('b/c')}</w:tr><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}</w:tr>"
        f"<w:tr>{cell('tall', '<w:vMerge w:val=\"restart\"/>')}{cell('1')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('2')}</w:tr></w:tbl>{paragraph('last ü')}"
    )
    raw = packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    assert office.docx(raw) == "One & two\tx\nylink\nlast ü\na\tb\nc\nwide\twide\ntall\t1\ntall\t2"


def workbook(sheets, strings=(), formats="", xfs="", settings=""):
    files = {
        "xl/workbook.xml": f"<workbook {M} {L}><workbookPr {settings}/><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>",
        "xl/sharedStrings.xml": f"<sst {M}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>",
        "xl/styles.xml": f"<styleSheet {M}><numFmts>{formats}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>",
    }
    for k, xml in enumerate(sheets.values()):
        files[f"xl/worksheets/s{k}.xml"] = f"<worksheet {M}>{xml}</worksheet>"
    return packed(files)


def test_workbooks():
    data = (
        '<dimension ref="A1:D4"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>in|line</t></is></c></row>'
        '<row r="2"><c r="A2"><v>5</v></c><c r="B2" s="1"><v>45293</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="str"><f>A2&amp;"x"</f><v>5x</v></c></row>'
        '<row r="4"><c r="A4"><v>-2.50</v></c><c r="B4" s="2"><v>45294.25</v></c><c r="C4" t="e"><v>#DIV/0!</v></c><c r="D4" s="3"><v>7</v></c></row></sheetData>'
    )
    raw = workbook(
        {"Data": data, "Empty": "<sheetData/>"}, ["<t>name</t>", "<r><t>two\n</t></r><r><t>runs</t></r><rPh><t>no</t></rPh>"],
        '<numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/>',
        '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/>',
    )
    assert office.xlsx(raw) == (
        "## Data\n\n*(sheet facts: 4 rows x 4 cols; 2 date cells spanning 2024-01-02..2024-01-03; 3 numeric cells in [-2.5, 7])*\n\n"
        "| name | two runs | in\\|line |  |\n|---|---|---|---|\n| 5 | 2024-01-02 00:00:00 | True | 5x |\n|  |  |  |  |\n| -2.5 | 2024-01-03 06:00:00 | #DIV/0! | 7 |\n\n"
        "## Empty\n\n*(sheet facts: 0 rows x 0 cols)*\n\n*(empty sheet)*\n\n*(values as last calculated, not formulas)*"
    )
    old = workbook({"S": '<sheetData><row><c s="0"><v>1</v></c></row></sheetData>'}, xfs='<xf numFmtId="14"/>', settings='date1904="1"')
    assert "| 1904-01-02 00:00:00 |" in office.xlsx(old)


def test_facts_cover_rows_that_are_not_shown():
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, 701))
    text = office.xlsx(workbook({"Long": f'<dimension ref="A1:A700"/><sheetData>{rows}</sheetData>'}))
    assert "700 numeric cells in [1, 700]" in text and "*(first 500 of 700 rows: the file itself holds the rest)*" in text and "\n| 500 |" in text and "\n| 501 |" not in text


def test_formats_that_show_dates():
    yes = ["yyyy-mm-dd", "h:mm", "[h]:mm", "d/m", "mm:ss.0"]
    no = ["General", "0.00", '0 "days"', "[Red]0", "#,##0\\d", "0%"]
    assert all(map(office.shows_date, yes)) and not any(map(office.shows_date, no))


def test_office_files_in_spark(spark):
    word = packed({"word/document.xml": f"<w:document {W}><w:body>{paragraph('hello')}</w:body></w:document>"})
    rows = [("a.DOCX", bytearray(word)), ("b.xlsx", bytearray(workbook({"S": "<sheetData/>"}))), ("c.docx", bytearray(b"no zip")), ("d.xlsm", None)]
    found = {r["path"]: r["text"] for r in extract.extracted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found["a.DOCX"] == "hello" and found["b.xlsx"].startswith("## S\n") and found["c.docx"] is None and found["d.xlsm"] is None


def test_many_quotations_of_one_source(spark, monkeypatch):
    """A source that many drafts cite: its text is looked through once a few quotations, not once each."""
    monkeypatch.setattr(R, "PATTERNS", 50)
    words = [f"word{k} and word{k + 1} again" for k in range(300)]
    source = " ".join(w for k, w in enumerate(words) if k % 3)
    drafts = spark.createDataFrame([(f"d{k}", f'It says "{w}" and "and word1 again word2" [src-a] [src-b]') for k, w in enumerate(words)], "id string, text string")
    prov = spark.createDataFrame([(f"d{k}", s) for k in range(300) for s in ("src-a", "src-b", "src-c")], "doc_id string, source_id string")
    sources = spark.createDataFrame([("src-a", source), ("src-b", None), ("src-c", words[0])], "id string, text string")
    got = {(r["id"], r["span"]): r["ok"] for r in R.quote_gate(drafts, prov, sources).collect()}
    assert got == {(f"d{k}", s): s in source for k, w in enumerate(words) for s in (w, "and word1 again word2")} and len({*got.values()}) == 2
