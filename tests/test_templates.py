"""Workbooks filled into a template."""

import io
import zipfile
from xml.etree import ElementTree

from tessera.sources import templates, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def styled():
    """A workbook with styles, a formula, a column width, a foreign namespace and a part of another kind."""
    plain = workbooks.xlsx_bytes([("A", 1, 1, "head"), ("A", 3, 2, "old"), ("B", 1, 1, "b")])
    sheet = (
        f'<worksheet xmlns="{MAIN}" xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="x14ac">'
        '<cols><col min="1" max="1" width="40"/></cols><sheetData><row r="1" x14ac:dyDescent="0.2"><c r="A1" s="3" t="inlineStr"><is><t>head</t></is></c><c r="C1" s="4"><f>SUM(A5:B5)</f><v>0</v></c></row>'
        '<row r="3"><c r="B3" s="5" t="inlineStr"><is><t>old</t></is></c></row></sheetData><mergeCells count="1"><mergeCell ref="A7:B7"/></mergeCells></worksheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(out, "w") as made:
        for name in z.namelist():
            content = z.read(name)
            if name.endswith("sheet1.xml"):
                content = sheet.encode()
            if name == "xl/workbook.xml":
                content = content.replace(b"</workbook>", b'<calcPr calcId="1"/></workbook>')
            made.writestr(name, content)
        made.writestr("xl/styles.xml", "<styleSheet/>")
        made.writestr("xl/media/logo.png", b"\x89PNG")
    return out.getvalue()


def parts(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_what_is_not_filled_stays(spark):
    template = styled()
    got = parts(templates.filled(template, [("A", 3, 2, "1.5"), ("A", 5, 1, "a <b>"), ("A", 2, 3, "between"), ("A", 1, 2, "7")]))
    before = parts(template)
    assert got.keys() == before.keys() and all(got[n] == before[n] for n in ("xl/styles.xml", "xl/media/logo.png", "xl/worksheets/sheet2.xml", "[Content_Types].xml"))
    assert b'fullCalcOnLoad="1"' in got["xl/workbook.xml"] and b'mc:Ignorable="x14ac"' in got["xl/worksheets/sheet1.xml"] and b"xmlns:x14ac" in got["xl/worksheets/sheet1.xml"]
    sheet = ElementTree.fromstring(got["xl/worksheets/sheet1.xml"])
    cells = {c.get("r"): c for c in sheet.iter(f"{{{MAIN}}}c")}
    assert [r.get("r") for r in sheet.iter(f"{{{MAIN}}}row")] == ["1", "2", "3", "5"] and list(cells) == ["A1", "B1", "C1", "C2", "B3", "A5"]
    assert cells["B3"].get("s") == "5" and cells["B3"].find(f"{{{MAIN}}}v").text == "1.5" and cells["C1"].find(f"{{{MAIN}}}f").text == "SUM(A5:B5)"
    assert sheet.find(f"{{{MAIN}}}mergeCells") is not None and sheet.find(f"{{{MAIN}}}cols") is not None
    assert {(c["row"], c["col"]): c["value"] for c in workbooks.cells_of(templates.filled(template, [("A", 1, 3, "4")]))}[1, 3] == "4"


def test_one_workbook_a_book(spark):
    rows = [("p", "A", 5, 1, "x"), ("p", "A", 5, 1, "y"), ("p", "A", None, 1, "z"), ("p", None, 1, 1, "z"), ("q", "none", 1, 1, "x"), ("r", "A", 3, 2, None), (None, "B", 9, 9, "n")]
    grid = spark.createDataFrame(rows, "book string, sheet string, row int, col int, value string")
    got = {r.book: r for r in templates.fill_template(grid, styled()).collect()}
    assert got.keys() == {"p", "q", "r", None} and got["q"].content is None and "no sheet none" in got["q"].error
    held = {b: {(c["sheet"], c["row"], c["col"]): c["value"] for c in workbooks.cells_of(bytes(got[b].content))} for b in ("p", "r", None)}
    assert held["p"]["A", 5, 1] == "y" and ("A", 3, 2) not in held["r"] and held[None]["B", 9, 9] == "n"
    assert templates.fill_template(grid.limit(0), styled()).count() == 0


def test_the_quote_template(spark):
    cells = workbooks.cells_of(templates.quote_template())
    assert [*dict.fromkeys(c["sheet"] for c in cells)] == list(templates.SHEETS) and len(cells) == len(templates.template_cells())
