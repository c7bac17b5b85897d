"""Workbooks made by filling in a template: what is not filled stays as it is, styles, formulas and parts of other kinds included."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.sources.tables import in_slices
from tessera.sources.workbooks import _LINKS, _MAIN, FIRST_MONTH_COLUMN, column_name, xlsx_bytes

TEMPLATE_BYTES = 8 << 20  # a template goes to every task with the plan
_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?")
# The sheets of a quote, their headings and the labels of the information sheet.
SHEETS = ("How to Use", "Project information", "Manpower", "PM", "BIW", "Interior", "GI", "Test validation", "Chassis", "CAE", "EE", "PS")
INFORMATION = ((6, "Customer 客户"), (7, "Project 项目"), (8, "Quotation No. 报价号"), (10, "Edit by 编辑人"), (12, "Project Start"), (13, "Period (Month) 周期"), (14, "Project End"))
SUMMARY_HEAD, FUNCTION_HEAD = ("Function", "Description", "Total (man-months)"), ("Project Position", "Tariff Level", "Sum")


def template_cells() -> list[tuple[str, int, int, str]]:
    """The cells ``(sheet, row, col, value)`` of an empty quote."""
    out = [("How to Use", 1, 1, "Fill in the sheets behind this one.")]
    months = range(K.MONTH_SLOTS)
    for sheet in SHEETS[1:]:
        if sheet == "Project information":
            out += [(sheet, row, 1, label) for row, label in INFORMATION] + [(sheet, 2, FIRST_MONTH_COLUMN + m, f"Period {m + 1}") for m in months]
        else:
            head = SUMMARY_HEAD if sheet == K.SUMMARY_SHEET else FUNCTION_HEAD
            out += [(sheet, 1, 1, "Manpower Summary" if sheet == K.SUMMARY_SHEET else sheet)] + [(sheet, 2, c, h) for c, h in enumerate(head, 1)]
            if sheet != K.SUMMARY_SHEET:
                out += [(sheet, 2, FIRST_MONTH_COLUMN + m, f"Month {m + 1}") for m in months]
    return out


def _namespaces(xml: bytes) -> None:
    """Prefixes of a part stay as they are when it is written again."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(xml), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)


def _set(cell: ElementTree.Element, value: str | None) -> None:
    """A number, a text or nothing in place of what the cell held; its style stays."""
    for child in list(cell):
        cell.remove(child)
    cell.attrib.pop("t", None)
    if value is None or value == "":
        return
    if _NUMBER.fullmatch(value):
        ElementTree.SubElement(cell, f"{_MAIN}v").text = value
    else:
        cell.set("t", "inlineStr")
        text = ElementTree.SubElement(ElementTree.SubElement(cell, f"{_MAIN}is"), f"{_MAIN}t")
        text.text = value
        text.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _children(parent: ElementTree.Element, number) -> dict[int, ElementTree.Element]:
    """The rows of a sheet or the cells of a row by their numbers."""
    return {number(child.get("r")): child for child in parent}


def _ordered(parent: ElementTree.Element, children: dict[int, ElementTree.Element]) -> None:
    parent[:] = [children[k] for k in sorted(children)]


def _column(name: str) -> int:
    n = 0
    for x in re.match("[A-Z]+", name)[0]:
        n = n * 26 + ord(x) - 64
    return n


def filled(template: bytes, cells: Iterable[tuple[str, int, int, str | None]]) -> bytes:
    """The template with ``cells(sheet, row, col, value)`` set; a sheet that it does not have is an error. Formulas elsewhere are computed
    anew when the file is opened; one whose cell is set goes."""
    by: dict[str, list] = {}
    for sheet, row, col, value in cells:
        by.setdefault(sheet, []).append((row, col, value))
    with zipfile.ZipFile(io.BytesIO(template)) as z:
        parts = {i.filename: z.read(i) for i in z.infolist()}
    target = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(parts["xl/_rels/workbook.xml.rels"])}
    book = ElementTree.fromstring(parts["xl/workbook.xml"])
    paths = {s.get("name"): target[s.get(f"{_LINKS}id")].lstrip("/") for s in book.iter(f"{_MAIN}sheet")}
    if missing := sorted(by.keys() - paths.keys()):
        raise ValueError(f"no sheet {missing[0]}")
    for sheet, values in by.items():
        path = paths[sheet] if paths[sheet].startswith("xl/") else f"xl/{paths[sheet]}"
        _namespaces(parts[path])
        root = ElementTree.fromstring(parts[path])
        data = root.find(f"{_MAIN}sheetData")
        lines, rows = _children(data, int), {}
        for row, col, value in values:
            if row not in rows:
                line = lines.setdefault(row, ElementTree.Element(f"{_MAIN}row", {"r": str(row)}))
                rows[row] = line, _children(line, _column)
            cell = rows[row][1].setdefault(col, ElementTree.Element(f"{_MAIN}c", {"r": f"{column_name(col)}{row}"}))
            _set(cell, value)
        for line, own in rows.values():
            _ordered(line, own)
        _ordered(data, lines)
        parts[path] = ElementTree.tostring(root, "UTF-8", xml_declaration=True)
    _namespaces(parts["xl/workbook.xml"])
    settings = book.find(f"{_MAIN}calcPr")
    if settings is not None:
        settings.set("fullCalcOnLoad", "1")
        parts["xl/workbook.xml"] = ElementTree.tostring(book, "UTF-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


_FILE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def fill_template(grids: DataFrame, template: bytes, book: str = "book") -> DataFrame:
    """``<book>, content, error``: one workbook for each ``book`` of ``grids(<book>, sheet, row, col, value)``. A workbook is one row, so its cells meet in one
    task. Cells without a place are left out, of several values for one the last by its letters counts; what cannot be filled has an error instead."""
    if len(template) > TEMPLATE_BYTES:
        raise ValueError(f"a template has at most {TEMPLATE_BYTES} bytes")

    @F.arrow_udf(_FILE)
    def fill(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in in_slices(batches):
            out = []
            for own in cells.to_pylist():
                try:
                    out.append({"content": filled(template, ((c["sheet"], c["row"], c["col"], c["value"]) for c in own)), "error": None})
                except Exception as e:  # noqa: BLE001  a workbook's fault is a value here
                    out.append({"content": None, "error": f"{type(e).__name__}: {e}"[: K.ERROR_CHARS]})
            yield pa.array(out, pa.struct([("content", pa.binary()), ("error", pa.string())]))

    placed = grids.where("sheet is not null and row >= 1 and col >= 1")
    cell = F.struct("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("string").alias("value"))
    books = placed.groupBy(book).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return books.select(book, fill("cells").alias("x")).select(book, "x.content", "x.error")


def quote_template() -> bytes:
    """An empty quote as a workbook."""
    return xlsx_bytes(template_cells())
