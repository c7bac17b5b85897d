"""Workbooks as long grids ``(sheet, row, col, value)``; a small one can be written as an xlsx file at the edge."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.functions.values import compact_milestones, project_end, row_total
from tessera.operators.registry import register
from tessera.sources.tables import in_slices

FIRST_ROW, FIRST_MONTH_COLUMN, SUMMARY_ROW = 5, 4, 3
GRID = ("sheet", "row", "col", "value")
#: Columns of a question workbook, by place: as it is handed out, and with all that is kept of one.
QUESTION_COLUMNS = ("no", "question", "function", "impact", "history_reference")
QUESTION_RECORD = ("no", "area", "author", "question", "assumption", "answer_by_customer", "impact", "history_reference")


@register("staffing")
def staffing_grid(rows: DataFrame, **options: object) -> DataFrame:
    """Function sheets of a plan ``(function, pos_ord, position, tariff, monthly)``: position, tariff, total, months from column D."""
    line = F.lit(FIRST_ROW) + F.col("pos_ord")
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("value"))
    head = F.array(cell(1, F.col("position")), cell(2, F.col("tariff")), cell(3, row_total(F.col("monthly"))))
    months = F.transform("monthly", lambda v, i: F.struct((i + FIRST_MONTH_COLUMN).alias("col"), v.cast("string").alias("value")))
    return rows.select(F.col("function").alias("sheet"), line.alias("row"), F.inline(F.concat(head, months))).select(*GRID)


@register("staffing_summary")
def summary_grid(rows: DataFrame, **options: object) -> DataFrame:
    """The summary sheet of a plan ``(function, monthly)``: function, description and total over positions and months, for each
    function of the sheet; one without rows has the total 0."""
    sums = rows.select("function", F.aggregate("monthly", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("v"))
    totals = sums.agg(*(F.round(F.coalesce(F.sum(F.when(F.col("function") == f, F.col("v"))), F.lit(0.0)), 1).cast("string").alias(f) for f, _ in K.SUMMARY_FUNCTIONS))
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("value"))
    lines = [x for r, (f, about) in enumerate(K.SUMMARY_FUNCTIONS, SUMMARY_ROW) for x in (cell(r, 1, F.lit(f)), cell(r, 2, F.lit(about)), cell(r, 3, F.col(f)))]
    return totals.select(F.lit(K.SUMMARY_SHEET).alias("sheet"), F.inline(F.array(*lines))).select(*GRID)


@register("project_information")
def project_grid(rows: DataFrame, **options: object) -> DataFrame:
    """The information sheet of ``(customer, project_name, quotation_no, edit_by, start, months, milestones)``."""
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), c.alias("col"), v.cast("string").alias("value"))
    two = F.lit(2)
    fixed = F.array(
        cell(6, two, F.col("customer")), cell(7, two, F.col("project_name")), cell(8, two, F.col("quotation_no")), cell(10, two, F.col("edit_by")),
        cell(12, two, F.col("start")), cell(13, two, F.col("months")), cell(14, two, project_end(F.col("start"), F.col("months"))),
    )
    marks = compact_milestones(F.col("milestones"))
    names = F.transform(marks, lambda m, i: cell(2, i + FIRST_MONTH_COLUMN, m["milestone"]))
    dates = F.transform(marks, lambda m, i: cell(3, i + FIRST_MONTH_COLUMN, m["date"]))
    return rows.select(F.lit("Project information").alias("sheet"), F.inline(F.concat(fixed, names, dates))).where("value is not null")


@register("questions")
def question_grid(rows: DataFrame, title: str | None = None, **options: object) -> DataFrame:
    """A question list ``(no, question, function, impact, history_reference)``; a title row moves the header down."""
    first = 2 if title else 1
    names = ("no", "question", "function", "impact", "history_reference")
    body = rows.select(F.lit("Q&A").alias("sheet"), (F.col("no") + first).cast("int").alias("row"), F.inline(F.array(*(F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)))))
    head = [("Q&A", first, i + 1, c) for i, c in enumerate(names)] + ([("Q&A", 1, 1, title)] if title else [])
    return rows.sparkSession.createDataFrame(head, "sheet string, row int, col int, value string").unionByName(body)


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(grid: DataFrame, path: str, limit: int = 200_000) -> None:
    """One workbook from a grid of at most ``limit`` cells, written by the driver; larger grids belong in Parquet or CSV."""
    cells = grid.orderBy("sheet", "row", "col").limit(limit + 1).collect()
    if len(cells) > limit:
        raise ValueError("too many cells for one workbook")
    with open(path, "wb") as f:
        f.write(xlsx_bytes(cells))


def xlsx_bytes(cells: Iterable[tuple[str, int, int, str | None]]) -> bytes:
    """A workbook of ``cells(sheet, row, col, value)``, rows and columns ascending within each sheet."""
    sheets: dict[str, dict[int, list]] = {}
    for sheet, row, col, value in cells:
        sheets.setdefault(sheet, {}).setdefault(row, []).append((col, value))
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, rows in enumerate(sheets.values(), 1):
            data = "".join(f'<row r="{r}">' + "".join(f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for c, v in cs) + "</row>" for r, cs in rows.items())
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')
        listed = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
    return out.getvalue()


_CELL = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.StringType())])
_CELLS = T.StructType([T.StructField("cells", T.ArrayType(_CELL)), T.StructField("error", T.StringType())])
_ARROW = pa.struct([("cells", pa.list_(pa.struct([("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())]))), ("error", pa.string())])
_MAIN, _LINKS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_XML = 200 * 1024 * 1024


def cells_of(content: bytes | None) -> list[dict]:
    """The cells of a workbook that hold a value, sheet by sheet, rows and columns from 1."""
    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_XML:
            raise ValueError("workbook too large")
        part = lambda name: ElementTree.fromstring(z.read(name))
        words = lambda node: "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
        shared = [words(x) for x in part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {x.get("Id"): x.get("Target") for x in part("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in part("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            path = target[sheet.get(f"{_LINKS}id")].lstrip("/")
            for c in part(path if path.startswith("xl/") else f"xl/{path}").iter(f"{_MAIN}c"):
                letters, number = re.fullmatch("([A-Z]+)([0-9]+)", c.get("r")).groups()
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                value = words(c) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                if value:
                    out.append({"sheet": sheet.get("name"), "row": int(number), "col": functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0), "value": value})
        return out


@F.arrow_udf(_CELLS)
def read_cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bytes of a workbook -> (cells, null) or (null, what went wrong): one bad file does not end the job."""
    for contents in in_slices(batches):
        out = []
        for content in contents.to_pylist():
            try:
                out.append({"cells": cells_of(content), "error": None})
            except Exception as e:  # noqa: BLE001  a file's fault is a value here
                out.append({"cells": None, "error": f"{type(e).__name__}: {e}"[: K.ERROR_CHARS]})
        yield pa.array(out, _ARROW)


def read_workbooks(files: DataFrame) -> DataFrame:
    """``path, sheet, row, col, value`` of all cells of ``files(path, content)``; files that cannot be read have one row of nulls
    and ``error``."""
    read = files.select("path", read_cells("content").alias("x"))
    return read.select("path", F.col("x.error").alias("error"), F.inline_outer("x.cells")).where("sheet is not null or error is not null")


def question_rows(grid: DataFrame, names: Sequence[str] = QUESTION_COLUMNS, header: int = 1) -> DataFrame:
    """Specified only: one record for each row below the header of a question sheet, columns by place; empty rows are left out."""
    picked = [F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for i, n in enumerate(names, 1)]
    return grid.where(F.col("row") > header).groupBy("path", "sheet", "row").agg(*picked)


def baselines_of(grid: DataFrame) -> DataFrame:
    """Specified only: positions and man-days out of the function sheets of quotes (the layout of ``staffing_grid``):
    ``path, function, position, tariff, man_days``, and each position's ``share`` of its function."""
    sheets = grid.where((F.col("row") >= FIRST_ROW) & ~F.col("sheet").isin(K.SUMMARY_SHEET, "Project information"))
    number = F.when((F.col("col") >= FIRST_MONTH_COLUMN) & (F.col("col") < FIRST_MONTH_COLUMN + K.MONTH_SLOTS), F.col("value").try_cast("double"))
    rows = sheets.groupBy("path", F.col("sheet").alias("function"), "row").agg(
        F.max(F.when(F.col("col") == 1, F.col("value"))).alias("position"), F.max(F.when(F.col("col") == 2, F.col("value"))).alias("tariff"),
        F.round(F.sum(number) * K.WORK_DAYS_PER_MONTH, 1).alias("man_days"),
    )
    whole = Window.partitionBy("path", "function")
    share = F.when(F.sum("man_days").over(whole) > 0, F.round(F.col("man_days") / F.sum("man_days").over(whole), 4))
    return rows.where("position is not null").withColumn("share", share)
