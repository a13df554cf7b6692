"""XLSX workbooks as a Spark data source, and cells written as workbooks.

`spark.read.format("workbook")` has two views: `cells` (a row for each cell that is there) and `sheets` (a row for each sheet
with its extent, merged ranges and column widths). A partition is a file, or one sheet of a file of more than
`split_bytes`. Filters on the sheet's name are taken by the source: other sheets' XML is not read. A sheet is
streamed row by row; only the workbook's shared texts are held.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import urlparse
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

# Fixed values of the file format: name spaces and the numbers of built-in date formats.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
SPLIT_BYTES = 32 << 20
CELLS = "file string, sheet string, sheet_index int, row int, col int, a1 string, value string, is_formula boolean, formula string"
SHEETS = (
    "file string, sheet string, sheet_index int, state string, max_row int, max_col int, merges array<string>, col_widths map<string,double>, "
    "cells bigint, formulas bigint"
)


def letters_of(col: int) -> str:
    """Letters of a column counted from 1."""
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def place_of(a1: str) -> tuple[int, int]:
    """(row, column), counted from 1, of a place like C7."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", a1)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def moved(formula: str, rows: int, cols: int) -> str:
    """A formula with its relative places moved, as those that share it have it; texts in quotes stay."""

    def put(m: re.Match) -> str:
        if m[1]:
            return m[0]
        row, col = place_of(m[3] + m[5])
        return f"{m[2]}{m[3] if m[2] else letters_of(max(1, col + cols))}{m[4]}{row if m[4] else max(1, row + rows)}"

    return re.sub(r'("[^"]*"|\'[^\']*\'!?)|(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])', put, formula)


@dataclass
class Part(InputPartition):
    path: str
    sheet: str | None = None


def _filesystem(uri: str):
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


class Book:
    """One workbook, opened by its parts."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.names = set(self.zip.namelist())
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.epoch = datetime(1904, 1, 1) if (p := book.find(f"{{{MAIN}}}workbookPr")) is not None and p.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.sheets = []
        for n, sheet in enumerate(book.iterfind(f"{{{MAIN}}}sheets/{{{MAIN}}}sheet")):
            target = targets[sheet.get(f"{{{LINK}}}id")]
            self.sheets.append((n, sheet.get("name", ""), sheet.get("state", "visible"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
        self._texts: list[str] | None = None
        self._dates: list[bool] | None = None

    def texts(self) -> list[str]:
        if self._texts is None:
            self._texts = []
            if "xl/sharedStrings.xml" in self.names:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{{{MAIN}}}si":
                            phonetic = {t for p in e.iter(f"{{{MAIN}}}rPh") for t in p.iter(f"{{{MAIN}}}t")}
                            self._texts.append("".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t") if t not in phonetic))
                            e.clear()
        return self._texts

    def is_date(self, style: int) -> bool:
        if self._dates is None:
            self._dates = []
            if "xl/styles.xml" in self.names:
                root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
                own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iterfind(f"{{{MAIN}}}numFmts/{{{MAIN}}}numFmt")}
                for xf in root.iterfind(f"{{{MAIN}}}cellXfs/{{{MAIN}}}xf"):
                    n = int(xf.get("numFmtId", 0))
                    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(n, ""))
                    self._dates.append(n in DATES or bool(re.search(r"[dmyhs]", bare, re.I)) and "General" not in bare)
        return style < len(self._dates) and self._dates[style]

    def shown(self, cell) -> str | None:
        """A cell's value as it is displayed: whole numbers without a fraction, dates with their time; None for an empty one."""
        kind, raw = cell.get("t", "n"), cell.findtext(f"{{{MAIN}}}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
        if raw is None:
            return None
        if kind == "s":
            return self.texts()[int(raw)]
        if kind == "b":
            return {"1": "True", "0": "False"}.get(raw, raw)
        if kind != "n":
            return raw
        number = float(raw)
        if self.is_date(int(cell.get("s", 0))):
            return str(self.epoch + timedelta(milliseconds=round(number * 86_400_000)))
        return str(int(number)) if number.is_integer() else str(number)

    def rows(self, target: str) -> Iterator[tuple[str, object]]:
        """("cell", (row, col, value, formula)), ("merge", range) and ("width", (letter, width)) as they stand in the sheet."""
        shared: dict[str, tuple[str, int, int]] = {}
        row = col = 0
        with self.zip.open(target) as f:
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    if e.tag == f"{{{MAIN}}}row":
                        row, col = int(e.get("r", row + 1)), 0
                    continue
                if e.tag == f"{{{MAIN}}}c":
                    at, col = place_of(e.get("r")) if e.get("r") else (row, col + 1)
                    formula = e.find(f"{{{MAIN}}}f")
                    said = None
                    if formula is not None:
                        said = formula.text or ""
                        if formula.get("t") == "shared" and said:
                            shared[formula.get("si", "")] = (said, at, col)
                        elif formula.get("t") == "shared" and formula.get("si", "") in shared:
                            text, r, c = shared[formula.get("si", "")]
                            said = moved(text, at - r, col - c)
                    yield "cell", (at, col, self.shown(e), None if said is None else "=" + said)
                elif e.tag == f"{{{MAIN}}}mergeCell":
                    yield "merge", e.get("ref")
                elif e.tag == f"{{{MAIN}}}col" and e.get("width"):
                    yield "width", (letters_of(int(e.get("min"))), float(e.get("width")))
                if e.tag == f"{{{MAIN}}}row":
                    e.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str, view: str, split_bytes: int):
        self.path, self.view, self.split_bytes, self.wanted = path, view, split_bytes, None

    def pushFilters(self, filters):  # noqa: N802
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("sheet",):
                names = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield one

    def partitions(self):
        from pyarrow import fs

        filesystem, path = _filesystem(self.path)
        info = filesystem.get_file_info(path)
        files = [info] if info.is_file else filesystem.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for one in sorted((f for f in files if f.is_file and f.path.lower().endswith(".xlsx")), key=lambda f: f.path):
            if one.size <= self.split_bytes:
                out.append(Part(one.path))
            else:
                with filesystem.open_input_file(one.path) as f:
                    out += [Part(one.path, name) for _, name, _, _ in Book(f).sheets]
        return out or [Part("")]

    def read(self, partition):
        if not partition.path:
            return
        filesystem, _ = _filesystem(self.path)
        file = partition.path.rsplit("/", 1)[-1]
        with filesystem.open_input_file(partition.path) as f:
            book = Book(f)
            for n, name, state, target in book.sheets:
                if partition.sheet not in (None, name) or (self.wanted is not None and name not in self.wanted):
                    continue
                if self.view == "cells":
                    for kind, x in book.rows(target):
                        if kind == "cell" and (x[2] is not None or x[3] is not None):
                            row, col, value, formula = x
                            yield (file, name, n, row - 1, col - 1, f"{letters_of(col)}{row}", value, formula is not None, formula)
                    continue
                most, merges, widths, cells, formulas = [1, 1], [], {}, 0, 0
                for kind, x in book.rows(target):
                    if kind == "cell":
                        most = [max(most[0], x[0]), max(most[1], x[1])]
                        cells += x[2] is not None or x[3] is not None
                        formulas += x[3] is not None
                    elif kind == "merge":
                        merges.append(x)
                    else:
                        widths.setdefault(*x)
                yield (file, name, n, state, most[0], most[1], merges, widths, cells, formulas)


class WorkbookSource(DataSource):
    """path, view (cells or sheets), split_bytes."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return CELLS if self.options.get("view", "cells") == "cells" else SHEETS

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("view", "cells"), int(self.options.get("split_bytes", SPLIT_BYTES)))


def workbook(spark: SparkSession, path: str, view: str = "cells", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cells or sheets of a workbook or of all workbooks below a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("view", view).option("split_bytes", split_bytes).load(path)


def template_grid(cells: DataFrame, sheet: str, max_rows: int = 500, max_cols: int = 60) -> DataFrame:
    """(file, row, col, a1, value, is_formula) of one sheet within the limits: a formula is shown as it is written."""
    shown = F.when(F.col("is_formula"), F.col("formula")).otherwise(F.col("value"))
    near = (F.col("sheet") == sheet) & (F.col("row") < max_rows) & (F.col("col") < max_cols)
    return cells.where(near).select("file", "row", "col", "a1", shown.alias("value"), "is_formula").where("value is not null and value <> ''")


def sheet_pages(cells: DataFrame, sheets: DataFrame, max_rows: int = 500, max_cols: int = 60) -> DataFrame:
    """(file, page, sheet, blocks, table, n_rows, n_cols, truncated_rows, truncated_cols): a workbook's sheets as OCR pages.

    Every cell with text is a block whose box is its place in the grid (col, row, col + 1, row + 1), sure and labelled
    cell; the sheet is a markdown table too. A sheet without cells is a page without either.
    """
    from paperloom.operators import documents as D

    near = cells.where((F.coalesce("value", F.lit("")) != "") & (F.col("row") < max_rows) & (F.col("col") < max_cols))
    box = F.array(*(x.cast("double") for x in (F.col("col"), F.col("row"), F.col("col") + 1, F.col("row") + 1)))
    block = F.struct("row", "col", F.col("value").alias("text"), box.alias("bbox"), F.lit(1.0).alias("confidence"), F.lit("cell").alias("label"))
    listed = near.groupBy("file", "sheet").agg(F.sort_array(F.collect_list(block)).alias("b"))
    met = sheets.select("file", "sheet", "sheet_index", "max_row", "max_col").join(listed, ["file", "sheet"], "left")
    n_rows = F.coalesce(F.array_max(F.transform("b", lambda x: x["row"])) + 1, F.lit(0))
    n_cols = F.coalesce(F.array_max(F.transform("b", lambda x: x["col"])) + 1, F.lit(0))
    met = met.withColumn("n_rows", n_rows).withColumn("n_cols", n_cols)
    by_place = F.map_from_entries(F.transform("b", lambda x: F.struct(x["row"] * max_cols + x["col"], x["text"])))
    met = met.withColumn("m", by_place)
    row = lambda r: F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.try_element_at("m", r * max_cols + c), F.lit("")))
    grid = F.when(F.col("n_rows") > 0, F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), row))
    none = F.array().cast("array<struct<text:string,bbox:array<double>,confidence:double,label:string>>")
    blocks = F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), x["label"].alias("label")))
    return met.select(
        "file", (F.col("sheet_index") + 1).alias("page"), "sheet", F.coalesce(blocks, none).alias("blocks"), D.markdown_rows(grid).alias("table"), "n_rows", "n_cols",
        (F.col("max_row") > max_rows).alias("truncated_rows"), (F.col("max_col") > max_cols).alias("truncated_cols"),
    )


def _sheet_xml(cells: list[tuple[int, int, str | None, float | None, str | None]]) -> str:
    out, now = [f'<worksheet xmlns="{MAIN}"><sheetData>'], None
    for row, col, text, number, formula in sorted(cells, key=lambda x: x[:2]):
        if row != now:
            out.append(("</row>" if now is not None else "") + f'<row r="{row + 1}">')
            now = row
        place, value = f"{letters_of(col + 1)}{row + 1}", "" if number is None else f"<v>{number!r}</v>"
        if formula is not None:
            out.append(f'<c r="{place}"><f>{escape(formula.removeprefix("="))}</f>{value}</c>')
        elif number is not None:
            out.append(f'<c r="{place}">{value}</c>')
        else:
            out.append(f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text or "")}</t></is></c>')
    return "".join(out) + ("</row>" if now is not None else "") + "</sheetData></worksheet>"


def workbook_bytes(sheets: list[tuple[str, list]]) -> bytes:
    """A workbook of sheets (name, cells)."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="r{n}"/>' for n, (name, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{n}" Type="{LINK}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        for n, (_, cells) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{n}.xml", _sheet_xml(cells))
    return held.getvalue()


def write_workbooks(cells: DataFrame, folder: str) -> DataFrame:
    """Write a workbook for each file of (file, sheet, row, col, text, number, formula) into the folder; gives (file, bytes).

    A file's cells meet in one task, sheets in the order of their names; a task that runs again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        filesystem, path = _filesystem(folder)
        now, sheets = None, []

        def put():
            data, part = workbook_bytes(sheets), f"{path}/.{uuid.uuid4().hex}.part"
            with filesystem.open_output_stream(part) as out:
                out.write(data)
            filesystem.move(part, f"{path}/{now}")
            return pa.RecordBatch.from_pydict({"file": [now], "bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for file, sheet, row, col, text, number, formula in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    if now is not None:
                        yield put()
                    now, sheets = file, []
                if not sheets or sheets[-1][0] != sheet:
                    sheets.append((sheet, []))
                sheets[-1][1].append((row, col, text, number, formula))
        if now is not None:
            yield put()

    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    chosen = cells.select("file", "sheet", "row", "col", "text", "number", "formula")
    return chosen.repartition("file").sortWithinPartitions("file", "sheet", "row", "col").mapInArrow(run, "file string, bytes long")
