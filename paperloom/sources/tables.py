"""Reading and writing: file types, spreadsheets, golden sets, JSON lines, schemas that grow."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.settings import DEFAULT

#: File endings that documents may have, and their kinds.
DOCUMENT_TYPES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff", ".csv": "text/csv", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
TEMPLATE_TYPES = (".pdf", ".docx", ".xlsx")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))


def mime(filename: Column) -> Column:
    """The kind of a document file, null for one that isn't taken."""
    pairs = [F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(filename))


def is_template(filename: Column) -> Column:
    return extension(filename).isin(*TEMPLATE_TYPES)


def csv_sheets(spark: SparkSession, path: str, max_rows: int = DEFAULT.sheet_max_rows, max_cols: int = DEFAULT.sheet_max_cols) -> DataFrame:
    """(file, row, cells, truncated_rows, truncated_cols) of CSV files, rows in their order, bad bytes replaced."""
    import csv

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8", "replace"), newline="")))
                yield _grid(name, "Sheet1", rows, max_rows, max_cols)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, sheet string, row int, cells array<string>, truncated_rows boolean, truncated_cols boolean")


def _grid(file: str, sheet: str, rows: list[list[str]], max_rows: int, max_cols: int) -> pd.DataFrame:
    wide = any(len(r) > max_cols for r in rows)
    kept = [(file, sheet, n, r[:max_cols], len(rows) > max_rows, wide) for n, r in enumerate(rows[:max_rows])]
    return pd.DataFrame(kept or [(file, sheet, 0, [], False, False)], columns=["file", "sheet", "row", "cells", "truncated_rows", "truncated_cols"])


def _workbook(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Name and rows of each sheet of an XLSX file, cached values of formulas, empty rows at the end dropped."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", ns):
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(rel)].removeprefix("/xl/"))).iterfind("m:sheetData/m:row", ns):
                at = int(row.get("r", len(rows) + 1))
                rows.extend([] for _ in range(at - len(rows)))
                for cell in row.iterfind("m:c", ns):
                    letters = re.match(r"[A-Z]+", cell.get("r", "")) or [""]
                    place = 0
                    for c in letters[0]:
                        place = place * 26 + ord(c) - 64
                    place = place - 1 if letters[0] else len(rows[at - 1])
                    rows[at - 1].extend("" for _ in range(place + 1 - len(rows[at - 1])))
                    rows[at - 1][place] = _cell(cell, texts, ns)
            while rows and not any(rows[-1]):
                rows.pop()
            yield sheet.get("name", ""), rows


def _cell(cell, texts: list[str], ns: dict) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
    value = cell.findtext("m:v", "", ns)
    if cell.get("t") == "s":
        return texts[int(value)] if value else ""
    if cell.get("t") == "b":
        return {"1": "True", "0": "False"}.get(value, "")
    if cell.get("t") in (None, "n") and value:
        number = float(value)
        return str(int(number)) if number.is_integer() else str(number)
    return value


def xlsx_sheets(spark: SparkSession, path: str, max_rows: int = DEFAULT.sheet_max_rows, max_cols: int = DEFAULT.sheet_max_cols) -> DataFrame:
    """(file, sheet, row, cells, truncated_rows, truncated_cols) of XLSX files; an empty sheet has one empty row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for sheet, rows in _workbook(bytes(content)):
                    yield _grid(name, sheet, rows, max_rows, max_cols)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, sheet string, row int, cells array<string>, truncated_rows boolean, truncated_cols boolean")


def goldens(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from a folder of JSON files, by id: id, sample_file, doc_type, expected_fields map<string,value union>,
    expected_collections map<string, array of rows map<string,value union>>; a row that is a plain value has its collection's name."""
    read = spark.read.schema("id string, sample_file string, doc_type string, expected_fields variant, expected_collections variant").json(path, multiLine=True)
    cells = lambda v: F.transform_values(v.try_cast("map<string,variant>"), lambda _, x: _value(x))

    def rows(name: Column, listed: Column) -> Column:
        plain = lambda x: ~F.schema_of_variant(x).startswith("OBJECT")
        some = F.coalesce(listed.try_cast("array<variant>"), F.array().cast("array<variant>"))
        return F.transform(some, lambda x: F.when(plain(x), F.create_map(name, _value(x))).otherwise(cells(x)))

    none = F.create_map().cast(f"map<string,{V.VALUE}>")
    held = F.coalesce(F.col("expected_collections").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return read.select(
        "id", "sample_file", "doc_type", F.coalesce(cells(F.col("expected_fields")), none).alias("expected_fields"),
        F.transform_values(held, rows).alias("expected_collections"),
    ).orderBy("id")


def _value(x: Column) -> Column:
    """A JSON value as a value union; null for null, lists and objects."""
    kind = F.schema_of_variant(x)
    text, flag = F.when(kind == "STRING", x.try_cast("string")), F.when(kind == "BOOLEAN", x.try_cast("boolean"))
    amount = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), x.try_cast("double"))
    said = F.when(text.isNotNull(), "string").when(flag.isNotNull(), "bool").when(amount.isNotNull(), "number")
    return F.when(said.isNotNull(), F.struct(said.alias("kind"), text.alias("s"), amount.alias("n"), flag.alias("b")))


def golden(cases: DataFrame, golden_id: str):
    """The case of an id; KeyError if there is none."""
    found = cases.where(F.col("id") == golden_id).head()
    if found is None:
        raise KeyError(golden_id)
    return found


def golden_fields(cases: DataFrame) -> DataFrame:
    """(id, path, expected) of every expected field, as scoring takes them."""
    return cases.select("id", F.explode("expected_fields").alias("path", "expected"))


def golden_rows(cases: DataFrame) -> DataFrame:
    """(id, collection, idx, cells) of every expected row, as scoring takes them."""
    each = cases.select("id", F.explode("expected_collections").alias("collection", "rows"))
    return each.select("id", "collection", F.posexplode("rows").alias("idx", "cells"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def grown(old: DataFrame, new: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of both under all columns of both; what the older rows lack has its default."""
    out = old.unionByName(new, allowMissingColumns=True)
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def not_yet_done(rows: DataFrame, cache: DataFrame, content_col: str) -> DataFrame:
    """Rows whose content's hash has no result yet: failures are never in the cache."""
    return rows.withColumn("cache_key", F.sha2(F.col(content_col), 256)).join(cache.select("cache_key"), "cache_key", "left_anti")
