"""Workbooks as a data source."""

import zipfile

from pyspark.sql import functions as F

from paperloom.sources import workbooks as W

STYLES = (
    f'<styleSheet xmlns="{W.MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
)
FIRST = (
    f'<worksheet xmlns="{W.MAIN}"><cols><col min="2" max="4" width="12.5"/><col min="7" max="7"/></cols><sheetData>'
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2.0</v></c><c t="str"><v>auto</v></c></row>'
    '<row r="3"><c r="B3" t="b"><v>1</v></c><c r="C3" s="1"><v>45292.5</v></c><c r="D3" s="2"><v>45292</v></c><c r="E3" s="3"><v>2.5</v></c></row>'
    '<row><c><f t="shared" ref="A4:A6" si="0">$B$3+C3*SUM(B1:B3)&amp;"A1"</f><v>7</v></c></row><row r="6"><c r="B6"><f t="shared" si="0"/></c></row><row r="9"><c r="H9"/></row>'
    '</sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>'
)
EMPTY = f'<worksheet xmlns="{W.MAIN}"><sheetData/></worksheet>'


def write(path):
    with zipfile.ZipFile(path, "w") as z:
        sheets = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}" {more}/>' for i, (n, more) in enumerate((("One", ""), ("Void", 'state="hidden"'), ("T&amp;wo", "")), 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.LINK}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{W.PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in ((1, "worksheets/a.xml"), (2, "/xl/worksheets/b.xml"), (3, "worksheets/c.xml"))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{W.MAIN}"><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/worksheets/a.xml", FIRST)
        z.writestr("xl/worksheets/b.xml", EMPTY)
        z.writestr("xl/worksheets/c.xml", f'<worksheet xmlns="{W.MAIN}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x|y</t></is></c></row></sheetData></worksheet>')


WANT = {
    ("One", "A1"): ("name", None), ("One", "C1"): ("2", "=1+1"), ("One", "D1"): ("auto", None), ("One", "B3"): ("True", None), ("One", "C3"): ("2024-01-01 12:00:00", None),
    ("One", "D3"): ("2024-01-01 00:00:00", None), ("One", "E3"): ("2.5", None), ("One", "A4"): ("7", '=$B$3+C3*SUM(B1:B3)&"A1"'), ("One", "B6"): (None, '=$B$3+D5*SUM(C3:C5)&"A1"'), ("T&wo", "A1"): ("x|y", None),
}


def test_cells_and_sheets(spark, tmp_path):
    write(tmp_path / "b.xlsx")
    for split in (1 << 30, 1):  # a partition for the file, or one for each sheet
        cells = W.workbook(spark, str(tmp_path), split_bytes=split)
        assert {(r.sheet, r.a1): (r.value, r.formula) for r in cells.collect()} == WANT
        assert all(r.is_formula == (r.formula is not None) for r in cells.collect())
        assert cells.rdd.getNumPartitions() == (1 if split > 1 else 3)
    sheets = {r.sheet: r for r in W.workbook(spark, str(tmp_path / "b.xlsx"), "sheets").collect()}
    assert [(s.sheet_index, s.state, s.max_row, s.max_col, s.merges, s.col_widths, s.cells, s.formulas) for s in (sheets["One"], sheets["Void"], sheets["T&wo"])] == [
        (0, "visible", 9, 8, ["A1:B2"], {"B": 12.5}, 9, 3), (1, "hidden", 1, 1, [], {}, 0, 0), (2, "visible", 1, 1, [], {}, 1, 0),
    ]


def test_other_sheets_are_not_read(spark, tmp_path):
    write(tmp_path / "b.xlsx")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "a") as z:
        z.writestr("xl/worksheets/a.xml", "<broken")  # the last part of a name is the one that is read
    cells = W.workbook(spark, str(tmp_path))
    assert [r.value for r in cells.where("sheet = 'T&wo'").collect()] == ["x|y"]
    assert cells.where("sheet in ('T&wo', 'Void') and row = 0").count() == 1
    (tmp_path / "none").mkdir()
    assert W.workbook(spark, str(tmp_path / "none")).count() == 0


def test_template_grid_and_pages(spark, tmp_path):
    write(tmp_path / "b.xlsx")
    cells, sheets = W.workbook(spark, str(tmp_path)), W.workbook(spark, str(tmp_path), "sheets")
    grid = {r.a1: (r.value, r.is_formula) for r in W.template_grid(cells, "One", max_rows=4, max_cols=3).collect()}
    assert grid == {"A1": ("name", False), "C1": ("=1+1", True), "B3": ("True", False), "C3": ("2024-01-01 12:00:00", False), "A4": ('=$B$3+C3*SUM(B1:B3)&"A1"', True)}
    assert W.template_grid(cells, "no such sheet").count() == 0
    pages = {r.page: r for r in W.sheet_pages(cells, sheets, max_rows=3).collect()}
    assert pages[1].table == "| name |  | 2 | auto |  |\n| --- | --- | --- | --- | --- |\n|  |  |  |  |  |\n|  | True | 2024-01-01 12:00:00 | 2024-01-01 00:00:00 | 2.5 |"
    assert [(b.text, b.bbox) for b in pages[1].blocks][:2] == [("name", [0.0, 0.0, 1.0, 1.0]), ("2", [2.0, 0.0, 3.0, 1.0])]
    assert (pages[1].truncated_rows, pages[1].truncated_cols, pages[2].blocks, pages[2].table, pages[3].table) == (True, False, [], None, "| x\\|y |\n| --- |")


def test_moved_formulas():
    assert W.moved("A1+$A1+A$1+$A$1", 2, 1) == "B3+$A3+B$1+$A$1"
    assert W.moved("LOG10(A1)&\"A1\"&'A1 b'!A1", 1, 0) == "LOG10(A2)&\"A1\"&'A1 b'!A2"


def test_written_workbooks(spark, tmp_path):
    rows = [("a.xlsx", "S<1>", 0, 0, "text & more", None, None), ("a.xlsx", "S<1>", 1, 27, None, 2.5, None), ("a.xlsx", "T", 0, 0, None, 4.0, "=1+3"), ("b.xlsx", "S", 2, 1, " x ", None, None)]
    cells = spark.createDataFrame(rows, "file string, sheet string, row int, col int, text string, number double, formula string")
    assert {r.file for r in W.write_workbooks(cells, f"file://{tmp_path}/out").collect()} == {"a.xlsx", "b.xlsx"}
    back = W.workbook(spark, f"file://{tmp_path}/out").collect()
    assert {(r.file, r.sheet, r.a1, r.value, r.formula) for r in back} == {("a.xlsx", "S<1>", "A1", "text & more", None), ("a.xlsx", "S<1>", "AB2", "2.5", None), ("a.xlsx", "T", "A1", "4", "=1+3"), ("b.xlsx", "S", "B3", " x ", None)}
    assert back[0].file and W.workbook(spark, f"file://{tmp_path}/out", "sheets").agg(F.sum("formulas")).first()[0] == 1
