import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import analytics as A
from paperloom.operators import documents as D
from paperloom.functions import markup
from paperloom.operators import evaluation as E
from paperloom.operators import leaves as L
from paperloom.operators import reconcile as C
from paperloom.operators import templates as T
from paperloom.sources import tables as S
from paperloom.streaming import rollups


def candidates(spark, rows):
    frame = spark.createDataFrame(rows, "case_id int, field string, doc_id string, doc_ord int, ord int, s string, n double")
    return frame.withColumn("value", F.coalesce(V.number("n"), V.text("s"))).drop("s", "n")


def test_reconcile(spark):
    rows = [
        (1, "total", "a", 1, 0, None, 10.0), (1, "total", "b", 2, 0, None, 10.01), (2, "total", "a", 1, 0, None, 10.0), (2, "total", "b", 2, 0, None, 10.02),
        (3, "vendor", "a", 1, 0, "Acme Ltd", None), (3, "vendor", "b", 2, 0, "Other", None), (3, "vendor", "b", 2, 1, "ACME limited", None), (4, "vendor", "a", 1, 0, None, None),
        (5, "due_date", "a", 1, 0, "2026-04-02", None), (5, "due_date", "b", 2, 0, "April 5, 2026", None), (6, "vendor", "a", 1, 0, "Acme Robotics", None), (6, "vendor", "b", 2, 0, "Acme Robotic", None), (7, "vendor", "a", 1, 0, "Acme", None), (7, "vendor", "b", 2, 0, "Zenith", None),
    ]
    found = {r.case_id: (r.field_kind, r.agreement, r.docs) for r in C.reconciled(candidates(spark, rows)).collect()}
    assert found == {1: ("money", True, 2), 2: ("money", False, 2), 3: ("string", True, 2), 4: ("string", True, 0), 5: ("date", True, 2), 6: ("string", True, 2), 7: ("string", False, 2)}


def test_case_parts(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    members = spark.createDataFrame([(1, "invoice", True), (1, "po", False)], "case_id int, doc_type string, structured boolean")
    required = spark.createDataFrame([("invoice", 1), ("po", 1), ("contract", 0)], "doc_type string, least int")
    checks = C.completeness_checks(cases, members, required)
    assert {(r.case_id, r.name, r.passed) for r in checks.collect()} == {(1, "present:invoice", True), (1, "unstructured:po", False), (2, "missing:invoice", False), (2, "missing:po", False)}
    decided = C.case_decisions(checks, spark.createDataFrame([(1, 0.5), (1, 0.7)], "case_id int, confidence double"))
    assert {(r.case_id, r.decision, r.confidence) for r in decided.collect()} == {(1, "approve", 0.6), (2, "needs_review", 0.0)}


def test_alignment(spark):
    e = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 2.0), (2, 0, "x", 1.0)], "g int, idx int, d string, q double")
    a = spark.createDataFrame([(1, 0, "b", 2.0), (1, 1, "a", 9.0), (1, 2, "z", 0.0), (3, 0, "x", 1.0)], "g int, idx int, d string, q double")
    found = {r.g: (r.matched, r.row_precision, r.row_recall, r.row_f1, r.cell_accuracy) for r in E.align(e, a, ["g"], ["d", "q"]).collect()}
    assert found[1] == (2, 0.666667, 1.0, 0.8, 0.75) and found[2] == (0, 1.0, 0.0, 0.0, 0.0) and found[3] == (0, 0.0, 1.0, 0.0, 0.0)


def test_exact_and_matched(spark):
    pair = lambda e, a, k: (E.exact(e, a), E.matched(e, a, F.lit(k)))
    n, t, none = lambda x: V.number(F.lit(x)), lambda x: V.text(F.lit(x)), F.lit(None).cast(V.VALUE)
    tests = [(pair(n(658.80), n(658.79), "money"), (False, True)), (pair(t("2026-04-02"), t("2026-04-03"), "date"), (False, True)), (pair(n(135.0), t("$135.00"), "money"), (False, False)), (pair(none, none, "string"), (True, True)), (pair(none, t("x"), "string"), (False, False)), (pair(t(" a "), t("a"), "string"), (True, True))]
    got = spark.range(1).select(*(c.alias(f"c{i}{j}") for i, (cols, _) in enumerate(tests) for j, c in enumerate(cols))).first()
    assert list(got) == [x for _, want in tests for x in want]


def test_grounding(spark):
    text = "Total is 100 " + "x" * 50 + " Total is 300"
    rows = [(1, "Total", text, 0, 5), (2, "Total", text, 60, 65), (3, "Total", text, None, None), (4, "none", text, 3, 6), (5, "", text, None, None), (6, "Total", None, 0, 5), (7, "aa", "aaaa", 1, 2)]
    found = {r.k: (r.char_start, r.alignment) for r in D.grounded(spark.createDataFrame(rows, "k int, span string, text string, hint_start int, hint_end int")).collect()}
    assert found == {1: (0, "exact"), 2: (64, "partial"), 3: (0, "exact"), 4: (None, "ungrounded"), 5: (None, "ungrounded"), 6: (None, "ungrounded"), 7: (1, "partial")}


def test_sections(spark):
    rows = [(1, 1, 0, "text", "pre"), (1, 1, 1, "text", "# One"), (1, 1, 2, "text", "body " * 20), (1, 2, 0, "title", "Two"), (1, 2, 1, "text", "end"), (2, 1, 0, "text", "only")]
    parts = D.sections(spark.createDataFrame(rows, "doc_id int, page int, block int, label string, text string"))
    assert {(r.doc_id, r.section, r.title, r.n_blocks) for r in parts.collect()} == {(1, 0, None, 1), (1, 1, "One", 2), (1, 2, "Two", 2), (2, 0, None, 1)}
    found = {r.doc_id: [s.title for s in r.sections] for r in D.coalesced(parts, least=50).collect()}
    assert found == {1: ["One"], 2: [None]}
    assert {r.whole for r in D.coalesced(parts, least=1, most=2).where("doc_id = 1").collect()} == {True}


def test_tables_and_text(spark):
    page = spark.createDataFrame([(1, 1, "x\n| a | b |\n|---|---|\n| 1 | 2\\|3 |\n\n| no | rule |"), (2, 1, "a | b")], "doc_id int, page int, text string")
    found = D.markdown_tables(page).select("doc_id", "table", D.markdown_cells(F.col("markdown")).alias("rows")).collect()
    assert [(r.doc_id, r.table, r["rows"]) for r in found] == [(1, 1, [["1", "2|3"]])]
    grid = F.array(F.array(F.lit("h")), F.array(F.lit("a|b"), F.lit("c\nd")))
    assert spark.range(1).select(D.markdown_rows(grid)).first()[0] == "| h |  |\n| --- | --- |\n| a\\|b | c d |"
    items = spark.createDataFrame([(1, 0, "Acme Inc."), (1, 1, "ACME INC (Buyer)"), (1, 2, None), (1, 3, None), (1, 4, "Acme")], "doc_id int, ord int, v string")
    assert sorted(r.ord for r in D.dedup_list(items, "doc_id", "ord", "v").collect()) == [0, 2, 3, 4]
    docs = spark.createDataFrame([(1, "The total, and vendor."), (2, ""), (3, None)], "doc_id int, text string")
    assert {r.doc_id: (r.doc_type, r.confidence) for r in D.classified(docs, {"invoice": ["total", "vendor"], "contract": ["party", "total"]}).collect()} == {1: ("invoice", 0.6667), 2: (None, 0.0), 3: (None, 0.0)}


def test_chain_and_pages(spark):
    rows = [(1, 0, "a", 0.2, 10, False), (1, 1, "b", 0.9, 10, False), (2, 0, "a", None, 5, False), (3, 0, "a", 0.9, 0, False), (3, 1, "b", 0.1, 9, True)]
    found = D.chain_choice(spark.createDataFrame(rows, "doc_id int, rank int, engine string, confidence double, chars int, failed boolean"))
    assert {r.doc_id: (r.engine, r.adequate) for r in found.collect()} == {1: ("b", True), 2: ("a", True), 3: ("b", False)}


def test_leaves(spark):
    fields = L.BUILT_IN["contract"]
    schema = L.schema(fields)
    doc = {"parties": [{"value": "A", "confidence": 0.8, "page": 1}, {"value": "B", "confidence": 0.6, "page": 1}], "termination_clause": {"text": {"value": "t", "confidence": 0.5, "page": 2}, "notice_period": None}, "term": {"value": "1y", "confidence": 1.0, "page": 1}, "signatures_present": {"value": True, "confidence": 0.9, "page": 3}}
    frame = spark.createDataFrame([(1, {f.name: doc.get(f.name) for f in fields})], f"id int, fields {schema.simpleString()}")
    rows = {r.path: r for r in L.flatten(frame, "id", "fields", fields).collect() if r.value is not None}
    assert set(rows) == {"parties.0", "parties.1", "termination_clause.text", "term", "signatures_present"} and rows["parties.1"].value.s == "B" and rows["signatures_present"].value.b
    confidence = L.core_confidence(L.flatten(frame, "id", "fields", fields), "id", [f.name for f in fields if f.core]).first().confidence
    assert confidence == 0.425  # (0.7 + 0 + 1 + 0) / 4
    assert L.definition_problems(list(fields)) == [] and len(L.definition_problems([L.FieldDef("_x"), L.FieldDef("a", "odd"), L.FieldDef("a", "composite")])) == 5
    assert ("line_items.1.qty", "Line Items 2 Qty", "number") in L.catalogue(L.BUILT_IN["invoice"], 2)


def test_analytics(spark):
    at = datetime.datetime(2024, 1, 30, 12)
    rows = spark.createDataFrame([(1, 1, at, "x"), (1, 2, at, "y"), (2, 3, at - datetime.timedelta(days=40), "z")], "doc_id int, seq int, ts timestamp_ntz, v string")
    assert {(r.doc_id, r.v) for r in A.latest(rows, "doc_id", "ts", "seq").collect()} == {(1, "x"), (2, "z")}
    days = A.daily(rows, "ts", datetime.date(2024, 1, 31)).collect()
    assert len(days) == 30 and sum(r.n for r in days) == 2
    assert A.page_of(rows, [F.asc("seq")], 99, 2).collect()[0].seq == 3
    assert [r.doc_id for r in A.search(rows, "Y", "v").collect()] == [1] and A.search(rows, "", "v").count() == 3
    empty = rows.limit(0)
    assert A.daily(empty, "ts", datetime.date(2024, 1, 31), 7).count() == 7 and A.latest(empty, "doc_id", "ts", "seq").count() == 0


def test_templates(spark):
    form = spark.createDataFrame([("vendorName", ""), ("zzz", "")], "name string, label string")
    entries = spark.createDataFrame([("vendor", "Vendor name"), ("total", "Total")], "path string, entry_label string")
    assert {(r.name, r.path, r.score) for r in T.suggested(form, entries).collect()} == {("vendorName", "vendor", 1.0), ("zzz", None, None)}
    html = '<p onclick="x()">a<script>bad()</script><a href="javascript:x">b</a>&amp;<iframe src="y"></iframe></p>'
    page = spark.createDataFrame([(html,), (None,)], "html string")
    assert [r.x for r in page.select(markup.sanitized("html").alias("x")).collect()] == ["<p>a<a>b</a>&amp;</p>", None]
    assert "script" not in page.select(T.without_scripts(F.col("html")).alias("x")).first().x.replace("javascript", "")
    assert spark.range(1).select(T.widened(F.lit("=SUM(B2:B5)+C5+SUM(F1:F5)+SUM($A$1:$Z$5)+S!B1:B5"), F.lit(5), F.lit(3), ("B", "C"))).first()[0] == "=SUM(B2:B8)+C5+SUM(F1:F5)+SUM($A$1:$Z$8)+S!B1:B5"
    assert spark.range(1).select(T.widened(F.lit("=B1:B5"), F.lit(5), F.lit(0), ("B",))).first()[0] == "=B1:B5"
    lint = T.lint(spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "template int, path string"), spark.createDataFrame([("a",)], "path string")).first()
    assert (lint.total, lint.bound, lint.orphaned) == (3, 2, ["b"])


def test_sheets(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes(b'h,"x\ny",z\n1,\xff\n')
    rows = S.csv_sheets(spark, str(tmp_path / "csv"), max_cols=2).orderBy("row").collect()
    assert [r.cells for r in rows] == [["h", "x\ny"], ["1", "�"]] and rows[0].truncated_cols
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    (tmp_path / "x").mkdir()
    with zipfile.ZipFile(tmp_path / "x" / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2.0</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c></row><row r="5"><c r="A5"/></row></sheetData></worksheet>')
    rows = S.xlsx_sheets(spark, str(tmp_path / "x")).orderBy("row").collect()
    assert [(r.sheet, r.cells) for r in rows] == [("S", ["name", "", "2"]), ("S", []), ("S", ["", "True"])]
    cells = T.cells(S.xlsx_sheets(spark, str(tmp_path / "x")), ["sheet"], "row", "cells").collect()
    assert {(r.a1, r.value) for r in cells} == {("A1", "name"), ("C1", "2"), ("B3", "True")}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.json").write_text('{"id": "a",\n "doc_type": "invoice", "expected_fields": {"total": 1.5}}')
    (tmp_path / "g" / "two.json").write_text('{"id": "Z", "expected_fields": {"n": null, "b": true, "s": "x", "i": 3}, "expected_collections": {"items": [{"d": "y", "q": 2}], "tags": ["t", 1]}}')
    cases = S.goldens(spark, str(tmp_path / "g"))
    assert [r.id for r in cases.collect()] == ["Z", "a"] and S.golden(cases, "a").expected_fields["total"].n == 1.5
    with pytest.raises(KeyError):
        S.golden(cases, "none")
    said = {r.path: r.expected and (r.expected.kind, r.expected.s, r.expected.n, r.expected.b) for r in S.golden_fields(cases).where("id = 'Z'").collect()}
    assert said == {"n": None, "b": ("bool", None, None, True), "s": ("string", "x", None, None), "i": ("number", None, 3.0, None)}
    rows = {(r.collection, r.idx): {k: v.s or v.n for k, v in r.cells.items()} for r in S.golden_rows(cases).collect()}
    assert rows == {("items", 0): {"d": "y", "q": 2.0}, ("tags", 0): {"tags": "t"}, ("tags", 1): {"tags": 1.0}}


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = rollups.events(spark, folder, events.schema.simpleString()[7:-1].replace(":", " "))
    query = rollups.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    latest = rollups.latest_state(stream, "user_id", "ts", ["event_id", "event_type"]).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    for q in (query, latest):
        q.processAllAvailable()
        q.stop()
    batch = {r.day: r.n for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert {r.day: r.n for r in spark.table("daily").collect()} == batch
    newest = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert {(r.user_id, r.event_id) for r in spark.table("latest").collect()} == {(r.user_id, r.e) for r in newest.collect()}
