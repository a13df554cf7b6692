"""Records, paths, forms and extraction on rows that are hard on them."""

from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import extraction as X
from paperloom.operators import forms as M
from paperloom.operators import paths as P
from paperloom.operators import reconcile as C
from paperloom.operators import records as K
from paperloom.settings import Settings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def shown(v):
    return None if v is None else {"string": v.s, "number": v.n, "bool": v.b}[v.kind]


def test_edits_take_the_kind_of_the_field(spark):
    cases = [
        (V.number(F.lit(1.0)), V.text(F.lit(" $1,234.5 ")), 1234.5), (V.number(F.lit(1.0)), V.text(F.lit("n/a")), "n/a"), (V.number(F.lit(1.0)), V.boolean(F.lit(True)), True),
        (V.boolean(F.lit(False)), V.text(F.lit(" YES ")), True), (V.boolean(F.lit(True)), V.number(F.lit(0.0)), False), (V.text(F.lit("a")), V.number(F.lit(2.0)), 2.0),
        (V.number(F.lit(1.0)), F.lit(None).cast(V.VALUE), None), (F.lit(None).cast(V.VALUE), V.text(F.lit("x")), "x"),
    ]
    for reference, given, want in cases:
        assert shown(one(spark, P.coerced(reference, given))) == want


def test_paths_into_nested_fields(spark):
    row = spark.sql("select named_struct('a', array(named_struct('value', 1, 'confidence', 0.5), null), 'b', named_struct('c', named_struct('value', 'x', 'confidence', 1.0)), 'n', cast(null as struct<c:struct<value:int,confidence:double>>)) f")
    kind = row.schema["f"].dataType
    at = lambda how, path: row.select(how(F.col("f"), kind, path).alias("x")).first().x
    assert at(P.resolved, "a.0") == 1 and at(P.resolved, "a.1") is None and at(P.resolved, "a.7") is None and at(P.resolved, "a.x") is None and at(P.resolved, "b.d") is None and at(P.resolved, "n.c") is None
    assert at(P.cell_at, "a.0").confidence == 0.5 and at(P.cell_at, "b") is None and at(P.resolved, "b").c.value == "x"
    plain = row.select(P.values_only(F.col("f"), kind).alias("x")).first().x
    assert plain.a == [1, None] and plain.b.c == "x" and plain.n is None


def test_boxes_kinds_units_and_names(spark):
    for value, want in ((V.text(F.lit(" Off")), False), (V.text(F.lit("x")), True), (V.number(F.lit(0.0)), False), (V.boolean(F.lit(True)), True), (F.lit(None).cast(V.VALUE), False)):
        assert one(spark, M.ticked(value)) is want
    none = F.lit(None).cast("array<string>")
    assert one(spark, M.on_state(none)) == "/Yes" and one(spark, M.on_state(F.array(F.lit("Off"), F.lit("Ja")))) == "/Ja"
    assert one(spark, M.field_kind(F.lit("x"), F.lit(None).cast("string"), none, F.lit(None).cast("boolean"))) == "text"
    assert one(spark, M.field_kind(F.lit("x"), F.lit("/Btn"), F.array(F.lit("/A"), F.lit("/B")), F.lit(False))) == "checkbox"
    assert one(spark, M.with_unit(F.lit(None).cast(V.VALUE), F.lit("kg"))).shown is None
    assert [one(spark, M.model_name(F.lit(n))) for n in ("line_items", "termination_clause", "s", "")] == ["LineItem", "TerminationClause", "S", ""]


def test_service_answers_that_are_broken(spark):
    rows = [(1, '{"page":2,"text":"a"}'), (2, "nonsense"), (3, None), (4, '{"blocks":[{"text":null,"bbox":[1,2,3,4]}],"tables":[{"markdown":"|a|"}]}'), (5, "[1]"), (6, "{}")]
    got = {r.doc_id: r for r in X.service_pages(spark.createDataFrame(rows, "doc_id int, payload string")).collect()}
    assert got[1].page == 2 and got[1].blocks[0].text == "a" and got[1].blocks[0].bbox == [0.0] * 4 and got[1].error is None
    assert all(got[i].error and got[i].page is None and got[i].blocks is None for i in (2, 3, 5))
    assert got[4].page == 1 and got[4].blocks[0].label == "text" and got[4].tables[0].n_rows == 0 and got[6].text == ""


def test_restore_can_be_undone_and_blank_is_blank(spark):
    updates = spark.createDataFrame([(1, 1, "a", None, "n"), (1, 2, None, "c", "n"), (1, 3, "b", None, "n"), (2, 1, None, None, "n")], "template_id int, seq int, html string, css string, note string")
    kept = {(r.template_id, r.seq): (r.html, r.css) for r in K.revisions(updates).collect()}
    assert kept == {(1, 1): (None, None), (1, 2): ("a", None), (1, 3): ("a", "c")}
    asked = spark.createDataFrame([(1, 3, 9), (2, 5, 9)], "template_id int, revision int, seq int")
    after = K.restored(updates, asked)
    assert {r.template_id: (r.html, r.css) for r in K.now(after).collect()} == {1: ("a", "c"), 2: (None, None)}
    assert {(r.seq, r.html, r.css) for r in K.revisions(after).where("seq = 9").collect()} == {(9, "b", "c")}
    blank = K.restored(updates, spark.createDataFrame([(1, 1, 9)], "template_id int, revision int, seq int"))
    assert {(r.html, r.css) for r in K.now(blank).where("template_id = 1").collect()} == {("", "")}


def test_runs_are_appended(spark, tmp_path):
    for n in (1, 2):
        K.append_runs(spark.createDataFrame([("invoice", n, n, "e", 0.5 * n, {"a": 0.1, "b": 0.7} if n == 2 else None)], "doc_type string, created_at int, seq int, engine string, overall double, collections map<string,double>"), str(tmp_path / "runs"))
    found = K.latest_scores(spark.read.parquet(str(tmp_path / "runs"))).first()
    assert (found.runs, found.overall, found.line_score) == (2, 1.0, 0.7)


def test_extraction_isolates_documents(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int")
    pages = spark.createDataFrame([(1, 1, "the vendor Acme"), (2, 1, ""), (3, 1, "of nothing")], "doc_id int, page int, text string")
    extract = lambda p: p.where("contains(text, 'Acme')").select("doc_id", F.lit(0).alias("ord"), F.lit("vendor").alias("cls"), F.lit("Acme").alias("text"), F.lit(0.9).alias("confidence"))
    out = {r.doc_id: r for r in X.extracted(docs, pages, extract, [], {"prose": ["the", "of"]}, [], ["vendor"]).collect()}
    assert out[1].error is None and out[1].decision == "approve" and out[1].doc_type == "prose"
    assert {i: out[i].error for i in (2, 3, 4)} == {2: "no text", 3: "nothing was extracted", 4: "no pages"} and all(out[i].decision is None for i in (2, 3, 4))
    counts = X.batch_counts(spark.createDataFrame([(None,), ("x",)], "error string")).first()
    assert (counts.succeeded, counts.failed) == (1, 1)


def candidates(spark, rows):
    frame = spark.createDataFrame(rows, "case_id int, field string, doc_id string, doc_ord int, ord int, s string, n double")
    return frame.select("case_id", "field", "doc_id", "doc_ord", "ord", F.coalesce(V.text("s"), V.number("n")).alias("value"))


def test_ranges_settle_what_pairs_would(spark):
    """A field of many documents agrees exactly if all its pairs do."""
    rows = []
    for case, amounts in enumerate(([1.0, 1.005, 1.01], [1.0, 1.01, 1.02], [5.0], [None, None], [2.0, None, 2.0])):
        rows += [(case, "total", f"d{i}", i, 0, None, x) for i, x in enumerate(amounts)]
    for case, days in enumerate((["2024-01-01", "January 3, 2024", "1/4/2024"], ["2024-01-01", "2024-01-05"], ["2024-01-01", "soon"]), 10):
        rows += [(case, "invoice_date", f"d{i}", i, 0, x, None) for i, x in enumerate(days)]
    for case, names in enumerate((["Acme Ltd", "ACME  limited"], ["Acme Ltd", "Other Inc"]), 20):
        rows += [(case, "vendor", f"d{i}", i, 0, x, None) for i, x in enumerate(names)]
    rows += [(30, "party", "d0", 0, 0, "a", None), (30, "party", "d1", 1, 0, "x", None), (30, "party", "d1", 1, 1, "a", None), (30, "party", "d2", 2, 0, "a", None)]
    for settings in (Settings(), Settings(money_pct_tolerance=0.02)):
        frame = candidates(spark, rows)
        for fuzzy in (True, False):
            told = {r.case_id: r.agree for r in C.pairs(frame, settings, fuzzy).groupBy("case_id").agg(F.bool_and("agree").alias("agree")).collect()}
            got = {r.case_id: r.agreement for r in C.reconciled(frame, settings, fuzzy).collect()}
            assert got == {case: told.get(case, True) for case in got} and len(got) == 11
    assert not got[11] and not got[12] and got[20] and not got[21] and got[30]
