"""The whole way of documents, its stages and providers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import documents as D
from paperloom.operators import rules as R
from paperloom.operators import staged as S
from paperloom.operators.leaves import FieldDef
from paperloom.settings import Settings
from paperloom.sources import offline
from paperloom.sources.providers import Provider, Providers, answered
from paperloom.sources.snapshots import Snapshots

DOCS = (
    "doc_id long, spreadsheet boolean, doc_type string, engines array<string>, contents array<struct<page:int,content:string>>, "
    "scans array<struct<page:int,dpi:double,sharpness:double,contrast:double,brightness:double,ink:double>>, examples string"
)
INVOICE = S.DocType(
    "invoice",
    (
        FieldDef("vendor", core=True), FieldDef("invoice_no", core=True), FieldDef("total", coerce="number", core=True), FieldDef("stamp", "presence"),
        FieldDef("parties", "list_scalar", cls="party", dedup=True), FieldDef("clause", "composite", cls="clause", subs=(("text", "text"), ("days", "number")), span_sub="text"),
        FieldDef("line_items", "list_composite", cls="item", core=True, subs=(("desc", "text"), ("qty", "number"), ("unit_price", "number"), ("amount", "number")), span_sub="desc"),
    ),
    (R.Presence(name="vendor", path="vendor"), R.Threshold(name="limit", severity="hard", path="total", op="lte", threshold=1000.0), R.Unique(name="once", path="invoice_no", seen_path="seen_before")),
    key="invoice_no",
)
NOTE = S.DocType("note", (FieldDef("subject", core=True),))
WORDS = {"invoice": ["invoice", "total"], "note": ["subject", "note"]}
FINE = (1, 200.0, 100.0, 50.0, 200.0, 0.2)


def plan(structure="", judge="", **more):
    providers = Providers(
        offline.stored_answers("fast"), offline.stored_answers_by_page("careful"), offline.by_vocabulary(WORDS), offline.labelled(),
        offline.labelled_by_section(unreadable="~~~"), offline.approving(), offline.by_word("acme"),
    )
    return S.Plan(providers, (INVOICE, NOTE), ("fast", "careful"), structure=structure, judge=judge, settings=more.pop("settings", Settings(section_min_chars=5)), **more)


def page(n, text, sure=0.9, tables=(), label="text", careful=None):
    blocks = [{"text": x, "label": "title" if x.startswith("#") else label, "confidence": sure} for x in text.split("\n")]
    content = {"fast": {"text": text, "blocks": blocks, "tables": list(tables)}}
    if careful is not None:
        content["careful"] = {"text": careful, "blocks": [{"text": careful, "label": "text", "confidence": 0.8}], "tables": []}
    return (n, json.dumps(content))


def doc(i, pages, doc_type=None, scans=(FINE,), engines=None, spreadsheet=False):
    return (i, spreadsheet, doc_type, engines, pages, list(scans), None)


TEXT = "# Invoice\nInvoice No: {no}\nVendor: Acme\nTotal: $120.50\nParty: Acme Inc.\nParty: ACME INC (buyer)\nClause: pay soon; days=30"
ITEMS = "# Items\nItem: bolt; qty=2; unit_price=1.5; amount=3\nItem: nut; qty=x; amount=4"


def run(spark, tmp_path, rows, the_plan, name="run", prior=None):
    keep = Snapshots(spark, f"file://{tmp_path}/kept", name)
    results, errors = S.extract(spark.createDataFrame(rows, DOCS), the_plan, keep, prior)
    done = {(r.stage, int(r.id)) for r in keep.done().collect()}
    return {r.doc_id: r for r in results.collect()}, {(r.doc_id, r.stage): r.error for r in errors.collect()}, done


def leaves(row):
    return {x.path: (x.value.s if x.value.kind == "string" else x.value.n if x.value.kind == "number" else x.value.b) if x.value else None for x in row.leaves}


@pytest.mark.parametrize("structure, window", [("labelled", 8000), ("labelled_by_section", 10)])
def test_one_document(spark, tmp_path, structure, window):
    """Both providers, read as a whole and in sections, give the same fields."""
    found, errors, _ = run(spark, tmp_path, [doc(1, [page(1, TEXT.format(no="A-1")), page(2, ITEMS)])], plan(structure, window=window))
    row = found[1]
    assert errors == {} and row.failed_stage is None and row.doc_type == "invoice" and row.guessed and row.engine == "fast"
    assert leaves(row) == {
        "vendor": "Acme", "invoice_no": "A-1", "total": 120.5, "stamp": False, "parties.0": "Acme Inc.", "clause.text": "pay soon", "clause.days": 30.0,
        "line_items.0.desc": "bolt", "line_items.0.qty": 2.0, "line_items.0.unit_price": 1.5, "line_items.0.amount": 3.0,
        "line_items.1.desc": "nut", "line_items.1.qty": None, "line_items.1.unit_price": None, "line_items.1.amount": 4.0,
    }
    by_path = {x.path: x for x in row.leaves}
    assert by_path["vendor"].page == 1 and by_path["line_items.0.qty"].page == 2 and by_path["line_items.1.qty"].confidence == 0.45
    assert by_path["vendor"].confidence == 0.9 and by_path["stamp"].confidence == 0.0 and by_path["line_items.1.unit_price"].confidence == 0.0
    # vendor, invoice_no, total 0.9; items: (4 * 0.9 + 0.9 + 0.45 + 0 + 0.9) / 8
    assert row.confidence == round((3 * 0.9 + (4 * 0.9 + 0.9 + 0.45 + 0.9) / 8) / 4, 4)
    assert row.decision == "approve" and row.verdict == "pass"
    assert any("sections" in w for w in row.warnings) == (window == 10)


def test_every_stage_keeps_its_errors_apart(spark, tmp_path):
    low = "# Invoice\nTotal: $5000\nInvoice No: L"
    rows = [
        doc(1, [page(1, TEXT.format(no="A"))]),
        doc(2, [page(1, TEXT.format(no="B"), sure=0.1)]),  # the fast engine is unsure, the careful one has no answer
        doc(3, [page(1, TEXT.format(no="C"), sure=0.1, careful=TEXT.format(no="C"))]),
        doc(4, [page(1, "nothing to see")]),
        doc(5, [page(1, TEXT.format(no="E"))], doc_type="memo"),
        doc(6, [page(1, TEXT.format(no="F") + "\n~~~")]),
        doc(7, [page(1, low)]),
        doc(8, [page(1, TEXT.format(no="A"))], scans=[(1, 50.0, 100.0, 50.0, 200.0, 0.2)]),
        doc(9, [page(1, "Subject: hello note")], engines=["unheard of"]),
        doc(10, None), doc(11, [page(1, "Subject: a note")], doc_type="note"),
    ]
    found, errors, _ = run(spark, tmp_path, rows, plan("labelled_by_section"))
    assert {k: v.split(":")[0] for k, v in errors.items()} == {
        (2, "ocr"): "careful", (4, "classify"): "the type can't be told", (5, "classify"): "no document type memo", (6, "structure"): "labelled_by_section",
        (9, "ocr"): "no usable OCR engine", (10, "ocr"): "careful",
    }
    assert {i: r.failed_stage for i, r in found.items() if r.failed_stage} == {i: s for i, s in errors}
    assert {i: r.decision for i, r in found.items() if r.decision} == {1: "approve", 3: "approve", 7: "flag", 8: "needs_review", 11: "approve"}
    assert found[3].engine == "careful" and any("fell back" in w for w in found[3].warnings)
    assert any("prescan_quality" in r for r in found[8].reasons) and any("once" in r for r in found[8].reasons)
    assert found[7].reasons == ["Failed rule: limit — limit"]


def test_a_run_does_what_has_changed(spark, tmp_path):
    rows = [doc(i, [page(1, TEXT.format(no=f"N{i}"))]) for i in range(1, 6)]
    first, _, done = run(spark, tmp_path, rows, plan(), "one")
    assert done == {(s, i) for s in ("prescan", "ocr", "classify", "structure", "decide") for i in range(1, 6)}
    again, _, done = run(spark, tmp_path, rows, plan(), "two")
    assert done == set() and again == first
    rows[2] = doc(3, [page(1, TEXT.format(no="changed"))])
    rows[0] = doc(1, [(1, rows[0][4][0][1] + " ")])  # other bytes, the same text: no stage after OCR has anything to do
    rows.append(doc(6, [page(1, "nothing")]))
    after, errors, done = run(spark, tmp_path, rows, plan(), "three")
    assert done == {("ocr", 1), ("ocr", 3), ("classify", 3), ("structure", 3), ("decide", 3), ("prescan", 6), ("ocr", 6), ("classify", 6)}
    assert set(errors) == {(6, "classify")} and leaves(after[3])["invoice_no"] == "changed"
    assert {i: r for i, r in after.items() if i not in (3, 6)} == {i: r for i, r in first.items() if i != 3}
    # Another judge: decisions only; and the document that failed is tried again.
    _, _, done = run(spark, tmp_path, rows, plan(judge="by_word"), "four")
    assert done == {("decide", i) for i in range(1, 6)} | {("classify", 6)}


def test_history(spark, tmp_path):
    prior = spark.createDataFrame([(100, "invoice", "N1"), (2, "invoice", "N2"), (50, "note", "N3")], "doc_id long, doc_type string, value string")
    rows = [doc(i, [page(1, TEXT.format(no=no))]) for i, no in ((1, "N1"), (2, "N2"), (3, "N3"), (4, "N4"), (5, "N4"))]
    found, _, _ = run(spark, tmp_path, rows, plan(), prior=prior)
    assert {i: r.decision for i, r in found.items()} == {1: "needs_review", 2: "approve", 3: "approve", 4: "approve", 5: "needs_review"}


def test_rows_from_tables_and_anchors_of_the_whole(spark, tmp_path):
    table = "| what | n | price |\n|---|---|---|\n| bolt | 2 | 3.50 |\n| sum | | |\n| nut | 1 | 4.00 |"
    found, _, _ = run(spark, tmp_path, [doc(1, [page(1, TEXT.format(no="T")), page(2, "# End\nsee above", tables=[table])])], plan(window=10))
    assert [leaves(found[1])[f"line_items.{i}.{s}"] for i in (0, 1) for s in ("desc", "qty", "amount")] == ["bolt", None, "3.50", "nut", None, "4.00"]
    assert {x.page for x in found[1].leaves if x.path == "line_items.1.desc"} == {2} and any("tables" in w for w in found[1].warnings)

    elsewhere = Provider("structure", "elsewhere", ("text",), S.SPANS, call=lambda some: [[{"cls": "vendor", "text": "see above", "attributes": [], "char_start": None, "char_end": None}] for _ in some])
    the_plan = plan("elsewhere", window=10)
    the_plan.providers.register(elsewhere)
    found, _, _ = run(spark, tmp_path, [doc(1, [page(1, TEXT.format(no="T") * 3), page(2, "# End\nsee above")])], the_plan, "two")
    vendor = next(x for x in found[1].leaves if x.path == "vendor")
    assert (vendor.page, vendor.alignment, vendor.confidence) == (2, "exact", 0.9)


def test_sections_keep_pages_and_tables(spark):
    """Places of every section's text lead back to their pages."""
    pages = [(1, "intro\n# One\na", None, [], []), (2, "b\n# Two", None, [], ["| t |"]), (3, "", None, [], ["| u |", ""]), (4, "c", None, [], [])]
    frame = spark.createDataFrame([(1, "vlm", pages)], f"doc_id long, engine string, pages {S.PAGES}")
    rows = {r.section: r for r in S.cut_sections(frame).collect()}
    assert [(rows[i].title, rows[i].text) for i in range(3)] == [(None, "intro"), ("One", "# One\na\n\nb\n\n| t |"), ("Two", "# Two\n\n\n\n| u |\n\nc")]
    assert [(o.page, o.start) for o in rows[2].offsets] == [(2, 0), (3, 7), (4, 16)]
    text, offsets = frame.select(S.structuring_text(F.col("pages")).alias("w")).first().w
    assert text == "intro\n# One\na\n\nb\n# Two\n\n| t |\n\n\n\n| u |\n\nc"
    for o, p in zip(offsets, pages):
        assert text[o.start :].startswith(p[1])
    folded = S.folded_sections(S.cut_sections(frame), least=7).first().sections
    assert [(x.title, x.text) for x in folded] == [("One", "intro\n\n# One\na\n\nb\n\n| t |"), ("Two", "# Two\n\n\n\n| u |\n\nc")]
    assert [[(o.page, o.start) for o in x.offsets] for x in folded] == [[(1, 0), (1, 7), (2, 16)], [(2, 0), (3, 7), (4, 16)]]


def test_layout_sections(spark):
    block = lambda t, label="text": (t, label, 0.9)
    pages = [(1, "x", 0.9, [block("A", "title"), block("a")], []), (2, "y", 0.9, [], ["| t |"]), (3, "z", 0.9, [block("B", "section_header"), block("b")], [])]
    frame = spark.createDataFrame([(1, "docling", pages)], f"doc_id long, engine string, pages {S.PAGES}")
    rows = {r.section: (r.title, r.text, [(o.page, o.start) for o in r.offsets]) for r in S.cut_sections(frame).collect()}
    assert rows == {0: ("A", "A\na", [(1, 0)]), 1: ("B", "\n\n| t |\n\nB\nb", [(2, 0), (3, 9)])}


def test_provider_loses_only_the_row_it_cannot_answer(spark):
    def call(some):
        if any(x["n"] == 13 for x in some):
            raise RuntimeError("thirteen")
        return [x["n"] * 2 if x["n"] != 20 else "not a number" for x in some]

    rows = spark.range(40).select(F.col("id").alias("n"), F.lit("kept").alias("more"))
    found = answered(rows, Provider("judge", "doubling", ("n",), "bigint", call=call, batch=8)).collect()
    assert {r.n: r.answer for r in found} == {n: None if n in (13, 20) else 2 * n for n in range(40)}
    assert {r.n for r in found if r.error} == {13, 20} and next(r.error for r in found if r.n == 13) == "doubling: thirteen"
    assert {r.more for r in found} == {"kept"}


def test_providers_are_chosen_by_name():
    held = Providers(offline.approving(), offline.by_word("x"))
    assert held.chosen("judge").name == "approving" and held.chosen("judge", "by_word").name == "by_word"
    with pytest.raises(ValueError, match="approving, by_word"):
        held.chosen("judge", "other")
    with pytest.raises(ValueError, match="there already"):
        held.register(offline.approving())
    with pytest.raises(ValueError, match="needs a column or a call"):
        Provider("judge", "neither", (), "int")
    with pytest.raises(ValueError, match="no kind"):
        Provider("paint", "x", (), "int", call=list)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], plan()) == ({}, {}, set())


def test_preview_of_drafts(spark, tmp_path):
    """Drafts of one plan: a good one gives what the whole way gives, a bad one its problems."""
    whole, _, _ = run(spark, tmp_path, [doc(1, [page(1, TEXT.format(no="P")), page(2, ITEMS)])], plan())
    sub = lambda name, source="attribute", coerce="number", **more: {"name": name, "source": source, "coerce": coerce, **more}
    good = {"name": "d", "core_paths": ["vendor", "line_items"], "fields": [
        {"name": "vendor", "kind": "scalar"}, {"name": "stamp", "kind": "presence"}, {"name": "parties", "kind": "list_scalar", "cls": "party", "dedup": True},
        {"name": "clause", "kind": "composite", "sub_fields": [sub("text", "span", "text"), sub("within", attr_key="days")]},
        {"name": "line_items", "kind": "list_composite", "cls": "item", "sub_fields": [sub("desc", "span", "text"), sub("amount")]},
    ]}
    bad = {"name": "d", "core_paths": ["gone"], "fields": [{"name": "vendor", "kind": "scalar"}, {"name": "vendor", "kind": "odd"}]}
    drafts = spark.createDataFrame([(1, 1, json.dumps(good)), (2, 1, json.dumps(bad)), (3, 1, "no json"), (4, 99, json.dumps(good))], "draft_id int, doc_id long, extraction string")
    keep = Snapshots(spark, f"file://{tmp_path}/kept", "preview")
    docs = keep.all("ocr").select("doc_id", "engine", "pages", F.col("confidence").alias("ocr_confidence"))
    found = {r.draft_id: r for r in S.preview(drafts, docs, plan(), keep).collect()}
    assert leaves(found[1]) == {
        "vendor": "Acme", "stamp": False, "parties.0": "Acme Inc.", "clause.text": "pay soon", "clause.within": 30.0,
        "line_items.0.desc": "bolt", "line_items.0.amount": 3.0, "line_items.1.desc": "nut", "line_items.1.amount": 4.0,
    }
    same = {x.path: x for x in whole[1].leaves}
    assert all(x == same[x.path] for x in found[1].leaves if x.path != "clause.within") and found[1].confidence == 0.9 and found[1].problems == []
    assert [p.split(" - ")[0] for p in found[2].problems] == ["core", "field vendor", "field vendor"] and found[2].leaves is None
    assert found[3].problems == ["extraction - must be a JSON object"] and found[4].leaves is None and found[4].problems == []


def test_a_mean_that_is_a_tie_is_rounded_as_its_exact_value(spark, tmp_path):
    """(3 * 0.9 + 0.675) / 4 is 0.84375, whatever the sum of 48 confidences is off by."""
    items = "# Items\n" + "\n".join(f"Item: bolt {i}; qty=2; amount=3" for i in range(12))
    found, _, _ = run(spark, tmp_path, [doc(1, [page(1, TEXT.format(no="A-1")), page(2, items)])], plan())
    assert found[1].confidence == 0.8438


def test_a_run_keeps_one_copy_of_what_it_makes(spark, tmp_path):
    """Of what the stages write for themselves nothing is left, and a page's tables go with one of its lines."""
    run(spark, tmp_path, [doc(i, [page(1, TEXT.format(no=f"N{i}")), page(2, ITEMS)]) for i in range(3)], plan(window=10))
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "kept/_scratch").iterdir()} == {"documents", "errors"}
    pages = [(1, "a\nb\nc", None, [], ["| t |"]), (2, "", None, [], ["| u |"])]
    frame = spark.createDataFrame([(1, "vlm", pages)], f"doc_id long, engine string, pages {S.PAGES}")
    assert [(r.pi, r.ui, r.tables) for r in S.units(frame).orderBy("pi", "ui").collect()] == [(0, 0, ["| t |"]), (0, 1, None), (0, 2, None), (1, 0, ["| u |"])]


def test_documents_do_not_go_through_the_driver(spark, tmp_path):
    """Files say little of the rows in them, so no join of documents is left to their size: only the types' definitions are broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()

    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        some = store.executionsList()
        return [some.apply(k).physicalPlanDescription() for k in range(some.size())]

    before = len(plans())
    rows = [doc(i, [page(1, TEXT.format(no=f"N{i}")), page(2, ITEMS)]) for i in range(4)]
    run(spark, tmp_path, rows, plan(window=10), "one")
    rows[1] = doc(1, [page(1, TEXT.format(no="changed"))])
    run(spark, tmp_path, rows, plan(window=10), "two")
    assert sum("BroadcastHashJoin" in p for p in plans()[before:]) == 2  # the definitions of two runs


def test_pages_and_sections_stay_in_the_row_of_their_document(spark):
    pages = [(1, "# A\na\n#\n# B", None, [], ["| t |"]), (2, "b\n# C\r\nc", None, [], [])]
    frame = spark.createDataFrame([(1, "vlm", pages)], f"doc_id long, engine string, pages {S.PAGES}")
    found = S.sectioned(frame, plan(window=5, settings=Settings(section_min_chars=1)))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(s.title, s.text, [tuple(o) for o in s.offsets]) for s in found.first().sections] == [
        ("A", "# A\na\n#\n\n| t |", [(1, 0)]), ("B", "# B\n\nb", [(1, 0), (2, 5)]), ("C", "# C\r\nc", [(2, 0)]),
    ]


def test_elements_of_arrays_are_asked_for_without_a_row_for_each(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(some):
        calls.add(1)
        if any(x["n"] in (3, 4) for x in some):
            raise RuntimeError(" ".join(str(x["n"]) for x in some))
        return [x["n"] * x["by"] for x in some]

    rows = [(1, 10, [(1,), (2,)]), (2, 10, []), (3, 10, None), (4, 100, [(4,), (3,), (5,)]), (5, 1, [(6,)])]
    frame = spark.createDataFrame(rows, "k int, by int, some array<struct<n:int>>").coalesce(1)
    batch = answered(frame, Provider("judge", "product", ("n", "by"), "bigint", call=call, batch=4), each="some").collect()
    assert {r.k: (r.answer, r.error) for r in batch} == {1: ([10, 20], None), 2: ([], None), 3: ([], None), 4: ([None, None, 500], "product: 3"), 5: ([6], None)}
    # Of 1 2 4 3 | 5 6 the first batch and its lone rows are tried twice, its halves once.
    assert calls.value == 2 + 1 + 1 + 2 + 2 + 1
    native = answered(frame, Provider("judge", "product", ("n", "by"), "bigint", column=lambda c: c["n"] * c["by"]), each="some").collect()
    assert {r.k: r.answer for r in native} == {1: [10, 20], 2: [], 3: None, 4: [400, 300, 500], 5: [6]}


def test_the_nearest_occurrence_is_found_without_python(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aé😀") for _ in range(rng.randint(0, n)))
    rows = [(k, word(3), word(12), rng.choice([None, *range(-2, 15)])) for k in range(400)] + [(400, "a", None, 3), (401, None, "a", 3)]
    found = spark.createDataFrame(rows, "k int, needle string, hay string, hint int").select("*", D.nearest(F.col("needle"), F.col("hay"), F.col("hint")).alias("at"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        some = [i for i in range(len(r.hay or "")) if r.needle and r.hay.startswith(r.needle, i)]
        want = min(some, key=lambda i: (abs(i - (r.hint or 0)), i) if r.hint is not None else i, default=-1)
        assert r.at == want or (r.hay is None and r.at is None), r


def test_a_second_run_looks_up_what_is_kept_by_sorting(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("x"))
    compute = lambda docs: docs.select("doc_id", (F.col("x") * 2).alias("y"), F.lit(None).cast("string").alias("error"), "_key")
    Snapshots(spark, f"file://{tmp_path}/kept", "one").stage("ocr", "1", rows, compute)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsList().size()
    again = Snapshots(spark, f"file://{tmp_path}/kept", "two")
    found = again.stage("ocr", "1", rows.withColumn("x", F.when(F.col("doc_id") == 7, 50).otherwise(F.col("x"))), compute).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    some = store.executionsList()
    assert not any("BroadcastHashJoin" in some.apply(k).physicalPlanDescription() for k in range(before, some.size()))
    assert {r.doc_id: r.y for r in found} == {i: 100 if i == 7 else i % 3 * 2 for i in range(20)}
    assert [r.id for r in again.done().collect()] == ["7"]
