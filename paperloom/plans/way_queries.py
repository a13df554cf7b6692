"""Queries of the whole way of documents: orders as two-page invoices with OCR answers, customers as notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import definitions as N
from paperloom.operators import rules as R
from paperloom.operators import staged as S
from paperloom.operators.leaves import FieldDef
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import table
from paperloom.settings import Settings
from paperloom.sources import offline
from paperloom.sources import workbooks as W
from paperloom.sources.providers import Provider, Providers, answered
from paperloom.sources.snapshots import Snapshots, shared_folder

INVOICE = S.DocType(
    "invoice",
    (
        FieldDef("vendor", core=True), FieldDef("invoice_no", core=True), FieldDef("total", coerce="number", core=True),
        FieldDef("line_items", "list_composite", cls="item", core=True, subs=(("desc", "text"), ("qty", "number"), ("unit_price", "number"), ("amount", "number")), span_sub="desc"),
    ),
    (R.Threshold(name="limit", severity="hard", path="total", op="lte", threshold=250_000.0), R.Unique(name="once", path="invoice_no", seen_path="seen_before"), R.Presence(name="vendor", path="vendor")),
    key="invoice_no",
)
NOTE = S.DocType("note", (FieldDef("subject", core=True), FieldDef("segment", core=True)), (R.Presence(name="subject", path="subject"),))
WORDS = {"invoice": ["invoice", "total"], "note": ["subject", "segment"]}
UNREADABLE = "qty=50.0"


def _plan(structure: str, **more) -> S.Plan:
    providers = Providers(
        offline.stored_answers("fast"), offline.stored_answers_by_page("careful"), offline.by_vocabulary(WORDS), offline.labelled(),
        offline.labelled_by_section(unreadable=UNREADABLE), offline.approving(),
    )
    return S.Plan(providers, (INVOICE, NOTE), ("fast", "careful"), structure=structure, settings=Settings(section_min_chars=40, extraction_confidence_warn=0.7), **more)


def _answer(text: Column, sure: Column, tables: Column) -> Column:
    return F.struct(text.alias("text"), F.array(F.struct(text.alias("text"), F.lit("text").alias("label"), sure.alias("confidence"))).alias("blocks"), tables.alias("tables"))


def _document(doc_id: Column, doc_type: Column, pages: Column, scan: Column) -> list[Column]:
    none = F.lit(None)
    return [
        doc_id.alias("doc_id"), F.lit(False).alias("spreadsheet"), doc_type.cast("string").alias("doc_type"), none.cast("array<string>").alias("engines"),
        pages.alias("contents"), F.array(scan).alias("scans"), none.cast("string").alias("examples"),
    ]


def _scan(dpi: Column) -> Column:
    return F.struct(F.lit(1).alias("page"), dpi.alias("dpi"), F.lit(100.0).alias("sharpness"), F.lit(50.0).alias("contrast"), F.lit(200.0).alias("brightness"), F.lit(0.2).alias("ink"))


def _invoices(spark, sf) -> DataFrame:
    line = lambda x: F.format_string("Item: %d; qty=%s; amount=%.2f", x["l_partkey"], x["l_quantity"].cast("string"), x["l_extendedprice"])
    cells = lambda x: F.format_string("| %d | %.2f |", x["l_partkey"], x["l_extendedprice"])
    # Rows travel as their numbers, and become texts where their order is and only as its kind needs them; orders meet customers while they are narrow.
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_extendedprice")).alias("l"))
    names = table(spark, sf, "customer").select("c_custkey", "c_name").hint("merge")  # a row for each customer: nothing to broadcast
    rows = table(spark, sf, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    open_, bare = F.col("o_orderstatus") == "O", F.col("l").isNull()
    number = F.concat_ws("-", "o_custkey", F.substring("o_orderpriority", 1, 1))
    said = F.concat_ws("\n", F.lit("# Invoice"), F.concat(F.lit("Invoice No: "), number), F.concat(F.lit("Vendor: "), "c_name"), F.format_string("Total: $%.2f", "o_totalprice"))
    first = F.when(bare & F.col("o_orderpriority").startswith("3"), "nothing to see").otherwise(said)
    second = F.concat_ws("\n", F.lit("# Items"), F.when(~open_, F.array_join(F.sort_array(F.transform("l", line)), "\n")))
    none = F.array().cast("array<string>")
    tables = F.when(open_ & ~bare, F.array(F.concat(F.lit("| part | amount |\n|---|---|\n"), F.array_join(F.sort_array(F.transform("l", cells)), "\n")))).otherwise(none)

    def page(n: int, text: Column, some: Column) -> Column:
        sure = F.when(F.col("o_orderstatus") == "P", 0.2).otherwise(0.9)
        careful = F.when(~F.col("o_orderpriority").startswith("5"), _answer(text, F.lit(0.8), some))
        return F.struct(F.lit(n).alias("page"), F.to_json(F.struct(_answer(text, sure, some).alias("fast"), careful.alias("careful"))).alias("content"))

    kind = F.when((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("2"), "memo").when(~F.col("o_orderpriority").startswith("3"), "invoice")
    dpi = F.when(F.col("o_orderkey") % 50 == 0, 72.0).otherwise(300.0)
    rows = rows.withColumns({"first": first, "second": second, "tables": tables})  # each made once, though both engines have them
    first, second, tables = F.col("first"), F.col("second"), F.col("tables")
    return rows.select(*_document(F.col("o_orderkey"), kind, F.array(page(1, first, none), page(2, second, tables)), _scan(dpi)))


WAY = """
WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity = 50) AS fifty FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS doc_id, o_orderstatus AS s, o_orderpriority[1] AS p, coalesce(n, 0) AS n, coalesce(fifty, false) AS fifty, o_custkey || '-' || o_orderpriority[1] AS no, round(o_totalprice, 2) AS total
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey),
e AS (SELECT *, CASE WHEN s = 'P' AND p = '5' THEN 'ocr' WHEN s = 'P' AND p = '2' OR p = '3' AND n = 0 THEN 'classify' WHEN s <> 'O' AND fifty THEN 'structure' END AS failed_stage,
             CASE WHEN s = 'P' THEN 'careful' ELSE 'fast' END AS engine, CASE WHEN s = 'P' THEN 0.8 ELSE 0.9 END AS c FROM o),
c AS (SELECT *, round((3 * c + CASE WHEN n = 0 THEN 0 WHEN s = 'O' THEN 0.25 ELSE 0.75 * c END) / 4, 4)::DOUBLE AS confidence, failed_stage IS NULL AS fine FROM e),
d AS (SELECT *, min(doc_id) FILTER (fine) OVER (PARTITION BY no) < doc_id AS seen FROM c)
"""


@query("extraction_way", WAY + """SELECT doc_id, failed_stage, CASE WHEN coalesce(failed_stage, '') <> 'ocr' THEN engine END AS engine, CASE WHEN fine THEN confidence END AS confidence, CASE WHEN fine THEN total END AS total,
CASE WHEN fine THEN n END AS n_items, CASE WHEN fine THEN CASE WHEN total > 250000 THEN 'flag' WHEN seen OR confidence < 0.7 OR doc_id % 50 = 0 THEN 'needs_review' ELSE 'approve' END END AS decision FROM d""")
def extraction_way(spark, sf):
    keep = Snapshots(spark, shared_folder(spark, "way"))
    results, _ = S.extract(_invoices(spark, sf), _plan("labelled_by_section", window=100), keep)
    rows = F.size(F.filter("leaves", lambda x: x["path"].endswith(".desc"))).cast("long")
    total = F.get(F.filter("leaves", lambda x: x["path"] == "total"), F.lit(0))["value"]["n"]
    return results.select("doc_id", "failed_stage", "engine", "confidence", total.alias("total"), F.when(F.col("leaves").isNotNull(), rows).alias("n_items"), "decision")


@query("extraction_errors", WAY + """SELECT failed_stage AS stage, CASE failed_stage WHEN 'ocr' THEN 'careful' WHEN 'structure' THEN 'labelled_by_section' ELSE CASE WHEN s = 'P' AND p = '2' THEN 'no document type memo' ELSE 'the type can''t be told' END END AS why, count(*) AS documents
FROM e WHERE failed_stage IS NOT NULL GROUP BY 1, 2""")
def extraction_errors(spark, sf):
    keep = Snapshots(spark, shared_folder(spark, "way"))
    _, errors = S.extract(_invoices(spark, sf), _plan("labelled_by_section"), keep)
    return errors.groupBy("stage", F.substring_index("error", ":", 1).alias("why")).agg(F.count(F.lit(1)).alias("documents"))


def _notes(spark, sf, changed: bool) -> DataFrame:
    rows = table(spark, sf, "customer")
    name = F.when(F.lit(changed) & (F.col("c_custkey") % 10 == 0), F.concat("c_name", F.lit(" again"))).otherwise(F.col("c_name"))
    text = F.concat(F.lit("Subject: "), name, F.lit("\nSegment: "), F.col("c_mktsegment"))
    # Every seventh answer is written in another way: other bytes, the same text.
    plain = F.to_json(F.struct(_answer(text, F.lit(0.9), F.array().cast("array<string>")).alias("fast")))
    content = F.when(F.lit(changed) & (F.col("c_custkey") % 7 == 0), F.concat(plain, F.lit(" "))).otherwise(plain)
    bad = F.when(F.col("c_custkey") % 11 == 0, "memo").otherwise("note")
    return rows.select(*_document(F.col("c_custkey"), bad, F.array(F.struct(F.lit(1).alias("page"), content.alias("content"))), _scan(F.lit(300.0))))


@query("extraction_rerun", """WITH k AS (SELECT c_custkey % 10 = 0 AS edited, c_custkey % 7 = 0 AS rewritten, c_custkey % 11 = 0 AS bad FROM customer)
SELECT 'ocr' AS stage, count(*) FILTER (edited OR rewritten) AS documents FROM k UNION ALL SELECT 'classify', count(*) FILTER (edited OR bad) FROM k
UNION ALL SELECT 'structure', count(*) FILTER (edited AND NOT bad) FROM k UNION ALL SELECT 'decide', count(*) FILTER (edited AND NOT bad) FROM k""")
def extraction_rerun(spark, sf):
    """What a second run computes after some documents were edited: those, and those that had an error."""
    folder = shared_folder(spark, "notes")
    S.extract(_notes(spark, sf, False), _plan("labelled"), Snapshots(spark, folder, "first"))
    again = Snapshots(spark, folder, "second")
    S.extract(_notes(spark, sf, True), _plan("labelled"), again)
    return again.done().groupBy("stage").agg(F.count(F.lit(1)).alias("documents"))


@query("section_positions", """WITH t AS (SELECT conv_id AS doc_id, turn, coalesce(text, '') || CASE WHEN role = 'assistant' THEN chr(10) || chr(10) || '| t |' ELSE '' END AS text,
  count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) - (first_value(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn))::INT AS section FROM conversations)
SELECT doc_id, section, turn::INT AS page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, section ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, turn::INT AS page_of_last FROM t""")
def section_positions(spark, sf):
    """Where each page starts in its section's text, and the page that the place of its last letter leads back to."""
    block = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("role") == "user", "title").otherwise("text").alias("label"), F.lit(None).cast("double").alias("confidence"))
    tables = F.when(F.col("role") == "assistant", F.array(F.lit("| t |"))).otherwise(F.array().cast("array<string>"))
    page = F.struct(F.col("turn").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("double").alias("confidence"), F.array(block).alias("blocks"), tables.alias("tables"))
    docs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(page)).cast(S.PAGES).alias("pages"))
    parts = S.cut_sections(docs.withColumn("engine", F.lit(S.LAYOUT)))
    each = parts.select("doc_id", "section", "text", "offsets", F.posexplode("offsets").alias("n", "o"))
    after = F.coalesce(F.get("offsets", F.col("n") + 1)["start"] - 2, F.char_length("text"))
    return each.select("doc_id", F.col("section").cast("long").alias("section"), "o.page", F.col("o.start").cast("long").alias("start"), S.page_of(F.col("offsets"), F.greatest(after - 1, F.col("o.start"))).alias("page_of_last"))


@query("provider_errors", """SELECT doc_id, CASE WHEN NOT bad THEN length(coalesce(text, '')) END::BIGINT AS answer, CASE WHEN bad THEN 'lengths: nothing to answer to' END AS error
FROM (SELECT *, coalesce(text, '') = '' OR lang = 'de' AND doc_id % 3 = 0 AS bad FROM documents)""")
def provider_errors(spark, sf):
    """A provider that raises for some documents, in whose batches all others have their answers."""

    def lengths(some):
        if any(not x["text"] or (x["lang"] == "de" and x["doc_id"] % 3 == 0) for x in some):
            raise ValueError("nothing to answer to")
        return [len(x["text"]) for x in some]

    provider = Provider("judge", "lengths", ("doc_id", "text", "lang"), "bigint", call=lengths, batch=16, retries=0)
    return answered(table(spark, sf, "documents"), provider).select("doc_id", "answer", "error")


def _books(spark, sf) -> str:
    """A workbook for each nation: its customers' accounts with their sum as a formula, and a sheet about it."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_name", "c_acctbal", F.expr("row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)").alias("n"))
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    cell = lambda sheet, row, col, text=none_s, number=none_d, formula=none_s: F.struct(
        F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col"), text.alias("text"), number.alias("number"), formula.alias("formula")
    )
    one = c.select("c_nationkey", F.explode(F.array(cell("Accounts", F.col("n"), 0, text=F.col("c_name")), cell("Accounts", F.col("n"), 1, number=F.col("c_acctbal")))).alias("x"))
    sums = c.groupBy("c_nationkey").agg(F.max("n").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))
    formula = F.format_string("=SUM(B2:B%d)", F.col("n") + 1)
    total = sums.select("c_nationkey", F.explode(F.array(cell("Accounts", F.col("n") + 1, 1, number=F.col("total"), formula=formula), cell("Accounts", F.lit(0), 0, text=F.lit("name")))).alias("x"))
    about = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), cell("About", F.lit(0), 0, text=F.col("n_name")).alias("x"))
    cells = one.union(total).union(about).select(F.format_string("nation-%d.xlsx", "c_nationkey").alias("file"), "x.*")
    folder = shared_folder(spark, "books")
    W.write_workbooks(cells, folder).agg(F.count(F.lit(1))).collect()
    return folder


BOOKS = "WITH c AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total FROM customer GROUP BY 1)"


@query("workbook_sheets", BOOKS + """ SELECT 'nation-' || k || '.xlsx' AS file, 'Accounts' AS sheet, n + 2 AS max_row, 2 AS max_col, 2 * n + 2 AS cells, 1 AS formulas FROM c
UNION ALL SELECT 'nation-' || n_nationkey || '.xlsx', 'About', 1, 1, 1, 0 FROM nation""")
def workbook_sheets(spark, sf):
    return W.workbook(spark, _books(spark, sf), "sheets").select("file", "sheet", F.col("max_row").cast("long").alias("max_row"), "max_col", "cells", "formulas")


@query("workbook_grid", BOOKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
SELECT 'nation-' || c_nationkey || '.xlsx' AS file, 'A' || (i + 1) AS a1, c_name AS value, false AS is_formula FROM r WHERE i < 500 UNION ALL
SELECT 'nation-' || k || '.xlsx', 'A1', 'name', false FROM c UNION ALL SELECT 'nation-' || k || '.xlsx', 'B' || (n + 2), '=SUM(B2:B' || (n + 1) || ')', true FROM c WHERE n + 1 < 500""")
def workbook_grid(spark, sf):
    """Names and formulas of the accounts' grids, within the limits of a grid."""
    cells = W.workbook(spark, _books(spark, sf))
    return W.template_grid(cells, "Accounts").where("col = 0 or is_formula").select("file", "a1", "value", "is_formula")


@query("definition_problems", """WITH d AS (SELECT p_partkey AS id, p_size AS s, CASE WHEN p_size % 7 = 0 THEN 'price' ELSE 'brand' END AS second, CASE WHEN p_size % 4 = 0 THEN 'lost' ELSE 'brand' END AS core FROM part)
SELECT id, 'field' AS part, 1 AS place, 'the name is there already' AS problem FROM d WHERE second = 'price'
UNION ALL SELECT id, 'field', 1, '''kind'' must be one of composite, list_composite, list_scalar, presence, scalar, signature' FROM d WHERE s % 11 = 0
UNION ALL SELECT id, 'core', NULL, core || ' is no declared field' FROM d WHERE core <> second
UNION ALL SELECT id, 'rule', 0, '''field_path'' has the undeclared field gone' FROM d WHERE s % 3 = 0
UNION ALL SELECT id, 'rule', 0, '''op'' must be one of gt, gte, lt, lte' FROM d WHERE s % 5 = 0
UNION ALL SELECT id, 'rule', 1, '''min'' must be <= ''max''' FROM d WHERE s > 25
UNION ALL SELECT id, 'rule', 2, '''n'' must be <= the number of ''field_paths''' FROM d WHERE s % 3 + 1 > 2
UNION ALL SELECT id, 'rule', 2, '''field_paths'' has the undeclared field brand' FROM d WHERE second = 'price'
UNION ALL SELECT id, 'rule', 3, 'unknown field ''brand''' FROM d WHERE second = 'price'""")
def definition_problems(spark, sf):
    """Definitions of parts, with faults that follow from their sizes."""
    s, lit = F.col("p_size"), F.lit
    second, core = F.when(s % 7 == 0, "price").otherwise("brand"), F.when(s % 4 == 0, "lost").otherwise("brand")
    field = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    extraction = F.struct(
        F.col("p_name").alias("name"), F.array(field(lit("price"), lit("scalar")), field(second, F.when(s % 11 == 0, "odd").otherwise("scalar"))).alias("fields"),
        F.array(lit("price"), core).alias("core_paths"),
    )
    rule = lambda kind, **more: F.to_json(F.struct(lit(kind).alias("kind"), *(c.alias(k) for k, c in more.items())))
    listed = F.concat_ws(
        ",", rule("threshold", field_path=F.when(s % 3 == 0, "gone").otherwise("price"), op=F.when(s % 5 == 0, "eq").otherwise("lte"), threshold=lit(1.5)),
        rule("numeric_range", field_path=lit("price"), min=s, max=lit(25)), rule("at_least_n_of", field_paths=F.array(lit("price"), lit("brand")), n=s % 3 + 1),
        rule("expression", expression=lit("price > 1 and brand != 'x'")),
    )
    rules = F.concat(lit('{"name":"r","rules":['), listed, lit("]}"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.to_json(extraction).alias("extraction"), rules.alias("rules"))
    return N.problems(rows).drop("name")


@query("definition_preview", """SELECT c_custkey AS draft_id, (c_custkey % 3 = 0)::INT AS problems, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS subject, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 0.45 ELSE 0.9 END::DOUBLE END AS confidence FROM customer""")
def definition_preview(spark, sf):
    """A draft for each customer, tried on their note: every third has a core field that it doesn't declare, every fifth one that isn't there."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    field = lambda name: F.struct(name.alias("name"), F.lit("scalar").alias("kind"))
    second = F.when(k % 5 == 0, "absent").otherwise("segment")
    draft = F.struct(F.lit("d").alias("name"), F.array(field(F.lit("subject")), field(second)).alias("fields"), F.array(F.lit("subject"), F.when(k % 3 == 0, "gone").otherwise(second)).alias("core_paths"))
    text = F.concat(F.lit("Subject: "), "c_name", F.lit("\nSegment: "), "c_mktsegment")
    page = F.struct(F.lit(1).alias("page"), text.alias("text"), F.lit(0.9).alias("confidence"), F.array().cast("array<struct<text:string,label:string,confidence:double>>").alias("blocks"), F.array().cast("array<string>").alias("tables"))
    docs = c.select(k.alias("doc_id"), F.lit("fast").alias("engine"), F.array(page).cast(S.PAGES).alias("pages"), F.lit(0.9).alias("ocr_confidence"))
    drafts = c.select(k.alias("draft_id"), k.alias("doc_id"), F.to_json(draft).alias("extraction"))
    found = S.preview(drafts, docs, _plan("labelled"), Snapshots(spark, shared_folder(spark, "drafts")))
    subject = F.get(F.filter("leaves", lambda x: x["path"] == "subject"), F.lit(0))["value"]["s"]
    return found.select("draft_id", F.size("problems").alias("problems"), subject.alias("subject"), "confidence")
