"""Queries of the rule engine and of formulas."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from paperloom.functions import expression, formats, fuzzy
from paperloom.functions import values as V
from paperloom.operators import rules as R
from paperloom.operators.fields import Fields
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import INVOICES, RUNS, invoice_fields, invoice_totals, invoices, runs, table, total_fields

P0 = [
    R.Presence(name="dated", severity="advisory", path="invoice_date"),
    R.Threshold(name="large", severity="hard", path="total", op="gte", threshold=50_000),
    R.PercentageTolerance(name="items", severity="review", path="item_sum", reference="total", fraction=0.5),
]
CHECKS = """, checks AS (
    SELECT o_orderkey, 'dated' AS name, o_orderdate IS NOT NULL AS passed, 'advisory' AS severity FROM inv
    UNION ALL SELECT o_orderkey, 'large', o_totalprice >= 50000, 'hard' FROM inv WHERE o_totalprice IS NOT NULL
    UNION ALL SELECT o_orderkey, 'items', abs(item_sum - o_totalprice) / abs(o_totalprice) <= 0.5, 'review' FROM inv WHERE o_totalprice <> 0)
, decided AS (
    SELECT o_orderkey, CASE WHEN count(*) FILTER (severity = 'hard' AND NOT passed) > 0 THEN 'flag'
        WHEN count(*) FILTER (severity = 'review' AND NOT passed) > 0 THEN 'needs_review' ELSE 'approve' END AS decision
    FROM checks GROUP BY o_orderkey)"""


@query("decision_counts", INVOICES + CHECKS + " SELECT decision, count(*) AS n FROM decided GROUP BY decision")
def decision_counts(spark, sf):
    docs = R.decided(invoice_totals(spark, sf), R.ruleset(P0, total_fields()))
    return docs.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("check_trace", INVOICES + CHECKS + " SELECT o_orderkey, name, passed, severity FROM checks")
def check_trace(spark, sf):
    docs = invoice_totals(spark, sf).select("o_orderkey", F.explode(R.ruleset(P0, total_fields())).alias("c"))
    return docs.select("o_orderkey", "c.name", "c.passed", "c.severity")


def _rule(name: str, rule: R.Rule, passed_sql: str, where: str = "true"):
    """A query of one rule over invoices: the checks that it makes."""
    sql = INVOICES + f" SELECT o_orderkey, ({passed_sql}) AS passed FROM inv WHERE ({where}) AND ({passed_sql}) IS NOT NULL"

    def run(spark, sf):
        docs = invoices(spark, sf).select("o_orderkey", R.check(rule, invoice_fields()).alias("c"))
        return docs.where("c is not null").select("o_orderkey", "c.passed")

    query(name, sql)(run)


_rule("rule_presence", R.Presence(name="r", path="return_flag"), "items[1].flag IS NOT NULL AND items[1].flag <> ''")
_rule("rule_threshold", R.Threshold(name="r", path="total", op="lte", threshold_setting="invoice_max_total"), "o_totalprice <= 10000")
_rule("rule_arithmetic", R.Arithmetic(name="r", result="total", a="first_amount", b="first_tax"), "abs(o_totalprice - (items[1].amount + items[1].tax)) <= 0.01")
_rule("rule_numeric_range", R.NumericRange(name="r", path="total", least=1000, most=200_000), "o_totalprice BETWEEN 1000 AND 200000")
_rule("rule_percentage_tolerance", R.PercentageTolerance(name="r", path="item_sum", reference="total", fraction=0.25), "abs(item_sum - o_totalprice) / abs(o_totalprice) <= 0.25", "o_totalprice <> 0")
_rule("rule_set_membership_exact", R.SetMembership(name="r", path="doc_type", allowed=("1-urgent", "2-HIGH")), "lower(o_orderpriority) IN ('1-urgent', '2-high')", "o_orderpriority <> ''")
_rule("rule_set_membership_substring", R.SetMembership(name="r", path="doc_type", allowed=("low", "spec"), mode="substring"), "contains(lower(o_orderpriority), 'low') OR contains(lower(o_orderpriority), 'spec')", "o_orderpriority <> ''")
_rule("rule_field_dependency", R.FieldDependency(name="r", antecedent="status", consequent="return_flag"), "NOT (o_orderstatus IS NOT NULL AND o_orderstatus <> '') OR coalesce(items[1].flag <> '', false)")
_rule("rule_conditional_presence", R.ConditionalPresence(name="r", condition="status", equals="F", required="has_items"), "NOT coalesce(o_orderstatus = 'F', false) OR n_items IS NOT NULL")
_rule("rule_mutual_exclusivity", R.MutualExclusivity(name="r", paths=("return_flag", "first_tax"), mode="at_most_one"), "coalesce(items[1].flag <> '', false)::INT + coalesce(items[1].tax <> 0, false)::INT <= 1")
_rule("rule_at_least_n", R.AtLeast(name="r", paths=("return_flag", "first_tax", "status"), n=3), "coalesce(items[1].flag <> '', false)::INT + coalesce(items[1].tax <> 0, false)::INT + coalesce(o_orderstatus <> '', false)::INT >= 3")
_rule("rule_required_together", R.Together(name="r", paths=("return_flag", "first_tax")), "coalesce(items[1].flag <> '', false)::INT + coalesce(items[1].tax <> 0, false)::INT IN (0, 2)")
_rule("rule_equality_regex", R.Equality(name="r", path="doc_type", expected="[0-9]-[A-Z ]+", mode="regex"), "regexp_full_match(o_orderpriority, '[0-9]-[A-Z ]+')")
_rule("rule_date_constraint", R.DateConstraint(name="r", path="invoice_date", not_future=True, least="1996-01-01", before="ship_date"), "o_orderdate::DATE <= DATE '2024-01-31' AND o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE < items[1].ship::DATE", "items[1].ship IS NOT NULL")
_rule("rule_aggregate", R.Aggregate(name="r", list_path="line_items", how="max", sub="qty", op="lte", value=40), "list_max(list_transform(items, lambda x: x.qty)) <= 40")
_rule("rule_signature_presence", R.SignaturePresence(name="r", list_path="signatures", n=2), "coalesce(len(list_filter(items, lambda x: x.state = 'F')), 0) >= 2")
_rule("rule_advisory", R.Advisory(name="r", path="doc_type", question="plausible?"), "true")
_rule("rule_expression", R.Formula(name="r", formula="total > 1000 and count('line_items') >= 3 or status == 'O'"), "CASE WHEN o_totalprice > 1000 AND coalesce(n_items, 0) >= 3 THEN true ELSE o_orderstatus = 'O' END")


@query("rule_contains", "SELECT doc_id, contains(lower(text), 'stupid') OR contains(lower(text), 'the') AS passed FROM documents WHERE text IS NOT NULL")
def rule_contains(spark, sf):
    f = Fields(values={"text": V.Text("text")})
    docs = table(spark, sf, "documents").select("doc_id", R.check(R.Contains(name="r", path="text", keywords=("stupid", "THE")), f).alias("c"))
    return docs.where("c is not null").select("doc_id", "c.passed")


@query("rule_length_bounds", "SELECT doc_id, length(text) BETWEEN 100 AND 5000 AS passed FROM documents WHERE text IS NOT NULL")
def rule_length_bounds(spark, sf):
    f = Fields(values={"text": V.Text("text")})
    docs = table(spark, sf, "documents").select("doc_id", R.check(R.LengthBounds(name="r", path="text", least=100, most=5000), f).alias("c"))
    return docs.where("c is not null").select("doc_id", "c.passed")


@query("rule_confidence_floor", RUNS + " SELECT seq, confidence >= 0.4 AS passed FROM runs")
def rule_confidence_floor(spark, sf):
    f = Fields(values={"k": V.Number("k")}, confidences={"k": F.col("confidence")})
    return runs(spark, sf).select("seq", R.check(R.ConfidenceFloor(name="r", path="k", floor=0.4), f)["passed"].alias("passed"))


@query("rule_grounded", RUNS + " SELECT seq, k > 3 AS passed FROM runs WHERE k IS NOT NULL")
def rule_grounded(spark, sf):
    f = Fields(values={"k": V.Number("k")}, pages={"k": F.when(F.col("k") > 3, F.col("k"))})
    docs = runs(spark, sf).select("seq", R.check(R.GroundedOnPage(name="r", path="k"), f).alias("c"))
    return docs.where("c is not null").select("seq", "c.passed")


@query("rule_equality_exact", "SELECT s_suppkey, s_name = c_name AS passed FROM supplier JOIN customer ON s_suppkey = c_custkey")
def rule_equality_exact(spark, sf):
    return _equality(spark, sf, "exact")


@query("rule_equality_normalized", r"""SELECT s_suppkey, lower(regexp_replace(trim(s_name), '\s+', ' ', 'g')) = lower(regexp_replace(trim(c_name), '\s+', ' ', 'g')) AS passed
FROM supplier JOIN customer ON s_suppkey = c_custkey""")
def rule_equality_normalized(spark, sf):
    return _equality(spark, sf, "normalized")


def _equality(spark, sf, mode):
    both = table(spark, sf, "supplier").join(table(spark, sf, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    f = Fields(values={"s": V.Text("s_name"), "c": V.Text("c_name")})
    return both.select("s_suppkey", R.check(R.Equality(name="r", path="s", expected_path="c", mode=mode), f)["passed"].alias("passed"))


@query("rule_equality_fuzzy")
def rule_equality_fuzzy(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", fuzzy.ratio_at_least(F.lower("p_name"), F.lit("blue widget"), 0.6).alias("passed"))


def _format(name: str, tab: str, key: str, value, value_sql: str, passed_sql: str):
    def run(spark, sf):
        return table(spark, sf, tab).select(key, formats.check(value(), name).alias("passed"))

    query(f"rule_format_{name}", f"SELECT {key}, ({passed_sql}) AS passed FROM (SELECT *, {value_sql} AS v FROM {tab})")(run)


@query("rule_format_email", r"""SELECT doc_id, len(string_split(text, ' '))::INT AS n_words,
    len(list_filter(string_split(text, ' '), lambda x: regexp_full_match(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[^@\s]+@[^@\s]+\.[^@\s]+')))::INT AS n_emails FROM documents""")
def rule_format_email(spark, sf):
    """How many of the words of each whole text are e-mail addresses."""
    words = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n_words"), F.size(F.filter(words, lambda w: formats.check(w, "email"))).alias("n_emails"))


_format("url", "pages", "page_id", lambda: F.col("url"), "url", r"regexp_full_match(trim(v), 'https?://\S+')")
_format("digits", "orders", "o_orderkey", lambda: F.col("o_orderkey").cast("string"), "o_orderkey::VARCHAR", "regexp_full_match(v, '[0-9]+')")
_format("alphanumeric", "orders", "o_orderkey", lambda: F.col("o_orderpriority"), "o_orderpriority", "regexp_full_match(trim(v), '[A-Za-z0-9]+')")
_format("uuid", "orders", "o_orderkey", lambda: F.col("o_orderpriority"), "o_orderpriority", "regexp_full_match(trim(v), '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')")
_format("iso_currency", "nation", "n_nationkey", lambda: F.substring("n_name", 1, 3), "substr(n_name, 1, 3)", "upper(v) IN (" + ", ".join(f"'{c}'" for c in formats.CURRENCIES) + ")")
_format("luhn", "orders", "o_orderkey", lambda: F.col("o_orderkey").cast("string"), "o_orderkey::VARCHAR", """length(v) >= 2 AND list_sum(list_transform(range(1, length(v) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(v), i, 1)::INT ELSE (2 * substr(reverse(v), i, 1)::INT) // 10 + (2 * substr(reverse(v), i, 1)::INT) % 10 END)) % 10 = 0""")


SERVED = ["AR", "BR", "CA", "CN", "DE", "EG", "ET", "FR", "GE", "ID", "IN", "IR", "JO", "JP", "KE", "MA", "MO", "NA", "PE", "RO", "RU", "SA", "US", "VN"]


@query("rule_format_iso_country", "SELECT n_nationkey, upper(trim(substr(n_name, 1, 2))) IN (" + ", ".join(f"'{c}'" for c in SERVED) + ") AS passed FROM nation")
def rule_format_iso_country(spark, sf):
    """The codes are a parameter: those of the countries that a business serves."""
    return table(spark, sf, "nation").select("n_nationkey", formats.check(F.substring("n_name", 1, 2), "iso_country", SERVED).alias("passed"))


@query("rule_format_iban", """SELECT o_orderkey, (substr(v, 5) || '1314' || substr(v, 3, 2))::HUGEINT % 97 = 1 AS passed
FROM (SELECT o_orderkey, 'DE' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad(o_custkey::VARCHAR, 18, '0') AS v FROM orders)""")
def rule_format_iban(spark, sf):
    code = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad(F.col("o_custkey").cast("string"), 18, "0"))
    return table(spark, sf, "orders").select("o_orderkey", formats.iban(code).alias("passed"))


def _formula(name: str, formula: str, sql: str, kind: str = "n"):
    def run(spark, sf):
        v = expression.compiled(formula, invoice_fields())[kind]
        return invoices(spark, sf).select("o_orderkey", (F.round(v, 4) if kind == "n" else v).alias("result"))

    query(name, INVOICES + f" SELECT o_orderkey, ({sql}) AS result FROM inv")(run)


_formula("dsl_arithmetic", "abs(total - 1000) * 2 / first_tax + -total % 7", "round(CASE WHEN items[1].tax <> 0 THEN abs(o_totalprice - 1000) * 2 / items[1].tax + (-o_totalprice - 7 * floor(-o_totalprice / 7)) END, 4)")
_formula("dsl_boolean_skip", "first_tax > 0.02 and total > 20000 or return_flag == 'R'", """CASE WHEN items[1].tax IS NULL THEN NULL
    WHEN items[1].tax > 0.02 AND o_totalprice > 20000 THEN true WHEN items[1].flag IS NULL THEN NULL ELSE items[1].flag = 'R' END""", "b")
_formula("dsl_aggregate", "round(sum_of('line_items', 'qty') + count('line_items') + 0.25, 2)", "coalesce(list_sum(list_transform(items, lambda x: x.qty)), 0.0) + coalesce(n_items, 0) + 0.25")
_formula("dsl_min_max_avg", "max_of('line_items', 'qty') - min_of('line_items', 'qty')", "list_max(list_transform(items, lambda x: x.qty)) - list_min(list_transform(items, lambda x: x.qty))")
_formula("dsl_dates", "days_between(invoice_date, ship_date)", "abs(date_diff('day', o_orderdate::DATE, items[1].ship::DATE))::DOUBLE")
_formula("dsl_strings", "upper(trim(doc_type))", "upper(trim(o_orderpriority))", "s")
_formula("dsl_matches", "matches(doc_type, '[0-9]-[HU].*') and len(doc_type) > 6", "regexp_full_match(o_orderpriority, '[0-9]-[HU].*') AND length(o_orderpriority) > 6", "b")
_formula("dsl_membership", "status in ['O', 'P'] and not is_present('first_tax')", "o_orderstatus IN ('O', 'P') AND NOT coalesce(items[1].tax <> 0, false)", "b")
_formula("dsl_chained", "1000 < total <= 100000", "o_totalprice > 1000 AND o_totalprice <= 100000", "b")


@query("uniqueness_history", RUNS + """, decided AS (SELECT DISTINCT k, doc_id FROM runs WHERE stage = 'purchase' AND k IS NOT NULL)
SELECT r.seq, count(DISTINCT d.doc_id) FILTER (d.doc_id <> r.doc_id) AS seen_before FROM runs r LEFT JOIN decided d ON d.k = r.k GROUP BY r.seq""")
def uniqueness_history(spark, sf):
    rows = runs(spark, sf).withColumn("is_decided", F.col("stage") == "purchase")
    return R.history(rows, "doc_id", "k", "is_decided").select("seq", "seen_before")


@query("document_decisions", INVOICES + CHECKS + """ SELECT o_orderkey, decision, CASE WHEN decision = 'flag' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
    CASE WHEN decision = 'needs_review' THEN 'needs_review' ELSE 'decided' END AS status FROM decided""")
def document_decisions(spark, sf):
    docs = R.decided(invoice_totals(spark, sf), R.ruleset(P0, total_fields()), extraction=F.lit(0.8))
    return docs.select("o_orderkey", "decision", F.col("decision_confidence").alias("confidence"), "status")


@query("rule_citations", RUNS + """, l AS (SELECT doc_id, stage || '.' || (k % 3) || '.k' AS path, seq AS ord, k AS page FROM runs WHERE k IS NOT NULL AND k % 5 <> 0),
f(field) AS (VALUES ('purchase'), ('view.1'), ('click.2.k'), ('nothing'))
SELECT doc_id, field, 'page ' || arg_min(page, (path <> field, ord)) AS source FROM l JOIN f ON path = field OR starts_with(path, field || '.') GROUP BY 1, 2""")
def rule_citations(spark, sf):
    page = F.when(F.col("k") % 5 != 0, F.col("k"))
    leaves = runs(spark, sf).select("doc_id", F.concat_ws(".", "stage", F.col("k") % 3, F.lit("k")).alias("path"), F.col("seq").alias("ord"), page.alias("page"))
    return R.citations(leaves, spark.createDataFrame([("purchase",), ("view.1",), ("click.2.k",), ("nothing",)], "field string"))


@query("invoice_ruleset", INVOICES + """, numbered AS (SELECT *, o_custkey || '-' || strftime(o_orderdate, '%Y%m') AS number, o_orderstatus = 'F' AS done FROM inv),
seen AS (SELECT n.o_orderkey, count(d.o_orderkey) FILTER (d.o_orderkey <> n.o_orderkey) AS n FROM numbered n LEFT JOIN numbered d ON d.number = n.number AND d.done GROUP BY 1),
r AS (SELECT * FROM numbered JOIN seen USING (o_orderkey))
SELECT o_orderkey, 'amount_limit' AS name, o_totalprice <= 10000 AS passed, 'review' AS severity FROM r WHERE o_totalprice IS NOT NULL
UNION ALL SELECT o_orderkey, 'total_math', coalesce(abs(o_totalprice - item_sum) <= 0.01 OR n_items IS NULL, true), CASE WHEN n_items IS NULL OR o_totalprice IS NULL THEN 'advisory' ELSE 'hard' END FROM r
UNION ALL SELECT o_orderkey, 'po_present', coalesce(o_orderpriority <> '' AND o_orderstatus = 'O', false), 'advisory' FROM r
UNION ALL SELECT o_orderkey, 'due_date_present', items[1].ship IS NOT NULL, 'advisory' FROM r
UNION ALL SELECT o_orderkey, 'bank_details', true, 'advisory' FROM r
UNION ALL SELECT o_orderkey, 'duplicate_invoice_no', n = 0, 'hard' FROM r WHERE number IS NOT NULL""")
def invoice_ruleset(spark, sf):
    f = invoice_fields()
    number = F.concat_ws("-", "o_custkey", F.date_format("o_orderdate", "yyyyMM"))
    # What the rules need of the items is read before invoices meet their history, so that the items stay where they are.
    item_sum = F.when(F.size("items") > 0, V.as_number(f.value("item_sum")))
    narrow = invoices(spark, sf).select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("po"), number.alias("number"), (F.col("o_orderstatus") == "F").alias("done"),
        V.as_text(f.value("ship_date")).alias("due"), item_sum.alias("item_sum"),
    )
    docs = R.history(narrow, "o_orderkey", "number", "done")
    own = {
        "invoice_no": V.Text("number"), "seen_before": V.Number("seen_before"), "po_number": V.Text("po"), "due_date": V.Text("due"),
        "subtotal": V.Number("item_sum"), "tax": V.Number(F.lit(0.0)),
    }
    f = replace(f, values=f.values | own)
    checks = docs.select("o_orderkey", F.explode(R.ruleset(R.invoice_rules(f.settings), f)).alias("c"))
    return checks.select("o_orderkey", "c.name", "c.passed", "c.severity")
