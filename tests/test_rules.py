import pytest
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import rules as R
from paperloom.operators.fields import Fields
from paperloom.settings import DEFAULT


def fields(**more):
    values = {"total": V.Number(F.lit(110.0)), "subtotal": V.Number(F.lit(100.0)), "tax": V.Number(F.lit(10.0)), "zero": V.Number(F.lit(0.0)), "vendor": V.Text(F.lit(" Acme  Ltd ")), "same": V.Text(F.lit("acme ltd")), "empty": V.Text(F.lit("")), "gone": V.Text(F.lit(None).cast("string")), "day": V.Text(F.lit("2024-01-10")), "later": V.Text(F.lit("2024-02-10")), "odd": V.Text(F.lit("soon"))}
    lists = {"items": F.array(*(F.struct(V.number(F.lit(x)).alias("amount")) for x in (60.0, 50.0))), "signatures": F.array(V.boolean(F.lit(True)), V.boolean(F.lit(False))), "none": F.array().cast(f"array<{V.VALUE}>")}
    return Fields(values=values, lists=lists, composite=frozenset({"items"}), confidences={"total": F.lit(0.4)}, pages={"total": F.lit(1), "vendor": F.lit(None).cast("int")}, **more)


CASES = [
    (R.Presence(name="r", path="total"), True), (R.Presence(name="r", path="zero"), False), (R.Presence(name="r", path="nowhere"), False),
    (R.Threshold(name="r", path="total", op="lte", threshold=100), False), (R.Threshold(name="r", path="total", op="lte", threshold_setting="invoice_max_total"), True), (R.Threshold(name="r", path="vendor", op="lt", threshold=1), None),
    (R.Arithmetic(name="r", result="total", a="subtotal", b="tax"), True), (R.Arithmetic(name="r", result="total", a="subtotal", b="gone"), None),
    (R.SetMembership(name="r", path="same", allowed=("ACME LTD",)), True), (R.SetMembership(name="r", path="same", allowed=("acme",)), False), (R.SetMembership(name="r", path="same", allowed=("acme",), mode="substring"), True),
    (R.SetMembership(name="r", path="gone", allowed=("x",)), None), (R.SetMembership(name="r", path="gone", allowed=("x",), absent="pass"), True), (R.SetMembership(name="r", path="same", allowed=()), None), (R.SetMembership(name="r", path="same", allowed=(), empty="pass"), True),
    (R.FieldDependency(name="r", antecedent="total", consequent="gone"), False), (R.FieldDependency(name="r", antecedent="gone", consequent="gone"), True),
    (R.Equality(name="r", path="vendor", expected_path="same"), False), (R.Equality(name="r", path="vendor", expected_path="same", mode="normalized"), True), (R.Equality(name="r", path="same", expected="acme.*", mode="regex"), True),
    (R.Equality(name="r", path="same", expected="acme lt", mode="fuzzy"), True), (R.Equality(name="r", path="same", expected="acme ltd", negate=True), False), (R.Equality(name="r", path="gone", expected="x"), None),
    (R.DateConstraint(name="r", path="day", not_future=True, least="2024-01-10", most="2024-01-10", before="later"), True), (R.DateConstraint(name="r", path="later", not_future=True), False), (R.DateConstraint(name="r", path="day", after="later"), False),
    (R.DateConstraint(name="r", path="day", before="odd"), None), (R.DateConstraint(name="r", path="odd", not_future=True), None),
    (R.Formula(name="r", formula="total == subtotal + tax"), True), (R.Formula(name="r", formula="gone == 1"), None),
    (R.Aggregate(name="r", list_path="items", how="sum", sub="amount", op="eq", compare_path="total"), True), (R.Aggregate(name="r", list_path="nolist", how="sum", op="eq", value=0.0), None), (R.Aggregate(name="r", list_path="none", how="min", op="eq", value=0.0), None),
    (R.NumericRange(name="r", path="total", least=110, most=110), True), (R.NumericRange(name="r", path="same", least=1), None),
    (R.PercentageTolerance(name="r", path="total", reference="subtotal", fraction=0.1), True), (R.PercentageTolerance(name="r", path="total", reference="zero", fraction=0.1), None),
    (R.Format(name="r", path="same", format="digits"), False), (R.Format(name="r", path="gone", format="digits"), None),
    (R.ConditionalPresence(name="r", condition="same", equals="acme ltd", required="gone"), False), (R.ConditionalPresence(name="r", condition="same", equals="x", required="gone"), True), (R.ConditionalPresence(name="r", condition="same", required="total"), True),
    (R.MutualExclusivity(name="r", paths=("total", "gone")), True), (R.MutualExclusivity(name="r", paths=("gone", "empty")), False), (R.MutualExclusivity(name="r", paths=("gone", "empty"), mode="at_most_one"), True),
    (R.AtLeast(name="r", paths=("total", "tax", "gone"), n=2), True), (R.Together(name="r", paths=("total", "gone")), False), (R.Together(name="r", paths=("empty", "gone")), True),
    (R.Contains(name="r", path="same", keywords=("ACME", "x")), True), (R.Contains(name="r", path="same", keywords=("ACME", "x"), mode="all"), False), (R.Contains(name="r", path="gone", keywords=("x",)), None),
    (R.LengthBounds(name="r", path="same", least=8, most=8), True), (R.LengthBounds(name="r", path="gone", least=1), None),
    (R.ConfidenceFloor(name="r", path="total", floor=0.5), False), (R.ConfidenceFloor(name="r", path="tax", floor=0.5), None), (R.GroundedOnPage(name="r", path="total"), True), (R.GroundedOnPage(name="r", path="vendor"), False), (R.GroundedOnPage(name="r", path="tax"), None),
    (R.SignaturePresence(name="r", list_path="signatures"), True), (R.SignaturePresence(name="r", list_path="signatures", n=2), False), (R.SignaturePresence(name="r", list_path="none"), False), (R.SignaturePresence(name="r", list_path="nolist"), None),
    (R.Unique(name="r", path="total", seen_path="tax"), False), (R.Unique(name="r", path="total", seen_path="gone"), True), (R.Unique(name="r", path="gone", seen_path="tax"), None), (R.Advisory(name="r", path="same", question="?"), True),
]


def test_every_kind(spark):
    f = fields()
    got = spark.range(1).select(*(F.try_element_at(F.array(R.check(r, f)), F.lit(1))["passed"].alias(f"c{n}") for n, (r, _) in enumerate(CASES))).first()
    wrong = [(r, want, got[n]) for n, (r, want) in enumerate(CASES) if got[n] is not want]
    assert not wrong


def test_ruleset_decision_and_reasons(spark):
    rules = [R.Presence(name="a", path="gone", severity="hard", detail="no {path}"), R.Threshold(name="b", path="total", op="lt", threshold=1, detail="is {value}"), R.Arithmetic(name="skip", result="gone", a="tax", b="tax")]
    docs = spark.range(1)
    row = R.decided(docs, R.ruleset(rules, fields()), extraction=F.lit(0.5)).first()
    assert [c.name for c in row.checks] == ["a", "b"] and row.decision == "flag" and row.decision_confidence == 0.9 and row.reasons == ["Failed rule: a — no gone"]
    row = R.decided(docs, R.ruleset(rules[1:], fields()), extraction=F.lit(0.5)).first()
    assert row.decision == "needs_review" and row.decision_confidence == 0.5 and row.reasons == ["Needs review: b — is 110"] and row.status == "needs_review"
    row = R.decided(docs, R.ruleset(rules[2:], fields()), base="flag").first()
    assert row.decision == "flag" and row.checks == [] and row.status == "decided"


def test_built_in_rules_and_gates(spark):
    f = fields()
    row = spark.range(1).select(R.ruleset(R.invoice_rules(DEFAULT), f).alias("c"), R.gates(F.lit(0.5), F.lit("warn"), DEFAULT).alias("g"), R.ruleset(R.contract_rules(DEFAULT), f).alias("k")).first()
    assert {c.name: c.passed for c in row.c} == {"total_math": True, "amount_limit": True, "po_present": False, "due_date_present": False, "bank_details": True}
    assert [c.passed for c in row.g] == [False, False] and {c.name for c in row.k} >= {"signatures_present", "renewal_notice"}


@pytest.mark.parametrize("rule", [r for r, _ in CASES])
def test_json_round_trip(rule):
    assert R.from_dict(R.to_dict(rule)) == rule


def test_definitions_that_are_wrong():
    ok = {"kind": "presence", "name": "x", "path": "total"}
    assert R.problems(ok, {"total"}) == [] and R.from_dict({"kind": "nope"}) is None and R.to_dict(R.total_math()) is None
    for wrong in ({"kind": "nope"}, ok | {"name": ""}, ok | {"severity": "x"}, ok | {"path": "tota"}, {"kind": "presence", "name": "x"}, {"kind": "threshold", "name": "x", "path": "total", "op": "lt"},
                  {"kind": "numeric_range", "name": "x", "path": "total", "least": 2, "most": 1}, {"kind": "at_least_n_of", "name": "x", "paths": ["total"], "n": 2}, {"kind": "expression", "name": "x", "formula": "a.b"}, {"kind": "equality", "name": "x", "path": "total"}):
        assert R.problems(wrong, {"total"}), wrong


def test_history_and_citations(spark):
    docs = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", False), (4, "b", True), (5, None, True)], "doc_id long, no string, done boolean")
    assert {r.doc_id: r.seen_before for r in R.history(docs, "doc_id", "no", "done").collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0}
    again = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "a", False), (2, "a", False), (None, "a", False)], "doc_id long, no string, done boolean")
    assert sorted((r.doc_id or 0, r.seen_before) for r in R.history(again, "doc_id", "no", "done").collect()) == [(0, 1), (1, 0), (1, 0), (1, 0), (2, 1)]
    leaves = spark.createDataFrame([(1, "items.0.amount", 0, 3), (1, "items.1.amount", 1, 2), (1, "total", 2, None), (1, "total.x", 3, 7)], "doc_id long, path string, ord int, page int")
    paths = spark.createDataFrame([("items",), ("total",), ("items.1.amount",)], "field string")
    assert {(r.field, r.source) for r in R.citations(leaves, paths).collect()} == {("items", "page 3"), ("total", "page 7"), ("items.1.amount", "page 2")}
