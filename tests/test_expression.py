import pytest
from pyspark.sql import functions as F

from paperloom.functions import expression as X
from paperloom.functions import values as V
from paperloom.operators.fields import Fields

ROW = dict(total=100.0, tax=0.0, name="Acme", empty="", day="2024-01-10", flag=True)
SKIP = None


@pytest.fixture(scope="module")
def fields():
    values = {k: (V.Bool if isinstance(v, bool) else V.Text if isinstance(v, str) else V.Number)(F.lit(v)) for k, v in ROW.items()}
    values["gone"] = V.Number(F.lit(None).cast("double"))
    values["dynamic"] = V.number(F.lit(3.0))
    rows = F.array(*(F.struct(V.number(F.lit(x)).alias("amount"), V.text(F.lit("d")).alias("desc")) for x in (10.0, 20.0, 30.0)))
    lists = {"items": rows, "none": F.array().cast(f"array<struct<amount:{V.VALUE},desc:{V.VALUE}>>"), "names": F.array(V.text(F.lit("a")))}
    return Fields(values=values, lists=lists, composite=frozenset({"items", "none"}))


@pytest.mark.parametrize("formula, want", [
    ("total + 1", 101.0), ("-total", -100.0), ("total / tax", SKIP), ("total % 7", 2.0), ("-7 % 3", 2.0), ("7 % -3", -2.0), ("gone + 1", SKIP), ("name + 1", SKIP), ("flag + 1", 2.0), ("+flag", 1.0),
    ("total > 50", True), ("50 < total <= 100", True), ("50 < total < 100", False), ("gone > 1", SKIP), ("name > 1", SKIP), ("name == 1", False), ("name != 1", True), ("flag == 1", True), ("dynamic == 3", True),
    ("name in ['Acme', 'B']", True), ("name not in ('B',)", True), ("'cm' in name", True), ("gone in [1]", SKIP),
    ("gone and total > 50", SKIP), ("total < 50 and gone", False), ("gone or total > 50", SKIP), ("total > 50 or gone", True), ("empty or tax", False), ("flag and name", "Acme"), ("flag and empty", False), ("not empty", True), ("not gone", SKIP),
    ("sum_of('items', 'amount')", 60.0), ("sum_of('none', 'amount')", 0.0), ("min_of('none', 'amount')", SKIP), ("avg_of('items', 'amount')", 20.0), ("max_of('items', 'amount')", 30.0), ("count('items')", 3.0), ("count('none')", 0.0), ("count('nolist')", SKIP), ("sum_of('names')", 0.0),
    ("round(2.5)", 2.0), ("round(total / 3, 2)", 33.33), ("abs(0 - total)", 100.0), ("len(name)", 4.0), ("len(total)", SKIP), ("lower(name)", "acme"), ("upper(name)", "ACME"), ("trim('  x\t')", "x"),
    ("matches(name, 'A.*')", True), ("matches(name, 'A')", False), ("matches(name, '(')", SKIP), ("days_between(day, '2024-01-15')", 5.0), ("days_between(day, name)", SKIP), ("today()", "2024-01-31"), ("to_date('January 5, 2024')", "2024-01-05"),
    ("is_present('empty')", False), ("is_present('nothing')", False), ("is_present('total')", True), ("field('total') * 2", 200.0), ("items", SKIP),
])
def test_meaning(spark, fields, formula, want):
    v = V.union(X.compiled(formula, fields))
    got = spark.range(1).select(v.alias("v")).first().v
    got = None if got is None else {"string": got.s, "number": got.n, "bool": got.b}[got.kind]
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("formula", [
    "", " ", "total.__class__", "total[0]", "(lambda: 1)()", "[x for x in name]", "{1: 2}", "{1}", "f'{name}'", "2 ** 3", "1 if flag else 2", "__import__('os')", "_total", "name.lower()", "open('x')",
    "abs()", "abs(1, 2)", "sum_of(name)", "round(1, ndigits=2)", "abs(*[1])", "[total]", "total = 1", "1 +", "None", "b'x'", "1 " + "+ 1" * 200, "not " * 30 + "flag", "a" * 401, "x := 1", "total @ 2", "total is None",
])
def test_what_is_not_allowed(formula):
    with pytest.raises(X.FormulaError):
        X.checked(formula)
    assert X.problems(formula, {"total"})


def test_references():
    assert X.references("total > sum_of('items', 'amount') and is_present('po.no')") == {"total", "items", "po.no"}
    assert X.problems("total > 1", {"total"}) == [] and X.problems("tota > 1", {"total"}) == ["unknown field 'tota'"]


def test_deep_formulas_stay_small(spark, fields):
    formula = " and ".join(["(total + 1 > 2 or not (tax > 1))"] * 8)
    assert spark.range(1).select(V.truthy(X.compiled(formula, fields)).alias("x")).first().x is True
