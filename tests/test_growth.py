"""What travels, and what is computed more than once, in scoring and reconciling."""

import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import fuzzy
from paperloom.functions import values as V
from paperloom.operators import evaluation as E
from paperloom.operators import reconcile as C
from paperloom.settings import DEFAULT

CELLS = f"run_id int, collection string, idx int, cells map<string,{V.VALUE}>"


def shuffles(frame) -> int:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


def test_pairs_of_collections_do_not_travel(spark):
    rows = [(1, "items", i, {"a": ("number", None, float(i), None)}) for i in range(3)]
    e, a = spark.createDataFrame(rows, CELLS), spark.createDataFrame(rows[1:], CELLS)
    found = E.scored_collections(e, a)
    assert shuffles(found) <= 1
    assert [(r.matched, r.missing, r.extra) for r in found.collect()] == [(2, [0], [])]


def test_cells_match_as_fields_do(spark):
    """Every pair of values, in collections of one cell and in ones of many, against the columns that fields are compared by."""
    some = [None, ("string", "Acme Ltd", None, None), ("string", " acme limited", None, None), ("string", "Acme Works", None, None), ("string", "2026-04-02", None, None), ("string", "April 5, 2026", None, None),
            ("string", "2026-05-02", None, None), ("string", "135.0", None, None), ("string", "", None, None), ("number", None, 135.0, None), ("number", None, 135.009, None), ("number", None, 20260402.0, None), ("bool", None, None, True), ("bool", None, None, False), ("string", "true", None, None)]
    pairs = list(itertools.product(some, some))
    frame = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], f"k int, expected {V.VALUE}, actual {V.VALUE}")
    hit = E._hits(F.lit("x"), DEFAULT, True)[1]
    always = F.lit(True)
    want = {r.k: r.h for r in E._read(E._read(frame, "expected", "e", always), "actual", "a", always).select("k", hit.alias("h")).collect()}
    one = E.scored_collections(*(spark.createDataFrame([(k, "c", 0, {"v": p[side]}) for k, p in enumerate(pairs)], CELLS) for side in (0, 1)))
    assert {r.run_id: r.matched == 1 for r in one.collect()} == want
    many = [spark.createDataFrame([(1, "c", k, {"v": v, "w": v}) for k, v in enumerate(some)] + [(1, "c", 0, {"v": some[0], "w": some[0]})], CELLS) for _ in (0, 1)]
    row = E.scored_collections(*many).first()
    assert (row.n_expected, row.n_actual, row.matched, row.n_columns, row.missing, row.extra) == (len(some), len(some), len(some), 2, [], [])


def test_long_collections_are_compared_in_stretches(spark):
    rng = random.Random(5)
    sides = [[(c, i, rng.choice("xyz"), rng.randrange(4)) for c in range(5) for i in range(rng.randint(0, 9))] for _ in (0, 1)]
    kind = "c int, i long, s string, n int"
    schema = "struct<kind:int,n:double,m:double,text:struct<s:string,d:date,k:string>>"
    lists = []
    for name, rows in zip("ea", sides, strict=True):
        cell = F.array(F.expr(f"cast(struct(1, null, null, struct(s, null, s)) as {schema})"), F.expr(f"cast(struct(2, n, n, null) as {schema})"))
        by = spark.createDataFrame(rows, kind).withColumn("cell", cell).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", "cell"))).alias("l"))
        lists.append(by.select("c", F.transform("l", lambda x: x["i"]).alias(name), F.flatten(F.transform("l", lambda x: x["cell"])).alias(f"{name}_cells")))
    both = lists[0].join(lists[1], "c").select("c", F.lit(2).alias("n_columns"), "e", "a", "e_cells", "a_cells").coalesce(1)
    found = {n: {r.c: [tuple(p) for p in r.pairs] for r in E._with_matches(both, DEFAULT, True, n).collect()} for n in (3, 1 << 21)}
    assert found[3] == found[1 << 21]
    for c, pairs in found[3].items():
        e, a = ([r for r in rows if r[0] == c] for rows in sides)
        left, right, want = set(), set(), []
        for score, i, j in sorted(((((x[2] == y[2]) + (x[3] == y[3])) / 2, x[1], y[1]) for x in e for y in a), key=lambda p: (-p[0], p[1], p[2])):
            if score and i not in left and j not in right:
                left.add(i), right.add(j), want.append((i, j, score))
        assert sorted(pairs) == sorted(want)


def test_a_pair_of_texts_is_compared_once_in_a_batch(monkeypatch):
    calls = []

    class Counted(fuzzy.SequenceMatcher):
        def __init__(self, *given):
            calls.append(given)
            super().__init__(*given)

    monkeypatch.setattr(fuzzy, "SequenceMatcher", Counted)
    found = fuzzy._ratio.func(pd.Series(["ab", "ab", None, "x"] * 50), pd.Series(["ac", "ac", "q", None] * 50))
    assert len(calls) == 1 and found[0] == found[1] == 0.5 and found.isna().sum() == 100


def test_texts_that_are_no_numbers_do_not_reach_the_cast(spark):
    said = ["1", "-1.5", " 2 ", "1e5", ".5", ".", "1.5f", "2d", "inf", "-Infinity", "NaN", "0x1p3", "0x", "1-U", "", "1,000", "\t7\n", "5.e3", "1_0", "d", None]
    frame = spark.createDataFrame([(s,) for s in said], "s string")
    assert all(str(r.a) == str(r.b) for r in frame.select(F.col("s").try_cast("double").alias("a"), V.read_number(F.col("s")).alias("b")).collect())


def test_a_mapping_does_not_deal_out_leaves_by_document_type(spark):
    leaves = spark.createDataFrame([(1, "a", 1, "invoice", "total", 0, 2.0), (1, "b", 2, "po", "lines.0.amount", 1, 3.0), (1, "b", 2, "po", "linesman", 2, 3.0)], "case_id int, doc_id string, doc_ord int, doc_type string, path string, ord int, value double")
    mapping = spark.createDataFrame([("invoice", "total", "t"), ("po", "lines", "t")], "doc_type string, field_path string, field string")
    found = C.mapped(leaves, mapping)
    assert shuffles(found) == 0
    assert {(r.doc_id, r.field, r.value) for r in found.collect()} == {("a", "t", 2.0), ("b", "t", 3.0)}


def _candidates(spark, rows):
    frame = spark.createDataFrame(rows, "case_id int, field string, doc_id string, doc_ord int, ord int, n double, s string")
    return frame.withColumn("value", F.coalesce(V.number("n"), V.text("s"))).drop("n", "s")


def test_documents_of_few_values_are_settled_in_their_row(spark):
    """Three shuffles before the join of those that are left: the field's own, and one for each side of the join."""
    rows = [(1, "party", "a", 1, 0, 5.0, None)] + [(1, "party", "b", 2, k, float(k), None) for k in range(4)]
    found = C.reconciled(_candidates(spark, rows), use_fuzzy=False)
    assert shuffles(found) <= 7
    assert [(r.field_kind, r.value.n, r.docs, r.agreement) for r in found.collect()] == [("money", 5.0, 2, False)]


def test_agreement_of_few_and_of_many_values_and_of_documents_without_id(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for case in range(40):
        size, docs = rng.choice([1, 2, 3, 50]), ["a", "b", None, "c"][: rng.randint(1, 4)]
        values = {d: [rng.randrange(60 if size == 50 else 4) for _ in range(size)] for d in docs}
        text = case % 2
        rows += [(case, "party", d, k, j, None if text else float(v), f"w {v} co" if text else None) for k, d in enumerate(docs) for j, v in enumerate(values[d])]
        sets = {d: set(v) for d, v in values.items()}
        known = [d for d in docs if d is not None]
        one = all(len(v) == 1 for v in sets.values())
        met = all(sets[p] & sets[q] for p, q in itertools.combinations(known, 2))
        want[case] = (len(docs), len(docs) == 1 or (len(set.union(*sets.values())) == 1 if one else met))
    assert {r.case_id: (r.docs, r.agreement) for r in C.reconciled(_candidates(spark, rows), use_fuzzy=False).collect()} == want


def test_scalar_fields_are_read_in_one_pass(spark):
    import __spark_entry__ as entry

    for name in ("values_match_scalar", "field_accuracy"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2


def test_items_stay_where_they_are_when_invoices_meet_their_history(spark):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = entry.queries()["invoice_ruleset"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = [next(x for x in lines[k + 1 :] if "Project [" in x) for k, line in enumerate(lines) if "Exchange hashpartitioning(number#" in line]
    assert sent and not any("AS items#" in x or ", items#" in x for x in sent)


def test_cases_do_not_travel_once_for_each_document_type_asked_for(spark):
    cases, members = spark.createDataFrame([(1,)], "case_id int"), spark.createDataFrame([(1, "po", True)], "case_id int, doc_type string, structured boolean")
    found = C.completeness_checks(cases, members, spark.createDataFrame([("po", 2), ("invoice", 1)], "doc_type string, least int"))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len([x for x in lines if "Exchange hashpartitioning(case_id#" in x and ", doc_type#" in x]) == 1
    assert {(r.name, r.passed, r.detail) for r in found.collect()} == {("missing:po", False, "1 of 2"), ("missing:invoice", False, "0 of 1")}
