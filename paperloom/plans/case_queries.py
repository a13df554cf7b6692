"""Queries of cases: candidates, agreement, completeness, decisions; and of golden scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import evaluation as E
from paperloom.operators import reconcile as C
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import table

CANDIDATE = "case_id", "field", "doc_id", "doc_ord", "ord", "value"


def _candidates(rows, case, field, doc, order, value, at=None):
    return rows.select(
        case.alias("case_id"), F.lit(field).alias("field"), F.lit(doc).alias("doc_id"), F.lit(order).alias("doc_ord"),
        (F.lit(0) if at is None else at).alias("ord"), value.alias("value"),
    )


def _money(spark, sf):
    """An order is a case: the invoice has its total, the delivery its rows' amounts."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sums = items.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double") / 2, 2).alias("total"))
    a = _candidates(orders, F.col("o_orderkey"), "total", "invoice", 1, V.number(F.round("o_totalprice", 2)))
    b = _candidates(sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"), F.col("l_orderkey"), "total", "delivery", 2, V.number("total"))
    return a.unionByName(b)


MONEY = """WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(18,4))::DOUBLE / 2, 2) AS t FROM lineitem GROUP BY 1),
m AS (SELECT o_orderkey AS case_id, round(o_totalprice, 2) AS total, t FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) """


@query("reconcile_money", MONEY + "SELECT case_id, 'money' AS field_kind, (CASE WHEN t IS NULL THEN 1 ELSE 2 END)::BIGINT AS docs, coalesce(abs(total - t) <= greatest(0.01, 0.5 * greatest(abs(total), abs(t))), true) AS agreement FROM m")
def reconcile_money(spark, sf):
    from paperloom.settings import Settings

    found = C.reconciled(_money(spark, sf), Settings(money_pct_tolerance=0.5), use_fuzzy=False)
    return found.select("case_id", "field_kind", "docs", "agreement")


@query("conflict_details", """WITH i AS (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey::VARCHAR) AS l, bool_or(l_suppkey = o_custkey % 100 + 1) AS met, any_value(o_custkey % 100 + 1) AS own
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT l_orderkey AS case_id, 'invoice: ' || own || '; contract: ' || array_to_string(l, ', ') AS detail, 'page 1,' AS sources FROM i WHERE NOT met""")
def conflict_details(spark, sf):
    rows = _parties(spark, sf).withColumn("doc_type", F.col("doc_id")).withColumn("page", F.when(F.col("doc_ord") == 1, 1))
    found = C.conflicts(rows, C.reconciled(rows, use_fuzzy=False))
    return found.select("case_id", "detail", F.array_join(F.transform("citations", lambda c: c["source"]), ",").alias("sources"))


@query("reconcile_date", """WITH s AS (SELECT l_orderkey, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, 'date' AS field_kind, strftime(o_orderdate, '%Y-%m-%d') AS value, coalesce(abs(date_diff('day', o_orderdate::DATE, d)) <= 3, true) AS agreement FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def reconcile_date(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    first = items.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    a = _candidates(orders, F.col("o_orderkey"), "invoice_date", "invoice", 1, V.text(F.date_format("o_orderdate", "yyyy-MM-dd")))
    b = _candidates(first, F.col("l_orderkey"), "invoice_date", "delivery", 2, V.text(F.date_format("d", "MMMM d, yyyy")))
    return C.reconciled(a.unionByName(b), use_fuzzy=False).select("case_id", "field_kind", F.col("value.s").alias("value"), "agreement")


@query("reconcile_string_normalized", """SELECT s_suppkey AS case_id, s_suppkey % 2 = 0 AS agreement FROM supplier""")
def reconcile_string_normalized(spark, sf):
    s = table(spark, sf, "supplier")
    other = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.upper("s_name"), F.lit("  Limited Company."))).otherwise(F.concat(F.col("s_name"), F.lit(" Works")))
    a = _candidates(s, F.col("s_suppkey"), "vendor", "invoice", 1, V.text(F.concat(F.col("s_name"), F.lit(" ltd"))))
    return C.reconciled(a.unionByName(_candidates(s, F.col("s_suppkey"), "vendor", "po", 2, V.text(other))), use_fuzzy=False).select("case_id", "agreement")


@query("exists_match_list", """SELECT o_orderkey AS case_id, bool_or(coalesce(l_suppkey = o_custkey % 100 + 1, true)) AS agreement
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def exists_match_list(spark, sf):
    return C.reconciled(_parties(spark, sf), use_fuzzy=False).select("case_id", "agreement")


def _parties(spark, sf):
    """One party of the invoice, and the suppliers of the contract's rows."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    known = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    a = _candidates(orders, F.col("o_orderkey"), "party", "invoice", 1, V.number(F.col("o_custkey") % 100 + 1))
    b = _candidates(known, F.col("l_orderkey"), "party", "contract", 2, V.number("l_suppkey"), F.col("l_linenumber"))
    return a.unionByName(b)


@query("reconcile_string_fuzzy")
def reconcile_string_fuzzy(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    a = _candidates(names, F.col("k"), "item", "invoice", 1, V.text("p_name"))
    b = _candidates(names, F.col("k"), "item", "po", 2, V.text(F.concat(F.col("p_name"), F.lit("s"))))
    return C.reconciled(a.unionByName(b)).select("case_id", "agreement")


def _leaves(spark, sf):
    o, i = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = o.select(F.col("o_orderkey").alias("case_id"), F.lit("invoice").alias("doc_id"), F.lit(1).alias("doc_ord"), F.lit("invoice").alias("doc_type"), F.lit("total").alias("path"), F.lit(0).alias("ord"), V.number("o_totalprice").alias("value"))
    b = i.select(F.col("l_orderkey").alias("case_id"), F.lit("delivery").alias("doc_id"), F.lit(2).alias("doc_ord"), F.lit("delivery_note").alias("doc_type"), F.concat(F.lit("lines."), F.col("l_linenumber"), F.lit(".amount")).alias("path"), F.col("l_linenumber").alias("ord"), V.number("l_extendedprice").alias("value"))
    c = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("case_id"), F.lit("po").alias("doc_id"), F.lit(3).alias("doc_ord"), F.lit("po").alias("doc_type"), F.lit("total").alias("path"), F.lit(0).alias("ord"), V.number("o_totalprice").alias("value"))
    return a.unionByName(b).unionByName(c)


@query("mapped_candidates", """SELECT o_orderkey AS case_id, 'total_amount' AS field, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY 1""")
def mapped_candidates(spark, sf):
    mapping = spark.createDataFrame([("invoice", "total", "total_amount"), ("po", "total", "total_amount"), ("delivery_note", "lines", "total_amount")], "doc_type string, field_path string, field string")
    return C.mapped(_leaves(spark, sf), mapping).groupBy("case_id", "field").agg(F.count(F.lit(1)).alias("n"))


@query("open_pile_shared_keys", "SELECT o_orderkey AS case_id, 'total' AS field, 2::BIGINT AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice IS NOT NULL")
def open_pile_shared_keys(spark, sf):
    return C.open_pile(_leaves(spark, sf)).groupBy("case_id", "field").agg(F.count(F.lit(1)).alias("n"))


def _case_parts(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cases = orders.select(F.col("o_orderkey").alias("case_id"))
    members = cases.select("case_id", F.lit("invoice").alias("doc_type"), F.lit(True).alias("structured")).unionByName(
        items.select(F.col("l_orderkey").alias("case_id"), F.lit("po").alias("doc_type"), (F.col("l_linestatus") == "F").alias("structured")).join(cases, "case_id", "left_semi")
    )
    required = spark.createDataFrame([("invoice", 1), ("po", 2), ("contract", 0)], "doc_type string, least int")
    return cases, members, required


COMPLETE = """WITH p AS (SELECT o_orderkey AS case_id, count(l_orderkey) AS n, coalesce(bool_and(l_linestatus = 'F'), false) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
complete AS (SELECT case_id, 'present:invoice' AS name, true AS passed, 'advisory' AS severity FROM p
UNION ALL SELECT case_id, CASE WHEN n < 2 THEN 'missing:po' WHEN NOT s THEN 'unstructured:po' ELSE 'present:po' END, n >= 2 AND s, CASE WHEN n < 2 THEN 'review' ELSE 'advisory' END FROM p)"""


@query("completeness_checks", COMPLETE + " SELECT * FROM complete")
def completeness_checks(spark, sf):
    return C.completeness_checks(*_case_parts(spark, sf)).select("case_id", "name", "passed", "severity")


@query("case_decision", COMPLETE + ", " + MONEY.replace("WITH s", "s") + """, conflict AS (SELECT case_id, coalesce(abs(total - t) <= 0.01, true) AS passed, 'review' AS severity FROM m),
every AS (SELECT case_id, passed, severity FROM complete UNION ALL SELECT * FROM conflict)
SELECT case_id, CASE WHEN count(*) FILTER (NOT passed AND severity = 'review') > 0 THEN 'needs_review' ELSE 'approve' END AS decision, 0.75::DOUBLE AS confidence,
       count(*) AS n_checks, count(*) FILTER (NOT passed) AS n_failed FROM every GROUP BY case_id""")
def case_decision(spark, sf):
    cases, members, required = _case_parts(spark, sf)
    checks = C.completeness_checks(cases, members, required).unionByName(C.conflict_checks(C.reconciled(_money(spark, sf), use_fuzzy=False)))
    sure = cases.select("case_id", F.lit(0.75).alias("confidence"))
    return C.case_decisions(checks, sure)


def _scalars(spark, sf):
    """Expected and actual scalar fields: an order's total against its row sum, and its status against its rows'."""
    o = table(spark, sf, "orders")
    i = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("state"), F.round(F.max("l_extendedprice"), 0).alias("top"))
    met = o.join(i, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    field = lambda kind, e, a: F.struct(F.lit(kind).alias("kind"), e.alias("expected"), a.alias("actual"))
    both = F.array(field("string", V.text("o_orderstatus"), V.text(F.lower("state"))), field("money", V.number(F.round("o_totalprice", 0)), V.number("top")))
    return met.select("o_orderkey", F.explode(both).alias("f")).select("o_orderkey", "f.*")


SCALARS = """WITH i AS (SELECT l_orderkey, max(l_linestatus) AS state, round(max(l_extendedprice), 0) AS top FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey, 'string' AS kind, coalesce(o_orderstatus = lower(state), false) AS e, coalesce(lower(o_orderstatus) = lower(state), false) AS m FROM orders LEFT JOIN i ON o_orderkey = l_orderkey
UNION ALL SELECT o_orderkey, 'money', coalesce(abs(round(o_totalprice, 0) - top) <= 1e-9, false), coalesce(abs(round(o_totalprice, 0) - top) <= 0.01, false) FROM orders LEFT JOIN i ON o_orderkey = l_orderkey)"""


@query("values_match_scalar", SCALARS + " SELECT o_orderkey, kind, e AS exact, m AS normalized FROM f")
def values_match_scalar(spark, sf):
    rows = _scalars(spark, sf)
    return rows.select("o_orderkey", "kind", E.exact(F.col("expected"), F.col("actual")).alias("exact"), E.matched(F.col("expected"), F.col("actual"), F.col("kind"), use_fuzzy=False).alias("normalized"))


@query("field_accuracy", SCALARS + " SELECT kind, round(avg(e::INT), 6) AS exact_accuracy, round(avg(m::INT), 6) AS normalized_accuracy, count(*) AS n_fields FROM f GROUP BY 1")
def field_accuracy(spark, sf):
    return E.scalar_accuracy(_scalars(spark, sf), "kind")


def _collections(spark, sf):
    i = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), "l_linestatus", "l_partkey", "l_suppkey", "l_extendedprice")
    order = "l_orderkey, idx, l_partkey, l_suppkey, qty, l_extendedprice"
    numbered = i.withColumn("idx", F.expr(f"row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {order})"))
    return numbered.where("l_linestatus = 'F'").select("l_orderkey", "idx", "qty", "flag"), numbered.where("l_linestatus = 'O'").select("l_orderkey", "idx", "qty", "flag")


SIMILAR = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx FROM lineitem),
sim AS (SELECT e.l_orderkey, e.idx AS i, a.idx AS j, ((abs(e.l_quantity - a.l_quantity) <= 0.01)::INT + (e.l_returnflag = a.l_returnflag)::INT) / 2 AS score
FROM n e JOIN n a ON e.l_orderkey = a.l_orderkey AND e.l_linestatus = 'F' AND a.l_linestatus = 'O')"""


@query("align_similarity_matrix", SIMILAR + " SELECT l_orderkey, i, j, score FROM sim")
def align_similarity_matrix(spark, sf):
    return E.similarity(*_collections(spark, sf), ["l_orderkey"], ["qty", "flag"])


@query("align_greedy_f1", SIMILAR + """, c AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS n_expected, count(*) FILTER (l_linestatus = 'O') AS n_actual FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey, list_reduce(list({'i': [i], 'j': [j], 's': [score]} ORDER BY score DESC, i, j), lambda a, x: CASE WHEN list_contains(a.i, x.i[1]) OR list_contains(a.j, x.j[1]) THEN a
      ELSE {'i': list_concat(a.i, x.i), 'j': list_concat(a.j, x.j), 's': list_concat(a.s, x.s)} END).s AS s FROM sim WHERE score > 0 GROUP BY 1),
m AS (SELECT c.*, coalesce(len(s), 0) AS n, coalesce(list_sum(s), 0) AS total FROM c LEFT JOIN g USING (l_orderkey)),
f AS (SELECT *, CASE WHEN n_actual = 0 THEN 1 ELSE n / n_actual END AS p, CASE WHEN n_expected = 0 THEN 1 ELSE n / n_expected END AS r, CASE WHEN n > 0 THEN total / n ELSE 0 END AS cell FROM m)
SELECT l_orderkey, n_expected, n_actual, n AS matched, round(p, 6) AS row_precision, round(r, 6) AS row_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS row_f1,
round(cell, 6) AS cell_accuracy, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * cell, 6) AS line_item_score FROM f""")
def align_greedy_f1(spark, sf):
    return E.align(*_collections(spark, sf), ["l_orderkey"], ["qty", "flag"])


@query("pooled_overall_score", SCALARS + """, c AS (SELECT l_orderkey, sum(l_discount::DECIMAL(18,4))::DOUBLE AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, round((sum(m::INT) + coalesce(any_value(s), 0)) / (count(*) + coalesce(any_value(n), 0)), 6) AS score FROM f LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1""")
def pooled_overall_score(spark, sf):
    fields = _scalars(spark, sf).withColumn("m", E.matched(F.col("expected"), F.col("actual"), F.col("kind"), use_fuzzy=False).cast("int"))
    per = fields.groupBy("o_orderkey").agg(F.sum("m").alias("s"), F.count("m").alias("n"))
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double").alias("cs"), F.count(F.lit(1)).alias("cn"))
    met = per.join(cells, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = F.lit(0)
    return met.select("o_orderkey", E.pooled(F.col("s"), F.col("n"), F.coalesce("cs", zero), F.coalesce("cn", zero)).alias("score"))


def _scored(spark, sf):
    """Orders as runs: a text with a typo, an amount and a date that are near; line items and a list of flags with rows missing."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    typo = F.concat(F.expr("left(o_orderpriority, length(o_orderpriority) - 1)"), F.lit("#"))
    off = F.when(key % 3 == 0, 1.0).when(key % 2 == 0, 0.005).otherwise(0.0)
    day = lambda shift: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), shift), "yyyy-MM-dd")
    field = lambda path, e, a: F.struct(F.lit(path).alias("path"), e.alias("expected"), a.alias("actual"))
    each = F.array(
        field("priority", V.text("o_orderpriority"), V.text(typo)), field("total", V.number(F.round("o_totalprice", 2)), V.number(F.round("o_totalprice", 2) + off)),
        field("order_date", V.text(day(F.lit(0))), V.text(day((key % 5).cast("int")))),
    )
    fields = o.select(key.alias("run_id"), F.explode(each).alias("f")).select("run_id", "f.*")
    n = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
    rows = table(spark, sf, "lineitem").withColumn("n", n)
    own = F.struct(F.lit("line_items").alias("collection"), F.create_map(F.lit("own"), V.number("n"), F.lit("part"), V.number("l_partkey")).alias("cells"), (F.col("n") > 1).alias("given"))
    flag = F.struct(F.lit("flags").alias("collection"), F.create_map(F.lit("flags"), V.text("l_returnflag")).alias("cells"), (F.col("l_linestatus") == "F").alias("given"))
    each = rows.select(F.col("l_orderkey").alias("run_id"), F.col("n").alias("idx"), F.explode(F.array(own, flag)).alias("r")).select("run_id", "r.collection", "idx", "r.cells", "r.given")
    return fields, each.drop("given"), each.where("given").drop("given")


SCORED = """WITH f AS (SELECT o_orderkey AS run_id, ((length(o_orderpriority) - 1) / length(o_orderpriority) >= 0.85)::INT + (o_orderkey % 3 <> 0)::INT + (o_orderkey % 5 <= 3)::INT AS m,
  (o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0)::INT + (o_orderkey % 5 = 0)::INT AS e FROM orders),
l AS (SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT run_id, sum(least(e, a)) AS hit, sum(a) AS given FROM (SELECT l_orderkey AS run_id, l_returnflag, count(*) AS e, count(*) FILTER (l_linestatus = 'F') AS a FROM lineitem GROUP BY 1, 2) GROUP BY 1)"""


@query("scored_runs", SCORED + """ SELECT f.run_id, round(e / 3, 6) AS exact, round(m / 3, 6) AS normalized, round((m + coalesce((n - 1) * 2 + hit, 0)) / (3 + coalesce(3 * n, 0)), 6) AS overall
FROM f LEFT JOIN l ON f.run_id = l.run_id LEFT JOIN g ON f.run_id = g.run_id""")
def scored_runs(spark, sf):
    return E.scored_runs(*_scored(spark, sf)).select("run_id", "exact", "normalized", "overall")


@query("scored_collections", SCORED + """ SELECT run_id, 'flags' AS collection, n AS n_expected, given::BIGINT AS n_actual, hit::BIGINT AS matched, (n - hit)::BIGINT AS missing, (given - hit)::BIGINT AS extra FROM l JOIN g USING (run_id)
UNION ALL SELECT run_id, 'line_items', n, n - 1, n - 1, 1, 0 FROM l""")
def scored_collections(spark, sf):
    _, expected, actual = _scored(spark, sf)
    found = E.scored_collections(expected, actual)
    return found.select("run_id", "collection", "n_expected", "n_actual", "matched", F.size("missing").alias("missing"), F.size("extra").alias("extra"))
