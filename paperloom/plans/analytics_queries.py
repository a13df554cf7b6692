"""Queries of KPIs, review queue, corrections and run logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import analytics as A
from paperloom.operators import leaves as L
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import RUNS, runs, table
from paperloom.sources import tables as T

AS_OF = date(2024, 1, 30)


@query("latest_run", RUNS + " SELECT doc_id, seq, stage FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, seq) = 1")
def latest_run(spark, sf):
    return A.latest(runs(spark, sf), "doc_id", "ts", "seq").select("doc_id", "seq", "stage")


@query("status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return A.counts(table(spark, sf, "orders"), "o_orderstatus")


@query("status_share", "SELECT o_orderstatus, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def status_share(spark, sf):
    return A.shares(table(spark, sf, "orders"), "o_orderstatus")


@query("daily_throughput_zero_filled", """SELECT d::DATE AS day, count(e.event_id) AS n FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) r(d)
LEFT JOIN events e ON e.ts::DATE = d::DATE AND e.event_type = 'purchase' GROUP BY 1""")
def daily_throughput(spark, sf):
    return A.daily(table(spark, sf, "events").where("event_type = 'purchase'"), "ts", AS_OF)


@query("distinct_documents", "SELECT count(DISTINCT user_id) AS docs, count(DISTINCT event_type) AS stages FROM events")
def distinct_documents(spark, sf):
    return table(spark, sf, "events").agg(F.count_distinct("user_id").alias("docs"), F.count_distinct("event_type").alias("stages"))


def _kpi(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("doc_type"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey")
    decision = F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "O", "flag").otherwise("needs_review")
    run = docs.select("doc_id", (F.col("o_totalprice") / 1_000_000).alias("confidence"), decision.alias("decision"))
    fixed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    evals = docs.groupBy("doc_type", F.year("o_orderdate").alias("created_at")).agg(F.count(F.lit(1)).alias("accuracy"))
    return docs, run, fixed, evals


@query("kpi_by_doc_type", """
WITH d AS (SELECT o_orderkey AS doc_id, o_orderpriority AS doc_type, o_totalprice / 1000000 AS confidence, o_orderstatus AS s, year(o_orderdate) AS y FROM orders),
c AS (SELECT doc_type, count(*) AS corrections, count(DISTINCT doc_id) AS corrected_docs FROM d JOIN lineitem ON doc_id = l_orderkey AND l_returnflag = 'R' GROUP BY 1),
e AS (SELECT doc_type, count(*) AS eval_runs, max_by(n, y) AS accuracy FROM (SELECT doc_type, y, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT doc_type, count(*) AS documents, round(count(*) / (SELECT count(*) FROM d), 6) AS share, round(avg(confidence), 4) AS avg_confidence,
       count(*) FILTER (s = 'F') AS approved, count(*) FILTER (s = 'O') AS flagged, count(*) FILTER (s NOT IN ('F', 'O')) AS needs_review,
       coalesce(any_value(corrections), 0) AS corrections, coalesce(any_value(corrected_docs), 0) AS corrected_docs,
       coalesce(any_value(eval_runs), 0) AS eval_runs, any_value(accuracy) AS accuracy
FROM d LEFT JOIN c USING (doc_type) LEFT JOIN e USING (doc_type) GROUP BY doc_type""")
def kpi_by_doc_type(spark, sf):
    return A.by_doc_type(*_kpi(spark, sf))


@query("kpi_overview", """SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS doc_types, (SELECT count(*) FROM orders) AS decided,
(SELECT round(avg(o_totalprice / 1000000), 4) FROM orders) AS avg_confidence, count(*) AS corrections, count(DISTINCT l_orderkey) AS corrected_docs FROM lineitem WHERE l_returnflag = 'R'""")
def kpi_overview(spark, sf):
    docs, run, fixed, _ = _kpi(spark, sf)
    return A.overview(docs, run, fixed)


def _leaves(spark, sf):
    return runs(spark, sf).select("doc_id", F.col("stage").alias("path"), "confidence", (F.col("k") % 2 == 0).alias("edited"), "seq")


@query("at_risk_queue", RUNS + " SELECT doc_id, seq, stage AS path FROM runs WHERE confidence < 0.5 AND NOT k % 2 = 0 AND stage NOT IN ('view')")
def at_risk_queue(spark, sf):
    return A.at_risk(_leaves(spark, sf), presence=("view",)).select("doc_id", "seq", "path")


@query("at_risk_rollup", RUNS + " SELECT doc_id, count(*) AS at_risk, round(min(confidence), 6) AS lowest FROM runs WHERE confidence < 0.5 AND NOT k % 2 = 0 GROUP BY 1")
def at_risk_rollup(spark, sf):
    return A.queue(A.at_risk(_leaves(spark, sf))).select("doc_id", "at_risk", F.round("lowest", 6).alias("lowest"))


def _log(spark, sf):
    return runs(spark, sf).select("doc_id", F.col("stage").alias("field_path"), F.col("k").cast("string").alias("original"), F.col("seq").cast("string").alias("value"), F.col("ts").alias("updated_at"), "seq", (F.col("doc_id") % 7).alias("doc_type"))


@query("corrections_latest", RUNS + """ SELECT doc_id, stage AS field_path, arg_min(k::VARCHAR, (ts, seq)) AS original, arg_max(seq::VARCHAR, (ts, seq)) AS value FROM runs GROUP BY 1, 2""")
def corrections_latest(spark, sf):
    return A.latest_corrections(_log(spark, sf)).select("doc_id", "field_path", "original", "value")


@query("correction_examples_jsonl", RUNS + """, l AS (SELECT doc_id, stage, arg_max(seq::VARCHAR, (ts, seq)) AS v, max(ts) AS t FROM runs GROUP BY 1, 2)
SELECT doc_id, '{"doc_id":' || doc_id || ',"fields":{' || string_agg('"' || stage || '":"' || v || '"', ',' ORDER BY stage) || '},"corrected_at":"' || strftime(max(t), '%Y-%m-%dT%H:%M:%S') || '"}' AS json FROM l GROUP BY doc_id""")
def correction_examples_jsonl(spark, sf):
    return A.correction_examples(_log(spark, sf))


@query("correction_latest_topn", RUNS + """, l AS (SELECT doc_id % 7 AS doc_type, stage AS field_path, arg_max(seq::VARCHAR, (ts, seq)) AS value, max((ts, seq)) AS t FROM runs GROUP BY 1, 2)
SELECT doc_type, field_path, value, row_number() OVER (PARTITION BY doc_type ORDER BY t DESC) AS rank FROM l QUALIFY rank <= 3""")
def correction_latest_topn(spark, sf):
    return A.top_corrections(_log(spark, sf), 3)


@query("stage_upsert", RUNS + " SELECT seq, CASE WHEN stage IN ('decide', 'sign') THEN 1 ELSE 2 END AS stages FROM runs")
def stage_upsert(spark, sf):
    stages = F.create_map(F.lit("sign"), F.lit("old"), F.col("stage"), F.lit("x"))
    return runs(spark, sf).select("seq", F.size(A.with_stage(stages, "decide", F.lit("new"))).alias("stages"))


@query("flatten_leaves", """
SELECT o_orderkey, 'total' AS path, NULL::INT AS idx, 'number' AS kind, o_totalprice AS n, NULL AS s FROM orders
UNION ALL SELECT o_orderkey, 'status', NULL, 'string', NULL, o_orderstatus FROM orders
UNION ALL SELECT l_orderkey, 'line_items.' || (i - 1) || '.qty', i - 1, 'number', l_quantity, NULL FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS i FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
""")
def flatten_leaves(spark, sf):
    return _flat(spark, sf).select("o_orderkey", "path", "idx", "value.kind", "value.n", "value.s")


def _flat(spark, sf):
    from paperloom.plans.fixtures import invoices

    fields = (L.FieldDef("total", coerce="number"), L.FieldDef("status"), L.FieldDef("line_items", "list_composite", subs=(("qty", "number"),)))
    cell = lambda v, c=0.9137313: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(1).alias("page"))
    shaped = F.struct(
        cell(F.col("o_totalprice")).alias("total"), cell(F.col("o_orderstatus")).alias("status"),
        F.transform("items", lambda x: F.struct(F.struct(x["l_quantity"].alias("value"), x["l_discount"].alias("confidence"), F.lit(1).alias("page")).alias("qty"))).alias("line_items"),
    )
    docs = invoices(spark, sf).select("o_orderkey", shaped.alias("fields"))
    return L.flatten(docs, "o_orderkey", "fields", fields).where("value is not null")


@query("confidence_mean_of_means", """WITH i AS (SELECT l_orderkey, avg(l_discount) AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey, round((0.9137313 + coalesce(c, 0)) / 2, 4) AS confidence FROM orders LEFT JOIN i ON o_orderkey = l_orderkey""")
def confidence_mean_of_means(spark, sf):
    return L.core_confidence(_flat(spark, sf), "o_orderkey", ["total", "line_items"]).select("o_orderkey", "confidence")


for _how in ("sum", "count", "min", "max", "avg"):
    def _aggregate(spark, sf, how=_how):
        from paperloom.plans.fixtures import invoice_fields, invoices

        return invoices(spark, sf).select("o_orderkey", F.round(invoice_fields().aggregate("line_items", how, "qty"), 4).alias("result"))

    _empty = "0.0" if _how in ("sum", "count") else "NULL"
    query(f"aggregate_{_how}", f"SELECT o_orderkey, coalesce(round(({_how}(l_quantity))::DOUBLE, 4), {_empty}) AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")(_aggregate)


@query("pagination", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8 OFFSET 16")
def pagination(spark, sf):
    return A.page_of(table(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_orderkey")


@query("search_filter", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'mach') AND c_nationkey = 3")
def search_filter(spark, sf):
    return A.search(table(spark, sf, "customer"), "MACH", "c_name", "c_mktsegment", status=3, status_col="c_nationkey").select("c_custkey")


@query("docs_left_membership", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def docs_left_membership(spark, sf):
    members = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("orphan_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_anti(spark, sf):
    return A.without(table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("semi_decided", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_decided(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("member_state", RUNS + """, m AS (SELECT doc_id // 10 AS case_id, doc_id, arg_max(CASE WHEN stage = 'purchase' THEN 'structured' WHEN stage = 'view' THEN 'error' ELSE 'active' END, seq) AS status FROM runs GROUP BY 1, 2)
SELECT case_id, count(*) FILTER (status = 'structured') AS structured, count(*) FILTER (status = 'error') AS errored, bool_and(status IN ('structured', 'error')) AS settled, count(*) AS members FROM m GROUP BY 1""")
def member_state(spark, sf):
    status = F.when(F.col("stage") == "purchase", "structured").when(F.col("stage") == "view", "error").otherwise("active")
    return A.member_state(runs(spark, sf).select(F.expr("doc_id div 10").alias("case_id"), "doc_id", status.alias("status"), "seq"))


@query("preview_cache_keys", "SELECT page_id, sha256(html) AS cache_key FROM pages WHERE page_id % 3 <> 0 AND sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0)")
def preview_cache_keys(spark, sf):
    pages = table(spark, sf, "pages")
    done = pages.where("page_id % 3 = 0").select(F.sha2("html", 256).alias("cache_key"))
    return T.not_yet_done(pages.where("page_id % 3 <> 0"), done, "html").select("page_id", "cache_key")


@query("additive_schema_union", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, -1 FROM region")
def additive_schema_union(spark, sf):
    new = table(spark, sf, "nation").toDF("key", "name", "parent")
    return T.grown(table(spark, sf, "region").toDF("key", "name"), new, {"parent": -1}).select("key", "name", "parent")


@query("type_detection", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'application/pdf' WHEN page_id % 3 = 1 THEN 'text/csv' END AS mime FROM pages")
def type_detection(spark, sf):
    name = F.concat(F.lit("f."), F.element_at(F.array(F.lit("PDF"), F.lit("csv"), F.lit("exe")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", T.mime(name).alias("mime"))


@query("display_values", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '—' WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS shown, CASE WHEN c_acctbal / 10000 >= 0.8 THEN 'high' WHEN c_acctbal / 10000 >= 0.5 THEN 'medium' ELSE 'low' END AS tone FROM customer")
def display_values(spark, sf):
    v = V.boolean(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") > 5000))
    return table(spark, sf, "customer").select("c_custkey", V.display(v).alias("shown"), V.tone(F.col("c_acctbal") / 10000).alias("tone"))
