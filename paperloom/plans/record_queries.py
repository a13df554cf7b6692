"""Queries of records: cases, listings, corrections, revisions, paths, forms, and documents from pages to decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import analytics as A
from paperloom.operators import extraction as X
from paperloom.operators import forms as M
from paperloom.operators import paths as P
from paperloom.operators import records as K
from paperloom.operators import rules as R
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import RUNS, runs, table


def _docs(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("status"))


DOCS = ", docs AS (SELECT c_custkey AS doc_id, c_name AS filename, c_mktsegment AS status FROM customer)"


@query("case_assembly", RUNS + DOCS + """, m AS (SELECT doc_id, arg_max(k, (ts, k)) AS case_id FROM runs WHERE k IS NOT NULL GROUP BY 1),
r AS (SELECT doc_id, arg_max(confidence, (ts, -seq)) AS confidence FROM runs WHERE stage = 'purchase' GROUP BY 1)
SELECT case_id, doc_id, filename, status, confidence FROM m JOIN docs USING (doc_id) LEFT JOIN r USING (doc_id)""")
def case_assembly(spark, sf):
    log = runs(spark, sf)
    membership = log.where("k is not null").select(F.col("k").alias("case_id"), "doc_id", F.col("ts").alias("joined_at"))
    return K.assembled_cases(membership, _docs(spark, sf), log.where("stage = 'purchase'"), ["confidence"]).drop("joined_at")


@query("case_member_order", RUNS + DOCS + """, m AS (SELECT doc_id, arg_max(k, (ts, k)) AS case_id, max(ts) AS joined FROM runs WHERE k IS NOT NULL GROUP BY 1)
SELECT case_id, string_agg(filename, ',' ORDER BY joined, doc_id) AS members FROM m JOIN docs USING (doc_id) GROUP BY 1""")
def case_member_order(spark, sf):
    membership = runs(spark, sf).where("k is not null").select(F.col("k").alias("case_id"), "doc_id", F.col("ts").alias("joined_at"))
    listed = K.members_of(K.assembled_cases(membership, _docs(spark, sf), runs(spark, sf), ["stage"]), "filename")
    return listed.select("case_id", F.array_join(F.transform("members", lambda m: m["filename"]), ",").alias("members"))


@query("latest_fields_or_error", RUNS + DOCS + """, r AS (SELECT doc_id, arg_max({'k': k}, (ts, -seq)).k AS fields FROM runs GROUP BY 1)
SELECT doc_id, fields, CASE WHEN fields IS NULL THEN 'the document has no structured extraction yet' END AS error FROM docs LEFT JOIN r USING (doc_id)""")
def latest_fields_or_error(spark, sf):
    log = runs(spark, sf).withColumn("fields", F.col("k"))
    return K.fields_or_error(_docs(spark, sf), log, "fields")


@query("corrections_with_text", RUNS + """, r AS (SELECT doc_id, arg_max(stage, (ts, -seq)) AS engine FROM runs GROUP BY 1),
t AS (SELECT doc_id, stage AS engine, string_agg(k::VARCHAR, ' ' ORDER BY seq) AS full_text FROM runs WHERE k > 2 GROUP BY 1, 2)
SELECT c.seq, t.full_text FROM runs c LEFT JOIN r USING (doc_id) LEFT JOIN t ON t.doc_id = r.doc_id AND t.engine = r.engine WHERE c.k % 2 = 0""")
def corrections_with_text(spark, sf):
    log = runs(spark, sf)
    one = F.sort_array(F.collect_list(F.when(F.col("k") > 2, F.struct("seq", F.col("k").cast("string").alias("k")))))
    texts = log.where("k > 2").groupBy("doc_id", F.col("stage").alias("engine")).agg(F.array_join(F.transform(one, lambda x: x["k"]), " ").alias("full_text"))
    return K.corrections_with_text(log.where("k % 2 = 0").select("doc_id", "seq"), log.withColumn("engine", F.col("stage")), texts).select("seq", "full_text")


def _corrections(spark, sf):
    return runs(spark, sf).select(
        "doc_id", F.col("stage").alias("doc_type"), F.concat(F.lit("items."), F.col("k")).alias("field_path"), F.lit("a").alias("original"), F.col("k").cast("string").alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "seq",
    )


@query("corrections_raw_export", RUNS + """ SELECT '{"doc_id":' || doc_id || ',"doc_type":"purchase","field_path":"items.' || k || '","original":"a","value":"' || k || '","updated_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}' AS json
FROM runs WHERE stage = 'purchase' AND k IS NOT NULL""")
def corrections_raw_export(spark, sf):
    return K.raw_corrections(_corrections(spark, sf).where("value is not null"), "purchase")


@query("correction_groups", RUNS + DOCS + " SELECT doc_id, coalesce(filename, doc_id::VARCHAR) AS filename, status, count(*) AS n FROM runs LEFT JOIN docs USING (doc_id) GROUP BY ALL")
def correction_groups(spark, sf):
    return K.correction_groups(_corrections(spark, sf), _docs(spark, sf))


@query("review_queue_documents", RUNS + DOCS + " SELECT doc_id, filename, status, count(*) AS at_risk, min(confidence) AS lowest FROM runs LEFT JOIN docs USING (doc_id) WHERE confidence < 0.5 GROUP BY ALL")
def review_queue_documents(spark, sf):
    leaves = runs(spark, sf).select("doc_id", F.col("stage").alias("path"), "confidence", F.lit(False).alias("edited"))
    return K.review_queue(A.queue(A.at_risk(leaves)), _docs(spark, sf)).drop("fields")


@query("status_order", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 8 END AS status_rank FROM orders""")
def status_order(spark, sf):
    named = F.when(F.col("o_orderstatus") == "F", "decided").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("lost")
    return K.by_status(table(spark, sf, "orders").withColumn("status", named)).select("o_orderkey", "status_rank")


@query("conflicts_first", """SELECT o_custkey AS case_id, o_orderkey AS field, o_orderstatus = 'F' AS agreement, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderkey) AS rank FROM orders""")
def conflicts_first(spark, sf):
    fields = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("field"), (F.col("o_orderstatus") == "F").alias("agreement"))
    return K.conflicts_first(fields, "case_id", "field")


@query("kpi_order", "SELECT o_orderpriority AS doc_type, count(*) AS documents, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY 1")
def kpi_order(spark, sf):
    return K.kpi_order(table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("doc_type")).agg(F.count(F.lit(1)).alias("documents")))


def _updates(spark, sf):
    return runs(spark, sf).select(
        F.col("doc_id").alias("template_id"), "seq", F.when(F.col("k") % 3 != 0, F.concat(F.lit("h"), "seq")).alias("html"),
        F.when(F.col("k") % 3 == 1, F.concat(F.lit("c"), "seq")).alias("css"), F.col("stage").alias("note"),
    )


UPDATES = RUNS + """, u AS (SELECT doc_id AS template_id, seq, CASE WHEN k % 3 <> 0 THEN 'h' || seq END AS html, CASE WHEN k % 3 = 1 THEN 'c' || seq END AS css, stage AS note FROM runs),
v AS (SELECT template_id, seq, note, html IS NOT NULL OR css IS NOT NULL AS touches, last_value(html IGNORE NULLS) OVER w AS html, last_value(css IGNORE NULLS) OVER w AS css
FROM u WINDOW w AS (PARTITION BY template_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("template_revisions", UPDATES + " SELECT template_id, seq, html, css, note FROM v WHERE touches")
def template_revisions(spark, sf):
    return K.revisions(_updates(spark, sf))


@query("template_restore", UPDATES + """, f AS (SELECT template_id, min(seq) AS revision FROM v WHERE touches GROUP BY 1)
SELECT template_id, coalesce(html, '') AS html, coalesce(css, '') AS css FROM v JOIN f USING (template_id) WHERE seq = revision
UNION ALL SELECT template_id, max(html), max(css) FROM u WHERE template_id NOT IN (SELECT template_id FROM f) GROUP BY 1""")
def template_restore(spark, sf):
    updates = _updates(spark, sf)
    first = K.revisions(updates).groupBy("template_id").agg(F.min("seq").alias("revision")).withColumn("seq", F.lit(1 << 60))
    return K.now(K.restored(updates, first))


@query("latest_eval_scores", RUNS + " SELECT stage AS doc_type, count(*) AS runs, arg_max(doc_id::VARCHAR, (ts, seq)) AS engine, arg_max(confidence, (ts, seq)) AS overall, arg_max(CASE WHEN k % 2 = 0 THEN greatest(k, 10)::DOUBLE ELSE k::DOUBLE END, (ts, seq)) AS line_score FROM runs WHERE k IS NOT NULL GROUP BY 1")
def latest_eval_scores(spark, sf):
    k = F.col("k").cast("double")
    both = F.create_map(F.lit("a"), k, F.lit("b"), F.when(F.col("k") % 2 == 0, F.lit(10.0)).otherwise(k))
    scored = runs(spark, sf).where("k is not null").select(F.col("stage").alias("doc_type"), F.col("ts").alias("created_at"), "seq", F.col("doc_id").cast("string").alias("engine"), F.col("confidence").alias("overall"), both.alias("collections"))
    return K.latest_scores(scored)


@query("resolve_doc_type", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'P' THEN 'unclassified' ELSE 'own' END AS doc_type FROM orders")
def resolve_doc_type(spark, sf):
    found = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("")
    own = F.when(F.col("o_orderstatus") != "P", "own")
    return table(spark, sf, "orders").select("o_orderkey", K.resolved_type(found, own).alias("doc_type"))


@query("filter_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_conjunction(spark, sf):
    return K.where_all(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


def _nested(spark, sf):
    """Orders with typed fields: a scalar, a composite and a list of rows."""
    cell = lambda v: F.struct(v.alias("value"), F.lit(0.9).alias("confidence"))
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("l"))
    rows = F.transform("l", lambda x: F.struct(cell(x["l_quantity"]).alias("qty"), cell(x["l_partkey"]).alias("part")))
    fields = F.struct(cell(F.col("o_totalprice")).alias("total"), F.struct(cell(F.col("o_orderstatus")).alias("status")).alias("clause"), rows.alias("items"))
    return table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", fields.alias("fields"))


NESTED = "WITH l AS (SELECT l_orderkey, list({'q': l_quantity, 'p': l_partkey} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l FROM lineitem GROUP BY 1), n AS (SELECT * FROM orders JOIN l ON o_orderkey = l_orderkey) "


@query("resolved_paths", NESTED + "SELECT o_orderkey, o_totalprice AS total, o_orderstatus AS status, l[2].q AS second, NULL::INT AS beyond, NULL::INT AS wrong FROM n")
def resolved_paths(spark, sf):
    rows = _nested(spark, sf)
    at = lambda path: P.resolved(F.col("fields"), rows.schema["fields"].dataType, path)
    return rows.select("o_orderkey", at("total").alias("total"), at("clause.status").alias("status"), at("items.1.qty").alias("second"), at("items.900.qty").alias("beyond"), at("items.first").alias("wrong"))


@query("values_only", NESTED + "SELECT o_orderkey, '{\"total\":' || o_totalprice::DECIMAL(18,2) || ',\"clause\":{\"status\":\"' || o_orderstatus || '\"},\"items\":' || len(l) || ',\"parts\":' || list_sum(list_transform(l, lambda x: x.p))::BIGINT || '}' AS plain FROM n")
def values_only(spark, sf):
    rows = _nested(spark, sf)
    plain = rows.select("o_orderkey", P.values_only(F.col("fields"), rows.schema["fields"].dataType).alias("v"))
    parts = F.aggregate("v.items", F.lit(0).cast("long"), lambda a, x: a + x["part"])
    said = F.to_json(F.struct(F.col("v.total").cast("decimal(18,2)").alias("total"), F.col("v.clause").alias("clause"), F.size("v.items").alias("items"), parts.alias("parts")))
    return plain.select("o_orderkey", said.alias("plain"))


@query("field_tree", NESTED + """, t AS (SELECT unnest([{'p': 'total', 'k': 'leaf', 'c': 1}, {'p': 'clause', 'k': 'object', 'c': 1}, {'p': 'clause.status', 'k': 'leaf', 'c': 1}, {'p': 'items', 'k': 'list', 'c': 1}, {'p': 'items.*.qty', 'k': 'leaf', 'c': len(l)}, {'p': 'items.*.part', 'k': 'leaf', 'c': len(l)}]) AS x FROM n)
SELECT x.p AS path, x.k AS kind, sum(x.c)::BIGINT AS filled FROM t GROUP BY 1, 2""")
def field_tree(spark, sf):
    """Every path of the documents' fields, what stands there and how many documents' values it has."""
    return P.filled_paths(_nested(spark, sf), "fields")


@query("edits_applied", RUNS + """, f AS (SELECT o_orderkey AS doc_id, 'total' AS path, o_totalprice AS value FROM orders),
e AS (SELECT doc_id, arg_max(k, seq) AS k FROM runs WHERE k IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN k IS NULL THEN round(value, 2)::DECIMAL(18,2)::VARCHAR WHEN k % 2 = 0 THEN (1000 + k)::DECIMAL(18,2)::VARCHAR ELSE 'n/a' END AS value, k IS NOT NULL AS edited FROM f LEFT JOIN e USING (doc_id)""")
def edits_applied(spark, sf):
    leaves = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("total").alias("path"), V.number("o_totalprice").alias("value"))
    new = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" $1,0"), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit(" "))).otherwise("n/a")
    edits = runs(spark, sf).where("k is not null").select("doc_id", F.lit("total").alias("path"), "seq", V.text(new).alias("new"))
    out = P.edited(leaves, edits)
    shown = F.coalesce(F.col("value.n").cast("decimal(18,2)").cast("string"), F.col("value.s"))
    return out.select("doc_id", shown.alias("value"), "edited")


def _form(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ("text", "checkbox", "choice", "radio", "signature"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    path = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "missing").otherwise("status")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("f").alias("name"), kinds.alias("kind"), path.alias("field_path"),
        F.array(F.lit("/Off"), F.lit("On")).alias("states"), F.array(F.lit("F"), F.lit("P")).alias("options"),
    )


@query("form_values", """WITH f AS (SELECT o_orderkey AS doc_id, o_orderstatus AS v, o_orderkey % 5 AS kind, o_orderkey % 7 = 0 AS unbound, o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS missing FROM orders)
SELECT doc_id, CASE WHEN kind >= 3 OR unbound OR missing THEN NULL WHEN kind = 1 THEN '/On' WHEN kind = 2 AND v NOT IN ('F', 'P') THEN NULL ELSE v END AS written,
'f: ' || CASE WHEN kind = 4 THEN NULL WHEN unbound THEN 'no field bound' WHEN missing THEN 'no value at missing' WHEN kind = 3 THEN 'radio groups are not filled' WHEN kind = 2 AND v NOT IN ('F', 'P') THEN 'not an option: ' || v END AS warning FROM f""")
def form_values(spark, sf):
    leaves = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("status").alias("path"), V.text("o_orderstatus").alias("value"))
    return M.form_values(_form(spark, sf), leaves, ["doc_id"]).select("doc_id", "written", "warning")


@query("form_field_kinds", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'signature' WHEN p_size % 5 = 1 THEN 'choice' WHEN p_size % 5 = 2 THEN 'radio' WHEN p_size % 5 = 3 THEN 'checkbox' ELSE 'text' END AS kind FROM part")
def form_field_kinds(spark, sf):
    n = F.col("p_size") % 5
    name = F.when(n == 0, "applicant_Signature").otherwise(F.col("p_name"))
    kind = F.when(n == 1, "/Ch").when(n.isin(2, 3), "/Btn").otherwise("/Tx")
    states = F.when(n == 2, F.array(F.lit("/Off"), F.lit("/A"), F.lit("/B"))).otherwise(F.array(F.lit("/Off"), F.lit("/Yes")))
    return table(spark, sf, "part").select("p_partkey", M.field_kind(name, kind, states, F.lit(True)).alias("kind"))


@query("units_of_cells", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' kg' ELSE p_size::VARCHAR END AS shown, CASE WHEN p_size % 3 = 1 THEN '#,##0.00\" kg\"' END AS number_format FROM part")
def units_of_cells(spark, sf):
    value = F.when(F.col("p_size") % 3 == 0, V.text("p_name")).otherwise(V.number("p_size"))
    unit = F.when(F.col("p_size") % 3 != 2, "kg")
    return table(spark, sf, "part").select("p_partkey", M.with_unit(value, unit).alias("u")).select("p_partkey", "u.*")


@query("boxes_ticked", "SELECT o_orderkey, o_orderkey % 6 IN (1, 3) AS ticked FROM orders")
def boxes_ticked(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ("No ", "yes", "0", "x", " off", ""))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", M.ticked(V.text(said)).alias("ticked"))


@query("suggestions_taken", "SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'other' END AS path, CASE WHEN c_custkey % 3 = 0 THEN least(greatest(c_acctbal, 0.0), 1.0) ELSE 0.25 END AS confidence, CASE WHEN c_custkey % 3 = 0 THEN 'given' ELSE 'fallback' END AS source FROM customer")
def suggestions_taken(spark, sf):
    c = table(spark, sf, "customer")
    path = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "made up")
    suggested = c.select(F.col("c_name").alias("name"), path.alias("path"), F.col("c_acctbal").alias("confidence"))
    fallback = c.select(F.col("c_name").alias("name"), F.lit("other").alias("path"), F.lit(0.25).alias("confidence"))
    return M.taken_suggestions(suggested, fallback, c.select(F.col("c_mktsegment").alias("path"))).drop("is_signature", "rationale")


@query("signatures_suggested", """SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN c_mktsegment ELSE 'other' END AS path, c_custkey % 5 = 0 OR c_custkey % 5 = 4 AS is_signature,
CASE WHEN c_custkey % 5 IN (0, 1) THEN 'because' END AS rationale, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'given' ELSE 'fallback' END AS source FROM customer""")
def signatures_suggested(spark, sf):
    """Suggestions of signatures have no path; those without a path that are none, and made-up paths, are not taken."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 5
    path = F.when(k == 1, F.col("c_mktsegment")).when(k.isin(3, 4), "made up")
    suggested = c.select(F.col("c_name").alias("name"), path.alias("path"), F.lit(0.5).alias("confidence"), (k == 0).alias("is_signature"), F.lit("because").alias("rationale"))
    fallback = c.select(F.col("c_name").alias("name"), F.lit("other").alias("path"), F.lit(0.25).alias("confidence"), (k == 4).alias("is_signature"))
    return M.taken_suggestions(suggested, fallback, c.select(F.col("c_mktsegment").alias("path"))).drop("confidence")


@query("signatures_stamped", """SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderstatus = 'F' AS stamped, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'f: the signature has no place and is not stamped'
WHEN o_orderstatus <> 'F' THEN 'f: there is no image to stamp' END END AS warning FROM orders""")
def signatures_stamped(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rect = F.when(k % 3 > 0, F.array(*(F.lit(float(x)) for x in (0, 0, 9, 9))))
    none = F.array().cast("array<string>")
    form = o.select(k.alias("doc_id"), F.lit("f").alias("name"), F.lit("text").alias("kind"), F.lit("status").alias("field_path"), none.alias("states"), none.alias("options"), (k % 2 == 0).alias("is_signature"), rect.alias("rect"), (F.col("o_orderstatus") == "F").alias("image"))
    leaves = o.select(k.alias("doc_id"), F.lit("status").alias("path"), V.text("o_orderstatus").alias("value"))
    return M.form_values(form, leaves, ["doc_id"]).select("doc_id", "stamped", "warning")


@query("few_shot_texts", RUNS + """, l AS (SELECT stage AS doc_type, 'field_' || k % 4 AS f, arg_max(k, (ts, seq)) AS k, max(ts) AS t FROM runs WHERE k % 4 < 3 AND k % 7 <> 0 GROUP BY 1, 2)
SELECT doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY t DESC, f) AS rank, 'Field ' || f[7:] || ': ' || k AS text, 'cls_' || f[7:] AS cls, k::VARCHAR AS value FROM l QUALIFY rank <= 2""")
def few_shot_texts(spark, sf):
    """Corrections as short texts to learn from: of scalar fields with a value, the newest of each, two for a type."""
    k = F.col("k")
    log = runs(spark, sf).select(F.col("stage").alias("doc_type"), F.concat(F.lit("field_"), k % 4).alias("field_path"), F.when(k % 7 != 0, k.cast("string")).otherwise("").alias("value"), F.col("ts").alias("updated_at"), "seq")
    four = F.array(*(F.struct(F.lit(f"field_{i}").alias("name"), F.lit(f"cls_{i}").alias("cls"), F.lit("scalar" if i < 3 else "list_scalar").alias("kind")) for i in range(4)))
    fields = runs(spark, sf).select(F.col("stage").alias("doc_type")).distinct().select("doc_type", F.explode(four).alias("f")).select("doc_type", "f.*")
    return A.correction_texts(log, fields, 2)


@query("places_of_fields", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'blocks' WHEN 2 THEN 'table' ELSE 'none' END AS source, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n FROM part")
def places_of_fields(spark, sf):
    n = F.col("p_size") % 4
    box = F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4)))
    zero = F.array(*(F.lit(0.0) for _ in range(4)))
    blocks = F.when(n == 1, F.array(box, zero, box)).otherwise(F.array(zero))
    return table(spark, sf, "part").select("p_partkey", M.place_of(F.when(n == 0, box), blocks, F.when(n == 2, box)).alias("p")).select("p_partkey", F.col("p.by").alias("source"), F.size("p.rects").alias("n"))


@query("model_names", "SELECT n_nationkey, CASE WHEN ends_with(n, 's') THEN n[:-2] ELSE n END AS model FROM (SELECT n_nationkey, replace(upper(n_name[1]) || lower(n_name[2:]), '_', '') || 'Items' AS n FROM nation)")
def model_names(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", M.model_name(F.concat("n_name", F.lit("_items"))).alias("model"))


@query("rows_inserted", """WITH i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), c AS (SELECT l_orderkey, count(*) - 1 AS more FROM i GROUP BY 1)
SELECT l_orderkey, 4 + i::INT AS row, 0 AS col, l_partkey::VARCHAR AS value FROM i UNION ALL SELECT l_orderkey, 4, 0, 'head' FROM c UNION ALL SELECT l_orderkey, (6 + more)::INT, 0, 'sum' FROM c""")
def rows_inserted(spark, sf):
    items = table(spark, sf, "lineitem")
    template = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(0).alias("col"), F.lit(v).alias("value")) for r, v in ((4, "head"), (5, "{item}"), (6, "sum"))))
    cells = items.select("l_orderkey").distinct().select("l_orderkey", F.explode(template).alias("c")).select("l_orderkey", "c.*")
    return M.inserted_rows(cells, items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"], 5)


def _answers(spark, sf):
    """A service's answers: users' turns with blocks, assistants' without, systems' turns can't be read."""
    block = F.struct("text", (F.col("turn") % 5 / 4).alias("confidence"))
    whole = F.struct(F.col("turn").cast("int").alias("page"), "text", F.when(F.col("role") == "user", F.array(block, block)).alias("blocks"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("role") == "system", "<html>").otherwise(F.to_json(whole)).alias("payload"))


@query("service_pages", """SELECT conv_id AS doc_id, CASE WHEN role <> 'system' THEN turn::INT END AS page, CASE WHEN role <> 'system' THEN length(coalesce(text, '')) END::INT AS chars,
CASE role WHEN 'user' THEN 2 WHEN 'system' THEN NULL ELSE 1 END AS blocks, CASE WHEN role <> 'system' THEN 'text' END AS label, CASE WHEN role = 'system' THEN 'the service''s answer can''t be read' END AS error FROM conversations""")
def service_pages(spark, sf):
    pages = X.service_pages(_answers(spark, sf))
    return pages.select("doc_id", "page", F.char_length("text").alias("chars"), F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("blocks"), F.col("blocks")[0]["label"].alias("label"), "error")


@query("service_documents", """SELECT conv_id AS doc_id, round(avg(turn % 5 / 4.0) FILTER (role = 'user'), 4) AS avg_confidence, (sum(length(coalesce(text, '')) + 2) - 2)::INT AS char_count, 0::BIGINT AS table_count,
coalesce(round(avg(turn % 5 / 4.0) FILTER (role = 'user'), 4) < 0.8, false) AS low_confidence FROM conversations WHERE role <> 'system' GROUP BY 1""")
def service_documents(spark, sf):
    return X.page_summary(X.service_pages(_answers(spark, sf)).where("error is null")).drop("full_text")


def _blocks(spark, sf):
    label = F.when(F.col("role") == "user", "section_header").otherwise("text")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("block"), label.alias("label"), "text")


@query("section_gates", r"""WITH b AS (SELECT conv_id AS doc_id, turn, text, role = 'user' OR regexp_matches(text, '^#{1,6}\s+\S') AS h FROM conversations),
a AS (SELECT doc_id, count(*) FILTER (h) AS n, sum(length(text) + 2) - 2 AS chars FROM b GROUP BY 1)
SELECT doc_id, CASE WHEN n < 2 THEN 'headings' WHEN chars <= 1500 THEN 'fits' END AS gate, n < 2 OR chars <= 1500 AS whole FROM a""")
def section_gates(spark, sf):
    return X.sections_or_whole(_blocks(spark, sf), window=1500).select("doc_id", "gate", "whole")


@query("list_concat", RUNS + " SELECT doc_id, stage AS field, count(*) AS n, arg_min(k, seq) AS first, arg_max(k, seq) AS last FROM runs WHERE k IS NOT NULL GROUP BY 1, 2")
def list_concat(spark, sf):
    items = runs(spark, sf).where("k is not null").select("doc_id", F.col("stage").alias("field"), F.col("seq").alias("section"), F.lit(0).alias("idx"), F.col("k").cast("string").alias("value"))
    out = X.concatenated(items)
    return out.groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ord").cast("long").alias("first"), F.max_by("value", "ord").cast("long").alias("last"))


@query("list_concat_dedup", RUNS + " SELECT doc_id, count(DISTINCT k) AS n FROM runs WHERE k IS NOT NULL GROUP BY 1")
def list_concat_dedup(spark, sf):
    said = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Item "), F.col("k"), F.lit(" (copy)"))).otherwise(F.concat(F.lit("ITEM  "), F.col("k"), F.lit(".")))
    items = runs(spark, sf).where("k is not null").select("doc_id", F.lit("parties").alias("field"), F.col("seq").alias("section"), F.lit(0).alias("idx"), said.alias("value"))
    return X.concatenated(items, dedup=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("composite_merge", RUNS + """, s AS (SELECT doc_id, seq, k % 4 = 0 OR k % 7 = 0 AS g, k FROM runs WHERE k IS NOT NULL)
SELECT doc_id, arg_min(k, (NOT g, seq)) AS clause, arg_min(k, (NOT g, seq)) + 1 AS notice FROM s GROUP BY 1""")
def composite_merge(spark, sf):
    r = runs(spark, sf).where("k is not null")
    both = F.array(
        F.struct(F.lit("text").alias("sub"), F.col("k").alias("value"), (F.col("k") % 4 == 0).alias("grounded")),
        F.struct(F.lit("notice").alias("sub"), (F.col("k") + 1).alias("value"), (F.col("k") % 7 == 0).alias("grounded")),
    )
    cells = r.select("doc_id", F.lit("termination").alias("field"), F.col("seq").alias("section"), F.explode(both).alias("c")).select("doc_id", "field", "section", "c.*")
    out = X.merged_composites(cells)
    pick = lambda sub: F.max(F.when(F.col("sub") == sub, F.col("value")))
    return out.groupBy("doc_id").agg(pick("text").alias("clause"), pick("notice").alias("notice"))


def _money_spans(pages):
    """Spans that a text itself gives: the first amount, and the first word as the vendor."""
    amount = F.regexp_extract("text", r"([$€£]\s?[0-9][0-9.,]*)", 1)
    vendor = F.regexp_extract("text", r"^(\w+)", 1)
    span = lambda cls, text, sure: F.struct(F.lit(cls).alias("cls"), text.alias("text"), F.lit(sure).alias("confidence"))
    return pages.select("doc_id", F.col("page").alias("ord"), F.explode(F.array(span("total", amount, 0.9), span("vendor", vendor, 0.8))).alias("s")).select("doc_id", "ord", "s.*").where("text <> ''")


PAGES = r""", p AS (SELECT doc_id, text, regexp_extract(text, '([$€£]\s?[0-9][0-9.,]*)', 1) AS amount, regexp_extract(text, '^([0-9A-Za-z_]+)', 1) AS vendor FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, TRY_CAST(nullif(rtrim(replace(regexp_extract(amount, '[0-9][0-9.,]*'), ',', ''), '.'), '') AS DOUBLE) AS total FROM p),
s AS (SELECT *, CASE WHEN amount = '' THEN 0.0 WHEN total IS NULL THEN 0.45 ELSE 0.9 END AS ct, CASE WHEN vendor = '' THEN 0.0 ELSE 0.8 END AS cv FROM f)"""


def _text_pages(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.lit(1).alias("page"), "text")


@query("structured_documents", "WITH x AS (SELECT 1)" + PAGES + " SELECT doc_id, total, nullif(vendor, '') AS vendor, round((ct + cv) / 2, 4) AS confidence FROM s WHERE amount <> '' OR vendor <> ''")
def structured_documents(spark, sf):
    out = X.structured(_text_pages(spark, sf), _money_spans, ["total"], ["total", "vendor"])
    value = lambda name, arm: F.try_element_at("fields", F.lit(name))["value"][arm]
    return out.select("doc_id", value("total", "n").alias("total"), value("vendor", "s").alias("vendor"), "confidence")


def _extracted(spark, sf):
    rules = [R.Presence(name="vendor", severity="review", path="vendor"), R.Threshold(name="limit", severity="hard", path="total", op="lte", threshold=500.0)]
    docs = table(spark, sf, "documents").select("doc_id")
    words = {"english": ["the", "of"], "german": ["der", "die"]}
    return X.extracted(docs, _text_pages(spark, sf), _money_spans, rules, words, ["total"], ["total", "vendor"])


EXTRACTED = PAGES + """, r AS (SELECT d.doc_id, s.doc_id IS NULL OR text = '' OR (amount = '' AND vendor = '') AS bad, CASE WHEN s.doc_id IS NULL THEN 'no pages' WHEN text = '' THEN 'no text' WHEN amount = '' AND vendor = '' THEN 'nothing was extracted' END AS error,
total > 500 AS hard, vendor = '' OR (ct + cv) / 2 < 0.6 AS review FROM (SELECT doc_id FROM documents) d LEFT JOIN s USING (doc_id))"""


@query("extracted_documents", "WITH x AS (SELECT 1)" + EXTRACTED + " SELECT doc_id, CASE WHEN error IS NULL THEN CASE WHEN coalesce(hard, false) THEN 'flag' WHEN review THEN 'needs_review' ELSE 'approve' END END AS decision, error FROM r")
def extracted_documents(spark, sf):
    return _extracted(spark, sf).select("doc_id", "decision", "error")


@query("batch_counts", "WITH x AS (SELECT 1)" + EXTRACTED + " SELECT count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed FROM r")
def batch_counts(spark, sf):
    return X.batch_counts(_extracted(spark, sf))
