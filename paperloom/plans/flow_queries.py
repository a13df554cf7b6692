"""Queries of stages put together, of display texts and of page images."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import display
from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.operators import flows as W
from paperloom.operators import pages as P
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import RUNS, runs, table


@query("assembled_fields", RUNS + """, f AS (SELECT doc_id, stage AS field, arg_min(k, seq) AS k, round(arg_min(confidence, seq), 4) AS c FROM runs GROUP BY 1, 2)
SELECT doc_id, field, CASE WHEN field = 'purchase' THEN k::DOUBLE END AS n, CASE WHEN field <> 'purchase' THEN k || ' eur' END AS s, c AS confidence FROM f""")
def assembled_fields(spark, sf):
    rows = runs(spark, sf).select("doc_id", F.col("seq").alias("ord"), F.col("stage").alias("cls"), F.concat(F.col("k").cast("string"), F.lit(" eur")).alias("text"), "confidence")
    return W.assembled(rows, ["purchase"]).select("doc_id", "field", "value.n", "value.s", "confidence")


@query("first_extraction", RUNS + " SELECT doc_id, stage AS cls, arg_min(k::VARCHAR, seq) AS text, count(*) AS n FROM runs GROUP BY 1, 2")
def first_extraction(spark, sf):
    return W.first_of_class(runs(spark, sf).select("doc_id", F.col("seq").alias("ord"), F.col("stage").alias("cls"), F.col("k").cast("string").alias("text")))


@query("grouped_extractions", RUNS + " SELECT doc_id, stage AS cls, string_agg(k::VARCHAR, ',' ORDER BY seq) AS texts FROM runs WHERE k IS NOT NULL GROUP BY 1, 2")
def grouped_extractions(spark, sf):
    rows = runs(spark, sf).where("k is not null").select("doc_id", F.col("seq").alias("ord"), F.col("stage").alias("cls"), F.col("k").cast("string").alias("text"))
    return W.grouped_by_class(rows).select("doc_id", F.explode("groups").alias("cls", "t")).select("doc_id", "cls", F.array_join("t", ",").alias("texts"))


@query("regrounded_leaves", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 5 WHEN w <> '' AND instr(text, w) > 0 THEN instr(text, w) - 1 END AS char_start,
CASE WHEN doc_id % 2 = 0 OR NOT (w <> '' AND instr(text, w) > 0) THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM (SELECT *, coalesce(string_split(text, ' ')[3], '') AS w FROM documents)""")
def regrounded_leaves(spark, sf):
    docs = table(spark, sf, "documents")
    word = F.coalesce(F.get(F.split("text", " "), 2), F.lit(""))
    leaves = docs.select("doc_id", F.lit("a").alias("path"), V.text(word).alias("value"), F.when(F.col("doc_id") % 2 == 0, 5).alias("char_start"), F.lit(0.4).alias("confidence"))
    return W.regrounded(leaves, docs.select("doc_id", "text")).select("doc_id", "char_start", "confidence")


@query("table_backfill", "SELECT n_regionkey AS doc_id, n_name AS item, n_nationkey::DOUBLE AS amount FROM nation")
def table_backfill(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.col("n_name"), F.col("n_nationkey").cast("string")))).alias("rows"))
    page = rows.select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), D.markdown_rows(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), "rows")).alias("text"))
    return W.backfilled_rows(D.markdown_tables(page)).select("doc_id", F.col("desc").alias("item"), "amount")


@query("engine_chain", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'mock' WHEN o_orderstatus = 'F' THEN 'F,vlm' ELSE 'vlm,O' END AS chain FROM orders")
def engine_chain(spark, sf):
    s = F.col("o_orderstatus")
    fallbacks = F.when(s == "F", F.array(F.lit("vlm"), F.lit("F"))).when(s == "O", F.array(F.lit("vlm"), F.lit("O"), F.lit("vlm")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(W.engine_chain(F.when(s == "F", s), fallbacks, "mock"), ",").alias("chain"))


@query("stored_engine", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'b' WHEN o_orderstatus = 'O' THEN 'mock' ELSE 'a' END AS engine FROM orders")
def stored_engine(spark, sf):
    s = F.col("o_orderstatus")
    stored = F.when(s == "O", F.array(F.lit("b"), F.lit("mock"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return table(spark, sf, "orders").select("o_orderkey", W.stored_engine(F.when(s == "F", "b"), stored, "mock").alias("engine"))


@query("qa_findings", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity, 'layout' AS category, s_suppkey::INT AS page FROM supplier")
def qa_findings(spark, sf):
    raw = F.format_string('[{"severity": "%s", "category": "?", "page": %d}]', F.when(F.col("s_suppkey") % 2 == 0, "high").otherwise("odd"), F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(W.findings(raw)).alias("f")).select("s_suppkey", "f.severity", "f.category", "f.page")


@query("in_use_guard", "SELECT n_nationkey, count(s_suppkey) AS uses FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def in_use_guard(spark, sf):
    users = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return W.in_use(table(spark, sf, "nation"), users, "n_nationkey").select("n_nationkey", "uses")


@query("computed_grid", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_size::VARCHAR ELSE '=A1' END AS value, p_size % 3 <> 2 AS computed FROM part")
def computed_grid(spark, sf):
    part = table(spark, sf, "part")
    formulas = part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("=A1").alias("raw"))
    computed = part.where("p_size % 3 = 1").select("p_partkey", F.col("p_size").cast("string").alias("value"))
    return W.merged_grids(formulas, computed, ["p_partkey"])


@query("server_event_frames", RUNS + " SELECT seq, '{\"k\":1}' AS payload FROM runs UNION ALL SELECT seq, stage FROM runs")
def server_event_frames(spark, sf):
    text = F.concat(F.lit('data: {"k":1}\n\n: note\ndata: '), F.col("stage"), F.lit("\n\ndata: cut"))
    return runs(spark, sf).select("seq", F.explode(W.server_events(text)).alias("payload"))


@query("display_money", """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '€' ELSE 'XYZ ' END || CASE WHEN round(c_acctbal) < 0 THEN '-' ELSE '' END || format('{:,}', abs(round(c_acctbal))::BIGINT) || '.00' AS shown,
floor(c_acctbal / 10000 * 100 + 0.5)::BIGINT || '%' AS share FROM customer""")
def display_money(spark, sf):
    code = F.when(F.col("c_nationkey") % 2 == 0, "eur").otherwise("xyz")
    return table(spark, sf, "customer").select("c_custkey", display.money(F.round("c_acctbal"), code).alias("shown"), display.percent(F.col("c_acctbal") / 10000).alias("share"))


@query("display_durations", RUNS + " SELECT seq, CASE WHEN k IS NULL THEN '—' WHEN k * 100 < 1000 THEN k * 100 || ' ms' ELSE printf('%.2f s', k * 100 / 1000.0) END AS shown FROM runs")
def display_durations(spark, sf):
    return runs(spark, sf).select("seq", display.duration(F.col("k") * 100).alias("shown"))


@query("a1_source_reference", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE 'R' || n_regionkey || '!' END || 'C' || (n_nationkey + 1) AS ref FROM nation")
def a1_source_reference(spark, sf):
    sheet = F.when(F.col("n_regionkey") != 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    return table(spark, sf, "nation").select("n_nationkey", display.a1(sheet, F.lit(2), F.col("n_nationkey")).alias("ref"))


@query("route_views", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'cases' WHEN 2 THEN 'case' ELSE 'home' END AS view, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderkey::VARCHAR END AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'ocr' END AS tab FROM orders")
def route_views(spark, sf):
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    link = F.when(kind == 0, F.concat(F.lit("#/documents/"), k, F.lit("?tab=ocr"))).when(kind == 1, "#/cases/new").when(kind == 2, F.concat(F.lit("#/cases/"), k)).otherwise("#/")
    return table(spark, sf, "orders").select("o_orderkey", display.route(link).alias("r")).select("o_orderkey", "r.view", "r.id", "r.tab")


@query("snippet_match_key", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '-{2,}', ' ', 'g'), '\|', ' ', 'g'), '[^0-9A-Za-z_ .,/$%@\-]', '', 'g'), '\s+', ' ', 'g'))) AS key FROM documents WHERE text IS NOT NULL")
def snippet_match_key(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(display.match_key(F.col("text")), 256).alias("key"))


@query("prescan_verdicts", RUNS + """, p AS (SELECT doc_id, seq AS page, k * 10 < 50 AS dark FROM runs WHERE k IS NOT NULL)
SELECT doc_id, CASE WHEN bool_or(dark) THEN 'warn' ELSE 'pass' END AS verdict, count(*) FILTER (dark)::INT AS reasons FROM p GROUP BY 1""")
def prescan_verdicts(spark, sf):
    m = F.struct(F.lit(100.0).alias("sharpness"), F.lit(40.0).alias("contrast"), (F.col("k") * 10).cast("double").alias("brightness"), F.lit(0.5).alias("ink"))
    pages = runs(spark, sf).where("k is not null").select("doc_id", F.col("seq").alias("page"), P.verdicts(m, F.lit(200.0)).alias("checks"))
    return P.prescan(pages).select("doc_id", "verdict", F.size("reasons").alias("reasons"))


@query("effective_dpi", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 200.0 ELSE round(greatest(p_size * 40, 700) / 11.0, 1) END AS dpi FROM part")
def effective_dpi(spark, sf):
    source = F.when(F.col("p_size") % 2 == 0, "pdf").otherwise("image")
    return table(spark, sf, "part").select("p_partkey", P.effective_dpi(F.col("p_size") * 40, F.lit(700), source).alias("dpi"))


@query("image_metrics")
def image_metrics(spark, sf):
    """Pixels of a page are the bytes of its whole text, 32 to a row; a last row that isn't full is no row."""
    gray = F.encode("text", "ISO-8859-1")
    image = F.struct(F.lit(32).alias("width"), F.floor(F.octet_length(gray) / 32).cast("int").alias("height"), gray.alias("gray"))
    return table(spark, sf, "documents").select("doc_id", P.image_metrics(image).alias("m")).select("doc_id", "m.*")


@query("page_skew", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, a - 90 * floor((a + 45) / 90) + CASE WHEN a - 90 * floor((a + 45) / 90) = -45 THEN 90 ELSE 0 END AS skew, abs(a - 90 * floor((a + 45) / 90)) > 2 AS straighten FROM (SELECT *, (l_partkey % 360 - 180)::DOUBLE AS a FROM lineitem)")
def page_skew(spark, sf):
    pages = table(spark, sf, "lineitem").withColumn("angle", (F.col("l_partkey") % 360 - 180).cast("double"))
    return P.skewed(pages).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "skew", "straighten")


@query("boxes_kept", """WITH c AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_partkey % 60 AS cx, l_suppkey % 60 AS cy, l_quantity + 10 AS w, l_tax * 500 + 10 AS h, l_discount * 8 + 0.2 AS score FROM lineitem),
b AS (SELECT page, n, score, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM c WHERE score >= 0.45),
s AS (SELECT page, list([{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score, 'area': greatest(0, x2 - x1) * greatest(0, y2 - y1)}] ORDER BY score DESC, n) AS l FROM b GROUP BY 1),
k AS (SELECT page, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: greatest(0, least(x[1].x2, y.x2) - greatest(x[1].x1, y.x1)) * greatest(0, least(x[1].y2, y.y2) - greatest(x[1].y1, y.y1))
  > 0.5 * (y.area + x[1].area - greatest(0, least(x[1].x2, y.x2) - greatest(x[1].x1, y.x1)) * greatest(0, least(x[1].y2, y.y2) - greatest(x[1].y1, y.y1))))) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM s)
SELECT page, least(greatest((k.x1 - 2) / 0.5, 0), 100) AS x1, least(greatest((k.y1 - 1) / 0.5, 0), 90) AS y1, least(greatest((k.x2 - 2) / 0.5, 0), 100) AS x2, least(greatest((k.y2 - 1) / 0.5, 0), 90) AS y2, k.score AS score FROM k""")
def boxes_kept(spark, sf):
    """Line items as boxes of their orders' pages: those that stay after better ones have suppressed what they overlap."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    box = F.struct(
        (F.col("l_partkey") % 60).cast("double").alias("cx"), (F.col("l_suppkey") % 60).cast("double").alias("cy"), (F.col("l_quantity") + 10).alias("w"),
        (F.col("l_tax") * 500 + 10).alias("h"), (F.col("l_discount") * 8 + 0.2).alias("score"),
    )
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), box.alias("b")))).alias("l"))
    pages = rows.select("page", F.transform("l", lambda x: x["b"]).alias("candidates"), F.lit(0.5).alias("scale"), F.lit(2.0).alias("pad_x"), F.lit(1.0).alias("pad_y"), F.lit(100.0).alias("width"), F.lit(90.0).alias("height"))
    return P.detections(pages, ["page"])
