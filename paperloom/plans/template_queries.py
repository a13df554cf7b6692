"""Queries of templates, mappings and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import markup as M
from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.operators import templates as T
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import table


@query("html_attr_scan", """SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n, coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[1], '') AS first FROM pages""")
def html_attr_scan(spark, sf):
    found = T.attributes(F.col("html"), "href")
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("first"))


@query("html_sanitize", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<iframe\b[^>]*>.*?</iframe\s*>', '', 'g'), '(?i)\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g')) AS digest FROM pages""")
def html_sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.without_scripts(F.col("html")), 256).alias("digest"))


@query("html_sanitize_parsed", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<iframe\b[^>]*>.*?</iframe\s*>', '', 'g'),
'(?i)\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g'), '(?i)\s(href|src)\s*=\s*("\s*javascript:[^"]*"|''\s*javascript:[^'']*''|javascript:[^\s>]+)', '', 'g')) AS digest FROM pages""")
def html_sanitize_parsed(spark, sf):
    """Every page cleaned by its tags, with a handler, a link and a frame put into it."""
    return table(spark, sf, "pages").select("page_id", F.sha2(M.sanitized("html"), 256).alias("digest"))


@query("html_bind", """SELECT page_id, ['url'] AS filled, ['none'] AS skipped, sha256('<p><span class=''>'' data-field=''url''>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
|| '</span><span data-field="none"></span></p>' || html || '<p><span data-sig-anchor="true" style="color:transparent;font-size:6px;">§§SIGZONE§§</span></p>') AS digest FROM pages""")
def html_bind(spark, sf):
    """A form before each page and a signature after it: only what they bind changes."""
    form = F.lit("<p><span class='>' data-field='url'>old <b><span>deep</span></b> tail</span><span data-field=\"none\">x</span></p>")
    body = F.concat(form, F.col("html"), F.lit("<p><img alt='a > b' data-signature src=x></p>"))
    rows = table(spark, sf, "pages").select("page_id", M.bound(body, F.create_map(F.lit("url"), F.col("url"))).alias("b"))
    return rows.select("page_id", "b.filled", "b.skipped", F.sha2("b.html", 256).alias("digest"))


@query("jaccard_mapping_top1", r"""WITH f AS (SELECT DISTINCT p_name AS name, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+'))) AS ft FROM part),
c AS (SELECT DISTINCT p_type AS path, list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+'))) AS ct FROM (SELECT p_type, min(p_brand) AS p_brand FROM part GROUP BY 1)),
s AS (SELECT name, path, round(len(list_intersect(ft, ct)) / len(list_distinct(list_concat(ft, ct))), 4) AS score FROM f, c WHERE len(list_intersect(ft, ct)) > 0),
b AS (SELECT name, arg_min({'path': path, 'score': score}, (-score, path)) AS b FROM s GROUP BY 1)
SELECT f.name, CASE WHEN b.score >= 0.3 THEN b.path END AS path, CASE WHEN b.score >= 0.3 THEN b.score END AS score FROM f LEFT JOIN b USING (name)""")
def jaccard_mapping_top1(spark, sf):
    part = table(spark, sf, "part")
    form = part.select(F.col("p_name").alias("name"), F.lit("").alias("label")).distinct()
    entries = part.groupBy(F.col("p_type").alias("path")).agg(F.min("p_brand").alias("entry_label"))
    return T.suggested(form, entries)


@query("lint_orphans", """SELECT l_suppkey AS template, count(*) AS total, count(CASE WHEN l_linenumber > 1 THEN l_partkey END) AS bound,
coalesce(len(list_distinct(list(l_partkey) FILTER (l_linenumber > 1 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)))), 0)::INT AS n_orphaned FROM lineitem GROUP BY 1""")
def lint_orphans(spark, sf):
    bound = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("template"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("path"))
    known = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"))
    return T.lint(bound, known).select("template", "total", "bound", F.size("orphaned").alias("n_orphaned"))


def _sheet(spark, sf):
    row = F.array(F.col("n_name"), F.lit(""), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("row"), row.alias("cells"))


@query("grid_cells", "SELECT n_nationkey AS row, 0 AS col, n_name AS value, 'A' || (n_nationkey + 1) AS a1 FROM nation UNION ALL SELECT n_nationkey, 2, n_regionkey::VARCHAR, 'C' || (n_nationkey + 1) FROM nation")
def grid_cells(spark, sf):
    return T.cells(_sheet(spark, sf), [], "row", "cells")


@query("grid_markdown", "SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS markdown FROM nation GROUP BY 1")
def grid_markdown(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.col("n_name"), F.col("n_nationkey").cast("string")))).alias("rows"))
    return rows.select("n_regionkey", D.markdown_rows(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), "rows")).alias("markdown"))


@query("a1_reference", """SELECT p_partkey, CASE WHEN c < 26 THEN chr((65 + c)::INT) ELSE chr((65 + (c - 26) // 26)::INT) || chr((65 + (c - 26) % 26)::INT) END || p_size AS a1 FROM (SELECT *, p_partkey % 700 AS c FROM part)""")
def a1_reference(spark, sf):
    place = (F.col("p_partkey") % 700).cast("int")
    return table(spark, sf, "part").select("p_partkey", F.concat(V.column_letters(place), F.col("p_size").cast("string")).alias("a1"))


@query("table_expand_rows", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, 9 + i AS row, 2 AS col, l_partkey::VARCHAR AS value FROM n UNION ALL SELECT l_orderkey, 9 + i, 3, l_suppkey::VARCHAR FROM n""")
def table_expand_rows(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return T.expanded_rows(table(spark, sf, "lineitem"), "l_orderkey", order, ["l_partkey", "l_suppkey"], 10, 2)


@query("region_grouping", """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first, count(*) AS fields FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, fields, (row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_suppkey) - 1) % 12 AS color FROM f""")
def region_grouping(spark, sf):
    return T.regions(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber").select("l_orderkey", "l_suppkey", "fields", "color")


@query("formula_widening", r"""WITH f AS (SELECT n_nationkey, '=SUM(B2:B' || n_nationkey || ')+SUM(E2:E' || n_nationkey || ')+SUM(A1:$C$' || n_nationkey || ')+Other!B1:B' || n_nationkey AS f FROM nation)
SELECT n_nationkey, regexp_replace(regexp_replace(f, '(\(B2:B)10\)', '\114)'), '(\(A1:\$C\$)10\)', '\114)') AS formula FROM f""")
def formula_widening(spark, sf):
    row = F.col("n_nationkey").cast("string")
    f = F.concat(F.lit("=SUM(B2:B"), row, F.lit(")+SUM(E2:E"), row, F.lit(")+SUM(A1:$C$"), row, F.lit(")+Other!B1:B"), row)
    return table(spark, sf, "nation").select("n_nationkey", T.widened(f, F.lit(10), F.lit(4), ("B", "C")).alias("formula"))


@query("engine_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || '/' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def engine_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.slug(F.concat_ws("/", "p_brand", "p_name")).alias("slug"))
