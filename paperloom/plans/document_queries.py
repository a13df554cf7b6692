"""Queries of document text: offsets, grounding, headings, sections, tables, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import RUNS, runs, table

VOCABULARY = {"prose": ["the", "of", "and"], "german": ["der", "die", "und"], "french": ["le", "la", "des", "est"]}
OFFSETS = """WITH b AS (SELECT conv_id AS doc_id, turn AS page, role, text, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM conversations),
o AS (SELECT *, char_start + length(coalesce(text, '')) AS char_end FROM b)"""


def _pages(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")


@query("page_offsets", OFFSETS + " SELECT doc_id, page, char_start, char_end FROM o")
def page_offsets(spark, sf):
    return D.page_offsets(_pages(spark, sf)).select("doc_id", "page", "char_start", "char_end")


@query("char_to_page", OFFSETS + ", s AS (SELECT DISTINCT doc_id, p.pos FROM o, (VALUES (0), (150), (600), (5000)) p(pos)) SELECT s.doc_id, s.pos, max(o.page) FILTER (o.char_start <= s.pos) AS page FROM s JOIN o USING (doc_id) GROUP BY 1, 2")
def char_to_page(spark, sf):
    pages = _pages(spark, sf)
    spans = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(x) for x in (0, 150, 600, 5000)))).alias("pos"))
    return D.char_to_page(spans, D.page_offsets(pages))


@query("interval_overlap_blocks", OFFSETS + " SELECT doc_id, page, (char_start // 300)::INT AS span FROM o WHERE char_start < 300 AND char_end > 100")
def interval_overlap_blocks(spark, sf):
    pages = D.page_offsets(_pages(spark, sf))
    spans = pages.select("doc_id").distinct().select("doc_id", F.lit(100).alias("start"), F.lit(300).alias("end"))
    return D.overlapping_blocks(pages, spans).select("doc_id", "page", F.floor(F.col("char_start") / 300).cast("int").alias("span"))


def _spans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", "text", F.get(F.split("text", " "), 3).alias("span"), F.lit(None).cast("int").alias("hint_start"), F.lit(None).cast("int").alias("hint_end"))


@query("ground_exact_first", """SELECT doc_id, CASE WHEN coalesce(span, '') <> '' THEN instr(text, span) - 1 END AS char_start, CASE WHEN coalesce(span, '') <> '' THEN 'exact' ELSE 'ungrounded' END AS alignment
FROM (SELECT *, string_split(text, ' ')[4] AS span FROM documents)""")
def ground_exact_first(spark, sf):
    return D.grounded(_spans(spark, sf)).select("doc_id", "char_start", "alignment")


@query("ground_nearest")
def ground_nearest(spark, sf):
    hinted = _spans(spark, sf).withColumn("hint_start", F.lit(200)).withColumn("hint_end", F.lit(203))
    return D.grounded(hinted).select("doc_id", "char_start", "char_end", "alignment", "base_confidence")


def _blocks(spark, sf):
    label = F.when(F.col("role") == "system", "title").when(F.col("role") == "user", "section_header").otherwise("text")
    return _pages(spark, sf).select("doc_id", "page", F.lit(0).alias("block"), label.alias("label"), "text")


@query("heading_blocks", r"SELECT conv_id AS doc_id, turn AS page, trim(regexp_replace(text, '^#{1,6}\s+', '')) AS title FROM conversations WHERE role IN ('system', 'user')")
def heading_blocks(spark, sf):
    return D.headings(_blocks(spark, sf)).where("is_heading").select("doc_id", "page", "title")


@query("section_partition", """WITH h AS (SELECT conv_id AS doc_id, turn, text, (role IN ('system', 'user'))::INT AS h FROM conversations),
c AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY turn) - first(h) OVER (PARTITION BY doc_id ORDER BY turn) AS section FROM h)
SELECT doc_id, section::INT AS section, count(*)::INT AS n_blocks, length(string_agg(text, chr(10) || chr(10) ORDER BY turn))::INT AS n_chars FROM c GROUP BY 1, 2""")
def section_partition(spark, sf):
    return D.sections(_blocks(spark, sf)).select("doc_id", "section", "n_blocks", F.char_length("text").alias("n_chars"))


@query("section_coalesce")
def section_coalesce(spark, sf):
    return D.coalesced(D.sections(_blocks(spark, sf))).select("doc_id", "whole", F.size("sections").alias("n_sections"))


@query("section_merge_first_grounded", RUNS + """ SELECT doc_id, stage AS field, arg_min(seq, (confidence <= 0.5, seq)) AS value, count(*) AS candidates FROM runs GROUP BY 1, 2""")
def section_merge_first_grounded(spark, sf):
    leaves = runs(spark, sf).select("doc_id", F.col("stage").alias("field"), F.col("seq").alias("section"), F.col("seq").alias("value"), "confidence", (F.col("confidence") > 0.5).alias("grounded"))
    return D.merged_sections(leaves).select("doc_id", "field", "value", "candidates")


@query("ocr_chain_select", RUNS + """, a AS (SELECT doc_id, seq AS rank, stage AS engine, confidence, confidence >= 0.4 AND k > 2 AS good, seq = max(seq) OVER (PARTITION BY doc_id) AS last FROM runs WHERE k IS NOT NULL)
SELECT doc_id, arg_min(engine, rank) AS engine, min(rank) AS rank FROM a WHERE good OR last GROUP BY 1""")
def ocr_chain_select(spark, sf):
    attempts = runs(spark, sf).where("k is not null").select("doc_id", F.col("seq").alias("rank"), F.col("stage").alias("engine"), "confidence", F.lit(10).alias("chars"), (F.col("k") <= 2).alias("failed"))
    return D.chain_choice(attempts).select("doc_id", "engine", "rank")


@query("ocr_confidence_summary", RUNS + " SELECT doc_id, round(avg(confidence), 4) AS avg_confidence, sum(length(stage))::BIGINT AS char_count, round(avg(confidence), 4) < 0.8 AS low_confidence FROM runs GROUP BY 1")
def ocr_confidence_summary(spark, sf):
    blocks = runs(spark, sf).select("doc_id", F.col("stage").alias("text"), "confidence")
    return D.confidence_summary(blocks).select("doc_id", "avg_confidence", "char_count", "low_confidence")


@query("to_number_parse", r"""SELECT doc_id, TRY_CAST(nullif(rtrim(replace(replace(replace(coalesce(nullif(regexp_extract(text, '[$€£]\s?([0-9][0-9.,oO]*)', 1), ''), regexp_extract(text, '(?:^|[^0-9A-Za-z_.])([0-9][0-9.,oO]*)', 1)), ',', ''), 'o', '0'), 'O', '0'), '.'), '') AS DOUBLE) AS amount
FROM documents""")
def to_number_parse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.to_number(F.col("text")).alias("amount"))


@query("dedup_list_keep_first", r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS item, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord FROM documents),
k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(item), '\s*\([^)]*\)\s*$', ''), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM w)
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, key FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) = 1) GROUP BY 1""")
def dedup_list_keep_first(spark, sf):
    items = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ord", "item"))
    return D.dedup_list(items, "doc_id", "ord", "item").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _score_sql(name: str) -> str:
    words = VOCABULARY[name]
    hits = " + ".join(f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')::INT" for w in words)
    return f"({hits}) / {len(words)}.0 AS {name}"


@query("classify_vocabulary", f"""WITH r AS (SELECT doc_id, {", ".join(map(_score_sql, sorted(VOCABULARY)))} FROM documents),
s AS (SELECT doc_id, unnest(['french', 'german', 'prose']) AS t, unnest([french, german, prose]) AS v, french + german + prose AS total FROM r),
b AS (SELECT doc_id, t, round(CASE WHEN total > 0 THEN v / total ELSE 0 END, 4) AS score FROM s)
SELECT doc_id, CASE WHEN max(score) > 0 THEN arg_min(t, (-score, t)) END AS doc_type, round(max(score), 4) AS confidence FROM b GROUP BY 1""")
def classify_vocabulary(spark, sf):
    return D.classified(table(spark, sf, "documents"), VOCABULARY).select("doc_id", "doc_type", "confidence")


@query("markdown_table_parse", "SELECT r_regionkey, n_name AS cell FROM region JOIN nation ON n_regionkey = r_regionkey")
def markdown_table_parse(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.col("n_name"), F.col("n_nationkey").cast("string")))).alias("rows"))
    head = F.array(F.array(F.lit("name"), F.lit("key")))
    page = rows.select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("Intro\n"), D.markdown_rows(F.concat(head, "rows")), F.lit("\nafter")).alias("text"))
    cells = D.markdown_tables(page).select("doc_id", F.explode(D.markdown_cells(F.col("markdown"))).alias("row"))
    return cells.select(F.col("doc_id").alias("r_regionkey"), F.col("row")[0].alias("cell"))


@query("interval_containment", """WITH e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + floor(value * 300)::BIGINT AS e FROM events)
SELECT a.event_id, count(*) AS overlapped, count(*) FILTER (b.s <= a.s AND a.e <= b.e) AS inside, count(*) FILTER (a.s <= b.s AND b.e <= a.e) AS holds
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s < b.e AND a.e > b.s GROUP BY 1""")
def interval_containment(spark, sf):
    """How many of a user's other stretches of time each one overlaps, lies in and holds."""
    start = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")  # the nearest second, as the SQL's cast takes it
    e = table(spark, sf, "events").select("event_id", "user_id", start.alias("s"), (start + F.floor(F.col("value") * 300)).alias("e"))
    other = e.select("user_id", F.col("event_id").alias("other_id"), F.col("s").alias("os"), F.col("e").alias("oe"))
    met = D.interval_pairs(e, other, ["user_id"], ("s", "e"), ("os", "oe"), least=1024).where("event_id <> other_id")
    return met.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("overlapped"), F.count_if(F.col("inside").isin("left", "both")).alias("inside"), F.count_if(F.col("inside").isin("right", "both")).alias("holds")
    )
