"""From pages to decided documents in one plan, each document with its own error, and scored runs in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.operators import flows, rules
from paperloom.operators.fields import Fields
from paperloom.settings import DEFAULT, Settings

#: What an OCR service answers for a page; what it leaves out is null and gets its default below.
ANSWER = (
    "page int, text string, blocks array<struct<text:string,bbox:array<double>,confidence:double,label:string>>, "
    "tables array<struct<bbox:array<double>,n_rows:int,n_cols:int,markdown:string,confidence:double>>"
)


def service_pages(answers: DataFrame, id_col: str = "doc_id", json_col: str = "payload") -> DataFrame:
    """(id, page, text, blocks, tables, error) from the JSON answers of an OCR service, one row for each answer.

    Missing texts are empty, boxes zeros, labels `text`; without blocks the whole page is one. What is no
    JSON object is an error and has no page.
    """
    got = answers.select(id_col, F.from_json(F.col(json_col), f"struct<{ANSWER}>").alias("a"), F.get_json_object(json_col, "$").alias("_object"))
    zero = F.array(*(F.lit(0.0) for _ in range(4)))
    text = F.coalesce("a.text", F.lit(""))
    block = lambda t, box, sure, label: F.struct(F.coalesce(t, F.lit("")).alias("text"), F.coalesce(box, zero).alias("bbox"), sure.alias("confidence"), F.coalesce(label, F.lit("text")).alias("label"))
    blocks = F.transform("a.blocks", lambda b: block(b["text"], b["bbox"], b["confidence"], b["label"]))
    whole = F.array(block(text, zero, F.lit(None).cast("double"), F.lit("text")))
    tables = F.transform("a.tables", lambda t: F.struct(t["bbox"].alias("bbox"), F.coalesce(t["n_rows"], F.lit(0)).alias("n_rows"), F.coalesce(t["n_cols"], F.lit(0)).alias("n_cols"), F.coalesce(t["markdown"], F.lit("")).alias("markdown"), t["confidence"].alias("confidence")))
    none = F.array().cast("array<struct<bbox:array<double>,n_rows:int,n_cols:int,markdown:string,confidence:double>>")
    bad = ~F.coalesce(F.col("_object").startswith("{"), F.lit(False))
    return got.select(
        id_col, F.when(~bad, F.coalesce("a.page", F.lit(1))).alias("page"), F.when(~bad, text).alias("text"),
        F.when(~bad, F.when(F.size(F.coalesce(blocks, F.array())) > 0, blocks).otherwise(whole)).alias("blocks"),
        F.when(~bad, F.coalesce(tables, none)).alias("tables"), F.when(bad, "the service's answer can't be read").alias("error"),
    )


def page_summary(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, full_text, avg_confidence, char_count, table_count, low_confidence) of pages with blocks and tables."""
    sums = F.transform(F.filter("blocks", lambda b: b["confidence"].isNotNull()), lambda b: b["confidence"])
    one = pages.select(id_col, "page", "text", F.size("tables").alias("t"), F.aggregate(sums, F.lit(0.0), lambda a, x: a + x).alias("c"), F.size(sums).alias("n"))
    found = one.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"), F.sum("t").alias("table_count"), F.round(F.try_divide(F.sum("c"), F.sum("n")), 4).alias("avg_confidence"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), D.JOINER)
    low = F.coalesce(F.col("avg_confidence") < DEFAULT.ocr_confidence_warn, F.lit(False))
    return found.select(id_col, text.alias("full_text"), "avg_confidence", F.char_length(text).alias("char_count"), "table_count", low.alias("low_confidence"))


def sections_or_whole(blocks: DataFrame, engine: Column | None = None, id_col: str = "doc_id", sectioning: bool = True, window: int = 8000, least: int = DEFAULT.section_min_chars, most: int = DEFAULT.max_sections) -> DataFrame:
    """(id, sections, whole, gate): a document's sections, or the document as one where a gate holds.

    Gates: sectioning is off, the engine is the spreadsheet one, fewer than two headings, or the text fits
    one window; and more than `most` sections after folding.
    """
    marked = D.headings(blocks.withColumn("_engine", F.lit("layout") if engine is None else engine))
    about = marked.groupBy(id_col).agg(
        F.count_if("is_heading").alias("_headings"), (F.sum(F.char_length("text") + len(D.JOINER)) - len(D.JOINER)).alias("_chars"), F.first("_engine").alias("_engine")
    )
    parts = D.sections(blocks, id_col)
    folded = D.coalesced(parts, id_col, least, most)
    text = parts.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), D.JOINER).alias("_text"))
    gate = (
        F.when(F.lit(not sectioning), "off").when(F.col("_engine") == "spreadsheet", "spreadsheet").when(F.col("_headings") < 2, "headings")
        .when(F.col("_chars") <= window, "fits").when(F.col("whole"), "too_many")
    )
    one = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("_text").alias("text")))
    met = about.join(folded, id_col).join(text, id_col).withColumn("gate", gate)
    return met.select(id_col, F.when(F.col("gate").isNotNull(), one).otherwise(F.col("sections")).alias("sections"), F.col("gate").isNotNull().alias("whole"), "gate")


def concatenated(items: DataFrame, dedup: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, field, ord, value): list fields of ordered sections one after the other; with dedup, of equal keys the first stays.

    items: id, field, section, idx, value (text).
    """
    rows = items
    if dedup:
        first = F.min_by(F.struct("section", "idx", "value"), F.struct("section", "idx")).alias("f")
        keyed = items.where("value is not null").groupBy(id_col, "field", V.dedup_key(F.col("value")).alias("_key")).agg(first)
        rows = keyed.select(id_col, "field", "f.*").unionByName(items.where("value is null").select(id_col, "field", "section", "idx", "value"))
    listed = rows.groupBy(id_col, "field").agg(F.sort_array(F.collect_list(F.struct("section", "idx", "value"))).alias("l"))
    return listed.select(id_col, "field", F.posexplode(F.transform("l", lambda x: x["value"])).alias("ord", "value"))


def merged_composites(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, field, sub, value): of each composite field the first section that has any grounded cell, whole; else the first.

    cells: id, field, section, sub, value, grounded.
    """
    by_section = cells.groupBy(id_col, "field", "section").agg(F.bool_or("grounded").alias("g"), F.collect_list(F.struct("sub", "value")).alias("cells"))
    chosen = by_section.groupBy(id_col, "field").agg(F.min_by("cells", F.struct((~F.col("g")).alias("late"), F.col("section"))).alias("cells"))
    return chosen.select(id_col, "field", F.explode("cells").alias("c")).select(id_col, "field", "c.*")


def structured(
    pages: DataFrame, extract: Callable[[DataFrame], DataFrame], numbers: list[str], core: list[str], id_col: str = "doc_id"
) -> DataFrame:
    """(id, fields, confidence): a map of each document's fields from its pages.

    extract makes (id, ord, cls, text, confidence) of pages; spans that stand nowhere in the document count less.
    """
    spans = extract(pages)
    whole = pages.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), D.JOINER).alias("text"))
    placed = spans.join(whole.withColumnRenamed("text", "_text"), id_col)
    anchored = F.coalesce(F.contains(F.col("_text"), F.col("text")) & (F.col("text") != ""), F.lit(False))
    weight = F.when(anchored, D.ALIGNMENT["exact"]).otherwise(D.ALIGNMENT["ungrounded"])
    sure = placed.withColumn("confidence", F.round(F.col("confidence") * weight, 4)).drop("_text")
    leaves = flows.assembled(sure, numbers, id_col)
    cells = F.sort_array(F.collect_list(F.struct("field", F.struct("value", "confidence").alias("cell"))))
    of_core = F.sum(F.when(F.col("field").isin(*core), F.col("confidence")).otherwise(0.0))
    return leaves.groupBy(id_col).agg(F.map_from_entries(cells).alias("fields"), F.round(of_core / max(1, len(core)), 4).alias("confidence"))


def extracted(
    docs: DataFrame, pages: DataFrame, extract: Callable[[DataFrame], DataFrame], rule_list: list[rules.Rule], vocabularies: dict[str, list[str]],
    numbers: list[str], core: list[str], settings: Settings = DEFAULT,
) -> DataFrame:
    """(doc_id, doc_type, fields, confidence, decision, decision_confidence, reasons, error): the whole way of each document.

    Classify, structure and decide in one plan. A document that one stage can't handle has an error and no
    decision, and changes nothing for the others. docs: doc_id.
    """
    text = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), D.JOINER).alias("text"))
    typed = D.classified(text, vocabularies).select("doc_id", "doc_type")
    fields = structured(pages, extract, numbers, core)
    met = docs.join(typed, "doc_id", "left").join(fields, "doc_id", "left").join(text.select("doc_id", F.char_length("text").alias("_chars")), "doc_id", "left")
    error = F.when(F.col("_chars").isNull(), "no pages").when(F.col("_chars") == 0, "no text").when(F.col("fields").isNull(), "nothing was extracted")
    names = sorted({*numbers, *core})
    held = Fields(values={n: F.col("fields")[n]["value"] for n in names}, confidences={n: F.col("fields")[n]["confidence"] for n in names}, settings=settings)
    gate = F.array(rules.gates(F.coalesce("confidence", F.lit(0.0)), F.lit("pass"), settings)[0])
    judged = rules.decided(met.withColumn("error", error), F.concat(rules.ruleset(rule_list, held), gate), extraction=F.coalesce("confidence", F.lit(0.0)))
    fine = F.col("error").isNull()
    return judged.select(
        "doc_id", "doc_type", "fields", "confidence", F.when(fine, F.col("decision")).alias("decision"),
        F.when(fine, F.col("decision_confidence")).alias("decision_confidence"), F.when(fine, F.col("reasons")).alias("reasons"), "error",
    )


def batch_counts(results: DataFrame) -> DataFrame:
    """(succeeded, failed) of a batch of results with an error column."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
