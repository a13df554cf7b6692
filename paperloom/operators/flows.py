"""Stages of a document's way put together, and what a service keeps about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import documents as D

FINDING = "array<struct<severity:string,category:string,description:string,suggested_fix:string,page:string>>"


def engine_chain(preferred: Column, fallbacks: Column, default: str) -> Column:
    """Engines in the order of their use: the preferred one and the fallbacks, each once; else the default."""
    chain = F.array_distinct(F.filter(F.concat(F.array(preferred), F.coalesce(fallbacks, F.array())), lambda x: x.isNotNull()))
    return F.when(F.size(chain) > 0, chain).otherwise(F.array(F.lit(default)))


def stored_engine(asked: Column, stored: Column, default: str) -> Column:
    """Which stored result is meant: the one asked for, the default, the only one, else the first by name."""
    has = lambda x: F.array_contains(stored, x)
    return F.when(asked.isNotNull(), F.when(has(asked), asked)).when(has(F.lit(default)), F.lit(default)).otherwise(F.try_element_at(F.array_sort(stored), F.lit(1)))


def first_of_class(extractions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, cls, text, n): the first extraction of each class and how many there are. extractions: id, ord, cls, text."""
    return extractions.groupBy(id_col, "cls").agg(F.min_by("text", "ord").alias("text"), F.count(F.lit(1)).alias("n"))


def grouped_by_class(extractions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, groups): a map of each class to its texts, in the order in which they were extracted. extractions: id, ord, cls, text."""
    listed = extractions.groupBy(id_col, "cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    return listed.groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cls", "texts")))).alias("groups"))


def assembled(extractions: DataFrame, numbers: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, field, value, confidence): scalar fields of the first extraction of each class; a number that can't
    be read is null with half the confidence. extractions: id, ord, cls, text, confidence."""
    first = extractions.groupBy(id_col, "cls").agg(F.min_by(F.struct("text", "confidence"), "ord").alias("e"))
    is_number = F.col("cls").isin(*numbers)
    amount = V.to_number(F.col("e.text"))
    value = F.when(is_number, V.number(amount)).otherwise(V.text(V.strip(F.col("e.text"))))
    lost = is_number & amount.isNull()
    return first.select(id_col, F.col("cls").alias("field"), value.alias("value"), F.round(F.when(lost, F.col("e.confidence") / 2).otherwise(F.col("e.confidence")), 4).alias("confidence"))


def regrounded(leaves: DataFrame, texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Leaves with text but without an anchor looked for in the whole document; anchored ones stay as they are.

    leaves: id, path, value, char_start, confidence. texts: id, text.
    """
    open_ = F.col("char_start").isNull() & (F.col("value.kind") == "string") & (F.col("value.s") != "")
    at = F.instr(F.col("_text"), F.when(open_, F.col("value.s"))) - 1
    met = leaves.join(texts.select(id_col, F.col("text").alias("_text")), id_col, "left")
    found = open_ & (at >= 0)
    return met.select(
        id_col, "path", "value", F.when(found, at).otherwise(F.col("char_start")).alias("char_start"),
        F.when(found, F.lit(D.ALIGNMENT["exact"])).otherwise(F.col("confidence")).alias("confidence"),
    )


def backfilled_rows(tables: DataFrame, id_col: str = "doc_id", confidence: float = 0.5) -> DataFrame:
    """(id, idx, desc, qty, unit_price, amount, confidence): rows with a number from tables found in the text."""
    rows = tables.select(id_col, "page", "table", F.posexplode(D.markdown_cells(F.col("markdown"))).alias("n", "cells"))
    numeric = rows.where(F.exists("cells", lambda c: V.looks_numeric(c)) & (F.size("cells") >= 2))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("page", "table", "n")) - 1
    number = lambda i: F.when(F.size("cells") > i, V.to_number(F.try_element_at("cells", F.lit(i + 1))))
    last = V.to_number(F.try_element_at("cells", F.lit(-1)))
    return numeric.select(id_col, place.alias("idx"), F.col("cells")[0].alias("desc"), F.when(F.size("cells") > 2, number(1)).alias("qty"), F.when(F.size("cells") > 3, number(2)).alias("unit_price"), last.alias("amount"), F.lit(confidence).alias("confidence"))


def findings(raw: Column, severities=("low", "medium", "high"), categories=("layout", "content", "typography", "data")) -> Column:
    """Findings of a JSON text with unknown severities, categories and pages set to their defaults."""
    read = F.coalesce(F.from_json(raw, FINDING), F.array().cast(FINDING))
    return F.transform(read, lambda x: F.struct(
        F.when(x["severity"].isin(*severities), x["severity"]).otherwise("low").alias("severity"),
        F.when(x["category"].isin(*categories), x["category"]).otherwise("layout").alias("category"),
        F.coalesce(x["description"], F.lit("")).alias("description"), F.coalesce(x["suggested_fix"], F.lit("")).alias("suggested_fix"),
        F.coalesce(x["page"].try_cast("int"), F.lit(1)).alias("page"),
    ))


def in_use(definitions: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Definitions with how many rows use them: those with any can't be deleted."""
    counted = users.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("uses"))
    return definitions.join(counted, definitions[key] == counted["_key"], "left").drop("_key").withColumn("uses", F.coalesce("uses", F.lit(0)))


def merged_grids(formulas: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, computed) of a workbook's cells: a formula's computed value, else the formula itself, marked.

    formulas: keys, raw. computed: keys, value.
    """
    met = formulas.join(computed, keys, "left")
    is_formula = F.col("raw").startswith("=")
    return met.select(*keys, F.when(is_formula & F.col("value").isNotNull(), F.col("value")).otherwise(F.col("raw")).alias("value"), (~is_formula | F.col("value").isNotNull()).alias("computed"))


def image_models(payload: DataFrame, column: str = "body") -> DataFrame:
    """(id, name) of the models of a listing that take images, by name."""
    schema = "struct<data:array<struct<id:string,name:string,architecture:struct<input_modalities:array<string>>>>>"
    rows = payload.select(F.explode(F.from_json(column, schema)["data"]).alias("m"))
    return rows.where(F.array_contains("m.architecture.input_modalities", "image")).select("m.id", "m.name").orderBy(F.lower("name"))


def server_events(chunks: Column) -> Column:
    """JSON payloads of the complete frames of an event stream's text; a frame without its end is left."""
    frames = F.split(chunks, "\n\n")
    whole = F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0)))
    lines = F.filter(F.flatten(F.transform(whole, lambda f: F.split(f, "\n"))), lambda x: x.startswith("data: "))
    return F.transform(lines, lambda x: F.substring(x, F.lit(7), F.char_length(x)))
