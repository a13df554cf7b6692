"""Forms and sheets filled from fields: kinds, values by kind, units, suggestions, places of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import values as V

#: Texts that leave a box empty.
OFF = ["", "false", "no", "off", "0", "n"]
#: Names that make a form field one for a signature.
SIGNATURE_NAME = "(?i)signat"
#: Words for leaf states of a button that is off.
OFF_STATES = ["/Off", "Off"]


def ticked(v: Column) -> Column:
    """Whether a value ticks a box; null ticks none."""
    by_text = ~F.lower(V.strip(v["s"])).isin(*OFF)
    return F.coalesce(F.when(v["kind"] == "string", by_text).when(v["kind"] == "number", v["n"] != 0).when(v["kind"] == "bool", v["b"]), F.lit(False))


def field_kind(name: Column, form_type: Column, states: Column, has_kids: Column) -> Column:
    """signature, choice, radio, checkbox or text, from a field's name, type and states of its buttons."""
    on = F.array_distinct(F.filter(F.coalesce(states, F.array().cast("array<string>")), lambda x: ~x.isin(*OFF_STATES)))
    button = F.when(F.coalesce(has_kids, F.lit(False)) & (F.size(on) > 1), "radio").otherwise("checkbox")
    return (
        F.when(name.rlike(SIGNATURE_NAME) | F.coalesce(form_type == "/Sig", F.lit(False)), "signature")
        .when(form_type == "/Ch", "choice").when(form_type == "/Btn", button).otherwise("text")
    )


def on_state(states: Column) -> Column:
    """What a ticked box is set to: its first state that isn't off."""
    first = F.try_element_at(F.filter(F.coalesce(states, F.array().cast("array<string>")), lambda x: ~x.isin(*OFF_STATES)), F.lit(1))
    return F.when(first.isNull(), "/Yes").when(first.startswith("/"), first).otherwise(F.concat(F.lit("/"), first))


def _given(rows: DataFrame, name: str, default: Column) -> Column:
    """A column that rows may have."""
    return F.coalesce(F.col(name), default) if name in rows.columns else default


def form_values(fields: DataFrame, leaves: DataFrame, on: list[str]) -> DataFrame:
    """fields with what is written into each: `written` (null: skipped), `stamped` and `warning`.

    fields: on..., name, kind, field_path, states, options; and, where a binding has them, is_signature (the field is one,
    whatever its kind), rect (where it is: without a place it isn't stamped) and image (whether there is one to stamp).
    leaves: on..., path, value (a value union).
    """
    held = leaves.select(*on, F.col("path").alias("field_path"), F.col("value").alias("_value"))
    met = fields.join(held, [*on, "field_path"], "left")
    said, kind, path = V.as_text(F.col("_value")), F.col("kind"), F.col("field_path")
    signs = (kind == "signature") | _given(fields, "is_signature", F.lit(False))
    placed, image = F.col("rect").isNotNull() if "rect" in fields.columns else F.lit(True), _given(fields, "image", F.lit(True))
    known = F.array_contains(F.coalesce("options", F.array().cast("array<string>")), said)
    written = (
        F.when(signs | (kind == "radio") | F.col("_value").isNull(), None)
        .when(kind == "checkbox", F.when(ticked(F.col("_value")), on_state(F.col("states"))).otherwise("/Off"))
        .when(kind == "choice", F.when(known, said)).otherwise(said)
    )
    warning = (
        F.when(signs, F.when(~placed, "the signature has no place and is not stamped").when(~image, "there is no image to stamp"))
        .when(F.coalesce(path, F.lit("")) == "", "no field bound")
        .when(F.col("_value").isNull(), F.concat(F.lit("no value at "), path)).when(kind == "radio", "radio groups are not filled")
        .when((kind == "choice") & ~known, F.concat(F.lit("not an option: "), said))
    )
    return met.select(*fields.columns, written.alias("written"), (signs & placed & image).alias("stamped"), F.concat(F.col("name"), F.lit(": "), warning).alias("warning"))


def with_unit(v: Column, unit: Column) -> Column:
    """(shown, number_format): a number keeps its value and gets a format with the unit, text gets it appended."""
    has, is_number = F.coalesce(unit, F.lit("")) != "", v["kind"] == "number"
    shown = F.when(has & ~is_number, F.concat(V.as_text(v), F.lit(" "), unit)).otherwise(V.as_text(v))
    return F.struct(shown.alias("shown"), F.when(has & is_number, F.concat(F.lit('#,##0.00" '), unit, F.lit('"'))).alias("number_format"))


def taken_suggestions(suggested: DataFrame, fallback: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, path, confidence, source, is_signature, rationale): a suggestion whose path the catalogue has, or that is a
    signature (which has no path), its confidence kept within 0 and 1; else the fallback.

    suggested and fallback: name, path, confidence, and is_signature and rationale where they have them. catalogue: path.
    """
    valid, no = catalogue.select(F.col("path").alias("_known")).distinct(), F.lit(False)
    none = F.lit(None).cast("string")
    s = suggested.select("name", F.col("path").alias("_path"), F.col("confidence").alias("_sure"), _given(suggested, "is_signature", no).alias("_signs"), _given(suggested, "rationale", none).alias("_why"), F.lit(True).alias("_said"))
    s = s.join(valid, F.col("_path") == F.col("_known"), "left")
    own = fallback.select("name", "path", "confidence", _given(fallback, "is_signature", no).alias("is_signature"), _given(fallback, "rationale", none).alias("rationale"))
    met = own.join(s, "name", "left")
    signs = F.coalesce("_signs", no) | (F.col("is_signature") & F.col("_said").isNotNull())
    good = F.coalesce("_said", no) & (F.col("_known").isNotNull() | (F.col("_path").isNull() & signs))
    sure = F.least(F.greatest(F.col("_sure"), F.lit(0.0)), F.lit(1.0))
    return met.select(
        "name", F.when(good, F.when(~signs, F.col("_path"))).otherwise(F.col("path")).alias("path"),
        F.when(good, F.when(F.col("_sure").isNotNull(), sure)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(good, "given").otherwise("fallback").alias("source"), F.when(good, signs).otherwise(F.col("is_signature")).alias("is_signature"),
        F.when(good, F.col("_why")).otherwise(F.col("rationale")).alias("rationale"),
    )


def place_of(box: Column, blocks: Column, table_box: Column) -> Column:
    """(rects, by): the field's own box, else the boxes of its blocks, else its table's box."""
    none = F.array().cast("array<array<double>>")
    real = F.filter(F.coalesce(blocks, none), lambda b: F.exists(b, lambda x: x != 0))
    return (
        F.when(box.isNotNull(), F.struct(F.array(box).alias("rects"), F.lit("box").alias("by")))
        .when(F.size(real) > 0, F.struct(real.alias("rects"), F.lit("blocks").alias("by")))
        .when(table_box.isNotNull(), F.struct(F.array(table_box).alias("rects"), F.lit("table").alias("by")))
        .otherwise(F.struct(none.alias("rects"), F.lit("none").alias("by")))
    )


def model_name(name: Column) -> Column:
    """line_items becomes LineItem: each part capitalised, one s at the end dropped."""
    joined = F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), "")
    return F.regexp_replace(joined, "s$", "")


def inserted_rows(cells: DataFrame, items: DataFrame, id_col: str, order: list[str], columns: list[str], anchor_row: int, anchor_col: int = 0, most: int = 500) -> DataFrame:
    """(id, row, col, value): template cells with rows for items put in at the anchor and what is below moved down.

    The first item takes the anchor row itself; items beyond `most` are left out, as a table's limit.
    """
    from paperloom.operators.templates import expanded_rows

    filled = expanded_rows(items, id_col, order, columns, anchor_row, anchor_col).where(F.col("row") < anchor_row + most)
    added = filled.groupBy(id_col).agg((F.max("row") - anchor_row).alias("_added"))
    moved = cells.join(added, id_col, "left").withColumn("_added", F.coalesce("_added", F.lit(0)))
    row = F.when(F.col("row") > anchor_row, F.col("row") + F.col("_added")).otherwise(F.col("row"))
    taken = F.lit(list(range(anchor_col, anchor_col + len(columns))))
    stays = (F.col("row") != anchor_row) | ~F.array_contains(taken, F.col("col"))
    return moved.where(stays).select(id_col, row.cast("int").alias("row"), "col", "value").unionByName(filled.select(id_col, F.col("row").cast("int").alias("row"), "col", "value"))
