"""From typed nested fields to leaf rows, and from definitions to schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import values as V


@dataclass(frozen=True)
class FieldDef:
    """A field of a document type: scalar, presence, list_scalar, list_composite, composite or signature.

    cls: the class of its extractions, by default the field's name. span_sub: the column that is the extraction's own
    text; the others are its attributes. dedup: of a list's items with equal keys the first stays.
    """

    name: str
    kind: str = "scalar"
    coerce: str = "text"
    label: str = ""
    subs: tuple[tuple[str, str], ...] = ()  # (name, text or number)
    core: bool = False
    cls: str = ""
    span_sub: str = ""
    dedup: bool = False


#: Fields of the built-in document types; text unless said otherwise.
BUILT_IN: dict[str, tuple[FieldDef, ...]] = {
    "invoice": (
        FieldDef("vendor", core=True), FieldDef("invoice_no", core=True), FieldDef("po_number"), FieldDef("invoice_date"),
        FieldDef("due_date"), FieldDef("currency"), FieldDef("payment_terms"), FieldDef("subtotal", coerce="number"),
        FieldDef("tax", coerce="number"), FieldDef("total", coerce="number", core=True),
        FieldDef("line_items", "list_composite", subs=(("desc", "text"), ("qty", "number"), ("unit_price", "number"), ("amount", "number")), core=True),
        FieldDef("bank_details_present", "presence"),
    ),
    "contract": (
        FieldDef("parties", "list_scalar", core=True), FieldDef("effective_date", core=True), FieldDef("term", core=True),
        FieldDef("renewal_clause"), FieldDef("governing_law", core=True), FieldDef("total_value", coerce="number"),
        FieldDef("liability_cap", coerce="number"), FieldDef("key_dates", "list_scalar"),
        FieldDef("termination_clause", "composite", subs=(("text", "text"), ("notice_period", "text"))),
        FieldDef("signatures_present", "presence"), FieldDef("signatures", "signature"),
    ),
    "po": (
        FieldDef("po_number", core=True), FieldDef("vendor", core=True), FieldDef("order_date"), FieldDef("total", coerce="number", core=True),
        FieldDef("line_items", "list_composite", subs=(("desc", "text"), ("qty", "number"), ("unit_price", "number"), ("amount", "number")), core=True),
    ),
    "delivery_note": (
        FieldDef("delivery_note_no", core=True), FieldDef("delivery_date", core=True), FieldDef("vendor", core=True),
        FieldDef("line_items", "list_composite", subs=(("desc", "text"), ("qty", "number")), core=True),
    ),
}


def schema(fields: tuple[FieldDef, ...]) -> T.StructType:
    """The Spark type of a document type's fields, every cell with its value, confidence and page."""
    def cell(coerce: str) -> T.StructType:
        kind = {"number": T.DoubleType(), "bool": T.BooleanType()}.get(coerce, T.StringType())
        return T.StructType([T.StructField("value", kind), T.StructField("confidence", T.DoubleType()), T.StructField("page", T.IntegerType())])

    def of(f: FieldDef) -> T.DataType:
        row = T.StructType([T.StructField(n, cell(c)) for n, c in f.subs])
        return {
            "scalar": cell(f.coerce), "presence": cell("bool"), "list_scalar": T.ArrayType(cell(f.coerce)),
            "list_composite": T.ArrayType(row), "composite": row, "signature": T.ArrayType(cell("bool")),
        }[f.kind]

    return T.StructType([T.StructField(f.name, of(f)) for f in fields])


def definition_problems(fields: list[FieldDef]) -> list[str]:
    """What is wrong with a document type; empty if nothing."""
    out, seen = [], set()
    for f in fields:
        if not f.name.isidentifier() or f.name.startswith("_"):
            out.append(f"bad field name {f.name!r}")
        if f.name in seen:
            out.append(f"field {f.name!r} stands twice")
        seen.add(f.name)
        if f.kind not in ("scalar", "presence", "list_scalar", "list_composite", "composite", "signature"):
            out.append(f"no field kind {f.kind!r}")
        if f.kind in ("list_composite", "composite") and not f.subs:
            out.append(f"{f.name!r} needs columns")
    if not any(f.core for f in fields):
        out.append("at least one core field")
    return out


LEAF = "path string, key string, idx int, value " + V.VALUE + ", confidence double, page int"


def flatten(docs: DataFrame, id_col: str, fields_col: str, fields: tuple[FieldDef, ...]) -> DataFrame:
    """One row for each leaf: id, path, key, idx, ord, value, confidence, page. Lists number their rows.

    One generator over an array that is built in the projection: no union of scans, no shuffle.
    """
    def leaf(path, key, idx, cell, coerce):
        make = {"number": V.number, "bool": V.boolean}.get(coerce, V.text)
        return F.struct(
            path.alias("path"), F.lit(key).alias("key"), idx.alias("idx"), make(cell["value"]).alias("value"),
            cell["confidence"].alias("confidence"), cell["page"].alias("page"),
        )

    def of(f: FieldDef):
        at, none = F.col(fields_col)[f.name], F.lit(None).cast("int")
        coerce = "bool" if f.kind in ("presence", "signature") else f.coerce
        if f.kind in ("scalar", "presence"):
            return F.array(leaf(F.lit(f.name), f.name, none, at, coerce))
        if f.kind in ("list_scalar", "signature"):
            return F.transform(F.coalesce(at, F.array()), lambda x, i: leaf(F.concat_ws(".", F.lit(f.name), i), f.name, i, x, coerce))
        if f.kind == "composite":
            return F.array(*(leaf(F.lit(f"{f.name}.{n}"), n, none, at[n], c) for n, c in f.subs))
        row = lambda x, i: F.array(*(leaf(F.concat_ws(".", F.lit(f.name), i, F.lit(n)), n, i, x[n], c) for n, c in f.subs))
        return F.flatten(F.transform(F.coalesce(at, F.array()), row))

    parts = [of(f) for f in fields]
    return docs.select(id_col, F.posexplode(F.concat(*parts)).alias("ord", "leaf")).select(id_col, "ord", "leaf.*")


def core_confidence(leaves: DataFrame, id_col: str, core: list[str]) -> DataFrame:
    """Mean over core fields of their confidence: of a list or composite the mean of its rows; nothing is 0."""
    top = F.substring_index("path", ".", 1)
    by_row = leaves.where(top.isin(core)).groupBy(id_col, top.alias("field"), "idx").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    by_field = by_row.groupBy(id_col, "field").agg(F.avg("c").alias("c"))
    return by_field.groupBy(id_col).agg(F.round(F.sum("c") / len(core), 4).alias("confidence"))


def catalogue(fields: tuple[FieldDef, ...], rows: int = 1) -> list[tuple[str, str, str]]:
    """(path, label, kind) of every field that a template can bind; lists repeat `rows` times."""
    out = []
    for f in fields:
        label = f.label or f.name.replace("_", " ").title()
        if f.kind in ("scalar", "presence"):
            out.append((f.name, label, "bool" if f.kind == "presence" else f.coerce))
        elif f.kind == "composite":
            out += [(f"{f.name}.{n}", f"{label} {n.replace('_', ' ').title()}", c) for n, c in f.subs]
        elif f.kind in ("list_scalar", "signature"):
            out += [(f"{f.name}.{i}", f"{label} {i + 1}", f.coerce) for i in range(rows)]
        else:
            out += [(f"{f.name}.{i}.{n}", f"{label} {i + 1} {n.replace('_', ' ').title()}", c) for i in range(rows) for n, c in f.subs]
    return out
