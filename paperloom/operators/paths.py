"""Paths into typed nested fields, compiled to columns when the plan is made.

A path is dotted; a number in it is a position in a list. Cells are structs with `value` and `confidence`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import values as V


def _is_cell(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"value", "confidence"} <= set(kind.names)


def _walked(at: Column, kind: T.DataType, path: str) -> tuple[Column, T.DataType] | None:
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            if not part.isdigit():
                return None
            at, kind = F.try_element_at(at, F.lit(int(part) + 1)), kind.elementType
        elif isinstance(kind, T.StructType) and part in kind.names:
            at, kind = at[part], kind[part].dataType
        else:
            return None
    return at, kind


def cell_at(fields: Column, kind: T.DataType, path: str) -> Column:
    """The cell at a path; null where the path leads to none, or beyond the end of a list."""
    found = _walked(fields, kind, path)
    return found[0] if found is not None and _is_cell(found[1]) else F.lit(None)


def resolved(fields: Column, kind: T.DataType, path: str) -> Column:
    """What a path leads to, a cell as its value; null for a wrong path or a position out of range."""
    found = _walked(fields, kind, path)
    if found is None:
        return F.lit(None)
    return found[0]["value"] if _is_cell(found[1]) else found[0]


def values_only(at: Column, kind: T.DataType) -> Column:
    """The same nesting with every cell replaced by its value."""
    if _is_cell(kind):
        return at["value"]
    if isinstance(kind, T.StructType):
        inner = F.struct(*(values_only(at[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(at.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(at, lambda x: values_only(x, kind.elementType))
    return at


def subfields(kind: T.DataType, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, kind) of a type: leaf, list or object; the columns of a list follow it with a star for the row."""
    if _is_cell(kind):
        yield prefix, "leaf"
    elif isinstance(kind, T.ArrayType):
        yield prefix, "list"
        if not _is_cell(kind.elementType):
            yield from ((p, k) for p, k in subfields(kind.elementType, f"{prefix}.*") if p != f"{prefix}.*")
    elif isinstance(kind, T.StructType):
        if prefix:
            yield prefix, "object"
        for f in kind.fields:
            yield from subfields(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)


def filled_paths(rows: DataFrame, column: str) -> DataFrame:
    """(path, kind, filled) of every path of a column of nested fields: how many values stand there in all rows. One pass."""

    def count(at: Column, parts: list[str]) -> Column:
        if not parts:
            return at.isNotNull().cast("long")
        if parts[0] == "*":
            return F.coalesce(F.aggregate(at, F.lit(0).cast("long"), lambda n, x: n + count(x, parts[1:])), F.lit(0))
        return count(at[parts[0]], parts[1:])

    paths = list(subfields(rows.schema[column].dataType))
    sums = rows.agg(*(F.sum(count(F.col(column), p.split("."))).alias(f"n{i}") for i, (p, _) in enumerate(paths)))
    each = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.coalesce(f"n{i}", F.lit(0)).alias("filled")) for i, (p, k) in enumerate(paths)))
    return sums.select(F.explode(each).alias("x")).select("x.*")


def coerced(reference: Column, given: Column) -> Column:
    """An edited value (a value union) brought to the kind of the field's present one, else left as it was typed."""
    said = V.as_text(given)
    truth = F.when(given["kind"] == "bool", given["b"]).otherwise(F.lower(V.strip(said)).isin("true", "yes", "1"))
    amount = V.strip(F.translate(said, ",$", "")).try_cast("double")
    amount = F.coalesce(amount, given["n"])
    return (
        F.when(given.isNull(), None).when(reference["kind"] == "bool", V.boolean(truth))
        .when((reference["kind"] == "number") & amount.isNotNull(), V.number(amount)).otherwise(given)
    )


def edited(leaves: DataFrame, edits: DataFrame) -> DataFrame:
    """Leaves (doc_id, path, value, ...) with the newest edit of each path applied, coerced to the field's kind.

    edits: doc_id, path, seq, new. An edited leaf keeps its first value as `original`; paths without a leaf are left out.
    """
    newest = edits.groupBy("doc_id", "path").agg(F.max_by("new", "seq").alias("_new"), F.count(F.lit(1)).alias("_n"))
    met = leaves.join(newest, ["doc_id", "path"], "left")
    changed = F.col("_n").isNotNull()
    return met.select(
        *(c for c in leaves.columns if c != "value"), F.when(changed, coerced(F.col("value"), F.col("_new"))).otherwise(F.col("value")).alias("value"),
        F.when(changed, F.col("value")).alias("original"), changed.alias("edited"),
    )
