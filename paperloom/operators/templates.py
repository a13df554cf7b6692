"""Templates: which fields a text binds, how form fields map to a catalogue, and grids that rows are filled into."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import values as V
from paperloom.settings import DEFAULT


def suggested(form: DataFrame, catalogue: DataFrame, threshold: float = DEFAULT.mapping_threshold) -> DataFrame:
    """(name, path, score): for each form field the catalogue entry with the greatest share of common words.

    Candidates meet on a word they have in common; entries without one score 0 and are no suggestion.
    form: name, label. catalogue: path, entry_label.
    """
    f = form.select("name", V.tokens(F.col("name"), F.col("label")).alias("ft"))
    c = catalogue.select("path", V.tokens(F.col("path"), F.col("entry_label")).alias("ct"))
    met = f.withColumn("t", F.explode("ft")).join(c.withColumn("t", F.explode("ct")), "t").groupBy("name", "path").agg(
        F.count(F.lit(1)).alias("common"), F.first(F.size("ft")).alias("nf"), F.first(F.size("ct")).alias("nc")
    )
    scored = met.withColumn("score", F.round(F.col("common") / (F.col("nf") + F.col("nc") - F.col("common")), 4))
    best = scored.groupBy("name").agg(F.min_by(F.struct("path", "score"), F.struct((-F.col("score")).alias("less"), "path")).alias("best"))
    good = F.col("best.score") >= threshold
    return f.select("name").distinct().join(best, "name", "left").select("name", F.when(good, F.col("best.path")).alias("path"), F.when(good, F.col("best.score")).alias("score"))


def lint(bound: DataFrame, known: DataFrame) -> DataFrame:
    """(template, total, bound, orphaned): paths that a template uses and the catalogue hasn't.

    bound: template, path (null: unbound). known: path.
    """
    met = bound.join(known.select(F.col("path").alias("known")).distinct(), F.col("path") == F.col("known"), "left")
    return met.groupBy("template").agg(
        F.count(F.lit(1)).alias("total"), F.count("path").alias("bound"),
        F.sort_array(F.collect_set(F.when(F.col("path").isNotNull() & F.col("known").isNull(), F.col("path")))).alias("orphaned"),
    )


def attributes(html: Column, name: str = "data-field") -> Column:
    """Values of an attribute in the order in which they stand."""
    return F.regexp_extract_all(html, F.lit(rf'{name}="([^"]*)"'), F.lit(1))


def without_scripts(html: Column) -> Column:
    """Scripts, frames and handlers cut by patterns: what SQL can say of `markup.sanitized`."""
    bare = F.regexp_replace(html, r"(?is)<(script|iframe)\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(bare, r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")


def cells(sheet: DataFrame, id_cols: list[str], row_col: str, cells_col: str, max_rows: int = DEFAULT.sheet_max_rows, max_cols: int = DEFAULT.sheet_max_cols) -> DataFrame:
    """(ids, row, col, value, a1) of every cell that isn't empty, within the sheet's limits."""
    out = sheet.where(F.col(row_col) < max_rows).select(*id_cols, F.col(row_col).alias("row"), F.posexplode(F.slice(cells_col, 1, max_cols)).alias("col", "value"))
    return out.where(F.coalesce("value", F.lit("")) != "").withColumn("a1", F.concat(V.column_letters(F.col("col")), (F.col("row") + 1).cast("string")))


def expanded_rows(items: DataFrame, id_col: str, order: list[str], columns: list[str], anchor_row: int, anchor_col: int = 0) -> DataFrame:
    """(id, row, col, value): cells that a table of items fills from an anchor on, a row for each item."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1
    cellset = F.array(*(F.struct(F.lit(anchor_col + n).alias("col"), F.col(c).cast("string").alias("value")) for n, c in enumerate(columns)))
    numbered = items.select(id_col, (F.lit(anchor_row) + place).alias("row"), cellset.alias("c"))  # before a row becomes several
    return numbered.select(id_col, "row", F.explode("c").alias("c")).select(id_col, "row", "c.*")


def widened(formula: Column, anchor_row: Column, added: Column, columns: tuple[str, ...]) -> Column:
    """Formulas whose ranges end at the anchor row (numbered from 1) reach over the rows added below it.

    Only ranges that meet a column of the table (`columns`, by their letters) and aren't of another sheet.
    """
    table = {_column_number(c) for c in columns}

    @F.pandas_udf(T.StringType())
    def widen(formulas: pd.Series, rows: pd.Series, more: pd.Series) -> pd.Series:
        import re

        def one(f, row, n):
            def put(m):
                low, high = sorted((_column_number(m[2]), _column_number(m[6])))
                meets = any(low <= c <= high for c in table)
                return f"{m[1]}{m[2]}{m[3]}{m[4]}:{m[5]}{m[6]}{m[7]}{int(m[8]) + n}" if meets and int(m[8]) == row else m[0]

            return None if f is None or n < 1 else re.sub(r"(?<![A-Za-z0-9_!$])(\$?)([A-Za-z]{1,3})(\$?)(\d+):(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_])", put, f)

        return pd.Series([one(*x) for x in zip(formulas, rows, more, strict=True)], dtype=object)

    return F.when(added >= 1, widen(formula, anchor_row, added)).otherwise(formula)


def _column_number(letters: str) -> int:
    total = 0
    for c in letters.upper():
        total = total * 26 + ord(c) - 64
    return total


def regions(rows: DataFrame, id_col: str, key_col: str, ord_col: str, colors: int = 12) -> DataFrame:
    """Fields that share a region get one color, by the order in which regions first appear."""
    first = rows.groupBy(id_col, key_col).agg(F.min(ord_col).alias("first"), F.count(F.lit(1)).alias("fields"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("first", key_col)) - 1
    return first.withColumn("color", place % colors)
