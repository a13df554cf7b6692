"""Cell values as a union of text, number and boolean, and the conversions between them.

A value is NULL or STRUCT<kind, s, n, b>, so that a column can hold what a document says without
guessing types from text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind:string,s:string,n:double,b:boolean>"

#: Trailing words of company names that two spellings may differ in.
LEGAL_SUFFIXES = ["ltd", "limited", "inc", "incorporated", "llc", "corp", "corporation", "co", "company", "plc", "gmbh", "sa"]
#: Date patterns in the order in which they are tried.
DATE_PATTERNS = ["yyyy-MM-dd", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/M/d"]
#: Words in a field's name that make it a date.
DATE_NAME = "(?i)date|_dt|effective|expiry|due|renewal"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(given: Column, kind: str, s=None, n=None, b=None) -> Column:
    arms = [F.lit(kind).alias("kind"), (F.lit(None).cast("string") if s is None else s).alias("s")]
    arms += [(F.lit(None).cast("double") if n is None else n).alias("n"), (F.lit(None).cast("boolean") if b is None else b).alias("b")]
    return F.when(given.isNotNull(), F.struct(*arms))


def text(c) -> Column:
    return _value(col(c), "string", s=col(c).cast("string"))


def number(c) -> Column:
    return _value(col(c), "number", n=col(c).cast("double"))


def boolean(c) -> Column:
    return _value(col(c), "bool", b=col(c))


class Static:
    """A value whose kind is known when the plan is made: its arms fold away, so formulas stay small."""

    def __init__(self, kind: str, column: Column):
        self.kind, self.column = kind, column

    def __getitem__(self, arm: str) -> Column:
        if arm == "kind":
            return F.lit(self.kind)
        kinds = {"s": ("string", "string"), "n": ("number", "double"), "b": ("bool", "boolean")}[arm]
        return self.column if kinds[0] == self.kind else F.lit(None).cast(kinds[1])

    def isNotNull(self) -> Column:  # noqa: N802
        return self.column.isNotNull()

    def isNull(self) -> Column:  # noqa: N802
        return self.column.isNull()

    def union(self) -> Column:
        return {"string": text, "number": number, "bool": boolean}[self.kind](self.column)


def Text(c) -> Static:  # noqa: N802
    return Static("string", col(c).cast("string"))


def Number(c) -> Static:  # noqa: N802
    return Static("number", col(c).cast("double"))


def Bool(c) -> Static:  # noqa: N802
    return Static("bool", col(c))


def union(v) -> Column:
    """The value as a column of the union type."""
    return v.union() if isinstance(v, Static) else v


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def rounded(x: Column, places: int = 4) -> Column:
    """A mean of few-digit numbers, rounded as its exact value is: what their sum is off by doesn't move a tie."""
    return F.round(F.round(x, places + 8), places)


def present(v: Column) -> Column:
    """Not null, '', 0 or false; blanks and '0' are present."""
    empty = ((v["kind"] == "string") & (v["s"] == "")) | ((v["kind"] == "number") & (v["n"] == 0)) | ((v["kind"] == "bool") & ~v["b"])
    return v.isNotNull() & ~F.coalesce(empty, F.lit(False))


def as_number(v: Column) -> Column:
    """The number, or a boolean as 0 or 1; never text."""
    return F.when(v["kind"] == "number", v["n"]).when(v["kind"] == "bool", v["b"].cast("double"))


def read_number(s: Column) -> Column:
    """The number that a whole text is, or null; texts that can't be one don't reach the cast, as one that fails costs far more."""
    shape = r"^[\x00-\x20]*[+-]?(\d+\.?\d*([eE][+-]?\d+)?[fFdD]?|\.\d+([eE][+-]?\d+)?[fFdD]?|0[xX].*|(?i:inf|infinity|nan))[\x00-\x20]*$"
    return F.when(s.rlike(shape), s.try_cast("double"))


def as_text(v: Column) -> Column:
    """Text of any value; whole numbers without a fraction."""
    n = v["n"]
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    shown = F.when(whole, F.format_string("%d", n.cast("long"))).otherwise(n.cast("string"))
    return F.when(v["kind"] == "string", v["s"]).when(v["kind"] == "number", shown).when(v["kind"] == "bool", F.initcap(v["b"].cast("string")))


def truthy(v: Column) -> Column:
    """Whether Python would take the value for true; null stays null."""
    return F.when(v["kind"] == "string", v["s"] != "").when(v["kind"] == "number", v["n"] != 0).when(v["kind"] == "bool", v["b"])


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(s, F.lit(" \t\n\x0b\f\r"))


def collapse(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"\s+", " "))


def as_date(s: Column) -> Column:
    """A date by the first pattern that fits, or null; month before day where both could be."""
    x = strip(s)
    # All patterns have a year of four digits, so most texts are settled by one test.
    return F.when(s.rlike(r"\d{4}"), F.coalesce(*(F.when(x.rlike(_shape(p)), F.try_to_date(x, p)) for p in DATE_PATTERNS)))


def _shape(pattern: str) -> str:
    """A cheap test that a text must pass before it is parsed: a parser that fails costs far more."""
    parts = {"yyyy": r"\d{4}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}"}
    return "^" + re.sub("y+|M+|d+", lambda m: parts[m[0]], pattern) + "$"


def to_number(s: Column) -> Column:
    """The amount in a phrase: the number at a currency sign, else the first bare one; o is read as 0."""
    at_sign = F.regexp_extract(s, r"[$€£]\s?([0-9][0-9.,oO]*)", 1)
    bare = F.regexp_extract(s, r"(?:^|[^\w.])([0-9][0-9.,oO]*)", 1)
    token = F.coalesce(F.nullif(at_sign, F.lit("")), bare)
    return F.rtrim(F.translate(F.translate(token, ",", ""), "oO", "00"), F.lit(".")).try_cast("double")  # of no text, null


def looks_numeric(s: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(s), "[,$€£]", "").try_cast("double").isNotNull(), F.lit(False))


def equality_key(s: Column, trim=True, whitespace=True, case=True) -> Column:
    """Text for comparison: strip, fold white space, lower-case, each if asked for."""
    out = strip(s) if trim else s
    out = collapse(out) if whitespace else out
    return F.lower(out) if case else out


def company_key(s: Column) -> Column:
    """Lower-case, single spaces, trailing company-form words dropped unless nothing else is there."""
    base = collapse(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")))
    forms = "|".join(LEGAL_SUFFIXES)
    cut = F.regexp_replace(base, rf"(\s+[.,]*({forms})[.,]*)+$", "")
    only_forms = cut.rlike(rf"^[.,]*({forms})[.,]*$")
    # A form is cut off after a space only, so a single word stays as it is.
    return F.when(~base.contains(" ") | only_forms, base).otherwise(cut)


def dedup_key(s: Column) -> Column:
    """Lower-case, trailing remark in brackets dropped, punctuation dropped, single spaces."""
    bare = F.regexp_replace(F.lower(s), r"\s*\([^)]*\)\s*$", "")
    return collapse(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))


def tokens(*parts: Column) -> Column:
    """Distinct lower-case words of the parts, camel case split, numbers dropped."""
    spaced = F.regexp_replace(F.concat_ws(" ", *parts), "(?<=[a-z])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$")))


def cell_text(v: Column) -> Column:
    """Spreadsheet cell as text: null is empty, whole numbers without a fraction."""
    return F.coalesce(as_text(v), F.lit(""))


def index_free_path(path: Column) -> Column:
    """A path without its list positions."""
    return F.array_join(F.filter(F.split(path, r"\."), lambda x: ~x.rlike("^[0-9]+$")), ".")


def slug(s: Column, fallback: str = "engine") -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", F.lit(fallback)).otherwise(bare)


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a column position from 0, up to three letters."""
    def letter(n: Column) -> Column:
        return F.char(F.lit(65) + n)

    first, second = index - 26, index - 26 - 676
    return (
        F.when(index < 26, letter(index))
        .when(first < 676, F.concat(letter(F.floor(first / 26)), letter(first % 26)))
        .otherwise(F.concat(letter(F.floor(second / 676)), letter(F.floor(second / 26) % 26), letter(second % 26)))
    )


def humanize(path: Column) -> Column:
    return F.initcap(F.replace(path, F.lit("_"), F.lit(" ")))


def tone(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence.isNotNull(), "low")


def display(v: Column) -> Column:
    """As a reader sees it: a dash for nothing, Yes or No for booleans."""
    return F.when(v.isNull(), "—").when(v["kind"] == "bool", F.when(v["b"], "Yes").otherwise("No")).otherwise(as_text(v))
