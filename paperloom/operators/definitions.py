"""Checks of document type definitions that are held in a column, as JSON: a row for each problem.

What a rule may say is data: for each kind a list of constraints (exactly one of two, a choice, a number with bounds, lists
of words, paths that a declared field has). They are compiled to one expression over a variant, so any number of definitions is
checked in one projection without a shuffle. Only formulas and patterns are read in Python, in Arrow batches, and
only where a rule has one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import expression
from paperloom.functions import values as V
from paperloom.operators import rules as R

# The words of definitions.
FIELD_KINDS = ("scalar", "presence", "list_scalar", "list_composite", "composite", "signature")
COMPOSITE = ("composite", "list_composite")
COERCE = ("text", "number")
SOURCES = ("span", "attribute")
FORMATS = ("alphanumeric", "currency", "digits", "email", "iban", "iso_country", "luhn", "url", "uuid")
COMPARE, EQUAL_TOO = ("gt", "gte", "lt", "lte"), ("eq", "gt", "gte", "lt", "lte")
MAX_FORMULA = 400


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    """The JSON kind of a value: string, number, whole, bool, list, object, null; null where there is no value."""
    def told(said: Column) -> Column:
        return (
            F.when(said.isNull(), None).when(said == "STRING", "string").when(said == "BOOLEAN", "bool").when(said == "VOID", "null").when(said == "BIGINT", "whole")
            .when(said.startswith("ARRAY"), "list").when(said.startswith("OBJECT"), "object").otherwise("number")
        )

    return V.let(F.schema_of_variant(v), told)


def _text(v: Column) -> Column:
    """The value if it is a text."""
    return V.let(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _number(v: Column) -> Column:
    return V.let(v, lambda x: F.when(_kind(x).isin("whole", "number"), F.try_variant_get(x, "$", "double")))


def _set(v: Column) -> Column:
    """Whether there is a value that is not null."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "VOID"


def _filled(v: Column) -> Column:
    """Whether a value is not null, false, zero or empty."""
    def told(x: Column, kind: Column) -> Column:
        return (
            F.when(kind == "string", F.try_variant_get(x, "$", "string") != "").when(kind == "bool", F.try_variant_get(x, "$", "boolean"))
            .when(kind.isin("whole", "number"), F.try_variant_get(x, "$", "double") != 0).when(kind == "list", F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
            .when(kind == "null", False).otherwise(x.isNotNull())
        )

    return F.coalesce(V.let(v, lambda x: V.let(_kind(x), lambda kind: told(x, kind))), F.lit(False))


def _list(v: Column) -> Column:
    return V.let(v, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")))


def _if(bad: Column, problem: str | Column) -> Column:
    text = F.lit(problem) if isinstance(problem, str) else problem
    return F.when(F.coalesce(bad, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))


def _base(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


@dataclass(frozen=True)
class Exactly:
    """Exactly one of two keys is set."""

    a: str
    b: str

    def found(self, v, declared):
        return _if(_set(_at(v, self.a)) == _set(_at(v, self.b)), f"set exactly one of '{self.a}' / '{self.b}'")


@dataclass(frozen=True)
class OneOf:
    """A key's value is one of some words; without `needed` only if the key is there."""

    key: str
    words: tuple[str, ...]
    needed: bool = False

    def found(self, v, declared):
        bad = lambda x: ~F.coalesce(_text(x).isin(*self.words), F.lit(False)) & (F.lit(self.needed) | x.isNotNull())
        return _if(V.let(_at(v, self.key), bad), f"'{self.key}' must be one of {', '.join(sorted(self.words))}")


@dataclass(frozen=True)
class Number:
    """A key's value is a number in its bounds. skip: whether a missing key ("missing"), or null too ("null"), says nothing."""

    key: str
    low: float | None = None
    high: float | None = None
    whole: bool = False
    skip: str = ""

    def found(self, v, declared):

        def wrong(x: Column, n: Column) -> Column:
            bad = n.isNull() if not self.whole else (_kind(x) != "whole") | x.isNull()
            if self.low is not None:
                bad = bad | F.coalesce(n < self.low, F.lit(False))
            if self.high is not None:
                bad = bad | F.coalesce(n > self.high, F.lit(False))
            asked = {"": F.lit(True), "missing": x.isNotNull(), "null": _set(x)}[self.skip]
            return asked & F.coalesce(bad, F.lit(True))

        bounds = " and ".join(f"at {side} {bound:g}" for side, bound in (("least", self.low), ("most", self.high)) if bound is not None)
        return _if(V.let(_at(v, self.key), lambda x: V.let(_number(x), lambda n: wrong(x, n))), f"'{self.key}' must be {'a whole number' if self.whole else 'a number'}{' of ' + bounds if bounds else ''}")


@dataclass(frozen=True)
class Some:
    """At least one of the keys is set, or filled."""

    keys: tuple[str, ...]
    filled: bool = False

    def found(self, v, declared):
        has = reduce(lambda a, b: a | b, ((_filled if self.filled else _set)(_at(v, k)) for k in self.keys))
        return _if(~has, f"at least one of {', '.join(self.keys)} is needed")


@dataclass(frozen=True)
class Ordered:
    low: str
    high: str

    def found(self, v, declared):
        return _if(_number(_at(v, self.low)) > _number(_at(v, self.high)), f"'{self.low}' must be <= '{self.high}'")


@dataclass(frozen=True)
class Needed:
    key: str

    def found(self, v, declared):
        return _if(~_filled(_at(v, self.key)), f"'{self.key}' is needed")


@dataclass(frozen=True)
class IsoDate:
    key: str

    def found(self, v, declared):
        x = _at(v, self.key)
        good = _text(x).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(_text(x), "yyyy-MM-dd").isNotNull()
        return _if(_filled(x) & ~F.coalesce(good, F.lit(False)), f"'{self.key}' must be a date YYYY-MM-DD")


@dataclass(frozen=True)
class Text:
    """A key's value is a text, if it is set."""

    key: str

    def found(self, v, declared):
        x = _at(v, self.key)
        return _if(_set(x) & (_kind(x) != "string"), f"'{self.key}' must be a text")


@dataclass(frozen=True)
class Words:
    """A list of texts, none empty; as paths each has a declared field."""

    key: str
    paths: bool = False

    def found(self, v, declared):
        none = F.lit("")
        return V.let(F.transform(F.coalesce(_list(_at(v, self.key)), F.array().cast("array<variant>")), lambda x: F.coalesce(_text(x), none)), lambda some: self._told(some, declared))

    def _told(self, some: Column, declared: Column) -> Column:
        empty = F.exists(some, lambda x: x == "")
        out = F.concat(_if(F.size(some) == 0, f"'{self.key}' must be a list that isn't empty"), _if(empty, f"each of '{self.key}' must be a text that isn't empty"))
        if not self.paths:
            return out
        lost = F.filter(F.transform(some, _base), lambda p: F.coalesce((p != "") & ~F.array_contains(declared, p), F.lit(False)))
        return F.concat(out, F.transform(lost, lambda p: F.concat(F.lit(f"'{self.key}' has the undeclared field "), p)))


@dataclass(frozen=True)
class NoMoreThan:
    """A number isn't above the length of a list."""

    key: str
    listed: str

    def found(self, v, declared):
        size = F.size(F.coalesce(_list(_at(v, self.listed)), F.array().cast("array<variant>")))
        bad = lambda x: (F.schema_of_variant(x) == "BIGINT") & V.let(F.try_variant_get(x, "$", "double"), lambda n: (n >= 1) & (n > size))
        return _if(V.let(_at(v, self.key), bad), f"'{self.key}' must be <= the number of '{self.listed}'")


#: What each kind of rule may say; kinds that are not here carry code and are refused.
GRAMMAR: dict[str, tuple] = {
    "presence": (), "threshold": (Exactly("threshold", "threshold_setting"), OneOf("op", COMPARE, True)),
    "arithmetic": (Needed("result_path"), Needed("addend_a_path"), Needed("addend_b_path")),
    "set_membership": (Exactly("allowed_list", "allowed_list_setting"),), "field_dependency": (), "uniqueness_vs_history": (),
    "equality": (Exactly("expected", "expected_field_path"), OneOf("match_mode", ("exact", "normalized", "regex", "fuzzy")), Number("fuzzy_threshold", 0, 1, skip="missing")),
    "date_constraint": (Some(("not_future", "min", "max", "before_field_path", "after_field_path"), True), IsoDate("min"), IsoDate("max")),
    "expression": (),
    "aggregate": (
        OneOf("agg", ("sum", "count", "min", "max", "avg"), True), Exactly("compare_value", "compare_field_path"), Number("compare_value", skip="null"),
        OneOf("op", EQUAL_TOO, True), Number("tolerance", 0, skip="missing"), Text("sub_field"),
    ),
    "numeric_range": (Some(("min", "max")), Number("min", skip="null"), Number("max", skip="null"), Ordered("min", "max")),
    "percentage_tolerance": (Number("pct", 0),), "format": (OneOf("format", FORMATS, True),), "conditional_presence": (),
    "mutual_exclusivity": (Words("field_paths", True), OneOf("mode", ("exactly_one", "at_most_one"))),
    "at_least_n_of": (Words("field_paths", True), Number("n", 1, whole=True), NoMoreThan("n", "field_paths")),
    "required_together": (Words("field_paths", True),), "contains": (Words("keywords"), OneOf("mode", ("any", "all"))),
    "length_bounds": (Some(("min_length", "max_length")), Number("min_length", 0, whole=True, skip="null"), Number("max_length", 0, whole=True, skip="null"), Ordered("min_length", "max_length")),
    "field_confidence_floor": (Number("floor", 0, 1),), "grounded_on_page": (), "signature_presence": (Number("min_count", 1, whole=True, skip="missing"),), "llm_advisory": (),
}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _read(formula: pd.Series, pattern: pd.Series, declared: pd.Series) -> pd.Series:
    """Problems of formulas and patterns; rows without one have none."""

    def one(f, p, names) -> list[str]:
        out = expression.problems(f, set(names)) if f is not None else []
        if p is not None:
            try:
                re.compile(p)
            except re.error:
                out = [*out, "'expected' is no valid pattern"]
        return out

    return pd.Series([one(*x) for x in zip(formula, pattern, declared, strict=True)], dtype=object)


def _rule_problems(v: Column, kind: Column, formula: Column, declared: Column) -> Column:
    """Problems of a rule whose kind and expression were read before."""
    free = lambda severity: (kind == "llm_advisory") | severity.isNull() | _text(severity).isin(*R.SEVERITIES)
    free = V.let(_at(v, "severity"), free)
    fine = (F.coalesce(formula, F.lit("")) != "") & (F.char_length(formula) <= MAX_FORMULA)
    by_kind = F.when(kind == "expression", _if(~F.coalesce(fine, F.lit(False)), f"'expression' must be a text of 1 to {MAX_FORMULA} characters"))
    for name, constraints in GRAMMAR.items():
        if constraints:
            by_kind = by_kind.when(kind == name, F.concat(*(c.found(v, declared) for c in constraints)))
    by_kind = by_kind.otherwise(F.array().cast("array<string>"))
    keys = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: e["key"].endswith("_path"))
    named = F.transform(keys, lambda e: F.struct(e["key"].alias("key"), F.coalesce(_text(e["value"]), F.lit("")).alias("path")))
    lost = F.filter(named, lambda e: (e["path"] != "") & ~F.array_contains(declared, _base(e["path"])))
    paths = F.transform(lost, lambda e: F.concat(F.lit("'"), e["key"], F.lit("' has the undeclared field "), _base(e["path"])))
    known = F.coalesce(kind.isin(*GRAMMAR), F.lit(False))
    told = F.concat(_if(~F.coalesce(free, F.lit(False)), f"'severity' must be one of {', '.join(sorted(R.SEVERITIES))}"), by_kind, F.coalesce(paths, F.array().cast("array<string>")))
    return F.when(_kind(v) != "object", F.array(F.lit("must be an object"))).when(~known, F.array(F.lit("no kind of rule that can be written down"))).otherwise(told)


def _field_problems(v: Column, earlier: Column) -> Column:
    read = F.struct(_text(_at(v, "name")).alias("name"), _text(_at(v, "kind")).alias("kind"), F.coalesce(_list(_at(v, "sub_fields")), F.array().cast("array<variant>")).alias("subs"))
    return V.let(read, lambda x: _problems_of_field(v, x["name"], x["kind"], x["subs"], earlier))


def _problems_of_field(v: Column, name: Column, kind: Column, subs: Column, earlier: Column) -> Column:
    composite = F.coalesce(kind.isin(*COMPOSITE), F.lit(False))
    coerce = lambda x: OneOf("coerce", COERCE).found(x, None)
    sub = lambda x: F.when(_kind(x) != "object", F.array(F.lit("a column must be an object"))).otherwise(F.transform(F.concat(
        _if(F.coalesce(_text(_at(x, "name")), F.lit("")) == "", "'name' must be a text that isn't empty"), OneOf("source", SOURCES, True).found(x, None), coerce(x)
    ), lambda p: F.concat(F.lit("column: "), p)))
    told = F.concat(
        _if(F.coalesce(name, F.lit("")) == "", "'name' must be a text that isn't empty"), _if(F.array_contains(earlier, name), "the name is there already"),
        OneOf("kind", FIELD_KINDS, True).found(v, None), coerce(v),
        _if(_filled(_at(v, "sub_fields")) & (_kind(_at(v, "sub_fields")) != "list"), "'sub_fields' must be a list"),
        _if(composite & (F.size(subs) == 0), "'sub_fields' are needed"), _if(~composite & (F.size(subs) > 0), "'sub_fields' are for composites only"),
        F.flatten(F.transform(subs, sub)),
    )
    return F.when(_kind(v) != "object", F.array(F.lit("must be an object"))).otherwise(told)


def problems(definitions: DataFrame, id_col: str = "id", extraction_col: str = "extraction", rules_col: str = "rules") -> DataFrame:
    """id, part (extraction, field, core, rules or rule), place, name, problem: every problem of every definition.

    extraction_col, rules_col: JSON of {name, fields, core_paths} and of {name, rules, citation_paths}. A definition without
    problems has no row; null for a part is a part that isn't there and says nothing.
    """
    none, text = F.array().cast("array<variant>"), F.array().cast("array<string>")
    e, r = F.try_parse_json(extraction_col), F.try_parse_json(rules_col)
    rows = definitions.select(F.col(id_col), F.col(extraction_col).isNotNull().alias("has_e"), F.col(rules_col).isNotNull().alias("has_r"), e.alias("e"), r.alias("r"))
    rows = rows.withColumn("fields", F.coalesce(_list(_at(F.col("e"), "fields")), none)).withColumn("rules", F.coalesce(_list(_at(F.col("r"), "rules")), none))
    rows = rows.withColumn("names", F.transform("fields", lambda x: F.coalesce(_text(_at(x, "name")), F.lit(""))))
    rows = rows.withColumn("declared", F.filter("names", lambda n: n != ""))

    def whole(v: Column, part: str, listed: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
        lists = [_if((_kind(_at(v, k)) != "list") | (F.lit(k not in optional) & _at(v, k).isNull()), f"'{k}' must be a list") for k in listed]
        return F.when(F.coalesce(_kind(v), F.lit("")) != "object", F.array(F.lit("must be a JSON object"))).otherwise(
            F.concat(_if(F.coalesce(_text(_at(v, "name")), F.lit("")) == "", "'name' must be a text that isn't empty"), *lists)
        )

    row = lambda part, place, name, told: F.transform(told, lambda p: F.struct(F.lit(part).alias("part"), place.alias("place"), name.alias("name"), p.alias("problem")))
    no_place, no_name = F.lit(None).cast("int"), F.lit(None).cast("string")
    cores = F.coalesce(_list(_at(F.col("e"), "core_paths")), none)
    lost = F.filter(F.transform(cores, lambda x: F.try_variant_get(x, "$", "string")), lambda p: ~F.array_contains("declared", _base(F.coalesce(p, F.lit("None")))))
    by_field = F.flatten(F.transform("fields", lambda x, i: row("field", i, _text(_at(x, "name")), _field_problems(x, F.slice("names", F.lit(1), i)))))
    of_e = F.concat(row("extraction", no_place, no_name, whole(F.col("e"), "extraction", ("fields", "core_paths"))), by_field, row("core", no_place, no_name, F.transform(lost, lambda p: F.concat(F.coalesce(p, F.lit("null")), F.lit(" is no declared field")))))
    of_r = row("rules", no_place, no_name, whole(F.col("r"), "rules", ("rules", "citation_paths"), ("citation_paths",)))
    kind = "array<struct<part:string,place:int,name:string,problem:string>>"
    wide = rows.select(id_col, F.concat(F.when(F.col("has_e"), of_e).otherwise(F.array().cast(kind)), F.when(F.col("has_r"), of_r).otherwise(F.array().cast(kind))).alias("told"))
    out = wide.select(id_col, F.explode("told").alias("t")).select(id_col, "t.*")
    each = rows.where("has_r").select(id_col, "declared", F.posexplode("rules").alias("place", "v"))
    # What more than one check asks for is a column, read once.
    v, kind = F.col("v"), F.col("kind")
    each = each.select("*", _text(_at(v, "kind")).alias("kind"), _text(_at(v, "name")).alias("name"), _text(_at(v, "expression")).alias("said"))
    formula = F.when((kind == "expression") & F.char_length("said").between(1, MAX_FORMULA), F.col("said"))
    is_pattern = (kind == "equality") & (_text(_at(v, "match_mode")) == "regex")
    pattern = F.when(is_pattern, _text(_at(v, "expected")))
    asks = each.withColumn("formula", formula).withColumn("pattern", pattern)
    told_by = F.when(F.col("formula").isNotNull() | F.col("pattern").isNotNull(), _read("formula", "pattern", F.when(F.col("formula").isNotNull(), F.col("declared")).otherwise(text)))
    read = asks.withColumn("read", F.coalesce(told_by, text))
    told = read.select(id_col, "place", "name", F.explode(F.concat(_rule_problems(v, kind, F.col("said"), F.col("declared")), "read")).alias("problem"))
    return out.union(told.select(id_col, F.lit("rule").alias("part"), "place", "name", "problem"))
