"""Problems of definitions in a table: a case for each thing that can be wrong."""

import json

from pyspark.sql import functions as F

from paperloom.operators import definitions as N

FIELDS = [{"name": "total", "kind": "scalar", "coerce": "number"}, {"name": "items", "kind": "list_composite", "sub_fields": [{"name": "qty", "source": "attribute", "coerce": "number"}]}]
GOOD = {"name": "invoice", "fields": FIELDS, "core_paths": ["total", "items.qty"]}

#: (rule, problems): what must be said of it, by the beginning of the text.
RULES = [
    ({"kind": "presence", "field_path": "total", "severity": "hard"}, []),
    ({"kind": "presence", "field_path": "gone.x"}, ["'field_path' has the undeclared field gone"]),
    ({"kind": "presence", "field_path": ""}, []), ({"kind": "presence", "severity": "loud"}, ["'severity'"]), ({"kind": "llm_advisory", "severity": "loud"}, []),
    ({"kind": "coded"}, ["no kind"]), ({}, ["no kind"]), ("text", ["must be an object"]),
    ({"kind": "threshold", "op": "lte", "threshold": 1}, []), ({"kind": "threshold", "op": "lte", "threshold": 1, "threshold_setting": "x"}, ["set exactly one of 'threshold'"]),
    ({"kind": "threshold", "threshold": 0}, ["'op'"]), ({"kind": "threshold", "op": "eq", "threshold": None}, ["set exactly one", "'op'"]),
    ({"kind": "set_membership", "allowed_list": []}, []), ({"kind": "set_membership"}, ["set exactly one of 'allowed_list'"]),
    ({"kind": "arithmetic", "result_path": "total", "addend_a_path": "total", "addend_b_path": ""}, ["'addend_b_path' is needed"]),
    ({"kind": "equality", "expected": ""}, []), ({"kind": "equality", "expected": "x", "expected_field_path": "total"}, ["set exactly one of 'expected'"]),
    ({"kind": "equality", "expected": "(", "match_mode": "regex"}, ["'expected' is no valid"]), ({"kind": "equality", "expected": "(", "match_mode": "glob"}, ["'match_mode'"]),
    ({"kind": "equality", "expected": "x", "fuzzy_threshold": 1.5}, ["'fuzzy_threshold'"]), ({"kind": "equality", "expected": "x", "fuzzy_threshold": True}, ["'fuzzy_threshold'"]),
    ({"kind": "equality", "expected": "x", "fuzzy_threshold": None}, ["'fuzzy_threshold'"]), ({"kind": "equality", "expected": "x", "fuzzy_threshold": 1}, []),
    ({"kind": "date_constraint", "min": "", "not_future": False}, ["at least one"]), ({"kind": "date_constraint", "not_future": True}, []),
    ({"kind": "date_constraint", "min": "2024-02-30", "max": "2024-01-01"}, ["'min' must be a date"]), ({"kind": "date_constraint", "max": 5}, ["'max' must be a date"]),
    ({"kind": "expression", "expression": "total > 1"}, []), ({"kind": "expression", "expression": ""}, ["'expression'"]), ({"kind": "expression", "expression": "1" * 401}, ["'expression'"]),
    ({"kind": "expression", "expression": "gone > 1"}, ["unknown field"]), ({"kind": "expression"}, ["'expression'"]),
    ({"kind": "aggregate", "agg": "sum", "op": "eq", "compare_value": 1, "list_path": "items"}, []),
    ({"kind": "aggregate", "agg": "mode", "op": "ne", "compare_value": "x", "tolerance": -1, "sub_field": 3}, ["'agg'", "'compare_value' must be a number", "'op'", "'tolerance'", "'sub_field'"]),
    ({"kind": "aggregate", "agg": "sum", "op": "eq"}, ["set exactly one of 'compare_value'"]),
    ({"kind": "numeric_range", "min": 5, "max": 1}, ["'min' must be <= 'max'"]), ({"kind": "numeric_range"}, ["at least one"]), ({"kind": "numeric_range", "min": "1", "max": None}, ["'min' must be a number"]),
    ({"kind": "percentage_tolerance", "pct": 0.5}, []), ({"kind": "percentage_tolerance"}, ["'pct'"]), ({"kind": "percentage_tolerance", "pct": -1}, ["'pct'"]),
    ({"kind": "format", "format": "iban"}, []), ({"kind": "format", "format": "morse"}, ["'format'"]),
    ({"kind": "mutual_exclusivity", "field_paths": ["total", "gone", "", 4]}, ["each of 'field_paths'", "'field_paths' has the undeclared field gone"]),
    ({"kind": "mutual_exclusivity", "field_paths": [], "mode": "two"}, ["'field_paths' must be a list", "'mode'"]), ({"kind": "required_together", "field_paths": "total"}, ["'field_paths' must be a list"]),
    ({"kind": "at_least_n_of", "field_paths": ["total"], "n": 2}, ["'n' must be <="]), ({"kind": "at_least_n_of", "field_paths": ["total"], "n": 1.5}, ["'n' must be a whole"]), ({"kind": "at_least_n_of", "field_paths": ["total"], "n": 0}, ["'n' must be a whole"]),
    ({"kind": "contains", "keywords": ["a", ""], "mode": "none"}, ["each of 'keywords'", "'mode'"]), ({"kind": "contains"}, ["'keywords' must be a list"]),
    ({"kind": "length_bounds", "min_length": 3, "max_length": 2}, ["'min_length' must be <="]), ({"kind": "length_bounds", "min_length": -1}, ["'min_length' must be a whole"]), ({"kind": "length_bounds"}, ["at least one"]),
    ({"kind": "field_confidence_floor", "floor": 0.5}, []), ({"kind": "field_confidence_floor", "floor": 2}, ["'floor'"]),
    ({"kind": "signature_presence"}, []), ({"kind": "signature_presence", "min_count": 0}, ["'min_count'"]),
]

#: (extraction, (part, place, beginning)).
EXTRACTIONS = [
    (GOOD, []), ("nonsense", [("extraction", None, "must be a JSON object")]), ([], [("extraction", None, "must be a JSON object")]),
    ({"name": "", "fields": {}, "core_paths": ["total"]}, [("extraction", None, "'name'"), ("extraction", None, "'fields'"), ("core", None, "total is no declared field")]),
    ({"name": "a", "fields": [3, {"name": "x", "kind": "scalar"}, {"name": "x", "kind": "odd", "coerce": "date"}]}, [
        ("extraction", None, "'core_paths'"), ("field", 0, "must be an object"), ("field", 2, "the name is there"), ("field", 2, "'kind'"), ("field", 2, "'coerce'"),
    ]),
    ({"name": "a", "core_paths": [], "fields": [{"kind": "composite"}, {"name": "y", "kind": "scalar", "sub_fields": [{"name": "z", "source": "span"}]}, {"name": "q", "kind": "composite", "sub_fields": [{"source": "air"}, 5]}]}, [
        ("field", 0, "'name'"), ("field", 0, "'sub_fields' are needed"), ("field", 1, "'sub_fields' are for"), ("field", 2, "column: 'name'"), ("field", 2, "column: 'source'"), ("field", 2, "a column must be") ,
    ]),
]


def test_every_rule(spark):
    rows = [(i, json.dumps(GOOD), json.dumps({"name": "r", "rules": [rule]})) for i, (rule, _) in enumerate(RULES)]
    found = {}
    for r in N.problems(spark.createDataFrame(rows, "id int, extraction string, rules string")).collect():
        assert (r.part, r.place) == ("rule", 0)
        found.setdefault(r.id, []).append(r.problem)
    for i, (rule, want) in enumerate(RULES):
        got = sorted(found.get(i, []))
        assert len(got) == len(want) and all(any(g.startswith(w) for g in got) for w in want), (rule, got)


def test_every_part_of_an_extraction(spark):
    rows = [(i, x if x == "nonsense" else json.dumps(x), None) for i, (x, _) in enumerate(EXTRACTIONS)]
    found = {}
    for r in N.problems(spark.createDataFrame(rows, "id int, extraction string, rules string")).collect():
        found.setdefault(r.id, []).append((r.part, r.place, r.problem))
    for i, (one, want) in enumerate(EXTRACTIONS):
        got = found.get(i, [])
        assert len(got) == len(want) and all(any(g[:2] == w[:2] and g[2].startswith(w[2]) for g in got) for w in want), (one, got)


def test_rules_without_a_list_and_none(spark):
    rows = [(1, None, json.dumps({"rules": 3, "citation_paths": "x"})), (2, None, None), (3, None, json.dumps({"name": "n", "rules": [{"kind": "presence", "field_path": "total"}]}))]
    found = {(r.id, r.part, r.problem) for r in N.problems(spark.createDataFrame(rows, "id int, extraction string, rules string")).collect()}
    assert found == {
        (1, "rules", "'name' must be a text that isn't empty"), (1, "rules", "'rules' must be a list"), (1, "rules", "'citation_paths' must be a list"),
        (3, "rule", "'field_path' has the undeclared field total"),
    }
    assert N.problems(spark.createDataFrame([], "id int, extraction string, rules string")).count() == 0


def test_a_value_has_its_kind_told_once(spark):
    """However many kinds there are: telling it reads the whole value."""
    assert str(N._kind(F.col("v"))).count("schema_of_variant") == 1
