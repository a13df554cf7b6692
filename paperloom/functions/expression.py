"""Formulas over document fields, compiled to columns.

Python's own `ast` reads a formula. Each kind of node that a formula may hold has a function here that turns
it into a plan: what it reads, and how to build its column. A node without such a function isn't allowed,
so checking a formula and compiling it are one pass. A formula that can't be answered for a row (a missing
field, text in arithmetic, division by zero) is NULL there, which means "skip", not "false".
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators.fields import Fields

#: The limits of a formula's length, number of syntax nodes and nesting.
MAX_CHARS, MAX_NODES, MAX_DEPTH = 400, 150, 16


class FormulaError(ValueError):
    """A formula that isn't allowed."""


@dataclass(frozen=True)
class Plan:
    """build: the value for given fields. reads: the fields it needs. literal: the constant it is, if it is one."""

    build: Callable[[Fields], object]
    reads: frozenset[str] = frozenset()
    literal: object = None


def planned(formula: str) -> Plan:
    """The plan of a formula, or FormulaError."""
    if not isinstance(formula, str) or not formula.strip() or len(formula) > MAX_CHARS:
        raise FormulaError(f"a formula has 1 to {MAX_CHARS} characters")
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise FormulaError(f"not a formula: {e}") from None
    layer, nodes, depth = [tree], 1, 0
    while layer := [child for node in layer for child in ast.iter_child_nodes(node)]:
        nodes, depth = nodes + len(layer), depth + 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            raise FormulaError("the formula is too large")
    return _plan(tree.body)


checked = planned


def compiled(formula: str, fields: Fields) -> Column:
    """The formula's value for each row; NULL where it is skipped."""
    return planned(formula).build(fields)


def references(formula: str) -> set[str]:
    """Names and literal paths that a formula reads."""
    return set(planned(formula).reads)


def problems(formula: str, declared: set[str]) -> list[str]:
    """What is wrong with a formula for a set of declared field names; empty if nothing."""
    try:
        found = references(formula)
    except FormulaError as e:
        return [str(e)]
    return [f"unknown field {name!r}" for name in sorted(found) if name.split(".")[0] not in declared]


# --- nodes ---------------------------------------------------------------------

_NODES: dict[type, Callable[[ast.expr], Plan]] = {}


def _node(kind: type):
    def put(function):
        _NODES[kind] = function
        return function

    return put


def _plan(node: ast.expr) -> Plan:
    if type(node) not in _NODES:
        raise FormulaError(f"not allowed in a formula: {type(node).__name__}")
    return _NODES[type(node)](node)


def _of(operators: dict, op: ast.AST):
    if type(op) not in operators:
        raise FormulaError(f"not allowed in a formula: {type(op).__name__}")
    return operators[type(op)]


def _joined(parts: list[Plan]) -> frozenset[str]:
    return frozenset().union(*(p.reads for p in parts))


def _literal(x) -> object:
    if isinstance(x, bool):
        return V.Bool(F.lit(x))
    return V.Text(F.lit(x)) if isinstance(x, str) else V.Number(F.lit(float(x)))


@_node(ast.Constant)
def _constant(node: ast.Constant) -> Plan:
    if type(node.value) not in (bool, int, float, str):
        raise FormulaError(f"not allowed in a formula: {node.value!r}")
    return Plan(lambda fields: _literal(node.value), literal=node.value)


@_node(ast.Name)
def _name(node: ast.Name) -> Plan:
    if node.id.startswith("_"):
        raise FormulaError(f"not a field: {node.id!r}")
    return Plan(lambda fields: fields.value(node.id), frozenset({node.id}))


_SIGNS = {
    ast.Not: lambda v: V.Bool(~V.truthy(v)),
    ast.USub: lambda v: V.Number(-V.as_number(v)),
    ast.UAdd: lambda v: V.Number(V.as_number(v)),
}


@_node(ast.UnaryOp)
def _signed(node: ast.UnaryOp) -> Plan:
    change, inner = _of(_SIGNS, node.op), _plan(node.operand)
    return Plan(lambda fields: change(inner.build(fields)), inner.reads)


_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)),  # the remainder has the sign of the divisor
}


@_node(ast.BinOp)
def _calculated(node: ast.BinOp) -> Plan:
    work, sides = _of(_ARITHMETIC, node.op), [_plan(node.left), _plan(node.right)]
    return Plan(lambda fields: V.Number(work(*(V.as_number(s.build(fields)) for s in sides))), _joined(sides))


@_node(ast.BoolOp)
def _decided(node: ast.BoolOp) -> Plan:
    """Left to right: a skip met first skips the whole, a deciding value met first decides it."""
    is_and, inner = isinstance(node.op, ast.And), [_plan(v) for v in node.values]

    def build(fields: Fields):
        parts = [p.build(fields) for p in inner]
        last = parts[-1]
        if not is_and or (isinstance(last, V.Static) and last.kind == "bool"):
            return V.Bool(_truth(parts, is_and))
        out = V.union(last)
        for v in reversed(parts):
            out = F.when(v.isNull(), None).when(~V.truthy(v), V.boolean(F.lit(False))).otherwise(out)
        return out

    return Plan(build, _joined(inner))


def _truth(parts: list, is_and: bool) -> Column:
    out = F.lit(is_and)
    for v in reversed(parts):
        t = V.truthy(v)
        out = F.when(v.isNull(), None).when(~t if is_and else t, not is_and).otherwise(out)
    return out


def equal(a: Column, b: Column) -> Column:
    """Equality across kinds: numbers and booleans compare as numbers, text only with text."""
    both_text = (a["kind"] == "string") & (b["kind"] == "string")
    both_number = (a["kind"] != "string") & (b["kind"] != "string")
    return F.when(both_text, a["s"] == b["s"]).when(both_number, V.as_number(a) == V.as_number(b)).otherwise(F.lit(False))


def _ordered(test: Callable[[Column, Column], Column]):
    def compare(a: Column, b: Column) -> Column:
        both_text = (a["kind"] == "string") & (b["kind"] == "string")
        both_number = (a["kind"] != "string") & (b["kind"] != "string")
        return F.when(both_text, test(a["s"], b["s"])).when(both_number, test(V.as_number(a), V.as_number(b)))

    return compare


def _within(a: Column, b: Column) -> Column:
    """Text in text; of other kinds there is no answer."""
    return F.when((a["kind"] == "string") & (b["kind"] == "string"), b["s"].contains(a["s"]))


_COMPARISONS = {
    ast.Eq: equal,
    ast.NotEq: lambda a, b: ~equal(a, b),
    ast.Lt: _ordered(lambda x, y: x < y),
    ast.LtE: _ordered(lambda x, y: x <= y),
    ast.Gt: _ordered(lambda x, y: x > y),
    ast.GtE: _ordered(lambda x, y: x >= y),
    ast.In: _within,
    ast.NotIn: lambda a, b: ~_within(a, b),
}


@_node(ast.Compare)
def _compared(node: ast.Compare) -> Plan:
    """A chain of comparisons holds if all do; the first that has no answer skips it."""
    first, steps = _plan(node.left), []
    for op, right in zip(node.ops, node.comparators, strict=True):
        test = _of(_COMPARISONS, op)
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
            if not all(isinstance(e, ast.Constant) for e in right.elts):
                raise FormulaError("a list in a formula holds constants only")
            steps.append((op, None, [_plan(e) for e in right.elts]))
        else:
            steps.append((test, _plan(right), []))

    def build(fields: Fields):
        left, answers = first.build(fields), []
        for test, right, listed in steps:
            if right is None:
                found = F.lit(False)
                for e in listed:
                    found = found | equal(left, e.build(fields))
                answers.append((left.isNotNull(), ~found if isinstance(test, ast.NotIn) else found))
            else:
                other = right.build(fields)
                answers.append((left.isNotNull() & other.isNotNull(), test(left, other)))
                left = other
        out = F.lit(True)
        for known, answer in reversed(answers):
            out = F.when(~known | answer.isNull(), None).when(~answer, False).otherwise(out)
        return V.Bool(out)

    return Plan(build, _joined([first, *(right for _, right, _ in steps if right is not None)]))


# --- helpers -------------------------------------------------------------------

#: What a builder's parameter may be: a value; a literal path, which is read; another literal text; literal digits.
VALUE, PATH, TEXT, DIGITS = "value", "path", "text", "digits"
#: Name of a helper: its builder, the kinds of its parameters, and how many of them it needs.
_HELPERS: dict[str, tuple[Callable, tuple[str, ...], int]] = {}


def _helper(*kinds: str, least: int | None = None, name: str = ""):
    def put(function):
        _HELPERS[name or function.__name__] = function, kinds, len(kinds) if least is None else least
        return function

    return put


@_node(ast.Call)
def _called(node: ast.Call) -> Plan:
    if not isinstance(node.func, ast.Name) or node.keywords or node.func.id not in _HELPERS:
        raise FormulaError("only helpers may be called, with plain arguments")
    build, kinds, least = _HELPERS[node.func.id]
    if not least <= len(node.args) <= len(kinds):
        raise FormulaError(f"{node.func.id}() takes {least} to {len(kinds)} arguments")
    given, reads = [_plan(a) for a in node.args], frozenset()
    for plan, kind in zip(given, kinds, strict=False):
        wanted = {PATH: str, TEXT: str, DIGITS: int}.get(kind)
        if wanted is not None and type(plan.literal) is not wanted:
            raise FormulaError(f"{node.func.id}() takes a literal {kind}")
        reads |= frozenset({plan.literal}) if kind == PATH else plan.reads

    def built(fields: Fields):
        return build(fields, *(p.build(fields) if kind == VALUE else p.literal for p, kind in zip(given, kinds, strict=False)))

    return Plan(built, reads)


for _how in ("sum", "min", "max", "avg"):
    _helper(PATH, TEXT, least=1, name=f"{_how}_of")(lambda fields, path, column=None, how=_how: V.Number(fields.aggregate(path, how, column)))


@_helper(PATH)
def count(fields, path):
    return V.Number(fields.aggregate(path, "count", None))


@_helper(PATH)
def is_present(fields, path):
    return V.Bool(V.present(fields.value(path)))


@_helper(PATH)
def field(fields, path):
    return fields.value(path)


@_helper(VALUE, name="abs")
def _size(fields, v):
    return V.Number(F.abs(V.as_number(v)))


@_helper(VALUE, DIGITS, least=1, name="round")
def _rounded(fields, v, digits=0):
    return V.Number(F.bround(V.as_number(v), min(6, max(0, digits))))


@_helper(VALUE, name="len")
def _length(fields, v):
    return V.Number(F.when(v["kind"] == "string", F.char_length(v["s"])))


for _called_as, _change in (("lower", F.lower), ("upper", F.upper), ("trim", V.strip)):
    _helper(VALUE, name=_called_as)(lambda fields, v, change=_change: V.Text(change(V.as_text(v))))


@_helper(VALUE, TEXT)
def matches(fields, v, pattern):
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(None).cast(V.VALUE)
    return V.Bool(V.as_text(v).rlike(f"^(?:{pattern})$"))


@_helper(VALUE, VALUE)
def days_between(fields, a, b):
    return V.Number(F.abs(F.datediff(V.as_date(V.as_text(a)), V.as_date(V.as_text(b)))))


@_helper()
def today(fields):
    return V.Text(F.lit(fields.settings.as_of.isoformat()))


@_helper(VALUE)
def to_date(fields, v):
    return V.Text(F.date_format(V.as_date(V.as_text(v)), "yyyy-MM-dd"))
