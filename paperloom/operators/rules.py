"""Declarative checks over document fields, fused into one projection, and the decision they lead to.

A rule is data. `check` turns it into a nullable struct column (name, passed, detail, severity); NULL
means that the rule has nothing to say for the row. `ruleset` puts all rules of a document type in one
array column, so any number of rules costs one pass and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields as dataclass_fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import expression, formats, fuzzy
from paperloom.functions import values as V
from paperloom.operators.fields import Fields
from paperloom.settings import Settings

SEVERITIES = ("hard", "review", "advisory")
CHECK = "struct<name:string,passed:boolean,detail:string,severity:string>"


@dataclass(frozen=True, kw_only=True)
class Rule:
    """What all rules have. detail may hold {value} and {path}."""

    name: str
    severity: str = "review"
    detail: str = ""

    def passed(self, f: Fields) -> Column:
        """True, false, or NULL to skip."""
        raise NotImplementedError

    def shown(self, f: Fields) -> Column:
        path = getattr(self, "path", None)
        return F.coalesce(V.as_text(f.value(path)), F.lit("")) if path else F.lit("")


@dataclass(frozen=True, kw_only=True)
class Presence(Rule):
    path: str

    def passed(self, f):
        return V.present(f.value(self.path))


@dataclass(frozen=True, kw_only=True)
class Threshold(Rule):
    path: str
    op: str
    threshold: float | None = None
    threshold_setting: str | None = None

    def passed(self, f):
        limit = self.threshold if self.threshold_setting is None else getattr(f.settings, self.threshold_setting)
        return _compared(V.as_number(f.value(self.path)), self.op, F.lit(float(limit)))


@dataclass(frozen=True, kw_only=True)
class Arithmetic(Rule):
    result: str
    a: str
    b: str
    tolerance: float = 0.01

    def passed(self, f):
        c, a, b = (V.as_number(f.value(p)) for p in (self.result, self.a, self.b))
        return F.abs(c - (a + b)) <= self.tolerance


@dataclass(frozen=True, kw_only=True)
class SetMembership(Rule):
    path: str
    allowed: tuple[str, ...]
    mode: str = "exact"  # or substring; both without regard to case
    absent: str = "skip"  # or pass
    empty: str = "skip"  # or pass

    def passed(self, f):
        v = f.value(self.path)
        s = F.lower(V.as_text(v))
        if not self.allowed:
            found = F.lit(True) if self.empty == "pass" else F.lit(None).cast("boolean")
        elif self.mode == "exact":
            found = s.isin([x.lower() for x in self.allowed])
        else:
            found = reduce(lambda x, y: x | y, (s.contains(x.lower()) for x in self.allowed))
        missing = F.lit(True) if self.absent == "pass" else F.lit(None).cast("boolean")
        return F.when(~V.present(v), missing).otherwise(found)


@dataclass(frozen=True, kw_only=True)
class FieldDependency(Rule):
    antecedent: str
    consequent: str

    def passed(self, f):
        return ~V.present(f.value(self.antecedent)) | V.present(f.value(self.consequent))


@dataclass(frozen=True, kw_only=True)
class Unique(Rule):
    """seen_path names a field that says on how many other decided documents the value is (see `history`)."""

    path: str
    seen_path: str

    def passed(self, f):
        return F.when(f.value(self.path).isNotNull(), F.coalesce(V.as_number(f.value(self.seen_path)), F.lit(0.0)) == 0)


@dataclass(frozen=True, kw_only=True)
class Equality(Rule):
    path: str
    expected: str | None = None
    expected_path: str | None = None
    mode: str = "exact"  # exact, normalized, regex or fuzzy
    accents: bool = False
    fuzzy_threshold: float = 0.85
    negate: bool = False

    def passed(self, f):
        left = V.as_text(f.value(self.path))
        right = F.lit(self.expected) if self.expected_path is None else V.as_text(f.value(self.expected_path))
        if self.mode == "regex":
            found = left.rlike(f"^(?:{self.expected})$")
        else:
            if self.mode != "exact":
                left, right = V.equality_key(left), V.equality_key(right)
                if self.accents:
                    left, right = fuzzy.without_accents(left), fuzzy.without_accents(right)
            found = fuzzy.ratio_at_least(left, right, self.fuzzy_threshold) if self.mode == "fuzzy" else left == right
        found = F.when(left.isNotNull() & right.isNotNull(), found)
        return ~found if self.negate else found


@dataclass(frozen=True, kw_only=True)
class DateConstraint(Rule):
    path: str
    not_future: bool = False
    least: str | None = None
    most: str | None = None
    before: str | None = None
    after: str | None = None

    def passed(self, f):
        def tested(day: Column) -> Column:
            tests = []
            if self.not_future:
                tests.append(day <= F.lit(f.settings.as_of))
            if self.least is not None:
                tests.append(day >= V.as_date(F.lit(self.least)))
            if self.most is not None:
                tests.append(day <= V.as_date(F.lit(self.most)))
            if self.before is not None:
                tests.append(day < V.as_date(V.as_text(f.value(self.before))))
            if self.after is not None:
                tests.append(day > V.as_date(V.as_text(f.value(self.after))))

            def all_known(results: Column) -> Column:
                return F.when(~F.exists(results, lambda t: t.isNull()), F.forall(results, lambda t: t))

            return V.let(F.array(day.isNotNull(), *tests), lambda r: F.when(day.isNotNull(), all_known(r)))

        return V.let(V.as_date(V.as_text(f.value(self.path))), tested)


@dataclass(frozen=True, kw_only=True)
class Formula(Rule):
    formula: str

    def passed(self, f):
        return V.truthy(expression.compiled(self.formula, f))


@dataclass(frozen=True, kw_only=True)
class Aggregate(Rule):
    list_path: str
    how: str
    op: str
    sub: str | None = None
    value: float | None = None
    compare_path: str | None = None
    tolerance: float = 0.01

    def passed(self, f):
        right = F.lit(self.value) if self.compare_path is None else V.as_number(f.value(self.compare_path))
        return _compared(f.aggregate(self.list_path, self.how, self.sub), self.op, right, self.tolerance)


@dataclass(frozen=True, kw_only=True)
class NumericRange(Rule):
    path: str
    least: float | None = None
    most: float | None = None

    def passed(self, f):
        n = V.as_number(f.value(self.path))
        low = n >= self.least if self.least is not None else F.lit(True)
        high = n <= self.most if self.most is not None else F.lit(True)
        return F.when(n.isNotNull(), low & high)


@dataclass(frozen=True, kw_only=True)
class PercentageTolerance(Rule):
    path: str
    reference: str
    fraction: float

    def passed(self, f):
        a, b = V.as_number(f.value(self.path)), V.as_number(f.value(self.reference))
        return F.try_divide(F.abs(a - b), F.abs(b)) <= self.fraction


@dataclass(frozen=True, kw_only=True)
class Format(Rule):
    path: str
    format: str
    codes: tuple[str, ...] = ()

    def passed(self, f):
        return formats.check(V.as_text(f.value(self.path)), self.format, list(self.codes) or None)


@dataclass(frozen=True, kw_only=True)
class ConditionalPresence(Rule):
    condition: str
    required: str
    equals: str | None = None

    def passed(self, f):
        v = f.value(self.condition)
        holds = V.present(v) if self.equals is None else V.present(v) & (V.as_text(v) == self.equals)
        return ~holds | V.present(f.value(self.required))


@dataclass(frozen=True, kw_only=True)
class _Counting(Rule):
    paths: tuple[str, ...]

    def count(self, f):
        return reduce(lambda x, y: x + y, (V.present(f.value(p)).cast("int") for p in self.paths), F.lit(0))


@dataclass(frozen=True, kw_only=True)
class MutualExclusivity(_Counting):
    mode: str = "exactly_one"  # or at_most_one

    def passed(self, f):
        return self.count(f) == 1 if self.mode == "exactly_one" else self.count(f) <= 1


@dataclass(frozen=True, kw_only=True)
class AtLeast(_Counting):
    n: int = 1

    def passed(self, f):
        return self.count(f) >= self.n


@dataclass(frozen=True, kw_only=True)
class Together(_Counting):
    def passed(self, f):
        return self.count(f).isin(0, len(self.paths))


@dataclass(frozen=True, kw_only=True)
class Contains(Rule):
    path: str
    keywords: tuple[str, ...]
    mode: str = "any"  # or all
    ignore_case: bool = True

    def passed(self, f):
        s = V.as_text(f.value(self.path))
        found = [(F.lower(s) if self.ignore_case else s).contains(k.lower() if self.ignore_case else k) for k in self.keywords]
        return reduce((lambda x, y: x | y) if self.mode == "any" else (lambda x, y: x & y), found)


@dataclass(frozen=True, kw_only=True)
class LengthBounds(Rule):
    path: str
    least: int | None = None
    most: int | None = None

    def passed(self, f):
        n = F.char_length(V.as_text(f.value(self.path)))
        low = n >= self.least if self.least is not None else F.lit(True)
        high = n <= self.most if self.most is not None else F.lit(True)
        return F.when(n.isNotNull(), low & high)


@dataclass(frozen=True, kw_only=True)
class ConfidenceFloor(Rule):
    path: str
    floor: float

    def passed(self, f):
        return f.confidences.get(self.path, F.lit(None).cast("double")) >= self.floor


@dataclass(frozen=True, kw_only=True)
class GroundedOnPage(Rule):
    path: str

    def passed(self, f):
        if self.path not in f.pages:
            return F.lit(None).cast("boolean")
        return F.when(f.value(self.path).isNotNull(), f.pages[self.path].isNotNull())


@dataclass(frozen=True, kw_only=True)
class SignaturePresence(Rule):
    list_path: str
    n: int = 1

    def passed(self, f):
        items = f.items(self.list_path)
        if items is None:
            return F.lit(None).cast("boolean")
        return F.when(items.isNotNull(), F.size(F.filter(items, lambda x: F.coalesce(V.truthy(x), F.lit(False)))) >= self.n)


@dataclass(frozen=True, kw_only=True)
class Coded(Rule):
    """A function from Fields to a check column; not written to JSON."""

    function: Callable[[Fields], Column]


@dataclass(frozen=True, kw_only=True)
class Advisory(Rule):
    """An outside judgement (a pandas UDF on the named field); without one the check passes with a note."""

    path: str
    question: str
    judge: Callable[[Column], Column] | None = None

    def passed(self, f):
        return F.lit(True) if self.judge is None else F.coalesce(self.judge(V.as_text(f.value(self.path))), F.lit(True))


def _compared(a: Column, op: str, b: Column, tolerance: float = 0.0) -> Column:
    tests = {"lte": a <= b, "gte": a >= b, "lt": a < b, "gt": a > b, "eq": F.abs(a - b) <= tolerance, "ne": F.abs(a - b) > tolerance}
    if op not in tests:
        raise ValueError(f"no comparison {op!r}")
    return tests[op]


def check(rule: Rule, f: Fields) -> Column:
    """The rule's check, NULL where it is skipped."""
    if isinstance(rule, Coded):
        return rule.function(f).cast(CHECK)
    passed = rule.passed(f)
    detail = F.lit(rule.detail or rule.name)
    detail = F.replace(F.replace(detail, F.lit("{value}"), rule.shown(f)), F.lit("{path}"), F.lit(getattr(rule, "path", "")))
    made = F.struct(F.lit(rule.name).alias("name"), passed.alias("passed"), detail.alias("detail"), F.lit(rule.severity).alias("severity"))
    return F.when(passed.isNotNull(), made)


def ruleset(rules: list[Rule], f: Fields) -> Column:
    """All checks that aren't skipped, in the order of the rules."""
    return F.filter(F.array(*(check(r, f) for r in rules)), lambda c: c.isNotNull())


def gates(confidence: Column, verdict: Column, settings: Settings) -> Column:
    """The checks that every document gets: confidence of the extraction, and the scan's verdict."""
    floor = settings.extraction_confidence_warn
    return F.array(
        F.struct(F.lit("extraction_confidence").alias("name"), (confidence >= floor).alias("passed"), F.format_string("confidence %.2f", confidence).alias("detail"), F.lit("review").alias("severity")),
        F.struct(F.lit("prescan_quality").alias("name"), (verdict != "warn").alias("passed"), F.concat(F.lit("scan verdict "), verdict).alias("detail"), F.lit("review").alias("severity")),
    )


def failed(checks: Column, severity: str) -> Column:
    return F.filter(checks, lambda c: (c["severity"] == severity) & ~c["passed"])


def decision(checks: Column, base: Column) -> Column:
    """flag on a failed hard rule, else needs_review on a failed review rule, else the base judgement."""
    return F.when(F.size(failed(checks, "hard")) > 0, "flag").when(F.size(failed(checks, "review")) > 0, "needs_review").otherwise(base)


def decision_confidence(checks: Column, base: Column, extraction: Column) -> Column:
    least = F.least(F.greatest(base, F.lit(0.0)), F.greatest(extraction, F.lit(0.0)))
    return F.round(F.when(F.size(failed(checks, "hard")) > 0, F.greatest(least, F.lit(0.9))).otherwise(least), 4)


def reasons(checks: Column) -> Column:
    def said(severity: str, before: str):
        return F.transform(failed(checks, severity), lambda c: F.concat(F.lit(before), c["name"], F.lit(" — "), c["detail"]))

    hard = said("hard", "Failed rule: ")
    return F.when(F.size(hard) > 0, hard).otherwise(said("review", "Needs review: "))


def decided(docs: DataFrame, checks: Column, base: str = "approve", base_confidence: float = 0.95, extraction: Column | None = None) -> DataFrame:
    """docs with checks, decision, confidence, reasons and status."""
    sure = F.lit(1.0) if extraction is None else extraction
    out = docs.withColumn("checks", checks)
    out = out.withColumn("decision", decision(F.col("checks"), F.lit(base)))
    out = out.withColumn("decision_confidence", decision_confidence(F.col("checks"), F.lit(base_confidence), sure))
    out = out.withColumn("reasons", reasons(F.col("checks")))
    return out.withColumn("status", F.when(F.col("decision") == "needs_review", "needs_review").otherwise("decided"))


def history(docs: DataFrame, id_col: str, value_col: str, decided_col: str) -> DataFrame:
    """docs with `seen_before`: on how many other decided documents the value stands.

    A document that is decided more than once counts once, and never for its own rows. Values are counted
    after they are made distinct by document; rows without a value have seen nothing.
    """
    stands = docs.where(F.col(decided_col) & F.col(value_col).isNotNull()).select(F.col(value_col).alias("_value"), F.col(id_col).alias("_doc")).distinct()
    total = stands.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    own = stands.select(F.col("_value").alias("_own_value"), F.col("_doc").alias("_own_doc"), F.lit(1).alias("_own"))
    joined = docs.join(total, docs[value_col] == total["_value"], "left")
    joined = joined.join(own, (joined[value_col] == own["_own_value"]) & joined[id_col].eqNullSafe(own["_own_doc"]), "left")
    seen = F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return joined.withColumn("seen_before", seen).drop("_value", "_n", "_own_value", "_own_doc", "_own")


def citations(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """Per (doc_id, field): the page of the grounded leaf at the path, else of the first leaf below it.

    leaves: doc_id, path, ord, page. paths: field. Each leaf is listed under its own path and the paths above
    it, so that fields meet it by equality.
    """
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    listed = leaves.where("page is not null and path is not null").select("doc_id", "ord", "page", "path", F.explode(above).alias("field"))
    found = listed.join(paths.select("field").distinct(), "field", "left_semi")
    best = F.min_by("page", F.struct((F.col("path") != F.col("field")).alias("below"), F.col("ord")))
    return found.groupBy("doc_id", "field").agg(F.concat(F.lit("page "), best).alias("source"))


# --- rules as JSON -----------------------------------------------------------

KINDS: dict[str, type[Rule]] = {
    "presence": Presence, "threshold": Threshold, "arithmetic": Arithmetic, "set_membership": SetMembership,
    "field_dependency": FieldDependency, "uniqueness_vs_history": Unique, "equality": Equality,
    "date_constraint": DateConstraint, "expression": Formula, "aggregate": Aggregate, "numeric_range": NumericRange,
    "percentage_tolerance": PercentageTolerance, "format": Format, "conditional_presence": ConditionalPresence,
    "mutual_exclusivity": MutualExclusivity, "at_least_n_of": AtLeast, "required_together": Together, "contains": Contains,
    "length_bounds": LengthBounds, "field_confidence_floor": ConfidenceFloor, "grounded_on_page": GroundedOnPage,
    "signature_presence": SignaturePresence, "llm_advisory": Advisory,
}


def to_dict(rule: Rule) -> dict | None:
    """The rule as JSON data; None for coded rules."""
    for kind, cls in KINDS.items():
        if type(rule) is cls:
            return {"kind": kind} | {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(rule).items() if not callable(v) and v is not None}
    return None


def from_dict(data: dict) -> Rule | None:
    """The rule of JSON data; None for a kind that isn't known."""
    cls = KINDS.get(data.get("kind", ""))
    if cls is None:
        return None
    known = {f.name for f in dataclass_fields(cls)}
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known})


def problems(data: dict, declared: set[str]) -> list[str]:
    """What is wrong with a rule given as data, for a set of declared field names."""
    out = []
    cls = KINDS.get(data.get("kind", ""))
    if cls is None:
        return [f"no rule kind {data.get('kind')!r}"]
    if not str(data.get("name", "")).strip():
        out.append("a rule needs a name")
    if data.get("severity", "review") not in SEVERITIES:
        out.append(f"severity must be one of {', '.join(SEVERITIES)}")
    try:
        rule = from_dict(data)
    except TypeError as e:
        return [*out, str(e)]
    for key in ("path", "result", "a", "b", "antecedent", "consequent", "expected_path", "before", "after", "list_path", "compare_path", "reference", "condition", "required"):
        if (path := getattr(rule, key, None)) and str(path).split(".")[0] not in declared:
            out.append(f"unknown field {path!r}")
    out += [f"unknown field {p!r}" for p in getattr(rule, "paths", ()) if p.split(".")[0] not in declared]
    if isinstance(rule, Threshold) and (rule.threshold is None) == (rule.threshold_setting is None):
        out.append("exactly one of threshold and threshold_setting")
    if isinstance(rule, Equality) and (rule.expected is None) == (rule.expected_path is None):
        out.append("exactly one of expected and expected_path")
    if isinstance(rule, Formula):
        out += expression.problems(rule.formula, declared)
    if isinstance(rule, (NumericRange, LengthBounds)):
        if rule.least is None and rule.most is None:
            out.append("at least one bound")
        elif None not in (rule.least, rule.most) and rule.least > rule.most:
            out.append("the least is above the most")
    if isinstance(rule, AtLeast) and not 1 <= rule.n <= len(rule.paths):
        out.append("n must be between 1 and the number of fields")
    return out


# --- rules of the built-in invoice ---------------------------------------------


def total_math(tolerance: float = 0.01) -> Coded:
    """total = subtotal + tax, hard; an advisory pass where one is missing."""

    def run(f: Fields) -> Column:
        total, subtotal, tax = (V.as_number(f.value(p)) for p in ("total", "subtotal", "tax"))
        ok = F.abs(total - (subtotal + tax)) <= tolerance
        said = F.format_string("total %.2f, subtotal and tax %.2f", total, subtotal + tax)
        known = F.struct(F.lit("total_math").alias("name"), ok.alias("passed"), said.alias("detail"), F.lit("hard").alias("severity"))
        unknown = F.struct(F.lit("total_math").alias("name"), F.lit(True).alias("passed"), F.lit("not enough data").alias("detail"), F.lit("advisory").alias("severity"))
        return F.when(ok.isNotNull(), known).otherwise(unknown)

    return Coded(name="total_math", function=run)


def bank_details(flag: bool = False) -> Coded:
    def run(f: Fields) -> Column:
        has = V.present(f.value("bank_details_present"))
        return F.struct(
            F.lit("bank_details").alias("name"), (~has | F.lit(not flag)).alias("passed"),
            F.when(has, "bank details present").otherwise("bank details not present").alias("detail"),
            F.lit("hard" if flag else "advisory").alias("severity"),
        )

    return Coded(name="bank_details", function=run)


def invoice_rules(settings: Settings) -> list[Rule]:
    return [
        total_math(), Unique(name="duplicate_invoice_no", severity="hard", path="invoice_no", seen_path="seen_before"),
        Threshold(name="amount_limit", path="total", op="lte", threshold=settings.invoice_max_total),
        Presence(name="po_present", severity="advisory", path="po_number"),
        Presence(name="due_date_present", severity="advisory", path="due_date"), bank_details(),
    ]


def contract_rules(settings: Settings, laws: tuple[str, ...] = ()) -> list[Rule]:
    return [
        Presence(name="signatures_present", severity="hard", path="signatures_present"),
        FieldDependency(name="renewal_notice", severity="hard", antecedent="renewal_clause", consequent="termination_clause.notice_period"),
        Presence(name="termination_clause", severity="review", path="termination_clause.text"),
        Presence(name="liability_cap", path="liability_cap"),
        SetMembership(name="governing_law", path="governing_law", allowed=laws, mode="substring"),
        Threshold(name="value_limit", path="total_value", op="lte", threshold=settings.contract_max_value),
    ]
