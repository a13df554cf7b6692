"""Edits of HTML that leave every byte they aren't about as it was.

A text is read once, tag by tag, with a stack of open elements; what is to change is a list of ranges of the text.
Quotes of either kind, attributes without quotes, tags inside comments, scripts and styles, and elements that are
never closed are read as a lenient parser reads them: an end tag closes what is open inside its element, one that
closes nothing is left, and what is open at the end ends there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
# Elements without content, elements whose content is text, what is dropped, attributes that hold links,
# and the text that marks the place of a signature.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
DROPPED = ("script", "iframe")
LINKS = ("href", "src")
ANCHOR = "§§SIGZONE§§"


@dataclass
class Element:
    """Where an element's start tag, content and end are; attributes as (name, value, start, end) in the text."""

    name: str
    start: int
    content: int
    attributes: list[tuple[str, str, int, int]]
    content_end: int = -1
    end: int = -1

    def get(self, name: str) -> str | None:
        found = [v for n, v, _, _ in self.attributes if n == name]
        return found[-1] if found else None


def elements(text: str) -> list[Element]:
    """All elements in the order of their start tags."""
    out: list[Element] = []
    stack: list[Element] = []

    def close(n: int, content_end: int, end: int) -> None:
        for inner in stack[n + 1 :]:
            inner.content_end = inner.end = content_end
        stack[n].content_end, stack[n].end = content_end, end
        del stack[n:]

    at = 0
    while (m := _TAG.search(text, at)) is not None:
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            place = next((n for n in range(len(stack) - 1, -1, -1) if stack[n].name == name), None)
            if place is not None:
                close(place, m.start(), at)
            continue
        one = Element(name, m.start(), at, list(_attributes(m[3], m.start(3))))
        out.append(one)
        if name in VOID or m[3].endswith("/"):
            one.content_end = one.end = at
            continue
        stack.append(one)
        if name in RAW:
            ends = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            stop, at = (ends.start(), ends.end()) if ends else (len(text), len(text))
            close(len(stack) - 1, stop, at)
    if stack:
        close(0, len(text), len(text))
    return out


def _attributes(said: str, at: int) -> Iterator[tuple[str, str, int, int]]:
    for m in _ATTRIBUTE.finditer(said):
        value = m[2] or ""
        if value[:1] in "\"'":
            value = value[1:-1]
        yield m[1].lower(), entities.unescape(value), at + m.start(), at + m.end()


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with ranges replaced; an edit inside the range of another is part of it."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])


def bind(text: str, values: dict[str, str | None], stamp: str | None) -> tuple[str, list[str], list[str], bool]:
    """(html, paths filled, paths skipped, stamped): the spans of fields with their texts, and the signature's place.

    A field's whole content is replaced; without a value it is emptied. The image of the signature gets the stamp
    (base64 of a PNG), or an unseen mark takes its place.
    """
    edits, filled, skipped, stamped = [], [], [], False
    for one in elements(text):
        if one.name == "span" and (path := one.get("data-field")) is not None:
            value = values.get(path)
            (skipped if value is None else filled).append(path)
            edits.append((one.content, one.content_end, entities.escape(value or "", quote=False)))
        elif one.name == "img" and one.get("data-signature") is not None:
            if stamp is None:
                edits.append((one.start, one.end, f'<span data-sig-anchor="true" style="color:transparent;font-size:6px;">{ANCHOR}</span>'))
                continue
            stamped, new = True, f'src="data:image/png;base64,{stamp}"'
            places = [(start, end) for name, _, start, end in one.attributes if name == "src"]
            after = one.start + len("<img")
            edits += [(start, end, new) for start, end in places] or [(after, after, f" {new}")]
    return edited(text, edits), filled, skipped, stamped


def clean(text: str) -> str:
    """Without scripts and frames, event handlers and javascript links."""
    edits = []
    for one in elements(text):
        if one.name in DROPPED:
            edits.append((one.start, one.end, ""))
            continue
        for name, value, start, end in one.attributes:
            if name.startswith("on") or (name in LINKS and value.strip().lower().startswith("javascript:")):
                edits.append((start - 1 if text[start - 1].isspace() else start, end, ""))
    return edited(text, edits)


@F.pandas_udf(T.StringType())
def sanitized(html: pd.Series) -> pd.Series:
    """HTML without scripts, frames, event handlers and javascript links; null stays null."""
    return html.map(lambda x: None if x is None else clean(x))


BOUND = T.StructType([
    T.StructField("html", T.StringType()), T.StructField("filled", T.ArrayType(T.StringType())), T.StructField("skipped", T.ArrayType(T.StringType())),
    T.StructField("stamped", T.BooleanType()),
])


@F.pandas_udf(BOUND)
def _bound(html: pd.Series, values: pd.Series, stamp: pd.Series) -> pd.DataFrame:
    rows = [(None, [], [], False) if page is None else bind(page, dict(held or {}), s) for page, held, s in zip(html, values, stamp, strict=True)]
    return pd.DataFrame(rows, columns=BOUND.names)


def bound(html: Column, values: Column, stamp: Column | None = None) -> Column:
    """(html, filled, skipped, stamped) from a map of texts by path and, if there is one, a stamp in base64."""
    return _bound(html, values, F.lit(None).cast("string") if stamp is None else stamp)


def placeholder(path: Column, label: Column, kind: Column) -> Column:
    """A field's span, as `bound` finds it; without a kind it has no attribute of it."""

    def safe(x: Column, quote: bool) -> Column:
        out = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quote else out

    told = F.when(kind.isNull(), "").otherwise(F.concat(F.lit(' data-field-kind="'), safe(kind, True), F.lit('"')))
    return F.concat(F.lit('<span data-field="'), safe(path, True), F.lit('"'), told, F.lit(">"), safe(label, True), F.lit("</span>"))
