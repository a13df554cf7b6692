"""Providers that need no service: OCR answers that are stored, types by their words, spans of labelled lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.operators.staged import CLASS, JUDGEMENT, PAGE_ANSWER, SPANS
from paperloom.sources.providers import Provider

LINE = r"^([A-Z][A-Za-z ]*): (.*)$"


def stored_answers(name: str) -> Provider:
    """An OCR engine whose JSON answer is in the page's content under the engine's name; without one the page is empty."""
    kind = f"struct<`{name}`:{PAGE_ANSWER}>"
    return Provider("ocr", name, ("content",), PAGE_ANSWER, column=lambda c: F.from_json(c["content"], kind)[name])


def stored_answers_by_page(name: str) -> Provider:
    """The same, read in Arrow batches; a content that is no JSON or has no answer is its page's error."""
    return Provider("ocr", name, ("content",), PAGE_ANSWER, call=lambda some: [json.loads(x["content"])[name] for x in some])


def by_vocabulary(vocabularies: dict[str, list[str]], name: str = "vocabulary") -> Provider:
    def column(c: dict[str, Column]) -> Column:
        found = D.vocabulary_match(c["text"], vocabularies)
        return F.struct(found["doc_type"].alias("doc_type"), found["confidence"].alias("confidence"))

    return Provider("classify", name, ("text",), CLASS, column=column, version=json.dumps(vocabularies, sort_keys=True))


def labelled(name: str = "labelled") -> Provider:
    """Lines of the form "Some label: text; key=value; key=value" as spans of class some_label."""

    def column(c: dict[str, Column]) -> Column:
        whole, regex = F.coalesce(c["text"], F.lit("")), F.lit("(?m)" + LINE)
        pairs = F.arrays_zip(F.regexp_extract_all(whole, regex, F.lit(1)).alias("label"), F.regexp_extract_all(whole, regex, F.lit(2)).alias("value"))

        def span(p: Column) -> Column:
            parts = F.split(p["value"], "; ")
            rest = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.contains("="))
            entries = F.transform(rest, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
            last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
            none = F.lit(None).cast("int")
            return F.struct(
                F.replace(F.lower(p["label"]), F.lit(" "), F.lit("_")).alias("cls"), parts[0].alias("text"), F.map_from_entries(last).alias("attributes"),
                none.alias("char_start"), none.alias("char_end"),
            )

        return F.transform(pairs, span)

    return Provider("structure", name, ("text",), SPANS, column=column)


def labelled_by_section(name: str = "labelled_by_section", unreadable: str = "") -> Provider:
    """The same, read in Arrow batches, with places; a section that has the unreadable text is an error."""

    def spans(text: str) -> list[dict]:
        if unreadable and unreadable in text:
            raise ValueError(f"{unreadable!r} can't be read")
        out = []
        for m in re.finditer(LINE, text, re.M):
            value, *rest = m[2].split("; ")
            attributes = dict(x.split("=", 1) for x in rest if "=" in x)
            out.append({"cls": m[1].lower().replace(" ", "_"), "text": value, "attributes": list(attributes.items()), "char_start": m.start(2), "char_end": m.start(2) + len(value)})
        return out

    return Provider("structure", name, ("text",), SPANS, call=lambda some: [spans(x["text"] or "") for x in some], version=unreadable)


def approving(name: str = "approving", confidence: float = 0.95) -> Provider:
    """The judgement that leaves the decision to the rules."""
    return Provider("judge", name, (), JUDGEMENT, column=lambda c: F.struct(F.lit("approve").alias("decision"), F.lit(confidence).alias("confidence")), version=str(confidence))


def by_word(word: str, decision: str = "needs_review", name: str = "by_word") -> Provider:
    """Another judgement where a field has the word."""

    def column(c: dict[str, Column]) -> Column:
        hit = F.contains(F.lower(c["text"]), F.lit(word.lower()))
        return F.struct(F.when(hit, decision).otherwise("approve").alias("decision"), V.let(hit, lambda h: F.when(h, 0.6).otherwise(0.95)).alias("confidence"))

    return Provider("judge", name, ("text",), JUDGEMENT, column=column, version=f"{word}/{decision}")
