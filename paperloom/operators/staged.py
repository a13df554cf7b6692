"""The whole way of documents, stage by stage: prescan, OCR chain, classification, structuring, decision.

Each stage is one plan over all documents that have come so far, and gives a row for each: what it found, or its error.
A document with an error goes no further and changes nothing for the others. Results are kept by the content they
were made from (`sources.snapshots`), so a run over documents that were there before computes what changed.

Structuring reads a document as a whole or in sections: units (blocks of a layout engine, lines of the others) are cut at
headings, pages keep their places in each section's text, short sections join a neighbour. Spans are anchored in their
section's text, a document's fields are the first of their class (composites whole, lists of all sections one after the
other), text that has no anchor is looked for in the whole document, and an invoice without rows takes them from tables.

Pages, units, sections and spans are arrays in their document's row, so a stage deals nothing out; documents meet between
stages only. All of one document's pages are one row: a document's size bounds what is held.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import definitions as N
from paperloom.operators import documents as D
from paperloom.operators import pages as P
from paperloom.operators import rules as R
from paperloom.operators.fields import Fields
from paperloom.operators.leaves import FieldDef
from paperloom.settings import DEFAULT, Settings
from paperloom.sources.providers import Provider, Providers, answered
from paperloom.sources.snapshots import Snapshots, carried
from paperloom.sources.snapshots import met as joined

#: What an OCR provider answers for one page, and what a document's pages are after OCR.
PAGE_ANSWER = "struct<text:string,blocks:array<struct<text:string,label:string,confidence:double>>,tables:array<string>>"
PAGES = "array<struct<page:int,text:string,confidence:double,blocks:array<struct<text:string,label:string,confidence:double>>,tables:array<string>>>"
#: What a structuring provider answers for one section.
SPANS = "array<struct<cls:string,text:string,attributes:map<string,string>,char_start:int,char_end:int>>"
CLASS = "struct<doc_type:string,confidence:double>"
JUDGEMENT = "struct<decision:string,confidence:double>"
LEAF = "struct<path:string,field:string,value:" + V.VALUE + ",confidence:double,page:int,char_start:int,char_end:int,alignment:string>"
#: Labels of blocks that open a section.
HEADING_LABELS = ("section_header", "title")
LAYOUT, SPREADSHEET = "docling", "spreadsheet"
BACKFILL_CONFIDENCE = 0.5


@dataclass(frozen=True)
class DocType:
    """A document type: its fields and rules. key: the field that no two documents should share."""

    name: str
    fields: tuple[FieldDef, ...]
    rules: tuple[R.Rule, ...] = ()
    key: str = ""


@dataclass(frozen=True)
class Plan:
    """What a run is made of. chain: OCR engines in the order of their use, where a document names none."""

    providers: Providers
    types: tuple[DocType, ...]
    chain: tuple[str, ...]
    classify: str = ""
    structure: str = ""
    judge: str = ""
    prescan: bool = True
    sectioning: bool = True
    window: int = 8000
    settings: Settings = field(default=DEFAULT)


# --- text of pages ------------------------------------------------------------


def structuring_text(pages: Column) -> Column:
    """(text, offsets): pages with their tables' markdown, joined, and where each page starts in that text."""
    listed = F.transform(pages, lambda p: F.struct(p["page"].alias("page"), with_tables(p["text"], p["tables"]).alias("text")))
    return V.let(listed, joined_pages)


def with_tables(text: Column, tables: Column) -> Column:
    some = F.filter(F.coalesce(tables, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.array_join(F.concat(F.array(F.coalesce(text, F.lit(""))), some), D.JOINER)


def joined_pages(listed: Column) -> Column:
    """(text, offsets) of an array of (page, text)."""
    none = F.array().cast("array<struct<page:int,start:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("offsets"))
    walked = F.aggregate(
        listed, begin,
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["text"]) + len(D.JOINER)).alias("at"),
            F.concat(acc["offsets"], F.array(F.struct(p["page"].alias("page"), acc["at"].alias("start")))).alias("offsets"),
        ),
        lambda acc: acc["offsets"],
    )
    return F.struct(F.array_join(F.transform(listed, lambda p: p["text"]), D.JOINER).alias("text"), walked.alias("offsets"))


def page_of(offsets: Column, at: Column) -> Column:
    """The page on which a place of the text is: the last one that starts at or before it."""
    return F.try_element_at(F.filter(offsets, lambda o: o["start"] <= at), F.lit(-1))["page"]


#: A heading, at the start of a line, and what stands before one.
HEADING, BEFORE_HEADING = r"#{1,6}[^\S\n]", r"\n(?=#{1,6}[^\S\n])"


def _page_units(engine: Column, p: Column, pi: Column, between: str) -> Column:
    """A page's units: blocks (layout engine) or its text cut at `between` (others); one without text and ui if there are none.

    A page's tables go with the first.
    """
    line = F.transform(F.split(p["text"], between), lambda x: F.struct(x.alias("text"), x.rlike("^" + HEADING).alias("heading")))
    block = F.transform(p["blocks"], lambda b: F.struct(b["text"].alias("text"), F.coalesce(b["label"].isin(*HEADING_LABELS), F.lit(False)).alias("heading")))
    title = lambda x: F.when(engine == LAYOUT, x).otherwise(V.strip(F.regexp_replace(F.substring_index(x, "\n", 1), "^#+", "")))

    def unit(tables: Column, ui: Column, text: Column, heading: Column) -> Column:
        return F.struct(pi.alias("pi"), p["page"].alias("page"), tables.alias("tables"), ui.cast("int").alias("ui"), text.alias("text"), heading.alias("heading"), F.when(heading, title(text)).alias("title"))

    none = F.array(unit(p["tables"], F.lit(None), F.lit(None).cast("string"), F.lit(False)))
    every = lambda some: F.transform(some, lambda u, i: unit(F.when(i == 0, p["tables"]), i, u["text"], F.coalesce(u["heading"], F.lit(False))))
    return V.let(F.when(engine == LAYOUT, block).otherwise(line), lambda some: F.when(F.size(some) > 0, every(some)).otherwise(none))


def _units(engine: Column, pages: Column, between: str) -> Column:
    return F.flatten(F.transform(pages, lambda p, pi: _page_units(engine, p, pi, between)))


def units(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, pi, page, tables, ui, text, heading, title of each block (layout engine) or line (others); pages: id, engine, pages.

    A page without units has one row with a null ui, so that its tables aren't lost.
    """
    return pages.select(id_col, F.explode(_units(F.col("engine"), F.col("pages"), "\n")).alias("u")).select(id_col, "u.*")


def _stretches(listed: Column, begins: Column, body) -> Column:
    """body of each stretch of an array, from one of the places (an array) to the next."""
    until = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(listed))
    return V.let(begins, lambda at: F.transform(at, lambda b, k: V.let(F.slice(listed, b + 1, until(at, k) - b), body)))


def _places(listed: Column, test) -> Column:
    """Places of an array whose element and place pass a test."""
    return F.filter(F.transform(listed, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def cut(engine: Column, pages: Column) -> Column:
    """Sections of a document as an array of (title, text, offsets), from its units."""

    def page(some: Column) -> Column:
        lines = F.transform(F.filter(some, lambda u: u["ui"].isNotNull()), lambda u: u["text"])
        return F.struct(F.get(some, F.lit(0))["page"].alias("page"), with_tables(F.array_join(lines, "\n"), F.get(some, F.lit(0))["tables"]).alias("text"))

    def section(some: Column) -> Column:
        begins = _places(some, lambda u, i: (i == 0) | (F.get(some, i - 1)["pi"] != u["pi"]))
        title = F.get(F.filter(some, lambda u: u["ui"].isNotNull()), F.lit(0))["title"]
        return V.let(V.let(_stretches(some, begins, page), joined_pages), lambda j: F.struct(title.alias("title"), j["text"].alias("text"), j["offsets"].alias("offsets")))

    def cut_at(every: Column) -> Column:
        # A heading opens a section, with the pages without units that stand right before it; so does the first unit.
        begins = lambda real: F.filter(
            F.transform(real, lambda i, k: F.when(k == 0, 0).when(F.get(every, i)["heading"], F.get(real, k - 1) + 1)), lambda i: i.isNotNull()
        )
        some = V.let(_places(every, lambda u, i: u["ui"].isNotNull()), lambda real: F.when(F.size(real) > 0, begins(real)).otherwise(F.array(F.lit(0))))
        return _stretches(every, some, section)

    # Lines between two headings are one unit.
    return V.let(_units(engine, pages, BEFORE_HEADING), lambda every: F.when(F.size(every) > 0, cut_at(every)))


def cut_sections(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, section, title, text, offsets: units from one heading to the next; what stands before the first is one too.

    A page's tables go with the section that its first unit is in (without units, the one that goes on there).
    """
    return pages.select(id_col, F.posexplode(cut(F.col("engine"), F.col("pages"))).alias("section", "s")).select(id_col, "section", "s.*")


def folded(sections: Column, least: int = DEFAULT.section_min_chars) -> Column:
    """An array of (title, text, offsets): those shorter than `least` joined to the next, the last to the one before."""
    kind = "struct<title:string,text:string,offsets:array<struct<page:int,start:int>>>"

    def join(a, b):
        shift = F.char_length(a["text"]) + len(D.JOINER)
        moved = F.transform(b["offsets"], lambda o: F.struct(o["page"].alias("page"), (o["start"] + shift).alias("start")))
        return F.struct(F.coalesce(a["title"], b["title"]).alias("title"), F.concat(a["text"], F.lit(D.JOINER), b["text"]).alias("text"), F.concat(a["offsets"], moved).alias("offsets"))

    def step(acc, x):
        one = F.struct(x["title"].alias("title"), x["text"].alias("text"), x["offsets"].alias("offsets"))
        now = F.when(acc["open"].isNull(), one).otherwise(join(acc["open"], one))
        told = lambda now, whole: F.struct(F.when(whole, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"), F.when(~whole, now).alias("open"))
        return V.let(now, lambda now: told(now, F.char_length(now["text"]) >= least))

    def end(acc):
        n = F.size(acc["done"])
        back = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(join(F.try_element_at(acc["done"], F.lit(-1)), acc["open"])))
        return F.when(acc["open"].isNull(), acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(back)

    begin = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))
    return F.aggregate(sections, begin, step, end)


def folded_sections(parts: DataFrame, id_col: str = "doc_id", least: int = DEFAULT.section_min_chars) -> DataFrame:
    """id, sections array<struct<title,text,offsets>>, folded, from the rows of cut_sections."""
    listed = parts.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("section", "title", "text", "offsets"))).alias("s"))
    return listed.select(id_col, folded(F.col("s"), least).alias("sections"))


def sectioned(pages: DataFrame, plan: Plan, id_col: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """id, text, offsets, sections, said: how each document is read. pages: id, engine, pages; more: its columns that stay.

    One section, the whole text, where sectioning is off, the engine is the spreadsheet one, there are fewer than two
    headings or the text fits the window; and, with a warning, where there are too many sections.
    """
    whole = pages.select(id_col, *more, "engine", "pages", structuring_text(F.col("pages")).alias("w")).select(id_col, *more, "engine", "pages", "w.*")
    in_lines = F.aggregate("pages", F.lit(0), lambda a, p: a + F.regexp_count(p["text"], F.lit(r"(?:^|\n)" + HEADING)))
    in_blocks = F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(F.filter(p["blocks"], lambda b: F.coalesce(b["label"].isin(*HEADING_LABELS), F.lit(False)))))
    heads = F.when(F.col("engine") == LAYOUT, in_blocks).otherwise(in_lines)
    apart = F.lit(plan.sectioning) & (F.col("engine") != SPREADSHEET) & (F.char_length("text") > plan.window) & (heads >= 2)
    parts = F.when(F.coalesce(apart, F.lit(False)), folded(cut(F.col("engine"), F.col("pages")), plan.settings.section_min_chars))
    read = whole.select(id_col, *more, "text", "offsets", parts.alias("sections"))
    one = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("text"), F.col("offsets")))
    n, most = F.coalesce(F.size("sections"), F.lit(1)), plan.settings.max_sections
    said = F.when(n > most, F.array(F.format_string(f"%d sections are more than {most}: the document is read as a whole", n)))
    said = said.when(n > 1, F.array(F.format_string("read in %d sections", n))).otherwise(F.array().cast("array<string>"))
    return read.select(id_col, *more, "text", "offsets", F.when((n > most) | F.col("sections").isNull(), one).otherwise(F.col("sections")).alias("sections"), said.alias("said"))


# --- stages ---------------------------------------------------------------------


def prescanned(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """doc_id, verdict, reasons, error from (doc_id, spreadsheet, scans array<struct<page,dpi,sharpness,contrast,brightness,ink>>).

    One page's warning makes a document warn; sheets have no image and pass.
    """
    one = F.transform("scans", lambda s: F.struct(s["page"].alias("page"), P.said_of(P.verdicts(s, s["dpi"], settings), s["page"]).alias("said")))
    none = F.array().cast("array<string>")
    found = docs.select("doc_id", F.coalesce(F.when(~F.col("spreadsheet"), P.reasons_of(one)), none).alias("reasons"), *carried(docs))
    return found.select("doc_id", F.when(F.size("reasons") > 0, "warn").otherwise("pass").alias("verdict"), "reasons", F.lit(None).cast("string").alias("error"), *carried(docs))


def recognised(docs: DataFrame, plan: Plan, keep: Snapshots) -> DataFrame:
    """doc_id, engine, tried, pages, confidence, error from (doc_id, chain, contents array<struct<page,content>>).

    Engines take turns: one that raises, finds no text or is too unsure hands the document to the next; the last one's
    text is taken as it is. Only documents that come to an engine are sent to it.
    """
    known = plan.providers.names("ocr")
    usable = F.filter("chain", lambda e: e.isin(*known)) if known else F.array().cast("array<string>")
    own = carried(docs)
    mean = lambda c: V.rounded(_mean(c))
    sure = lambda blocks: F.transform(F.filter(blocks, lambda b: b["confidence"].isNotNull()), lambda b: b["confidence"])
    nothing = F.array().cast("array<struct<text:string,label:string,confidence:double>>")
    # A document without pages is one request without content.
    empty = F.array(F.struct(F.lit(None).alias("page"), F.lit(None).alias("content"))).cast(docs.schema["contents"].dataType)
    left = docs.select("doc_id", usable.alias("chain"), F.when(F.size("contents") > 0, F.col("contents")).otherwise(empty).alias("contents"), *own)

    def page(c: Column, a: Column) -> Column:
        blocks = F.coalesce(a["blocks"], nothing)
        return F.struct(
            c["page"].cast("int").alias("page"), F.coalesce(a["text"], F.lit("")).alias("text"), mean(sure(blocks)).alias("confidence"),
            blocks.alias("blocks"), F.coalesce(a["tables"], F.array().cast("array<string>")).alias("tables"),
        )

    def asked_for(rank: int) -> list[str | None]:
        return [r.e for r in left.select(F.get("chain", F.lit(rank)).alias("e")).distinct().collect()]  # of the engines, and null

    done, rank = None, 0
    engines = asked_for(0)
    columns = ["doc_id", "engine", "tried", "pages", "confidence", "error", *own]
    if None in engines or not engines:
        done = left.where(F.size("chain") == 0).select(
            "doc_id", F.lit(None).cast("string").alias("engine"), F.array().cast("array<string>").alias("tried"), F.lit(None).cast(PAGES).alias("pages"),
            F.lit(None).cast("double").alias("confidence"), F.lit("no usable OCR engine").alias("error"), *own,
        )
    while any(engines):
        tried = None
        for name in (n for n in known if n in engines):
            asked = left.where(F.get("chain", F.lit(rank)) == name)
            got = answered(asked, plan.providers.chosen("ocr", name), each="contents").withColumn("engine", F.lit(name))
            tried = got if tried is None else tried.union(got)
        listed = F.filter(F.zip_with("contents", "answer", lambda c, a: F.struct(c["page"].alias("page"), page(c, a).alias("p"))), lambda x: x["page"].isNotNull())
        pages = F.transform(F.sort_array(listed), lambda x: x["p"]).cast(PAGES)
        found = tried.select("doc_id", "engine", "chain", "contents", *own, F.when(F.col("error").isNull(), pages).alias("pages"), "error")
        found = found.withColumn("confidence", F.when(F.col("error").isNull(), mean(F.flatten(F.transform("pages", lambda p: sure(p["blocks"]))))))
        has_text = F.exists("pages", lambda p: V.strip(p["text"]) != "")
        good = F.col("error").isNull() & has_text & F.coalesce(F.col("confidence") >= plan.settings.ocr_fallback_confidence, F.lit(True))
        last = F.size("chain") == rank + 1
        found = found.withColumn("stays", F.coalesce(good, F.lit(False)) | last)
        # What the next engine is asked for instead isn't kept; its contents are with the row, so documents aren't met again.
        found = found.withColumn("pages", F.when(F.col("stays"), F.col("pages"))).withColumn("contents", F.when(~F.col("stays"), F.col("contents")))
        found = keep.scratch(found, "ocr-rank")
        ready = found.where("stays").withColumn("tried", F.slice("chain", 1, rank + 1)).select(columns)
        done = ready if done is None else done.union(ready)
        left, rank = found.where("not stays").select("doc_id", "chain", "contents", *own), rank + 1
        engines = asked_for(rank)
    return done


def classified(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, doc_type, guessed, class_confidence, error from (doc_id, doc_type, pages); a given type is taken as it is."""
    own = carried(docs)
    text = docs.select("doc_id", "doc_type", F.array_join(F.transform("pages", lambda p: p["text"]), D.JOINER).alias("text"), *own)
    given = text.where("doc_type is not null").select("doc_id", "doc_type", F.lit(False).alias("guessed"), F.lit(None).cast("double").alias("class_confidence"), F.lit(None).cast("string").alias("error"), *own)
    asked = answered(text.where("doc_type is null").drop("doc_type"), plan.providers.chosen("classify", plan.classify))
    guess = asked.select("doc_id", F.col("answer.doc_type").alias("doc_type"), F.lit(True).alias("guessed"), F.col("answer.confidence").alias("class_confidence"), "error", *own)
    known = F.coalesce(F.col("doc_type").isin(*(t.name for t in plan.types)), F.lit(False))
    why = F.coalesce("error", F.when(F.col("doc_type").isNull(), "the type can't be told: name it").when(~known, F.concat(F.lit("no document type "), F.col("doc_type"))))
    return given.union(guess).withColumn("error", why)


DEFS = (
    "array<struct<name:string,kind:string,coerce:string,cls:string,core:boolean,dedup:boolean,"
    "subs:array<struct<name:string,coerce:string,span:boolean,key:string>>>>"
)


def _definitions(plan: Plan, rows: DataFrame) -> DataFrame:
    """A row for each document type, with its fields as data: the plan's size doesn't follow the number of types."""
    data = [
        (t.name, [(f.name, f.kind, f.coerce, f.cls or f.name, f.core, f.dedup, [(n, c, n == f.span_sub, n) for n, c in f.subs]) for f in t.fields])
        for t in plan.types
    ]
    return F.broadcast(rows.sparkSession.createDataFrame(data, f"doc_type string, defs {DEFS}"))  # as many rows as the plan has types


def read_definitions(drafts: DataFrame, id_col: str = "draft_id", extraction_col: str = "extraction") -> DataFrame:
    """(doc_type, defs) of definitions in JSON; the draft's id is the type. Kinds and the rest are taken as they are written."""
    field_kind = "struct<name:string,kind:string,cls:string,coerce:string,is_core:boolean,dedup:boolean,sub_fields:array<struct<name:string,source:string,attr_key:string,coerce:string>>>"
    read = F.from_json(extraction_col, f"struct<fields:array<{field_kind}>,core_paths:array<string>>")
    text = F.lit("text")

    def sub(x: Column) -> Column:
        key = F.when(F.coalesce(x["attr_key"], F.lit("")) != "", x["attr_key"]).otherwise(x["name"])
        return F.struct(x["name"].alias("name"), F.coalesce(x["coerce"], text).alias("coerce"), (x["source"] == "span").alias("span"), key.alias("key"))

    def one(x: Column, cores: Column) -> Column:
        cls = F.when(F.coalesce(x["cls"], F.lit("")) != "", x["cls"]).otherwise(x["name"])
        subs = F.transform(F.coalesce(x["sub_fields"], F.array().cast("array<struct<name:string,source:string,attr_key:string,coerce:string>>")), sub)
        return F.struct(
            x["name"].alias("name"), x["kind"].alias("kind"), F.coalesce(x["coerce"], text).alias("coerce"), cls.alias("cls"),
            F.array_contains(cores, x["name"]).alias("core"), F.coalesce(x["dedup"], F.lit(False)).alias("dedup"), subs.alias("subs"),
        )

    rows = drafts.select(F.col(id_col).cast("string").alias("doc_type"), read.alias("r"))
    cores = F.coalesce("r.core_paths", F.array().cast("array<string>"))
    return rows.select("doc_type", F.transform("r.fields", lambda x: one(x, cores)).cast(DEFS).alias("defs"))


def preview(drafts: DataFrame, docs: DataFrame, plan: Plan, keep: Snapshots) -> DataFrame:
    """draft_id, doc_id, problems, leaves, confidence, warnings, error: drafts of definitions tried on documents.

    drafts: draft_id, doc_id (the document to try it on), extraction (JSON). docs: doc_id, engine, pages, ocr_confidence. All
    drafts are one plan, as definitions are data in it. A draft with problems is not tried: it has them and no leaves.
    """
    wrong = N.problems(drafts.select(F.col("draft_id").alias("id"), "extraction", F.lit(None).cast("string").alias("rules")))
    said = F.struct("part", "place", F.concat_ws(" ", "part", F.coalesce("name", F.col("place").cast("string")), F.lit("-"), "problem").alias("text"))
    told = wrong.groupBy(F.col("id").alias("draft_id")).agg(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]).alias("problems"))
    every = keep.scratch(joined(drafts, told, "draft_id", "left"), "drafts")
    good = every.where("problems is null").select(F.col("draft_id").cast("string").alias("doc_type"), "doc_id", "extraction")
    pair = F.concat_ws("/", "doc_type", "doc_id")
    asked = joined(good, docs, "doc_id").select(pair.alias("pair"), "doc_type", "engine", "pages", "ocr_confidence", F.lit(None).cast("string").alias("examples"))
    made = structured(asked.withColumnRenamed("pair", "doc_id"), plan, keep, read_definitions(good.withColumnRenamed("doc_type", "draft_id")).distinct())
    shown = made.select(F.col("doc_id").alias("_pair"), "leaves", "confidence", "warnings", "error")
    met = every.join(shown.hint("merge"), F.concat_ws("/", F.col("draft_id").cast("string"), "doc_id") == F.col("_pair"), "left")
    return met.select("draft_id", "doc_id", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"), "leaves", "confidence", "warnings", "error")


def _union(kind: Column, raw: Column) -> Column:
    """Text as the value of a field: the stripped text, or the number in it."""

    def made(amount: Column) -> Column:
        value = F.struct(
            F.when(kind == "number", "number").otherwise("string").alias("kind"), F.when(kind != "number", V.strip(raw)).alias("s"), amount.alias("n"), F.lit(None).cast("boolean").alias("b"),
        )
        return F.when(raw.isNotNull() & ((kind != "number") | amount.isNotNull()), value)

    return V.let(F.when(kind == "number", V.to_number(raw)), made)


def _leaf(path, name, value, confidence, page, start, end, alignment) -> Column:
    """A struct of the fields of LEAF; value: a value union, None for none."""
    return F.struct(
        path.alias("path"), name.alias("field"), (F.lit(None).cast(V.VALUE) if value is None else value).alias("value"), confidence.cast("double").alias("confidence"), page.cast("int").alias("page"),
        start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), alignment.cast("string").alias("alignment"),
    )


def _cell(path: Column, name: Column, kind: Column, raw: Column, item: Column) -> Column:
    """A leaf with its item's anchor; what can't be read is null with half the confidence, what isn't there has none."""
    none = F.lit(None)

    def told(value: Column) -> Column:
        sure = F.round(F.when(value.isNull(), item["confidence"] / 2).otherwise(item["confidence"]), 4)
        return _leaf(path, name, value, sure, item["page"], item["char_start"], item["char_end"], item["alignment"])

    return V.let(raw, lambda raw: F.when(raw.isNull(), _leaf(path, name, None, F.lit(0.0), none, none, none, none)).otherwise(V.let(_union(kind, raw), told)))


def _assembled(d: Column, found: Column) -> Column:
    """Leaves of one field from its items (an array, first come first)."""
    none = F.lit(None)
    name, first = d["name"], F.get(found, F.lit(0))
    kept = F.when(d["dedup"], F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: V.dedup_key(y["text"]) == V.dedup_key(x["text"])))).otherwise(found)
    missing = lambda path: _leaf(path, name, None, F.lit(0.0), none, none, none, none)
    subs = lambda item, before: F.transform(d["subs"], lambda s: _cell(F.concat(before, s["name"]), name, s["coerce"], F.when(s["span"], item["text"]).otherwise(F.try_element_at(item["attributes"], s["key"])), item))
    scalar = F.array(F.when(first.isNull(), missing(name)).otherwise(_cell(name, name, d["coerce"], first["text"], first)))
    true, false = (F.struct(F.lit("bool").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(b).alias("b")) for b in (True, False))
    presence = F.array(
        F.when(first.isNull(), _leaf(name, name, false, F.lit(0.0), none, none, none, none))
        .otherwise(_leaf(name, name, true, first["confidence"], first["page"], first["char_start"], first["char_end"], first["alignment"]))
    )
    composite = F.when(first.isNull(), F.transform(d["subs"], lambda s: missing(F.concat_ws(".", name, s["name"])))).otherwise(subs(first, F.concat(name, F.lit("."))))
    numbered = lambda i: F.concat_ws(".", name, i)
    listed = F.transform(kept, lambda x, i: _cell(numbered(i), name, d["coerce"], x["text"], x))
    rows = F.flatten(F.transform(found, lambda x, i: subs(x, F.concat(numbered(i), F.lit(".")))))
    return (
        F.when(d["kind"] == "scalar", scalar).when(d["kind"] == "presence", presence).when(d["kind"] == "composite", composite)
        .when(d["kind"] == "list_composite", rows).when(d["kind"] == "list_scalar", listed).otherwise(F.array().cast(f"array<{LEAF}>"))
    )


def _backfilled() -> Column:
    """Rows with a number in the tables of the document's pages, as line items of little trust."""
    cells = F.flatten(F.transform("tables", lambda p: F.flatten(F.transform(p["tables"], lambda t: F.transform(D.markdown_cells(t), lambda c: F.struct(p["page"].alias("page"), c.alias("c")))))))
    some = F.filter(cells, lambda x: F.exists(x["c"], V.looks_numeric))
    name, none = F.lit("line_items"), F.lit(None)

    def row(x, i):
        at = lambda sub: F.concat_ws(".", name, i, F.lit(sub))
        told = lambda sub, raw: _leaf(at(sub), name, _union(F.lit("text"), raw), F.lit(BACKFILL_CONFIDENCE), x["page"], none, none, F.lit("partial"))
        open_ = lambda sub: _leaf(at(sub), name, None, F.lit(0.0), none, none, none, none)
        return F.array(told("desc", x["c"][0]), open_("qty"), open_("unit_price"), told("amount", F.try_element_at(F.filter(x["c"], V.looks_numeric), F.lit(-1))))

    return F.flatten(F.transform(some, row))


def _mean(some: Column) -> Column:
    """The mean of an array of numbers, which is made once."""
    return V.let(some, lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.size(c)))


def _overall(leaves: Column, defs: Column) -> Column:
    """Mean over the core fields of their confidence: of lists and composites the mean of their parts; an empty list is 0."""
    of = F.transform(F.filter(defs, lambda d: d["core"]), lambda d: F.coalesce(_mean(F.transform(F.filter(leaves, lambda x: x["field"] == d["name"]), lambda x: x["confidence"])), F.lit(0.0)))
    return V.rounded(F.coalesce(_mean(of), F.lit(0.0)))


def structured(docs: DataFrame, plan: Plan, keep: Snapshots, definitions: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_type, leaves, confidence, backfilled, warnings, error from (doc_id, doc_type, engine, pages, ocr_confidence, examples).

    definitions: (doc_type, defs), by default those of the plan's types.
    """
    own = carried(docs)
    page_confidence = F.map_from_entries(F.transform(F.filter("pages", lambda p: p["confidence"].isNotNull()), lambda p: F.struct(p["page"], p["confidence"])))
    tables = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["tables"].alias("tables")))
    about = docs.select("doc_id", "doc_type", "engine", "pages", "ocr_confidence", "examples", page_confidence.alias("page_confidence"), tables.alias("tables"), *own)
    more = ("doc_type", "ocr_confidence", "examples", "page_confidence", "tables", *own)
    read = sectioned(about, plan, more=more)
    # A text that is its only section isn't sent twice.
    read = read.withColumn("text", F.when(F.size("sections") > 1, F.col("text")))
    got = answered(read, plan.providers.chosen("structure", plan.structure), each="sections")

    def item(s: Column, x: Column) -> Column:
        span = F.coalesce(x["text"], F.lit(""))

        def told(a: Column, page: Column) -> Column:
            sure = D.span_confidence(a["base_confidence"], F.try_element_at("page_confidence", page), F.col("ocr_confidence"))
            return F.struct(
                x["cls"].alias("cls"), span.alias("text"), x["attributes"].alias("attributes"), page.alias("page"), a["char_start"].alias("char_start"),
                a["char_end"].alias("char_end"), a["alignment"].alias("alignment"), sure.alias("confidence"),
            )

        placed = D.anchored(span, s["text"], x["char_start"], x["char_end"])
        return V.let(placed, lambda a: V.let(page_of(s["offsets"], a["char_start"]), lambda page: told(a, page)))

    # Of the first section that has a class its first span, of lists all: items stand in the order of sections and spans.
    items = F.flatten(F.zip_with("sections", "answer", lambda s, some: F.transform(F.coalesce(some, F.array().cast(SPANS)), lambda x: item(s, x))))
    met = got.withColumn("found", F.when(F.col("error").isNull(), items)).withColumn("text", F.coalesce("text", F.get("sections", F.lit(0))["text"])).drop("sections", "answer")
    met = met.join(_definitions(plan, docs), "doc_type") if definitions is None else joined(met, definitions, "doc_type")
    # A document with an error has no leaves, so none are made.
    of_class = lambda held, d: V.let(F.filter(held, lambda x: x["cls"] == d["cls"]), lambda some: _assembled(d, some))
    leaves = V.let(F.col("found"), lambda held: F.flatten(F.transform("defs", lambda d: of_class(held, d))))
    met = met.withColumn("leaves", F.when(F.col("error").isNull(), leaves))

    has_rows = F.exists("leaves", lambda x: x["field"] == "line_items")
    wants = (F.col("doc_type") == "invoice") & F.exists("defs", lambda d: d["name"] == "line_items") & ~has_rows
    met = met.withColumn("more", F.when(wants, _backfilled()).otherwise(F.array().cast(f"array<{LEAF}>")))

    def again(x):
        """Text without an anchor, looked for in the whole document."""
        at = F.instr(F.col("text"), x["value"]["s"]) - 1
        open_ = x["char_start"].isNull() & (x["value"]["kind"] == "string") & (x["value"]["s"] != "")
        page = page_of(F.col("offsets"), at)
        sure = D.span_confidence(F.lit(D.ALIGNMENT["exact"]), F.try_element_at("page_confidence", page), F.col("ocr_confidence"))
        return F.when(F.coalesce(open_ & (at >= 0), F.lit(False)), _leaf(x["path"], x["field"], x["value"], sure, page, at, at + F.char_length(x["value"]["s"]), F.lit("exact"))).otherwise(x)

    met = met.withColumn("leaves", F.concat(F.transform("leaves", again), F.col("more")))
    met = met.withColumn("confidence", _overall(F.col("leaves"), F.col("defs")))
    number = F.exists("leaves", lambda x: x["value"].isNull() & x["alignment"].isNotNull())
    warnings = F.concat(
        "said", _if(number, F.lit("a number can't be read")), _if(F.size("more") > 0, F.format_string("%d rows are taken from tables", F.expr("size(more) div 4"))),
        _if(F.col("ocr_confidence").isNull(), F.lit("the OCR engine gives no confidence: fields have that of their alignment")),
        _if(F.col("confidence") < plan.settings.extraction_confidence_warn, F.format_string("low confidence of the extraction (%.2f)", F.col("confidence"))),
    )
    fine = F.col("error").isNull()
    return met.select("doc_id", "doc_type", F.when(fine, F.col("leaves")).alias("leaves"), F.when(fine, F.col("confidence")).alias("confidence"), (F.size("more") > 0).alias("backfilled"), warnings.alias("warnings"), "error", *own)


def _if(test: Column, text: Column) -> Column:
    return F.when(test, F.array(text)).otherwise(F.array().cast("array<string>"))


def _of_field(leaves: Column, name: str) -> Column:
    return F.filter(leaves, lambda x: x["field"] == name)


def _at_path(leaves: Column, path: str) -> Column:
    return F.get(F.filter(leaves, lambda x: x["path"] == path), F.lit(0))


def _rows(own: Column, f: FieldDef) -> Column:
    """The leaves of a list of composites as rows: they stand row by row, each with all columns."""
    width = len(f.subs)
    n = F.floor(F.size(own) / width).cast("int")
    row = lambda i: F.struct(*(F.get(own, i * width + k)["value"].alias(sub) for k, (sub, _) in enumerate(f.subs)))
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), row)


def held_fields(leaves: Column, defs: tuple[FieldDef, ...], extra: dict[str, Column] | None = None, settings: Settings = DEFAULT) -> Fields:
    """The fields that rules read, from a column of leaves."""
    plain = {f.name: _at_path(leaves, f.name) for f in defs if f.kind in ("scalar", "presence")}
    plain |= {f"{f.name}.{n}": _at_path(leaves, f"{f.name}.{n}") for f in defs if f.kind == "composite" for n, _ in f.subs}
    lists = {f.name: F.transform(_of_field(leaves, f.name), lambda x: x["value"]) for f in defs if f.kind == "list_scalar"}
    for f in (f for f in defs if f.kind == "list_composite"):
        lists[f.name] = _rows(_of_field(leaves, f.name), f)
    return Fields(
        values={p: x["value"] for p, x in plain.items()} | (extra or {}), lists=lists, composite=frozenset(f.name for f in defs if f.kind == "list_composite"),
        confidences={p: x["confidence"] for p, x in plain.items()}, pages={p: x["page"] for p, x in plain.items()}, settings=settings,
    )


def seen_before(rows: DataFrame, prior: DataFrame | None, plan: Plan) -> DataFrame:
    """doc_id, seen: whether another document has the value of the type's key field: a prior one, or one of these with a smaller id.

    rows: doc_id, doc_type, leaves. prior: doc_id, doc_type, value. Values are aggregated before they meet documents.
    """
    value = F.lit(None).cast("string")
    for t in plan.types:
        if t.key:
            value = F.when(F.col("doc_type") == t.name, V.as_text(_at_path(F.col("leaves"), t.key)["value"])).otherwise(value)
    own = rows.select("doc_id", "doc_type", value.alias("value")).where("value is not null")
    least = own.groupBy("doc_type", "value").agg(F.min("doc_id").alias("first"))
    met = joined(own, least, ["doc_type", "value"])
    if prior is not None:
        held = prior.groupBy("doc_type", "value").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        met = joined(met, held, ["doc_type", "value"], "left")
        other = (F.col("low") != F.col("doc_id")) | (F.col("high") != F.col("doc_id"))
    else:
        other = F.lit(False)
    return met.select("doc_id", ((F.col("first") < F.col("doc_id")) | F.coalesce(other, F.lit(False))).alias("seen"))


def decided(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, decision, decision_confidence, reasons, checks, error from (doc_id, doc_type, leaves, confidence, verdict, seen)."""
    asked = answered(docs.withColumn("text", F.array_join(F.transform("leaves", lambda x: F.concat_ws("=", x["path"], F.coalesce(V.as_text(x["value"]), F.lit("")))), "\n")), plan.providers.chosen("judge", plan.judge))
    gate = R.gates(F.col("confidence"), F.coalesce("verdict", F.lit("pass")), plan.settings)
    gate = F.filter(gate, lambda c: (c["name"] != "prescan_quality") | F.col("verdict").isNotNull())
    checks = F.array().cast(f"array<{R.CHECK}>")
    for t in plan.types:
        fields = held_fields(F.col("leaves"), t.fields, {"seen_before": V.number(F.col("seen").cast("int"))}, plan.settings)
        if t.rules:
            checks = F.when(F.col("doc_type") == t.name, R.ruleset(list(t.rules), fields)).otherwise(checks)
    made = asked.withColumn("checks", F.concat(checks, gate))
    base, sure = F.coalesce("answer.decision", F.lit("approve")), F.coalesce("answer.confidence", F.lit(0.95))
    fine = F.col("error").isNull()
    made = made.withColumn("decision", F.when(fine, R.decision(F.col("checks"), base)))
    made = made.withColumn("decision_confidence", F.when(fine, R.decision_confidence(F.col("checks"), sure, F.col("confidence"))))
    return made.select("doc_id", "decision", "decision_confidence", R.reasons(F.col("checks")).alias("reasons"), "checks", "error", *carried(docs))


def extract(docs: DataFrame, plan: Plan, keep: Snapshots, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of the whole way.

    docs: doc_id, spreadsheet boolean, doc_type (null: to be told), engines array<string> (null: the plan's chain), contents
    array<struct<page,content>>, scans, examples string (corrections of the type, null if none). results: a row for each
    document: doc_id, doc_type, guessed, engine, leaves, confidence, verdict, decision, decision_confidence, reasons,
    warnings, failed_stage. errors: doc_id, stage, error. prior: doc_id, doc_type, value of documents decided before.
    """
    types = repr(plan.types)

    def prov(kind: str, name: str) -> str:
        one = plan.providers.chosen(kind, name)
        return f"{one.name}/{one.version}"

    chain = F.when(F.col("spreadsheet"), F.array(F.lit(SPREADSHEET))).otherwise(F.coalesce("engines", F.array(*map(F.lit, plan.chain))))
    source = keep.scratch(docs.withColumn("chain", chain), "documents")
    errors: list[DataFrame] = []

    def told(stage: str, frame: DataFrame) -> DataFrame:
        errors.append(frame.where("error is not null").select("doc_id", F.lit(stage).alias("stage"), "error"))
        return frame.where("error is null").drop("error")

    scans = None
    if plan.prescan:
        scans = told("prescan", keep.stage("prescan", repr(plan.settings), source.select("doc_id", "spreadsheet", "scans"), lambda x: prescanned(x, plan.settings)))
    engines = ",".join(prov("ocr", n) for n in plan.providers.names("ocr")) + f"/{plan.settings.ocr_fallback_confidence}"
    read = told("ocr", keep.stage("ocr", engines, source.select("doc_id", "chain", "contents"), lambda x: recognised(x, plan, keep)))
    read = read.withColumnRenamed("confidence", "ocr_confidence")
    # Blocks and tables travel once, to structuring; here a digest stands for them, so that changed pages are still met.
    about = source.select("doc_id", "doc_type", "examples")
    texts = read.select("doc_id", F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"))).alias("texts"), F.sha2(F.to_json("pages", {"ignoreNullFields": "false"}), 256).alias("digest"))
    asked = joined(texts, about.select("doc_id", "doc_type"), "doc_id").select("doc_id", "doc_type", F.when(F.col("doc_type").isNull(), F.col("texts")).alias("pages"), "digest")
    typed = told("classify", keep.stage("classify", prov("classify", plan.classify) + types, asked, lambda x: classified(x, plan)))
    asked = joined(read, joined(typed, about.select("doc_id", "examples"), "doc_id"), "doc_id")
    how = f"{prov('structure', plan.structure)}/{plan.sectioning}/{plan.window}/{plan.settings!r}/{types}"
    made = told("structure", keep.stage("structure", how, asked.select("doc_id", "doc_type", "engine", "pages", "ocr_confidence", "examples"), lambda x: structured(x, plan, keep)))
    seen = seen_before(made, prior, plan)
    asked = joined(made, scans.select("doc_id", "verdict"), "doc_id", "left") if scans is not None else made.withColumn("verdict", F.lit(None).cast("string"))
    asked = joined(asked, seen, "doc_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    inputs = asked.select("doc_id", "doc_type", "leaves", "confidence", "verdict", "seen")
    judged = told("decide", keep.stage("decide", prov("judge", plan.judge) + repr(plan.settings) + types, inputs, lambda x: decided(x, plan)))
    every = errors[0]
    for more in errors[1:]:
        every = every.union(more)
    every = keep.scratch(every, "errors")
    result = joined(joined(source.select("doc_id"), typed.select("doc_id", "doc_type", "guessed"), "doc_id", "left"), read.select("doc_id", "engine", "tried"), "doc_id", "left")
    result = joined(joined(result, made.select("doc_id", "leaves", "confidence", "warnings"), "doc_id", "left"), judged, "doc_id", "left")
    if scans is not None:
        result = joined(result, scans.select("doc_id", "verdict"), "doc_id", "left")
    swapped = F.when(F.size("tried") > 1, F.array(F.concat(F.lit("OCR fell back from "), F.col("tried")[0], F.lit(" to "), F.col("engine"))))
    guess = F.when(F.col("guessed"), F.array(F.concat(F.lit("the type was guessed as "), F.col("doc_type"))))
    empty = F.array().cast("array<string>")
    result = result.withColumn("warnings", F.concat(F.coalesce(swapped, empty), F.coalesce("warnings", empty), F.coalesce(guess, empty))).drop("tried")
    return joined(result, every.groupBy("doc_id").agg(F.min("stage").alias("failed_stage")), "doc_id", "left"), every
