"""Text of documents: pages, offsets, headings, sections, tables, spans and where they stand.

Pages are rows (doc_id, page, text); blocks are rows (doc_id, page, block, label, text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.settings import DEFAULT

JOINER = "\n\n"
#: Trust in a span by how it was found.
ALIGNMENT = {"exact": 1.0, "partial": 0.7, "ungrounded": 0.4}


def page_offsets(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text", joiner: int = len(JOINER)) -> DataFrame:
    """pages with char_start and char_end in the joined text."""
    before = Window.partitionBy(id_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    start = F.coalesce(F.sum(length + joiner).over(before), F.lit(0))
    return pages.withColumn("char_start", start).withColumn("char_end", start + length)


def char_to_page(spans: DataFrame, offsets: DataFrame, id_col: str = "doc_id", pos_col: str = "pos") -> DataFrame:
    """(id, pos, page): the page with the greatest start at or before the position, null without one.

    The pages of a document are gathered as one sorted array beside its spans, so it takes one join on the
    document and no range comparison between all spans and pages.
    """
    listed = offsets.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("char_start", "page"))).alias("_pages"))
    met = spans.join(listed, id_col, "left")
    at = F.filter("_pages", lambda p: p["char_start"] <= F.col(pos_col))
    return met.select(*spans.columns, F.try_element_at(at, F.lit(-1))["page"].alias("page"))


def nearest(needle: Column, hay: Column, hint: Column) -> Column:
    """Start of the occurrence nearest to the hint, the earlier of two; the first without a hint; -1 if none."""

    def around(at: Column) -> Column:
        """The first one from `at` on, and the last one that starts before it: that is, of the text reversed the first."""
        after = F.call_function("locate", needle, hay, at + 1) - 1
        before = F.substring(hay, F.lit(1), at + F.char_length(needle) - 1)
        turned = F.when(at > 0, F.instr(F.reverse(before), F.reverse(needle)))
        back = F.when(turned > 0, F.char_length(before) - turned + 1 - F.char_length(needle))
        return F.when(back.isNull() | ((after >= 0) & (after - at < at - back)), after).otherwise(back)

    missing = F.when(F.coalesce(needle, F.lit("")) == "", -1).otherwise(F.instr(hay, needle) - 1)
    return F.when(hint.isNull() | (F.coalesce(needle, F.lit("")) == "") | ~F.coalesce(F.contains(hay, needle), F.lit(False)), missing).otherwise(
        V.let(F.greatest(F.lit(0), F.least(hint, F.char_length(hay))), around)
    )


def anchored(needle: Column, hay: Column, start: Column, end: Column) -> Column:
    """(alignment, char_start, char_end, base_confidence) of a span in a text, where it says that it stands or is looked for."""
    quoted = F.coalesce((start >= 0) & (start < end) & (F.substring(hay, start + 1, end - start) == needle), F.lit(False))

    def told(at: Column, found: Column, alignment: Column, base: Column) -> Column:
        return F.struct(alignment.alias("alignment"), F.when(found, at).alias("char_start"), F.when(found, at + F.char_length(needle)).alias("char_end"), base.alias("base_confidence"))

    def looked_for(at: Column) -> Column:
        exact = (at >= 0) & start.isNull()
        weight = F.when(exact, ALIGNMENT["exact"]).when(at >= 0, ALIGNMENT["partial"]).otherwise(ALIGNMENT["ungrounded"])
        return told(at, at >= 0, F.when(exact, "exact").when(at >= 0, "partial").otherwise("ungrounded"), weight)

    # A span that stands where it says isn't looked for.
    return F.when(quoted, told(start, F.lit(True), F.lit("exact"), F.lit(ALIGNMENT["exact"]))).otherwise(V.let(nearest(needle, hay, start), looked_for))


def grounded(rows: DataFrame, needle: str = "span", hay: str = "text", start: str = "hint_start", end: str = "hint_end") -> DataFrame:
    """rows with char_start, char_end, alignment and base confidence of the span."""
    return rows.withColumn("_a", anchored(F.col(needle), F.col(hay), F.col(start), F.col(end))).select(*rows.columns, "_a.*")


def span_confidence(base: Column, page: Column, document: Column) -> Column:
    return F.round(F.least(F.lit(1.0), base * F.coalesce(page, document, F.lit(1.0))), 4)


def confidence_summary(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mean confidence of a document over all its blocks, its characters, and whether it is low."""
    mean = F.round(F.avg("confidence"), 4)
    out = blocks.groupBy(id_col).agg(mean.alias("avg_confidence"), F.sum(F.char_length("text")).alias("char_count"), F.count(F.lit(1)).alias("blocks"))
    return out.withColumn("low_confidence", F.coalesce(F.col("avg_confidence") < DEFAULT.ocr_confidence_warn, F.lit(False)))


def chain_choice(attempts: DataFrame, id_col: str = "doc_id", floor: float = DEFAULT.ocr_fallback_confidence) -> DataFrame:
    """The first adequate attempt of each document in rank order, else its last: one aggregation.

    attempts: id, rank, engine, confidence, chars, failed.
    """
    good = ~F.col("failed") & (F.col("chars") > 0) & (F.coalesce("confidence", F.lit(1.0)) >= floor)
    one, place = F.struct("engine", "rank", "confidence", "adequate"), F.struct("rank", "engine")
    first = F.min_by(one, F.when(F.col("adequate"), place))
    found = attempts.withColumn("adequate", F.coalesce(good, F.lit(False))).groupBy(id_col).agg(F.coalesce(first, F.max_by(one, place)).alias("chosen"))
    return found.select(id_col, "chosen.*")


def headings(blocks: DataFrame, labels: tuple[str, ...] = ("title", "section_header")) -> DataFrame:
    """blocks with is_heading and the heading's text: by label, or a markdown heading line."""
    marked = F.col("text").rlike(r"^#{1,6}\s+\S")
    is_heading = F.col("label").isin(*labels) | marked
    return blocks.withColumn("is_heading", is_heading).withColumn("title", F.when(is_heading, F.trim(F.regexp_replace("text", r"^#{1,6}\s+", ""))))


def sections(blocks: DataFrame, id_col: str = "doc_id", order: tuple[str, ...] = ("page", "block")) -> DataFrame:
    """(id, section, title, n_blocks, text): cut at headings; what stands before the first is a section too."""
    running = Window.partitionBy(id_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = headings(blocks)
    lead = F.first("is_heading").over(Window.partitionBy(id_col).orderBy(*order))
    cut = F.sum(F.col("is_heading").cast("int")).over(running) - lead.cast("int")
    listed = head.withColumn("section", cut.cast("int")).groupBy(id_col, "section").agg(F.sort_array(F.collect_list(F.struct(*order, "title", "text"))).alias("b"))
    return listed.select(
        id_col, "section", F.col("b")[0]["title"].alias("title"), F.size("b").alias("n_blocks"),
        F.array_join(F.transform("b", lambda x: x["text"]), JOINER).alias("text"),
    )


def coalesced(parts: DataFrame, id_col: str = "doc_id", least: int = DEFAULT.section_min_chars, most: int = DEFAULT.max_sections) -> DataFrame:
    """Sections shorter than `least` joined to the next one, the last to the one before; more than `most`
    sections become one. (id, sections: array of (title, text), whole)."""
    listed = parts.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("section", "title", "text"))).alias("s"))
    empty = F.array().cast("array<struct<title:string,text:string>>")
    begin = F.struct(empty.alias("done"), F.lit(None).cast("struct<title:string,text:string>").alias("open"))

    def join(a, b):
        return F.struct(F.coalesce(a["title"], b["title"]).alias("title"), F.concat(a["text"], F.lit(JOINER), b["text"]).alias("text"))

    def step(acc, x):
        one = F.struct(x["title"].alias("title"), x["text"].alias("text"))
        now = F.when(acc["open"].isNull(), one).otherwise(join(acc["open"], one))
        long_enough = F.char_length(now["text"]) >= least
        return F.struct(
            F.when(long_enough, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"),
            F.when(long_enough, F.lit(None)).otherwise(now).alias("open"),
        )

    def end(acc):
        n = F.size(acc["done"])
        back = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(join(F.try_element_at(acc["done"], F.lit(-1)), acc["open"])))
        return F.when(acc["open"].isNull(), acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(back)

    folded = listed.select(id_col, F.aggregate("s", begin, step, end).alias("sections"), "s")
    whole = F.size("sections") > most
    one = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.array_join(F.transform("s", lambda x: x["text"]), JOINER).alias("text")))
    return folded.select(id_col, F.when(whole, one).otherwise(F.col("sections")).alias("sections"), whole.alias("whole"))


def merged_sections(leaves: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One value for each (id, field) over ordered sections: the first grounded one, else the first."""
    place = F.struct((~F.col("grounded")).alias("late"), F.col("section"))
    return leaves.groupBy(id_col, "field").agg(
        F.min_by("value", place).alias("value"), F.min_by("confidence", place).alias("confidence"), F.count(F.lit(1)).alias("candidates")
    )


def dedup_list(items: DataFrame, id_col: str, ord_col: str, value_col: str) -> DataFrame:
    """Items without later ones of an equal key; items that aren't text all stay."""
    key = V.dedup_key(F.col(value_col))
    first = Window.partitionBy(id_col, key).orderBy(ord_col)
    return items.withColumn("_n", F.row_number().over(first)).where(F.col(value_col).isNull() | (F.col("_n") == 1)).drop("_n")


def markdown_rows(rows: Column) -> Column:
    """A grid of texts as a markdown table: the first row is the head, short rows are filled up."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n"))


def markdown_cells(table: Column, with_head: bool = False) -> Column:
    """Rows of cells of a markdown table, without its rule and, by default, its head."""
    lines = F.filter(F.split(table, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))
    return rows if with_head else F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))


def markdown_tables(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(id, page, table, markdown): runs of lines with pipes that hold a rule line."""
    lines = pages.select(id_col, page_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).where(F.trim("line").startswith("|"))
    island = F.col("n") - F.row_number().over(Window.partitionBy(id_col, page_col).orderBy("n"))
    runs = lines.withColumn("island", island).groupBy(id_col, page_col, "island").agg(
        F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"), F.bool_or(F.col("line").rlike(r"^[\s|:-]*---[\s|:-]*$")).alias("ruled")
    )
    number = F.row_number().over(Window.partitionBy(id_col, page_col).orderBy("island"))
    return runs.where("ruled").select(id_col, page_col, number.alias("table"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def interval_pairs(left: DataFrame, right: DataFrame, on: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], least: int = 64, step: int = 8) -> DataFrame:
    """Pairs of rows of equal keys whose intervals [start, end) overlap, with `inside`: left, right, both or null (which one the other holds).

    Intervals meet in bins, not under their key alone. A bin's width is `least` or `step` times that of the level below; an
    interval is at the lowest level whose bins are as wide as it, and covers two of them at most. It is put into bins of its
    own level and of the levels above, so two intervals meet at the level of the longer one, and the pair is taken in the bin
    of the later start, once. Starts that touch an end don't overlap. All columns but the keys must have different names.
    """
    (ls, le), (rs, re_) = left_ends, right_ends
    longest = F.max(F.greatest(F.col("end") - F.col("start"), F.lit(1)))
    both = left.select(F.col(ls).alias("start"), F.col(le).alias("end")).union(right.select(F.col(rs).alias("start"), F.col(re_).alias("end")))
    most, levels = both.agg(longest).first()[0] or 1, 1
    while least * step ** (levels - 1) < most:
        levels += 1
    widths = F.array(*(F.lit(least * step**n).cast("long") for n in range(levels)))

    def dealt(rows: DataFrame, start: str, end: str, own: str) -> DataFrame:
        level = F.size(F.filter(widths, lambda w: w < F.col(end) - F.col(start)))
        places = F.transform(F.sequence(level, F.lit(levels - 1)), lambda n: F.transform(
            F.sequence(F.floor(F.col(start) / widths[n]), F.floor(F.col(end) / widths[n])), lambda b: F.struct(n.alias("_level"), b.alias("_bin"), (n == level).alias(own))
        ))
        known = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        return known.withColumn("_place", F.explode(F.flatten(places))).select(*rows.columns, "_place.*")

    met = dealt(left, ls, le, "_own_l").join(dealt(right, rs, re_, "_own_r"), [*on, "_level", "_bin"])
    later = F.floor(F.greatest(ls, rs) / widths[F.col("_level")])
    found = met.where((F.col("_own_l") | F.col("_own_r")) & (F.col("_bin") == later) & (F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs)))
    in_right, in_left = (F.col(rs) <= F.col(ls)) & (F.col(le) <= F.col(re_)), (F.col(ls) <= F.col(rs)) & (F.col(re_) <= F.col(le))
    inside = F.when(in_left & in_right, "both").when(in_right, "left").when(in_left, "right")
    return found.withColumn("inside", inside).drop("_level", "_bin", "_own_l", "_own_r")


def overlapping_blocks(blocks: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks (id, block, char_start, char_end) and spans (id, span, start, end) of a document that overlap."""
    return interval_pairs(blocks, spans, [id_col], ("char_start", "char_end"), ("start", "end")).drop("inside")


def vocabulary_match(text: Column, vocabularies: dict[str, list[str]]) -> Column:
    """(doc_type, confidence, scores) of a text: the share of each type's words that stand in it, as a share of all.

    The text is cut into its words once and met with each vocabulary as a whole; a word with other characters than
    letters, digits and _ is looked for in the text.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def told(words: Column) -> Column:
        hits = []
        for _, some in sorted(vocabularies.items()):
            plain, other = (sorted({w for w in some if bool(re.fullmatch(r"\w+", w)) == is_plain}) for is_plain in (True, False))
            found = F.size(F.array_intersect(words, F.array(*map(F.lit, plain)))) if plain else F.lit(0)
            found = sum((F.when(low.rlike(rf"\b\Q{w}\E\b"), 1).otherwise(0) for w in other), found)
            hits.append(found / max(1, len(set(some))))
        return V.let(F.array(*hits) if hits else F.array().cast("array<double>"), lambda h: scored(h))

    def scored(shares: Column) -> Column:
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        names = F.array(*map(F.lit, sorted(vocabularies)))
        each = F.zip_with(names, shares, lambda n, x: F.struct((-F.round(F.coalesce(F.try_divide(x, total), F.lit(0.0)), 4)).alias("less"), n.alias("doc_type")))
        return V.let(F.array_sort(each), best)

    def best(order: Column) -> Column:
        top = F.get(order, F.lit(0))
        return F.struct(
            F.when(top["less"] < 0, top["doc_type"]).alias("doc_type"), F.when(top["less"] < 0, -top["less"]).otherwise(0.0).alias("confidence"),
            F.transform(order, lambda x: F.struct(x["doc_type"].alias("doc_type"), (-x["less"]).alias("score"))).alias("scores"),
        )

    return V.let(F.array_distinct(F.split(low, r"[^\p{L}\p{Nd}_]+")), told)


def classified(docs: DataFrame, vocabularies: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_type, confidence, scores): the share of each type's words in the text, as a share of all."""
    return docs.select(id_col, vocabulary_match(F.col(text_col), vocabularies).alias("m")).select(id_col, "m.*")
