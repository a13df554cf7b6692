"""What a service keeps about documents: listings, assembled cases, corrections, revisions, scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import markup

UNCLASSIFIED = "unclassified"
#: The order in which a listing shows documents by their status.
STATUS_ORDER = ["needs_review", "decided", "signed", "structured", "ocr_done", "prescanned", "uploaded"]


def resolved_type(structure_type: Column, document_type: Column) -> Column:
    """The type that the structure names, else the document's own, else `unclassified`."""
    return F.coalesce(F.nullif(structure_type, F.lit("")), F.nullif(document_type, F.lit("")), F.lit(UNCLASSIFIED))


def where_all(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal every value that is given; a value that is None or empty asks for nothing."""
    for name, value in equal.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows


def newest_run(runs: DataFrame, keep: list[str], id_col: str = "doc_id", at: str = "ts", tie: str = "seq") -> DataFrame:
    """(id, keep...) of the newest run of each document, from one aggregation."""
    return runs.groupBy(id_col).agg(F.max_by(F.struct(*keep), F.struct(F.col(at), -F.col(tie))).alias("_r")).select(id_col, "_r.*")


def assembled_cases(membership: DataFrame, docs: DataFrame, runs: DataFrame, keep: list[str]) -> DataFrame:
    """(case_id, doc_id, joined_at, place, docs' columns, keep...): members of cases with what the newest run says.

    A membership without a document is left out, a document without a run has nulls. A document is in the
    case that it was put into last. membership: case_id, doc_id, joined_at. runs: doc_id, ts, seq, keep...
    """
    one = membership.groupBy("doc_id").agg(F.max_by(F.struct("case_id", "joined_at"), F.struct("joined_at", "case_id")).alias("m")).select("doc_id", "m.*")
    met = one.join(docs, "doc_id").join(newest_run(runs, keep), "doc_id", "left")
    return met.select("case_id", "doc_id", "joined_at", *(c for c in docs.columns if c != "doc_id"), *keep)


def members_of(assembled: DataFrame, *columns: str) -> DataFrame:
    """(case_id, members): one row for each case, its members in the order in which they were put in."""
    one = F.struct("joined_at", "doc_id", *columns)
    return assembled.groupBy("case_id").agg(F.sort_array(F.collect_list(one)).alias("members"))


def fields_or_error(docs: DataFrame, runs: DataFrame, fields: str) -> DataFrame:
    """(doc_id, fields, error): the fields of each document's newest run, else why there are none."""
    met = docs.select("doc_id").join(newest_run(runs, [fields]), "doc_id", "left")
    return met.select("doc_id", fields, F.when(F.col(fields).isNull(), F.lit("the document has no structured extraction yet")).alias("error"))


def corrections_with_text(corrections: DataFrame, runs: DataFrame, texts: DataFrame) -> DataFrame:
    """corrections with the text that their document's newest structure was read from; null where there is none.

    runs: doc_id, ts, seq, engine. texts: doc_id, engine, full_text.
    """
    engine = newest_run(runs, ["engine"])
    held = engine.join(texts.select("doc_id", "engine", "full_text"), ["doc_id", "engine"], "left").select("doc_id", "full_text")
    return corrections.join(held, "doc_id", "left")


def raw_corrections(corrections: DataFrame, doc_type: str | None = None) -> DataFrame:
    """(json): one line for each correction, newest first, of one document type if asked for."""
    chosen = where_all(corrections, doc_type=doc_type).orderBy(F.desc("updated_at"), F.desc("seq"))
    return chosen.select(F.to_json(F.struct("doc_id", "doc_type", "field_path", "original", "value", "updated_at")).alias("json"))


def correction_groups(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, filename, status, n), documents with the most corrections first; a document that is gone has its id as name."""
    counted = corrections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(docs.select("doc_id", "filename", "status"), "doc_id", "left")
    return met.select("doc_id", F.coalesce("filename", F.col("doc_id").cast("string")).alias("filename"), "status", "n").orderBy(F.desc("n"), "doc_id")


def review_queue(queue: DataFrame, docs: DataFrame) -> DataFrame:
    """The queue (doc_id, at_risk, lowest, ...) with file names and status: most at risk first, then the lowest confidence."""
    met = queue.join(docs.select("doc_id", "filename", "status"), "doc_id", "left")
    return met.orderBy(F.desc("at_risk"), "lowest", "doc_id")


def by_status(docs: DataFrame, status: str = "status") -> DataFrame:
    """docs with `status_rank`, their place in the order of statuses; unknown ones come last."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col(status))
    return docs.withColumn("status_rank", F.when(F.coalesce(rank, F.lit(0)) == 0, len(STATUS_ORDER) + 1).otherwise(rank).cast("int"))


def conflicts_first(fields: DataFrame, case_col: str, *order: str) -> DataFrame:
    """Reconciled fields with `rank`, their place in their case: those that disagree first, each in the order given."""
    return fields.withColumn("rank", F.row_number().over(Window.partitionBy(case_col).orderBy("agreement", *order)))


def kpi_order(kpis: DataFrame) -> DataFrame:
    """A row for each document type with `rank`: the type of most documents first."""
    return kpis.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("documents"), "doc_type")))


def stored(updates: DataFrame) -> DataFrame:
    """updates as they are kept: bodies without what a page could run."""
    return updates.withColumn("html", markup.sanitized("html"))


def revisions(updates: DataFrame) -> DataFrame:
    """(template_id, seq, html, css, note): what stood before each update that touches html or css.

    updates: template_id, seq, html, css, note; null leaves a part as it is. The state before an update is
    the last value of each part before it as it was stored, null before the first.
    """
    updates = stored(updates)
    before = Window.partitionBy("template_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = updates.select("template_id", "seq", "note", F.last("html", True).over(before).alias("was_html"), F.last("css", True).over(before).alias("was_css"), (F.col("html").isNotNull() | F.col("css").isNotNull()).alias("touches"))
    return seen.where("touches").select("template_id", "seq", F.col("was_html").alias("html"), F.col("was_css").alias("css"), "note")


def restored(updates: DataFrame, asked: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """updates with one more for each restore: the revision's parts, '' where it had none, so that it can be undone too.

    asked: template_id, revision, seq. A revision that the template hasn't adds nothing.
    """
    kept = revisions(updates) if held is None else held
    back = asked.join(kept.select("template_id", F.col("seq").alias("revision"), "html", "css"), ["template_id", "revision"])
    empty = F.lit("")
    return updates.unionByName(back.select("template_id", "seq", F.coalesce("html", empty).alias("html"), F.coalesce("css", empty).alias("css"), F.concat(F.lit("restore: "), F.col("revision").cast("string")).alias("note")))


def now(updates: DataFrame) -> DataFrame:
    """(template_id, html, css): the last value of each part."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("html", "css")]
    return stored(updates).groupBy("template_id").agg(*last)


def append_runs(scored: DataFrame, path: str) -> None:
    """Add scored runs to the table of runs at a path; what is there stays."""
    scored.write.mode("append").parquet(path)


def latest_scores(runs: DataFrame) -> DataFrame:
    """(doc_type, runs, engine, overall, line_score) of the newest scored run of each type; line_score is the
    greatest over its collections, null without one. runs: doc_type, created_at, seq, engine, overall, collections (map)."""
    newest = F.max_by(F.struct("engine", "overall", "collections"), F.struct("created_at", "seq"))
    found = runs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("runs"), newest.alias("r"))
    return found.select("doc_type", "runs", "r.engine", "r.overall", F.array_max(F.map_values("r.collections")).alias("line_score"))


def enabled(engines: DataFrame) -> DataFrame:
    return engines.where("enabled")
