"""KPIs, review queue, corrections and run logs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.settings import DEFAULT


def latest(rows: DataFrame, by: str | list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the one with the smaller tie value.

    An aggregation with map-side combine, not a window: one row for each key is all that is kept.
    """
    keys = [by] if isinstance(by, str) else by
    rest = [c for c in rows.columns if c not in keys]
    kind = dict(rows.dtypes)[at]
    age = -F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith(("timestamp", "date")) else -F.col(at)
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(age.alias("age"), F.col(tie).alias("tie"))).alias("_row"))
    return found.select(*keys, "_row.*")


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Counts and their share of the total; the total is one number."""
    found = counts(rows, by)
    total = found.agg(F.sum("n")).scalar()
    return found.select(by, "n", F.round(F.col("n") / F.greatest(total, F.lit(1)), 6).alias("share"))


def daily(rows: DataFrame, at: str, as_of: date, days: int = 30) -> DataFrame:
    """(day, n) for each of the days up to as_of, 0 where nothing happened."""
    first = as_of - timedelta(days=days - 1)
    day = F.to_date(F.col(at))
    found = rows.where(day.between(F.lit(first), F.lit(as_of))).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day"))
    return calendar.join(F.broadcast(found), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))  # at most `days` rows


def overview(docs: DataFrame, runs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Totals: documents, decided, mean confidence, corrected documents, document types in use."""
    a = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(F.when(F.col("doc_type") != "unclassified", F.col("doc_type"))).alias("doc_types"))
    b = runs.agg(F.count_if(F.col("decision").isNotNull()).alias("decided"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    c = corrections.agg(F.count(F.lit(1)).alias("corrections"), F.count_distinct("doc_id").alias("corrected_docs"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def by_doc_type(docs: DataFrame, runs: DataFrame, corrections: DataFrame, evals: DataFrame) -> DataFrame:
    """KPIs of each document type; every side is aggregated before it is joined.

    docs: doc_id, doc_type. runs (latest): doc_id, confidence, decision. corrections: doc_id.
    evals: doc_type, accuracy, created_at.
    """
    per_run = docs.join(runs, "doc_id", "left").groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count_if(F.col("decision") == "approve").alias("approved"), F.count_if(F.col("decision") == "flag").alias("flagged"),
        F.count_if(F.col("decision") == "needs_review").alias("needs_review"),
    )
    fixed = docs.select("doc_id", "doc_type").join(corrections, "doc_id").groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("corrections"), F.count_distinct("doc_id").alias("corrected_docs")
    )
    scored = evals.groupBy("doc_type").agg(F.count(F.lit(1)).alias("eval_runs"), F.max_by("accuracy", "created_at").alias("accuracy"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    met = per_run.join(fixed, "doc_type", "left").join(scored, "doc_type", "left")
    return met.select(
        "doc_type", "documents", F.round(F.col("documents") / total, 6).alias("share"), "avg_confidence", "approved", "flagged", "needs_review",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("corrections", "corrected_docs", "eval_runs")), "accuracy",
    )


def at_risk(leaves: DataFrame, threshold: float = DEFAULT.field_review_threshold, presence: tuple[str, ...] = ()) -> DataFrame:
    """Leaves below the threshold that no one edited and that aren't presence fields."""
    return leaves.where((F.col("confidence") < threshold) & ~F.col("edited") & ~F.substring_index("path", ".", 1).isin(*presence))


def queue(risky: DataFrame) -> DataFrame:
    """Documents by their number of fields at risk and their lowest confidence, with the fields, worst first."""
    one = F.struct("confidence", "path")
    return risky.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("at_risk"), F.min("confidence").alias("lowest"), F.sort_array(F.collect_list(one)).alias("fields")
    )


def latest_corrections(log: DataFrame) -> DataFrame:
    """(doc_id, field_path, original, value, updated_at): the first original and the last value of each field."""
    return log.groupBy("doc_id", "field_path").agg(
        F.min_by("original", F.struct("updated_at", "seq")).alias("original"), F.max_by("value", F.struct("updated_at", "seq")).alias("value"), F.max("updated_at").alias("updated_at")
    )


def correction_examples(log: DataFrame) -> DataFrame:
    """(doc_id, json): one JSON line for each document with its fields and the time of the last change."""
    now = latest_corrections(log)
    fields = F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_path", "value"))))
    line = F.to_json(F.struct(F.col("doc_id"), fields.alias("fields"), F.date_format(F.max("updated_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("corrected_at")))
    return now.groupBy("doc_id").agg(line.alias("json"))


def top_corrections(log: DataFrame, n: int = DEFAULT.few_shot_examples, by: str = "doc_type") -> DataFrame:
    """The n newest corrections of each document type, one for each field path."""
    newest = log.groupBy(by, "field_path").agg(F.max_by(F.struct("value", "updated_at", "seq"), F.struct("updated_at", "seq")).alias("c"))
    order = Window.partitionBy(by).orderBy(F.desc("c.updated_at"), F.desc("c.seq"))
    return newest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(by, "field_path", "c.value", "rank")


def correction_texts(log: DataFrame, fields: DataFrame, n: int = DEFAULT.few_shot_examples) -> DataFrame:
    """(doc_type, rank, text, cls, value): the newest corrections of each type as texts "Label: value" with what is to be found.

    log: doc_type, field_path, value, updated_at, seq. fields: doc_type, name, cls, kind; only scalar ones are taken, and only
    values that aren't empty.
    """
    scalar = fields.where("kind = 'scalar'").select("doc_type", F.col("name").alias("field_path"), "cls")
    kept = log.where(F.coalesce("value", F.lit("")) != "").join(scalar, ["doc_type", "field_path"])
    newest = kept.groupBy("doc_type", "field_path", "cls").agg(F.max_by("value", F.struct("updated_at", "seq")).alias("value"), F.max("updated_at").alias("updated_at"))
    ranked = newest.withColumn("rank", F.row_number().over(Window.partitionBy("doc_type").orderBy(F.desc("updated_at"), "field_path"))).where(F.col("rank") <= n)
    return ranked.select("doc_type", "rank", F.concat(F.initcap(F.replace("field_path", F.lit("_"), F.lit(" "))), F.lit(": "), "value").alias("text"), "cls", "value")


def with_stage(stages: Column, name: str, payload: Column) -> Column:
    """A map of stage results with one stage put in; deciding again drops the signature."""
    kept = F.map_filter(stages, lambda k, v: (k != name) & ~((F.lit(name) == "decide") & (k == "sign")))
    return F.map_concat(kept, F.create_map(F.lit(name), payload))


def without(rows: DataFrame, deleted: DataFrame, *keys: str) -> DataFrame:
    """rows without those of deleted keys: what a cascade of deletes leaves."""
    return rows.join(deleted.select(*keys), list(keys), "left_anti")


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 8) -> DataFrame:
    """One page of an ordered listing; beyond the last page it is the last one."""
    total = rows.count()
    last = max(0, (total - 1) // size)
    return rows.orderBy(*order).offset(min(page, last) * size).limit(size)


def search(rows: DataFrame, term: str, *columns: str, status: str | None = None, status_col: str = "status") -> DataFrame:
    """Rows whose columns hold the term, in any case of letters, and whose status is the given one."""
    found = F.lower(F.concat_ws(" ", *columns)).contains(term.lower()) if term else F.lit(True)
    return rows.where(found if status is None else found & (F.col(status_col) == status))


def member_state(actions: DataFrame) -> DataFrame:
    """The last status of each case member from a log of actions, and whether a case is settled."""
    members = actions.groupBy("case_id", "doc_id").agg(F.max_by("status", "seq").alias("status"))
    return members.groupBy("case_id").agg(
        F.count_if(F.col("status") == "structured").alias("structured"), F.count_if(F.col("status") == "error").alias("errored"),
        F.bool_and(F.col("status").isin("structured", "error")).alias("settled"), F.count(F.lit(1)).alias("members"),
    )
