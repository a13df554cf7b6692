"""One value for each field of a case from several documents, with tolerances; and the case's decision.

Candidates are rows (case_id, field, doc_id, doc_ord, ord, value). Two documents agree on a field if any
of their values do; a field agrees if all pairs of its documents do. Values travel once, to their field, distinct
by document in each task; the range of the values, or a few values compared in place, settles most fields, and only
the documents of the other fields are compared in pairs, by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fuzzy
from paperloom.functions import values as V
from paperloom.settings import DEFAULT, Settings


def mapped(leaves: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidates of leaves (case_id, doc_id, doc_ord, doc_type, path, ord, value) under a mapping (doc_type,
    field_path, field): the leaf at the path and all below it.

    A mapping is written by hand and goes to all tasks: there are few document types, so leaves aren't dealt out by them.
    """
    named = mapping.select(F.col("doc_type").alias("map_type"), "field_path", "field")
    below = (F.col("path") == F.col("field_path")) | F.col("path").startswith(F.concat(F.col("field_path"), F.lit(".")))
    return leaves.join(F.broadcast(named), (F.col("doc_type") == F.col("map_type")) & below).select("case_id", "field", "doc_id", "doc_ord", "ord", "value")


def open_pile(leaves: DataFrame) -> DataFrame:
    """Candidates without a mapping: paths, list positions left out, that two or more documents of a case fill."""
    keyed = leaves.where("value is not null").withColumn("field", V.index_free_path(F.col("path")))
    often = keyed.groupBy("case_id", "field").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 2")
    return keyed.join(often.select("case_id", "field"), ["case_id", "field"], "left_semi").select("case_id", "field", "doc_id", "doc_ord", "ord", "value")


def agrees(kind: Column, a: Column, b: Column, settings: Settings = DEFAULT, use_fuzzy: bool = True) -> Column:
    """Whether two values agree as money, dates or text."""
    na, nb = (F.when(v["kind"] == "string", V.read_number(v["s"])).otherwise(V.as_number(v)) for v in (a, b))
    room = F.greatest(F.lit(settings.money_abs_tolerance), F.lit(settings.money_pct_tolerance) * F.greatest(F.abs(na), F.abs(nb)))
    money = F.coalesce(F.abs(na - nb) <= room, F.lit(False))
    # Amounts aren't read as text. The rest is read inside a lambda: written out, it is beyond what Spark compiles.
    said = [F.when(~kind.eqNullSafe("money"), V.strip(V.as_text(v))) for v in (a, b)]
    (da, ka), (db, kb) = ((x["d"], x["k"]) for x in (V.let(s, lambda s: F.struct(V.as_date(s).alias("d"), V.company_key(s).alias("k"))) for s in said))
    # Only what is compared as text reaches the similarity function.
    as_text = (kind == "string") | ((kind == "date") & (da.isNull() | db.isNull()))
    text = fuzzy.ratio_at_least(F.when(as_text, ka), F.when(as_text, kb), settings.string_fuzzy_threshold) if use_fuzzy else ka == kb
    days = F.abs(F.datediff(da, db)) <= settings.date_tolerance_days
    return F.when(kind == "money", money).when(as_text, text).otherwise(days)


#: Fields with more values than this are settled by their range or by the join of their documents.
MAX_LISTED = 64


def _once(rows: DataFrame) -> DataFrame:
    """rows whose columns are computed once: a filter on a row's struct can't go below it and take their expressions along."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def _listed(candidates: DataFrame) -> DataFrame:
    """Per (case_id, field): kind, first value, documents, and `points`: each document's different values as a number, or as
    a day and a key of text.

    Values travel once, to their field, each different one of a document once from a task. The kind is money if all values
    are numbers, date by the field's name or by a value, else string; only what isn't money is read as text.
    """
    has = F.col("value").isNotNull()
    found = candidates.groupBy("case_id", "field").agg(
        F.min_by(F.when(has, F.col("value")), F.when(has, F.struct("doc_ord", "ord"))).alias("value"),
        F.collect_set(F.when(has, F.struct("doc_id", F.col("value").alias("v")))).alias("_s"),
    )
    numeric = (F.size("_s") > 0) & F.forall("_s", lambda x: x["v"]["kind"] == "number")
    none = lambda kind: F.lit(None).cast(kind)
    numbers = F.transform("_s", lambda x: F.struct(x["doc_id"].alias("doc"), x["v"]["n"].alias("n"), none("date").alias("d"), none("string").alias("k")))

    def text(x: Column) -> Column:
        return V.let(V.strip(V.as_text(x["v"])), lambda s: F.struct(x["doc_id"].alias("doc"), none("double").alias("n"), V.as_date(s).alias("d"), V.company_key(s).alias("k")))

    read = found.withColumn("_numeric", F.coalesce(numeric, F.lit(False))).withColumn("points", F.when(F.col("_numeric"), numbers).otherwise(F.transform("_s", text)))
    read = _once(read.select("case_id", "field", "value", "_numeric", "points"))
    dated = F.col("field").rlike(V.DATE_NAME) | F.exists("points", lambda x: x["d"].isNotNull())
    kind = F.when(F.col("_numeric"), "money").when(dated, "date").otherwise("string")
    return read.select("case_id", "field", kind.alias("field_kind"), "value", F.size(F.array_distinct("points.doc")).alias("docs"), "points")


def _agree(x: Column, y: Column, kind: Column, settings: Settings) -> Column:
    """Whether two points agree, with texts taken as equal or not."""
    room = F.greatest(F.lit(settings.money_abs_tolerance), F.lit(settings.money_pct_tolerance) * F.greatest(F.abs(x["n"]), F.abs(y["n"])))
    as_text = (kind == "string") | x["d"].isNull() | y["d"].isNull()
    return F.when(kind == "money", F.abs(x["n"] - y["n"]) <= room).when(as_text, x["k"] == y["k"]).otherwise(F.abs(F.datediff(x["d"], y["d"])) <= settings.date_tolerance_days)


def _settled(settings: Settings, use_fuzzy: bool) -> Column:
    """Whether the documents of a field agree, where its own row tells: by the range of its values, or by a few values
    compared in place; else null."""
    kind, points = F.col("field_kind"), F.col("points")
    low, high = ({c: how(points[c]) for c in "ndk"} for how in (F.array_min, F.array_max))
    room = F.greatest(F.lit(settings.money_abs_tolerance), F.lit(settings.money_pct_tolerance) * F.greatest(F.abs(low["n"]), F.abs(high["n"])))
    one = F.size(points) == F.col("docs")
    # Room grows with the amounts, so the widest pair speaks for all only if room is the same for all, or if there is no other.
    money = F.when(F.lit(settings.money_pct_tolerance == 0) | (F.col("docs") == 2), high["n"] - low["n"] <= room)
    all_dated = F.forall(points, lambda x: x["d"].isNotNull())
    days = F.when(all_dated, F.datediff(high["d"], low["d"]) <= settings.date_tolerance_days)
    same = low["k"] == high["k"]
    by_range = F.when(one, F.when(kind == "money", money).when(kind == "date", days).otherwise(F.when(same, True) if use_fuzzy else same))
    docs = F.filter(F.array_distinct(points["doc"]), lambda d: d.isNotNull())
    by_doc = F.transform(docs, lambda p: F.filter(points, lambda x: x["doc"] == p))
    some = lambda xs, ys: F.exists(xs, lambda x: F.exists(ys, lambda y: _agree(x, y, kind, settings)))
    met = F.forall(F.sequence(F.lit(1), F.size(docs) - 1), lambda i: V.let(F.get(by_doc, i), lambda ys: F.forall(F.slice(by_doc, F.lit(1), i), lambda xs: some(xs, ys))))
    # Texts that aren't equal may still be alike.
    in_place = F.when(F.size(points) <= MAX_LISTED, F.when(met, True).when((kind == "money") | F.lit(not use_fuzzy), met))
    return F.when(F.col("docs") <= 1, True).otherwise(F.coalesce(by_range, in_place))


def _pairs(fields: DataFrame, settings: Settings, use_fuzzy: bool, *kept: str) -> DataFrame:
    """(case_id, field, doc_a, doc_b, agree) and kept columns of the fields given: values meet by a join, which a hot field can split."""
    # Dealt out by document first, so that the join has a shuffle of its own.
    each = fields.select("case_id", "field", "field_kind", *kept, F.explode("points").alias("p")).repartition("case_id", "field", "p.doc")
    a = each.select("case_id", "field", "field_kind", *kept, F.col("p.doc").alias("doc_a"), *(F.col(f"p.{c}").alias(f"{c}_a") for c in "ndk"))
    b = each.select("case_id", "field", F.col("p.doc").alias("doc_b"), *(F.col(f"p.{c}").alias(f"{c}_b") for c in "ndk"))
    met = a.join(b, ["case_id", "field"]).where("doc_a < doc_b")
    room = F.greatest(F.lit(settings.money_abs_tolerance), F.lit(settings.money_pct_tolerance) * F.greatest(F.abs("n_a"), F.abs("n_b")))
    money = F.coalesce(F.abs(F.col("n_a") - F.col("n_b")) <= room, F.lit(False))
    as_text = (F.col("field_kind") == "string") | ((F.col("field_kind") == "date") & (F.col("d_a").isNull() | F.col("d_b").isNull()))
    ka, kb = (F.when(as_text, F.col(c)) for c in ("k_a", "k_b"))
    text = fuzzy.ratio_at_least(ka, kb, settings.string_fuzzy_threshold) if use_fuzzy else ka == kb
    agree = F.when(F.col("field_kind") == "money", money).when(as_text, text).otherwise(F.abs(F.datediff("d_a", "d_b")) <= settings.date_tolerance_days)
    of = [F.any_value(k).alias(k) for k in ("field_kind", *kept)]
    return met.withColumn("agree", agree).groupBy("case_id", "field", "doc_a", "doc_b").agg(F.bool_or("agree").alias("agree"), *of)


def pairs(candidates: DataFrame, settings: Settings = DEFAULT, use_fuzzy: bool = True) -> DataFrame:
    """(case_id, field, doc_a, doc_b, agree) for each pair of documents that fill a field, doc_a being the smaller id."""
    return _pairs(_listed(candidates), settings, use_fuzzy).drop("field_kind")


def reconciled(candidates: DataFrame, settings: Settings = DEFAULT, use_fuzzy: bool = True) -> DataFrame:
    """(case_id, field, field_kind, value, docs, agreement): value is the first one in document order.

    Most fields are settled in their own row; the others' documents are compared by a join.
    """
    columns = ["case_id", "field", "field_kind", "value", "docs"]
    listed = _listed(candidates)
    # What can't meet by the join (no case, or one document with an id) has nothing to disagree with.
    meet = F.col("case_id").isNotNull() & F.col("field").isNotNull() & (F.size(F.filter(F.array_distinct("points.doc"), lambda d: d.isNotNull())) > 1)
    fields = _once(listed.select(*columns, "points", F.coalesce(_settled(settings, use_fuzzy), F.when(~meet, True)).alias("settled")))
    told = _pairs(fields.where("settled is null"), settings, use_fuzzy, "value", "docs")
    told = told.groupBy("case_id", "field").agg(F.any_value("field_kind").alias("field_kind"), F.any_value("value").alias("value"), F.any_value("docs").alias("docs"), F.bool_and("agree").alias("agreement"))
    return fields.where("settled is not null").select(*columns, F.col("settled").alias("agreement")).union(told.select(*columns, F.coalesce("agreement", F.lit(True)).alias("agreement")))


def conflicts(candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """(case_id, field, detail, citations) of the fields that disagree: what each document says, and where.

    candidates have doc_type and page too; a document without a type goes by its id. detail: `type: v1, v2; type: v`.
    citations: array of (doc_id, source), source being `page n` of the document's first value, or empty.
    """
    bad = fields.where(~F.col("agreement")).select("case_id", "field")
    own = candidates.where("value is not null").join(bad, ["case_id", "field"], "left_semi")
    one = F.struct("ord", V.as_text(F.col("value")).alias("said"), "page")
    by_doc = own.groupBy("case_id", "field", "doc_id").agg(F.min("doc_ord").alias("doc_ord"), F.first("doc_type", True).alias("doc_type"), F.sort_array(F.collect_list(one)).alias("l"))
    said = F.concat(F.coalesce("doc_type", F.col("doc_id").cast("string")), F.lit(": "), F.array_join(F.transform("l", lambda x: x["said"]), ", "))
    page = F.col("l")[0]["page"]
    cited = F.struct("doc_id", F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))).otherwise("").alias("source"))
    listed = by_doc.groupBy("case_id", "field").agg(F.sort_array(F.collect_list(F.struct("doc_ord", "doc_id", said.alias("said"), cited.alias("cited")))).alias("d"))
    return listed.select("case_id", "field", F.array_join(F.transform("d", lambda x: x["said"]), "; ").alias("detail"), F.transform("d", lambda x: x["cited"]).alias("citations"))


def conflict_checks(fields: DataFrame) -> DataFrame:
    """A review check for each field: failed where its documents disagree, passing rows too."""
    said = F.when(F.col("agreement"), F.lit("documents agree")).otherwise("documents disagree")
    return fields.select("case_id", F.concat(F.lit("conflict:"), F.col("field")).alias("name"), F.col("agreement").alias("passed"), said.alias("detail"), F.lit("review").alias("severity"))


def completeness_checks(cases: DataFrame, members: DataFrame, required: DataFrame) -> DataFrame:
    """A check for each case and required document type: missing is a review failure, present is advisory.

    cases: case_id. members: case_id, doc_type, structured. required: doc_type, least.
    """
    each = members.groupBy("case_id", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and("structured").alias("structured"))
    # A case meets its members once, in one row for all of its document types.
    have = each.groupBy("case_id").agg(F.collect_list(F.struct("doc_type", "n", "structured")).alias("_have"))
    # The document types of a case type are one array, read once: each case asks for all of them.
    listed = required.agg(F.collect_list(F.struct("doc_type", "least"))).scalar()
    asked = cases.join(have, "case_id", "left").withColumn("_r", F.explode(listed)).select(*cases.columns, "_r.doc_type", "_r.least", "_have")
    met = asked.withColumn("_h", F.get(F.filter("_have", lambda h: h["doc_type"] == F.col("doc_type")), F.lit(0))).select(*cases.columns, "doc_type", "least", "_h.n", "_h.structured")
    n = F.coalesce("n", F.lit(0))
    missing, open_ = n < F.col("least"), (n > 0) & ~F.coalesce("structured", F.lit(False))
    word = F.when(missing, "missing").when(open_, "unstructured").otherwise("present")
    return met.where((F.col("least") > 0) | (n > 0)).select(
        "case_id", F.concat(word, F.lit(":"), F.col("doc_type")).alias("name"), (~missing & ~open_).alias("passed"),
        F.concat(n.cast("string"), F.lit(" of "), F.col("least").cast("string")).alias("detail"),
        F.when(missing, "review").otherwise("advisory").alias("severity"),
    )


def case_decisions(checks: DataFrame, confidences: DataFrame, base: str = "approve", base_confidence: float = 0.95) -> DataFrame:
    """(case_id, decision, confidence, n_checks, n_failed) from check rows and members' confidences."""
    bad = ~F.col("passed")
    counted = checks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(bad).alias("n_failed"),
        F.count_if(bad & (F.col("severity") == "hard")).alias("hard"), F.count_if(bad & (F.col("severity") == "review")).alias("review"),
    )
    sure = confidences.groupBy("case_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("sure"))
    met = counted.join(sure, "case_id", "left").withColumn("sure", F.coalesce("sure", F.lit(0.0)))
    least = F.least(F.lit(base_confidence), F.col("sure"))
    verdict = F.when(F.col("hard") > 0, "flag").when(F.col("review") > 0, "needs_review").otherwise(base)
    return met.select("case_id", verdict.alias("decision"), F.round(F.when(F.col("hard") > 0, F.greatest(least, F.lit(0.9))).otherwise(least), 4).alias("confidence"), "n_checks", "n_failed")
