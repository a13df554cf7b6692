"""op4: secrets of all documents with corpus-wide ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import secret_scan
from paperloom.llm.secret_scan import ACCESS, ASSIGN, HEX, MAX_OWNERS, MAX_REPOSITORIES, OPAQUE, WIDE, WIDE_LEAST

NAME = "op4_secret_scan"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(kind: str, order: int, pattern: str, least: int, texts: str = "t") -> str:
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, source, lang, '{kind}' AS kind, {order} AS ord,
           list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
           s + length(m[i]) AS e, v[i] AS value
    FROM (SELECT *, unnest(generate_series(1, len(m))) AS i
          FROM (SELECT doc_id, source, lang, string_split_regex(text, {p}) AS p, regexp_extract_all(text, {p}) AS m,
                       regexp_extract_all(text, {p}, 1) AS v FROM {texts}))
    WHERE length(v[i]) >= {least}"""


# Values are compared without full stops at their ends; wide tokens are looked for in texts that have one of a base value.
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
base AS ({_kind("assign", 0, ASSIGN, 8)} UNION ALL {_kind("access", 1, ACCESS, 16)} UNION ALL {_kind("hex", 2, HEX, 32)}),
bare AS ({_kind("owned", 3, OPAQUE, 16)}),
opaques AS (SELECT * FROM bare WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
opaque AS (SELECT * FROM opaques b WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.s < b.e AND b.s < x.e)),
asked AS (SELECT t.* FROM t, (SELECT list(DISTINCT rtrim(value, '.')) AS held FROM base) k
          WHERE list_has_any(list_transform(regexp_extract_all(text, {_quoted(WIDE)}), lambda x: rtrim(x, '.')), held)),
wides AS ({_kind("owned", 4, WIDE, WIDE_LEAST, "asked")}),
wide AS (SELECT * FROM wides b WHERE length(rtrim(value, '.')) >= {WIDE_LEAST} AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.s < b.e AND b.s < x.e)
         AND NOT EXISTS (SELECT 1 FROM opaques x WHERE x.doc_id = b.doc_id AND x.s = b.s AND x.e = b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM opaque UNION ALL SELECT * FROM wide),
live AS (
    SELECT rtrim(value, '.') AS held FROM every GROUP BY held
    HAVING bool_or(kind <> 'owned') AND (count(DISTINCT coalesce(source, '?')) = 1 OR count(DISTINCT coalesce(source, '?')) <= {MAX_OWNERS}
        AND count(DISTINCT coalesce(source, '?') || '/' || coalesce(lang, '?')) <= {MAX_REPOSITORIES})),
kept AS (SELECT * FROM base UNION ALL SELECT * FROM (SELECT * FROM opaque UNION ALL SELECT * FROM wide) WHERE rtrim(value, '.') IN (SELECT held FROM live)),
listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (rtrim(value, '.') IN (SELECT held FROM live)) AS n_live,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind <> 'owned') AS base,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, ord) AS spans
    FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN listed USING (doc_id)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_scan.scan(docs, repository=F.concat_ws("/", "source", "lang"))

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(secret_scan.BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
    )
