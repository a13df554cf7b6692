"""op8: every page written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import warc

NAME = "op8_warc"

#: SQL has no base32, so the digest is spelled from the bits of the hash.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
    SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + b, 1), '' ORDER BY i) AS digest
    FROM (SELECT h, i, (('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS b
          FROM (SELECT DISTINCT h FROM p), range(32) r(i))
    GROUP BY h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN NULL ELSE max(page_id) OVER (PARTITION BY h) END AS refers_to
FROM p JOIN coded USING (h)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
