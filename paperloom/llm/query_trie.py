"""op12: the prefix trie of all rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import prefix_trie

NAME = "op12_prefix_trie"

# CRC-32 of the decimal id bit by bit, then every prefix of every rebuilt conversation as a list of turns.
ORACLE_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, name, 0 AS i, 4294967295::BIGINT AS acc FROM ids UNION ALL
        SELECT conv_id, name, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
        FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(acc, ascii(name[i // 8 + 1])::BIGINT) ELSE acc END AS x FROM crc WHERE i < 8 * length(name))),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(acc, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(name)),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM conversations),
rebuilt AS (SELECT h.conv_id, 0 AS own, t.r, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.r <= h.h UNION ALL
            SELECT h.conv_id, 1, t.r, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.r > h.h),
prefixes AS (SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, strlen(text) AS bytes FROM rebuilt
             WINDOW w AS (PARTITION BY conv_id ORDER BY own, r ROWS UNBOUNDED PRECEDING)),
walks AS (SELECT conv_id, 0 AS depth, md5('') AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS bytes FROM ids UNION ALL
          SELECT conv_id, depth, md5(path::VARCHAR || depth), CASE WHEN depth = 1 THEN md5('') ELSE md5(path[1:depth - 1]::VARCHAR || (depth - 1)) END, bytes FROM prefixes),
ended AS (SELECT conv_id, max(depth) AS depth FROM walks GROUP BY conv_id),
nodes AS (SELECT w.node, any_value(w.parent) AS parent, any_value(w.depth) AS depth, any_value(w.bytes) AS bytes, min(w.conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(w.conv_id, ',' ORDER BY w.conv_id) FILTER (WHERE e.depth = w.depth), '') AS ends
          FROM walks w JOIN ended e USING (conv_id) GROUP BY w.node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.node, b.node AS lower FROM walks a JOIN walks b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT b.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
         FROM below b JOIN nodes n ON n.node = b.lower LEFT JOIN kids k ON k.node = b.lower GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
