"""op11: the prefix trie of ``conversations`` with shared openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import table
from rankforge.llm.registry import register
from rankforge.llm.trie import numbered_turns, prefix_trie, with_shared_openings
from rankforge.session import materialise

SPAN, OPENINGS = 100, 6

# CRC-32 of the decimal id: every byte is followed by eight steps of one bit.
_STEPS = "flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_STEPS}), lambda s, x:
  CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END), 4294967295::BIGINT)"""

SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {SPAN} AS opener, {_CRC} % {OPENINGS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.opener AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (SELECT conv_id, text, row_number() OVER w AS depth, sha256(string_agg(
    length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '|') OVER w) AS prefix
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (
  SELECT conv_id, depth, prefix, length(text) AS size FROM placed
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs),
ends AS (SELECT conv_id, max(depth) AS last FROM members GROUP BY conv_id),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS node_id, count(*) AS n_convs, max(size) AS size, max(last) = depth AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last = depth), '')) AS ends_sha256
  FROM members JOIN ends USING (conv_id) GROUP BY depth, prefix),
linked AS (
  SELECT n.*, p.prefix AS parent_prefix, q.node_id AS parent_conv_id
  FROM nodes n LEFT JOIN members p ON p.conv_id = n.node_id AND p.depth = n.depth - 1
       LEFT JOIN nodes q ON q.depth = p.depth AND q.prefix = p.prefix),
children AS (SELECT depth - 1 AS depth, parent_prefix AS prefix, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT m.depth, m.prefix, count(*) FILTER (WHERE n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM nodes n JOIN members m ON m.conv_id = n.node_id AND m.depth <= n.depth GROUP BY 1, 2)
SELECT node_id AS conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked LEFT JOIN children USING (depth, prefix) JOIN below USING (depth, prefix)
"""


@register("op11_prefix_trie", SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(numbered_turns(table(spark, sf_dir, "conversations")))
    opener = F.col("conv") - F.col("conv") % SPAN
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS).cast("int")
    rebuilt = with_shared_openings(turns, opener, taken, OPENINGS - 1)
    return prefix_trie(rebuilt, turns.where(F.col("pos") == 1).select("conv"))
