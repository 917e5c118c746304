"""op9: documents that hold passages of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import WORD, table
from rankforge.llm.decontaminate import find_leaks
from rankforge.llm.registry import register

WINDOW = 13


def _tokens(name: str, key: str) -> str:
    """Words in lower case with their place, and the number of words."""
    return f"""
  SELECT {key}, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
    SELECT {key}, regexp_extract_all(lower(text), '{WORD}') AS ws FROM {name})"""


# Every alignment of a document and an item with enough equal words is looked at; no seeds.
SQL = f"""
WITH d AS ({_tokens('documents', 'doc_id')}), b AS ({_tokens('benchmark', 'item_id')}),
hits AS (
  SELECT d.doc_id, b.item_id, d.i - b.i AS shift FROM d JOIN b ON d.word = b.word
  GROUP BY d.doc_id, b.item_id, d.i - b.i HAVING count(*) >= ceil(least(max(b.n), {WINDOW}) * 0.8 - 1e-9)),
flags AS (
  SELECT h.doc_id, h.item_id, h.shift, b.i, b.n, CASE WHEN d.word = b.word THEN 1 ELSE 0 END AS same
  FROM hits h JOIN b ON b.item_id = h.item_id LEFT JOIN d ON d.doc_id = h.doc_id AND d.i = b.i + h.shift),
sums AS (
  SELECT doc_id, item_id, n, i, least(n, {WINDOW}) AS w,
         sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c
  FROM flags)
SELECT doc_id, item_id, max(c)::BIGINT AS n_matched, max(w)::BIGINT AS n_window
FROM sums WHERE i + w - 1 <= n AND c >= ceil(w * 0.8 - 1e-9) GROUP BY doc_id, item_id
"""


@register("op9_decontamination", SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=WINDOW)
