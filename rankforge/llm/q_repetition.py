"""op2: quality rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import WORD, table
from rankforge.llm.registry import register
from rankforge.llm.repetition import repetition_rules

MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.45, 100


def _grams(k: int) -> str:
    """Positions that start a window of k words found twice or more in the text."""
    return f"""
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (
      SELECT doc_id, i, n, string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS gram
      FROM tokens) WHERE i + {k - 1} <= n) WHERE c >= 2"""


def _covered(k: int) -> str:
    return f"""
  SELECT doc_id, count(DISTINCT i + j) AS c
  FROM g{k} CROSS JOIN (SELECT unnest(range(0, {k})) AS j) GROUP BY doc_id"""


# A maximal repeat of k words or more covers what the repeated windows of k words
# cover, and a repeat above m words exists where a window of m + 1 words repeats.
SQL = f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
tokens AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g3 AS ({_grams(3)}), c3 AS ({_covered(3)}),
g8 AS ({_grams(MIN_REPEAT)}), c8 AS ({_covered(MIN_REPEAT)}),
long AS (SELECT DISTINCT doc_id FROM ({_grams(MAX_REPEAT + 1)})),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS d FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(c3.c, 0)::BIGINT AS n_repeat_words,
         coalesce(c8.c, 0) AS n8, long.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN c3 USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN dups USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n8 <= {MAX_COVERED} * n_words AND NOT too_long AS kept
FROM base
"""


@register("op2_quality_rules", SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition_rules(table(spark, sf_dir, "documents"), MIN_REPEAT, MAX_COVERED, MAX_REPEAT)
    return judged.drop("covered", "longest_repeat")
