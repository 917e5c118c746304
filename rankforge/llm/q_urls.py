"""op1: URL filter over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import LOWER, UPPER, table
from rankforge.llm.registry import register
from rankforge.llm.urls import Rule, filter_urls, host_path_rule, regex_of, word_rule

# Fixed values of the contract.
BASE = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
# Words that name a trade of junk wherever they stand as a whole word, and words that do
# so only in the name of a site; a path such as /adult-education/ is no junk.
ANYWHERE = ["casino", "casinos", "viagra", "cialis", "porn"]
IN_HOST = [
    "casino", "casinos", "poker", "roulette", "jackpot", "bets", "betting", "pills", "viagra", "cialis", "payday", "replica", "replicas",
    "adult", "porn", "xxx", "escorts", "spam", "ads", "adserver", "linkfarm",
]
RULES = (
    [host_path_rule(name, action) for name, action in BASE]
    + [word_rule(w, "block", host_only=False) for w in ANYWHERE]
    + [word_rule(w, "block") for w in IN_HOST]
)


def _cases(rules: list[Rule], column: str) -> str:
    """The longest matching rule's column as SQL: rules in falling order, first match wins."""
    ordered = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name), reverse=True)
    return "CASE " + " ".join(
        f"WHEN regexp_matches(host || path, '{regex_of(r)}') THEN '{getattr(r, column)}'" for r in ordered
    ) + " END"


_base = [r for r in RULES if r.tier > 0]
_junk = [r for r in RULES if r.tier == 0]
SQL = f"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {_cases(_base, 'name')} AS rule,
       coalesce({_cases(_base, 'action')}, {_cases(_junk, 'action')}, 'allow') AS verdict,
       {_cases(_junk, 'name')} AS method_rule
FROM parts
"""


@register("op1_url_filter", SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
