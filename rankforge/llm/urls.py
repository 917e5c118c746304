"""URL filter: rules indexed by their rarest literal token.

A rule is a glob over ``host + path``: ``*`` stands for any text, ``||`` at the
start anchors at the host or at one of its parent domains, ``|`` at the start at
the begin of the host, ``^`` stands for a separator or an edge. A rule may look at
the host alone and regardless of case. From each rule the operator takes the literal tokens that
every matching URL must hold as a whole, and files the rule under the one that
is rarest in the corpus. URL tokens then fetch their rules with an equi-join and
only those rules run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import LOWER, UPPER, literal_table, pick

TOKEN = "[a-z0-9]+"
CATCH_ALL = ""


@dataclass(frozen=True)
class Rule:
    """``tier`` decides first, then the longer ``name``; ``action`` is allow or block.

    ``host_only`` rules begin inside the host; ``any_case`` rules match letters A-Z in either case.
    """

    name: str
    glob: str
    action: str
    tier: int = 0
    host_only: bool = False
    any_case: bool = False


def host_path_rule(name: str, action: str, tier: int = 1) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with ``/path``."""
    return Rule(name, f"||{name}*", action, tier)


def word_rule(word: str, action: str, host_only: bool = True) -> Rule:
    """A whole word between separators, of the host alone or of host and path."""
    return Rule(f"{'host' if host_only else 'url'}:{word}", f"^{word}^", action, 0, host_only, True)


def _parts(glob: str) -> tuple[str, str]:
    for anchor in ("||", "|"):
        if glob.startswith(anchor):
            return anchor, glob[len(anchor) :]
    return "", glob


def regex_of(rule: Rule) -> str:
    """The rule as a regular expression that Java and RE2 read alike."""
    anchor, body = _parts(rule.glob)
    start = {"||": "^(?:[^/]*\\.)?", "|": "^", "": ""}[anchor]
    if rule.host_only and not anchor:
        # A separator at the start is the begin of the host or a character inside it.
        start, body = ("^(?:[^/]*[^A-Za-z0-9/])?", body[1:]) if body.startswith("^") else ("^[^/]*", body)
    signs = {"*": ".*", "^": "(?:^|[^A-Za-z0-9]|$)"}
    body = "".join(signs.get(c) or (c if re.match("[A-Za-z0-9/_-]", c) else "\\" + c) for c in body)
    return f"({'?is' if rule.any_case else '?s'}){start}{body}"


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that are complete in every match: a literal separator or an anchor on both sides."""
    anchor, body = _parts(rule.glob)
    body = body.translate(str.maketrans(UPPER, LOWER))
    found = []
    for m in re.finditer(TOKEN, body):
        left = bool(anchor) if m.start() == 0 else body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right and m[0] not in found:
            found.append(m[0])
    return found


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit(f"({TOKEN})")))


def index_rules(urls: DataFrame, rules: Sequence[Rule], small: bool = True) -> DataFrame:
    """Rules with the token they are filed under: of their literal tokens the one on the fewest URLs.

    ``urls`` has a column ``_tokens``. Only tokens that occur in rules are
    counted, and counts are combined before the shuffle. Rules without a
    literal token are filed under the catch-all token. ``small`` says that the
    rules may be broadcast.
    """
    spark = urls.sparkSession
    places = [(i, t) for i, r in enumerate(rules) for t in literal_tokens(r)]
    owned = literal_table(spark, places, [("_rule", "int"), ("_token", "string")])
    wanted = owned.select("_token").distinct()
    counts = (
        urls.select(F.explode("_tokens").alias("_token"))
        .join(F.broadcast(wanted) if small else wanted, "_token", "left_semi")
        .groupBy("_token")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    chosen = (
        owned.join(counts, "_token", "left")
        .groupBy("_rule")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token")).alias("_best"))
        .select("_rule", F.col("_best._token").alias("_token"))
    )
    body = literal_table(
        spark,
        [(i, r.name, r.action, r.tier, len(r.name), regex_of(r)) for i, r in enumerate(rules)],
        [("_rule", "int"), ("_name", "string"), ("_action", "string"), ("_tier", "int"), ("_length", "int"), ("_regex", "string")],
    )
    return body.join(chosen, "_rule", "left").withColumn("_token", F.coalesce("_token", F.lit(CATCH_ALL)))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    rule_bytes: int = 16 << 20,
) -> DataFrame:
    """Judge every URL: one row per input row.

    Returns ``key, host, path, rule, verdict, method_rule``. ``rule`` names the
    deciding rule of tier 1 or above and ``method_rule`` that of tier 0; the
    verdict is the action of the highest tier's longest rule (equal lengths: the
    greater name, then block), or ``default``.

    Null or malformed URLs have empty host and path, match only rules without a
    literal token, and null URLs match none. Null keys and repeated rows are
    kept as they are. URLs of any length are judged whole. Other columns are not read.
    The rule list is the caller's and held by the driver: only up to ``rule_bytes``
    it is broadcast, beyond it joins by shuffle.
    """
    rows = pick(pages, key, url).toDF("_key", "_url")
    rows = rows.select("_key", "_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    # Equal URLs get equal verdicts, so each distinct URL is judged once.
    seen = rows.where(F.col("_url").isNotNull()).groupBy("_url").agg(
        F.first("_host").alias("_host"), F.first("_path").alias("_path")
    )
    target = F.concat("_host", "_path")
    listed = seen.select("_url", target.alias("_target"), _tokens(target).alias("_tokens"))
    small = sum(len(r.name) + 2 * len(r.glob) + 100 for r in rules) <= rule_bytes
    index = index_rules(listed, rules, small)
    if small:
        index = F.broadcast(index)
    general = any(not literal_tokens(r) for r in rules)
    words = F.array_append("_tokens", F.lit(CATCH_ALL)) if general else F.col("_tokens")
    hits = (
        listed.select("_url", "_target", F.explode(words).alias("_token"))
        .join(index, "_token")
        .where(F.expr("_target rlike _regex"))
    )
    order = F.struct("_tier", "_length", "_name", "_action")
    verdicts = hits.groupBy("_url").agg(
        F.max(F.when(F.col("_tier") > 0, order)).alias("_top"), F.max(F.when(F.col("_tier") == 0, order)).alias("_low")
    )
    return rows.join(verdicts, "_url", "left").select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_top._name").alias("rule"),
        F.coalesce("_top._action", "_low._action", F.lit(default)).alias("verdict"),
        F.col("_low._name").alias("method_rule"),
    )
