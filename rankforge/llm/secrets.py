"""Secret scan: all rules in one byte pass of a combined automaton.

The combined automaton reads each text once, from its end, and tells at every
byte which rules match from there. Only where a rule is known to match does its
own anchored automaton run forward, to the end of the longest match, and a rule
goes on behind its match. So the work is linear also in texts full of almost-matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from rankforge.llm.automaton import DEAD, Automaton, compile_rules
from rankforge.llm.common import map_texts, pick


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost longest matches; ``head`` matches from the same positions.

    The head is the pattern without what a match may have but need not, hence
    smaller; it may leave out starts of matches that ``check`` drops, if those
    hide no other. ``check`` drops matches after they were found, so a dropped
    match still hides what it covers.
    """

    kind: str
    pattern: str
    head: str
    check: Callable[[bytes], bool] | None = None


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _value_length(found: bytes) -> int:
    """Length of what follows the first sign of an assignment."""
    at = min(i for i in (found.find(b":"), found.find(b"=")) if i >= 0)
    value = found[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value)


KEYWORD = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY])"
SIGN = "[\"']? *[:=] *[\"']?"
# Fixed values of the contract: the three base kinds, in this order.
BASE_RULES = [
    Rule("assign", KEYWORD + SIGN + "[A-Za-z0-9+/_.=-]+", KEYWORD + SIGN + "[A-Za-z0-9+/_.=-]", lambda m: _value_length(m) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", lambda m: len(m) >= 20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", lambda m: len(m) >= 24),
]
# Shapes of further credentials, from their public documentation.
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", lambda m: len(m) >= 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]", lambda m: len(m) >= 15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]"),
    Rule("maps", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]", lambda m: len(m) >= 39),
]


def linked_rows(automaton: Automaton) -> list:
    """The transition array as lists that hold their successors, and at 256 the accepted rules' bits: the start row."""
    rows: list[list] = [[] for _ in automaton.accepts]
    for row, targets, bits in zip(rows, automaton.table.tolist(), automaton.accepts.tolist()):
        row.extend(rows[t] for t in targets)
        row.append(bits)
    return rows[automaton.start]


def as_lists(automaton: Automaton) -> tuple[Automaton, list[list[int]], list[int]]:
    """What ``longest`` needs of a rule's own automaton."""
    return automaton, automaton.table.tolist(), automaton.accepts.tolist()


def match_starts(data: bytes, first: list) -> list[tuple[int, int]]:
    """Positions from which rules match, with the rules' bits, ascending: the one pass over all bytes."""
    found, row, at = [], first, len(data)
    for byte in reversed(data):
        row = row[byte]
        at -= 1
        if row[256]:
            found.append((at, row[256]))
    found.reverse()
    return found


def longest(data: bytes, at: int, automaton: Automaton, table: list[list[int]], accepts: list[int]) -> int:
    """Where the longest match from ``at`` ends."""
    state, end = automaton.start, at
    for i in range(at, len(data)):
        state = table[state][data[i]]
        if state == DEAD:
            break
        if accepts[state]:
            end = i + 1
    return end


def find_spans(data: bytes, rules: Sequence[Rule], first: list, tables: Sequence[tuple]) -> list[tuple[int, int, int]]:
    """Leftmost longest matches, non-overlapping within a rule, that pass their checks: (start, rule, end) by start and rule."""
    found, free = [], [0] * len(rules)
    for at, bits in match_starts(data, first):
        for i, rule in enumerate(rules):
            if bits >> i & 1 and at >= free[i]:
                end = free[i] = longest(data, at, *tables[i])
                if rule.check is None or rule.check(data[at:end]):
                    found.append((at, i, end))
    return found


def scan_secrets(
    docs: DataFrame, rules: Sequence[Rule] = tuple(BASE_RULES + MORE_RULES), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All spans of all rules: one row per input row, ``key`` and ``spans``.

    ``spans`` is an array of (kind, first, last) in code points, last exclusive,
    by start and then in the order of ``rules``. Null and empty texts have none.
    Texts are read whole; null keys and repeated rows stay; other columns are not read.
    """
    rules = list(rules)
    starts, single = compile_rules([r.head for r in rules], starts=True), [compile_rules([r.pattern]) for r in rules]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, tables = linked_rows(starts), [as_lists(a) for a in single]
        for frame in frames:
            out = []
            for text_ in frame["_text"].tolist():
                data = text_.encode("utf-8", "surrogatepass") if text_ else b""
                found = find_spans(data, rules, first, tables)
                points = []
                done, cp = 0, 0
                for a, i, b in found:  # starts ascend, so text is decoded once
                    cp += len(data[done:a].decode("utf-8", "surrogatepass"))
                    done = a
                    points.append((rules[i].kind, cp, cp + len(data[a:b].decode("utf-8", "surrogatepass"))))
                out.append([{"kind": k, "first": a, "last": b} for k, a, b in points])
            yield pd.DataFrame({"_key": frame["_key"].array, "spans": out})

    rows = pick(docs, key, text).toDF("_key", "_text")
    return map_texts(rows, key, run, "spans array<struct<kind:string,first:long,last:long>>")
