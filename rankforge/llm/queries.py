"""All queries of this package; importing it registers them."""

from __future__ import annotations

from rankforge.llm import (  # noqa: F401  (modules register their queries)
    q_bpe,
    q_classifier,
    q_decontaminate,
    q_html,
    q_jaccard,
    q_mixing,
    q_negatives,
    q_preferences,
    q_repetition,
    q_secrets,
    q_tokens,
    q_trie,
    q_urls,
)
from rankforge.llm.registry import ORACLES, QUERIES  # noqa: F401
