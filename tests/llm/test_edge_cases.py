"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import pytest

from rankforge.llm.classifier import classify_quality
from rankforge.llm.decontaminate import find_leaks
from rankforge.llm.html import extract_main_text
from rankforge.llm.jaccard import jaccard_groups
from rankforge.llm.mixing import mix_sources
from rankforge.llm.preferences import format_preferences
from rankforge.llm.q_tokens import END_ID, tokenizer_path
from rankforge.llm.repetition import repetition_rules
from rankforge.llm.secrets import scan_secrets
from rankforge.llm.tokens import token_output
from rankforge.llm.urls import Rule, filter_urls, host_path_rule
from tests.llm.cases import TEXTS, by_row, clashing, documents, nothing

KEYS = sorted((t[0] for t in TEXTS), key=repr)


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (None, 1), (9, None), (6, 0)], "doc_id long, quality int")


def items(spark):
    return spark.createDataFrame(
        [(1, "eta theta iota kappa lambda mu nu xi omicron pi"), (2, None), (3, ""), (None, "too short")], "item_id long, text string"
    )


OPERATORS = {
    "repetition": lambda s, d: repetition_rules(d),
    "jaccard": lambda s, d: jaccard_groups(d),
    "classifier": lambda s, d: classify_quality(d, labels(s)),
    "tokens": lambda s, d: token_output(d, tokenizer_path(), END_ID)[0],
    "mixing": lambda s, d: mix_sources(d),
    "secrets": lambda s, d: scan_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    found = OPERATORS[name](spark, documents(spark)).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == KEYS


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, nothing(spark)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_names_that_differ_in_case_only(spark, name):
    plain, more = (OPERATORS[name](spark, d) for d in (documents(spark), clashing(documents(spark))))
    assert by_row(plain) == by_row(more)


def test_values_of_awkward_rows(spark):
    d = documents(spark)
    rules = {r["doc_id"]: r for r in repetition_rules(d).collect()}
    assert [(rules[i]["n_words"], rules[i]["base_failed"], rules[i]["kept"]) for i in (3, 4, 5, 6)] == [
        (0, True, False), (0, True, False), (0, True, False), (1, True, False),
    ]
    assert rules[7]["n_words"] == 60_000
    groups = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(d).where("doc_id is not null").collect()}
    assert groups[2][1] == 1 and groups[3] == (0, 3) and groups[6] == (1, 6) and groups[7][1] == 7
    mixed = {r["doc_id"]: r for r in mix_sources(d).collect()}
    assert mixed[3]["taken"] == mixed[4]["taken"] == 0
    assert all(0 <= r["copies"] <= 2 for r in mixed.values())
    scores = classify_quality(d, labels(spark)).collect()
    assert all(0 <= r["score"] <= 1 for r in scores)
    assert {r["predicted"] for r in classify_quality(d, labels(spark).limit(0)).collect()} == {0}
    spans = {r["doc_id"]: r["spans"] for r in scan_secrets(d).collect()}
    assert spans[3] == spans[4] == []


def test_leaks_of_awkward_rows(spark):
    found = by_row(find_leaks(documents(spark), items(spark)).select("doc_id", "item_id", "n_matched", "n_window"))
    assert found == [(1, 1, 10, 10), (2, 1, 10, 10)]
    assert find_leaks(nothing(spark), items(spark)).collect() == []
    more = find_leaks(clashing(documents(spark)), clashing(items(spark))).select("doc_id", "item_id", "n_matched", "n_window")
    assert by_row(more) == found
    assert find_leaks(documents(spark), items(spark).limit(0)).collect() == []


def test_urls_of_awkward_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/x?q#f"), (5, "http://example.com"), (6, "x://net/es/"),
        (None, "http://a.net/fr/"), (6, "x://net/es/"), (7, "http://" + "a" * 50_000 + ".com/"), (8, "://?://"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [host_path_rule("com/", "allow"), host_path_rule("example.com/en/", "block"), host_path_rule("net/es/", "block")]
    found = {(r["page_id"], r["verdict"], r["rule"]) for r in filter_urls(pages, rules + [Rule("every", "*.net*", "block")]).collect()}
    assert found == {
        (1, "allow", None), (2, "allow", None), (3, "allow", None), (4, "block", "example.com/en/"), (5, "allow", None),
        (6, "block", "net/es/"), (None, "block", None), (7, "allow", "com/"), (8, "allow", None),
    }
    assert filter_urls(pages, rules).count() == len(rows)
    assert filter_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in filter_urls(pages, []).collect()} == {"allow"}


def test_pages_of_awkward_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>Some text, here.</p>"), (3, "u", "<p>open <b>tag, and more" + " word" * 50_000), (3, "u", "< 3")]
    found = {(r["page_id"], r["text"][:20], r["n_chars"]) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {(1, "", 0), (2, "", 0), (None, "Some text, here.", 16), (3, "open tag, and more w", 250_018), (3, "< 3", 3)}


def test_conversations_of_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    chosen = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, None, None), (None, 0, "user", "x"), (3, 1, "assistant", "é"), (3, None, "user", "first"), (4, 0, "user", "q"), (4, 0, "user", "q")],
        schema,
    )
    rejected = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, None, None), (3, 0, "user", "first"), (5, 0, "user", "only")], schema
    )
    found = {r["conv_id"]: r for r in format_preferences(chosen, rejected).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    assert found[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n" and found[1]["n_common"] == 1
    for side in ("chosen", "rejected"):
        (span,) = found[1][f"{side}_mask"]
        assert found[1][side][span["first"] : span["last"]] == ("a" if side == "chosen" else "b") + "<|im_end|>"
    assert not found[2]["differs"] and found[2]["chosen"] == "" and found[2]["n_common"] == 1
    assert found[3]["n_common"] == 1 and found[3]["rejected"] == ""
    assert found[4]["n_common"] == 0 and found[4]["chosen"].count("q<") == 2
    assert found[5]["prompt"] == found[5]["chosen"] == ""
    assert format_preferences(chosen.limit(0), rejected.limit(0)).collect() == []


def test_junk_words_of_sites_outside_of_the_tables(spark):
    from rankforge.llm.q_urls import RULES

    junk = ["http://my-casino.org/a", "https://casino-win2.io", "http://www.Adult-fun.example.net/x", "http://free.bets.test/p/1", "http://news.test/2024/best-CASINO-offers"]
    clean = ["http://school.test/adult-education/", "http://casinotown.test/", "http://alphabets.test/ads.txt", "http://spammer.test/pills", "http://x.test/?q=casino", None, "poker"]
    pages = spark.createDataFrame(list(enumerate(junk + clean)), "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in filter_urls(pages, RULES).collect()}
    assert [verdicts[i] for i in range(len(junk + clean))] == ["block"] * len(junk) + ["allow"] * len(clean)


def test_long_rule_lists_plan_quickly_and_join_by_shuffle(spark):
    rules = [Rule(f"r{i}", f"||bad{i}.test^", "block") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.bad{i}.test/{i}") for i in range(2990, 3010)], "page_id long, url string")
    for rule_bytes in (16 << 20, 0):
        found = {r["page_id"]: r["method_rule"] for r in filter_urls(pages, rules, rule_bytes=rule_bytes).collect()}
        assert found == {i: f"r{i}" if i < 3000 else None for i in range(2990, 3010)}
