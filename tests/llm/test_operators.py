"""Operators against brute force on small fixtures and on the driver's smallest tables."""

from __future__ import annotations

import collections
import html as references
import itertools
import math
import random
import re
import zlib

import pytest

from rankforge.llm import queries
from rankforge.llm.components import components
from rankforge.llm.decontaminate import find_leaks
from rankforge.llm.jaccard import jaccard_groups
from rankforge.llm.q_tokens import END_ID, tokenizer_path
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, MID), connect(MID), queries.ORACLES[name])
    assert ok, message


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_groups(rows, width, num, den):
    holders = collections.defaultdict(list)
    for key, text in rows:
        holders[shingles(text, width)].append(key)
    sets = [s for s in holders if s]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, s in enumerate(sets):
        groups[find(k)] += holders[s]
    found = [(k, min((x for x in keys if x is not None), default=None)) for keys in groups.values() for k in keys]
    return found + [(k, k) for k in holders.get(frozenset(), [])]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary, rows = [f"W{i}" for i in range(300)], []
    for size in (60, 150, 30):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(50):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text[: size - rng.randrange(4)])))
    for _ in range(80):
        rows.append((len(rows), " ".join(rng.choice(vocabulary[:12]) for _ in range(rng.randrange(1, 14)))))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (None, "only here once ever"), (3, rows[70][1]), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,num,den,limit", [(3, 90, 100, 2), (3, 90, 100, 16), (5, 80, 100, 3)])
def test_jaccard_groups_are_exact(spark, width, num, den, limit):
    rows = near_copies(limit)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_groups(docs, width, (num, den), limit).collect()]
    assert sorted(got, key=repr) == sorted(brute_groups(rows, width, num, den), key=repr)


def test_jaccard_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.QUERIES["op3_jaccard_join"](spark, SF).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted(brute_groups(rows, 3, 90, 100))
    sizes = {k: len(shingles(t, 3)) for k, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in found)


def test_components_of_a_long_path_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def test_leaks_in_capitals_of_any_script(spark):
    words = [
        "l’été où l’élève répéta ça près de la forêt brûlée à évreux déjà", "übung größe straße öl ähnlich über für späte gäste müde flöße böse fuß",
        "мама мыла раму и пела песню о далёкой реке за лесом вечером", "ο λόγος της πόλης είναι ένας μύθος που δεν τελειώνει ποτέ σήμερα εδώ",
    ]
    items = spark.createDataFrame(list(enumerate(words)), "item_id long, text string")
    docs = [(i + 10 * up, f"a b {w.upper() if up else w} c") for i, w in enumerate(words) for up in (0, 1)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i + 10 * up, i) for up in (0, 1) for i in range(4)]
    assert all(r["n_matched"] == r["n_window"] for r in found)


@pytest.mark.parametrize("share", [0.8, 0.6])
def test_leaks_of_short_items(spark, share):
    rng = random.Random(4)
    items, docs = {}, {}
    for n in range(1, 16):
        items[n] = [f"i{n}w{j}" for j in range(n)]
        width = min(n, 13)
        for misses in range(4):
            for lost in itertools.islice(itertools.combinations(range(width), misses), 80):
                copy = [rng.choice("abc") if j in lost else w for j, w in enumerate(items[n])]
                docs[len(docs)] = rng.choices("abc", k=rng.randrange(3)) + copy + rng.choices("abc", k=rng.randrange(3))
    docs[len(docs)] = []

    def matched(own, item):
        width = min(13, len(item))
        return max(
            (sum(0 <= i + j < len(own) and own[i + j] == item[s + j] for j in range(width))
             for s in range(len(item) - width + 1) for i in range(-width, len(own))), default=0
        )

    best = {(k, n): (matched(d, w), min(13, n)) for k, d in docs.items() for n, w in items.items()}
    expected = {(*pair, m, w) for pair, (m, w) in best.items() if m >= math.ceil(w * share - 1e-9)}
    made = [spark.createDataFrame([(k, " ".join(w)) for k, w in t.items()], f"{key} long, text string") for t, key in ((docs, "doc_id"), (items, "item_id"))]
    assert {tuple(r) for r in find_leaks(*made, share=share).collect()} == expected


def test_classifier_on_held_out_rows(spark):
    scored = queries.QUERIES["op4_quality_classifier"](spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    held = [r for r in scored if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in scored)


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, expected = 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        expected.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    got = queries.QUERIES["op5_token_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == expected


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in docs:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weights[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * sizes[s] if s in capped else weights[s] * level for s in names}
    source = {r["doc_id"]: r["source"] for r in docs}
    runs = [sorted(tuple(r) for r in queries.QUERIES["op6_source_mix"](spark, MID).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    taken = collections.Counter()
    for key, size, source_size, goal, took, copies in runs[0]:
        s = source[key]
        assert source_size == sizes[s] and abs(goal - target[s]) < 1e-6 * target[s]
        assert took == copies * size <= 2 * size
        taken[s] += took
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in names)


def test_main_text_is_the_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MID}/pages.parquet").collect()}
    for r in queries.QUERIES["op7_main_text"](spark, MID).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        plain = references.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", article)))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])


def test_secret_query_counts(spark):
    for r in queries.QUERIES["op10_secret_scan"](spark, MID).where("spans != ''").collect():
        kinds = collections.Counter(x.split(":")[0] for x in r["spans"].split(","))
        assert (kinds["assign"], kinds["access"], kinds["hex"]) == (r["n_assign"], r["n_access"], r["n_hex"])
