"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import stages
from rankforge.llm.classifier import classify_quality
from tests.llm.test_operators import SF, brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(t.columns == COLUMNS for t in tables[:-1])
    ids = [sorted(r["doc_id"] for r in t.collect()) for t in tables]
    judged = classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == sorted(r["doc_id"] for r in judged.where("predicted = 1").collect())
    rows = [(r["doc_id"], r["text"]) for r in tables[1].collect()]
    assert ids[2] == sorted({c for _, c in brute_groups(rows, 5, 80, 100)})
    words = {r["item_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}

    def leaks(text):
        own = text.lower().split()
        return any(
            sum(x == y for x, y in zip(own[i : i + 13], w[j : j + 13])) >= 11
            for w in words.values()
            for j in range(max(1, len(w) - 12))
            for i in range(len(own) - 12)
            if own[i] == w[j] or own[i + 1] == w[j + 1] or own[i + 2] == w[j + 2]
        )

    kept = {r["doc_id"]: r["text"] for r in tables[2].collect()}
    short = [k for k in kept if len(kept[k]) < 3000]
    assert {k for k in short if leaks(kept[k])} == {k for k in short if k not in set(ids[3])}
    assert set(ids[4]) <= set(ids[3]) and all(ids[4].count(k) <= 2 for k in set(ids[4]))
    assert ids[5] == ids[4]


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0


def test_quality_of_rows_without_own_id(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = {r["doc_id"]: r["predicted"] for r in classify_quality(docs, labels).collect()}
    labelled = {r["doc_id"] for r in labels.collect()}
    bad = min(k for k, p in judged.items() if p == 0)
    good = min(k for k, p in judged.items() if p == 1 and k not in labelled)
    copies = [docs.where(f"doc_id = {bad}").withColumn("doc_id", F.lit(k).cast("long")) for k in (None, good)]
    nameless = docs.where(f"doc_id = {good}").withColumn("doc_id", F.lit(None).cast("long"))
    kept = stages.keep_quality(spark, docs.union(copies[0]).union(copies[1]).union(nameless), SF).collect()
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) == sorted(k for k, p in judged.items() if p)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [r["text"] for r in kept if r["doc_id"] in (None, good)] == [texts[good]] * 2


def test_copies_and_leaks_of_rows_without_own_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    schema = "doc_id long, text string"
    rows = [(None, a), (None, a), (5, b), (5, b), (5, c), (3, c), (None, c), (None, None), (None, None)]
    kept = stages.keep_one_of_each(spark, spark.createDataFrame(rows, schema), SF)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, a), (5, b), (3, c), (None, None), (None, None)], key=repr)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, item), (None, a), (4, f"{b} {item}"), (4, b)]
    kept = stages.keep_uncontaminated(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, a), (4, b)], key=repr)


def test_clashing_columns(spark):
    """Names in other letters, the same name twice, names used inside, and a row number of the table's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns(
        {"_row_number": F.lit(5), "_0": F.lit("a"), "_c": F.lit(1), "_same": F.lit(2), "_key": F.lit("k"), "size": F.lit(3)}
    )
    docs = docs.union(docs.select([F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(1))
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("TEXT", "Doc_Id", "SOURCE", "lang")])
    at = docs.columns.index("text")
    for stage in (stages.keep_quality, stages.keep_one_of_each, stages.keep_uncontaminated, stages.mix):
        plain, clashing = stage(spark, docs, SF), stage(spark, more, SF)
        assert plain.columns == docs.columns and clashing.columns == more.columns
        rows = sorted((r[0] is None, r[0] or 0, r[at] or "") for r in clashing.collect())
        assert rows == sorted((r[0] is None, r[0] or 0, r[at] or "") for r in plain.collect())
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert stages.tokenise(spark, more, SF).count() == 61


def test_equal_rows_share_their_copies(spark):
    rows = [(None, "some words " * 9, "a")] * 6 + [(1, "other words " * 50, "a"), (2, "one", None), (2, "one", None), (3, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in stages.mix(spark, docs, SF).collect()]
    assert all(kept.count(r) <= 2 * rows.count(r) for r in kept) and set(kept) <= set(rows)
    again = [tuple(r) for r in stages.mix(spark, docs.orderBy(F.desc("doc_id")), SF).collect()]
    assert sorted(kept, key=repr) == sorted(again, key=repr)
