from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute_classes
from test_texts import brute_hits, brute_lines

import corpus_pipeline
from thinjoin.llm.common import table


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(n))
    texts = [words(rng.randrange(20, 90)) for _ in range(25)]
    rows = [(i, t, "en", "s1", len(t), "x") for i, t in enumerate(texts)]
    rows += [(100 + i, t + " more", "en", "s2", None, None) for i, t in enumerate(texts[:6])]
    rows += [(200, None, None, None, None, None), (201, "", "en", "s1", 0, "r"), (202, "12 34", None, "s1", 5, "r")]
    rows += [rows[0], rows[0], (None, texts[1], "en", "s1", 3, "r"), (0, texts[2], "en", None, 1, "r")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")


def test_stages_keep_the_columns_and_take_odd_and_empty_tables(spark, odd, folder):
    for name, function in corpus_pipeline.STAGES:
        for docs in (odd, odd.where("false")):
            found = function(spark, docs, folder)
            if name == "mixing":
                assert found.columns == [*docs.columns, "mix_probability"]
            else:
                assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in docs.schema]
            assert found.count() <= docs.count()


def test_language_stage_drops_what_has_no_letters(spark, odd, folder):
    left = {r["doc_id"] for r in stage("language")(spark, odd, folder).collect()}
    assert {200, 201, 202}.isdisjoint(left)
    assert {*range(25), *range(100, 106)} <= left


def test_line_stage_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    want = {i: kept for i, _, _, kept in brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])}
    found = stage("lines")(spark, docs, folder).collect()
    assert {r["doc_id"]: r["text"] or "" for r in found} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_near_stage_keeps_one_of_each_class(spark, odd, folder):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    names = {name for i, name in brute_classes(rows) if i is not None}
    left = [r["doc_id"] for r in stage("near")(spark, odd, folder).collect() if r["doc_id"] is not None]
    assert sorted(left) == sorted([*names, 0])  # document 0 has two texts and stands for two classes


def test_benchmark_stage_against_all_windows(spark, folder):
    docs = table(spark, folder, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    rows = docs.where("length(text) < 3000").limit(60).collect()
    want = set()
    for r in rows:
        n_words, n_hit, _ = brute_hits(r["text"], items)
        if not (n_hit and 20 * n_hit >= n_words):
            want.add(r["doc_id"])
    found = stage("benchmark")(spark, spark.createDataFrame(rows, docs.schema), folder)
    assert {r["doc_id"] for r in found.collect()} == want


def test_benchmark_stage_cuts_long_spans(spark, folder):
    docs, prose = table(spark, folder, "documents"), " ".join(f"w{i}" for i in range(5000))
    item = table(spark, folder, "benchmark").where("length(text) > 80").first()["text"]
    one = docs.limit(1).withColumn("text", F.lit(f"{prose}\n{item}")).withColumn("n_chars", F.lit(1).cast(docs.schema["n_chars"].dataType))
    (found,) = stage("benchmark")(spark, one, folder).collect()
    assert item not in found["text"] and found["text"].startswith(prose)
    assert found["n_chars"] == len(found["text"])


def test_run_applies_all_stages(spark, folder):
    docs = table(spark, folder, "documents")
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*docs.columns, "mix_probability"]
    assert 0 < found.count() < docs.count()
