from __future__ import annotations

import random
from collections import Counter

import numpy as np

from thinjoin.llm.common import unpacked
from thinjoin.llm import near_dedup
from thinjoin.llm.near_dedup import SLOTS, jaccard, near_classes, overlaps, shingle_hashes, signatures, sketch_texts


def shingles(text):
    w = (text or "").split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 0.0


def brute_classes(rows):
    """Classes of (doc_id, text) rows by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and similarity(rows[i][1], rows[j][1]) >= 0.8:
                parent[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted(((r[0], names.get(find(i))) for i, r in enumerate(rows)), key=str)


def classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["row"]["doc_id"], r["class_id"]) for r in near_classes(docs).collect()), key=str)


def variants(seed, n_words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    texts = []
    for e in edits:
        words = list(base)
        for _ in range(e):
            words[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_against_all_pairs(spark):
    texts = []
    for seed in range(12):
        texts += variants(seed, 60 + 30 * seed, [0, 0, 1, 1, 2, 3, 5, 9, 20])
    texts += ["a b", "a b", "a  b ", "b a", "", None, " \n", "", "a a a a a a a a", "a a a a a a a a a", "one"]
    texts.append("long " * 60000)
    texts.append("long " * 50000)
    rows = list(enumerate(texts, 100))
    rows += [(100, texts[0]), (100, texts[9]), (None, texts[0])]
    random.Random(1).shuffle(rows)
    assert classes(spark, rows) == brute_classes(rows)


def test_empty_table_and_extra_columns(spark):
    assert classes(spark, []) == []
    schema = "node int, doc_id bigint, rid string, text string, class_id string, band int"
    docs = spark.createDataFrame([(1, 7, "r", "a b c", "z", 4), (2, 5, "q", "a b c", "y", None)], schema)
    found = near_classes(docs)
    assert {r["class_id"] for r in found.collect()} == {5}
    assert unpacked(found, docs.columns).columns == docs.columns


def signature(texts):
    words = [t.split() for t in texts]
    return signatures(len(texts), *shingle_hashes(words))


def test_signatures_are_unbiased():
    a = " ".join(["p q r s t"] * 30 + [f"u{i}" for i in range(40)]).encode()
    b = " ".join(["p q r s t"] * 18 + [f"u{i}" for i in range(40)] + [f"v{i}" for i in range(15)]).encode()
    true = jaccard(a, b)
    assert abs(true - similarity(a.decode(), b.decode())) < 1e-12
    agreement = []
    for k in range(150):
        rows = signature([t.replace(b"p", b"p%d" % k).replace(b"u", b"u%d" % k).replace(b"q", b"q%d" % k) for t in (a, b)])
        agreement.append(np.mean(rows[0] == rows[1]))
    assert abs(np.mean(agreement) - true) < 5 * np.sqrt(true * (1 - true) / SLOTS / 150)


def test_sketch_does_not_depend_on_its_neighbours():
    texts = [t.encode() for t in variants(3, 200, [0, 1, 5])] + [b"x y", None, b""]
    together = sketch_texts(texts)
    for i, t in enumerate(texts):
        assert [c.to_pylist()[0] for c in sketch_texts([t])] == [c.to_pylist()[i] for c in together]


def test_overlaps_are_exact():
    texts = variants(5, 80, [0, 2, 4, 30]) + ["a a a a a a a a", "a a a a a a a a a a", "b", ""]
    shared, size = overlaps([t.encode() for t in texts])
    for i, x in enumerate(texts):
        assert size[i] == sum(shingles(x).values())
        for j, y in enumerate(texts):
            if i != j:
                assert shared[i, j] == sum((shingles(x) & shingles(y)).values())


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Many texts around one original: most pairs are below the similarity, some chains are above."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(120)] = f"x{i}.{rng.random()}"
        rows.append((i, " ".join(words)))
    assert classes(spark, rows) == brute_classes(rows)
