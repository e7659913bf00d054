"""The divergence audit against SQL and against counting by hand; the quadtree against the whole matrix."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference

from thinjoin.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, value int, rank string"


def brute(rows, least):
    """The contract, term by term."""
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(words)
        documents[lang].update(set(words))
    found = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in documents[lang].items() if d >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n[s] + 2 * len(kept)) for t in kept} for s in sources}
        own = {t: 1 + 10**9 * (whole[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], own[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > own[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                items.sort(key=lambda i: (-i[0], i[1].encode()))
                found |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])}
    return found


def rows_for(seed, docs=120, sources=9):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "été", "Été", "x", "naïve", "日本", "a1b", "ß", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for i in range(docs):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(30)))
        rows.append((i, rng.choice([text, text, text, text, None]), rng.choice(["en", "de", None, ""]), rng.choice([None, "", *(f"s{k}" for k in range(sources))]), 1, "z"))
    return rows + [(1, "", "xx", "only", 1, "z"), (2, "few terms", "yy", "one", 1, "z"), (2, "few terms", "yy", "two", 1, "z")]


@pytest.mark.parametrize(("seed", "tile", "block", "held"), [(1, 128, 4096, 200_000), (2, 2, 5, 3), (3, 3, 1, 50), (4, 1, 1000, 10)])
def test_audit_against_counting_by_hand(spark, monkeypatch, seed, tile, block, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = rows_for(seed)
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), least=4).collect()
    assert len(found) == len(set(map(tuple, found)))
    assert set(map(tuple, found)) == brute(rows, 4)


def test_counts_handed_on_early_are_the_same(monkeypatch):
    import pyarrow as pa

    rows = rows_for(6)
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "" for r in rows]), pa.array([r[3] or "" for r in rows]), pa.array([(r[1] or "").encode() for r in rows])], names=["lang", "source", "text"])

    def summed():
        total = Counter()
        for out in divergence.count_terms(iter([batch, batch.slice(0, 0)])):
            for lang, source, term, n, documents in zip(*(c.to_pylist() for c in out.columns), strict=True):
                total[lang, source, term, "n"] += n
                total[lang, source, term, "d"] += documents
        return {k: v for k, v in total.items() if v}

    whole = summed()
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    assert summed() == whole


@pytest.mark.parametrize("leaf", [1, 2, 16])
def test_quadtree_against_the_matrix(monkeypatch, leaf):
    monkeypatch.setattr(divergence, "LEAF", leaf)
    rng = np.random.default_rng(3)
    for height, width, share in [(1, 1, 1.0), (1, 9, 0.3), (7, 1, 0.5), (5, 33, 0.2), (20, 64, 0.02), (40, 300, 0.01), (4, 16, 0.0), (3, 0, 0.0)]:
        matrix = rng.integers(100, 900, (height, width)) * (rng.random((height, width)) < share)
        rows, columns = np.nonzero(matrix)
        zero = rng.integers(1, 99, height)
        tree = divergence.Quadtree(rows, columns, matrix[rows, columns], zero, width)
        full = np.where(matrix > 0, matrix, zero[:, None])
        one, two = (a.ravel() for a in np.meshgrid(np.arange(height), np.arange(height)))
        zeros, pair, first, x, y = tree.together(one, two)
        p, q = tree.row(x, one[pair]), tree.row(y, two[pair])
        for k, (g, h) in enumerate(zip(one, two, strict=True)):
            met = [c for f in first[pair == k] for c in range(f, min(f + leaf, width))]
            rest = np.setdiff1d(np.arange(width), met)
            assert zeros[k] == len(rest) and not matrix[g, rest].any() and not matrix[h, rest].any()
            cells = [(a, b) for f, i in zip(first[pair == k], np.flatnonzero(pair == k), strict=True) for a, b in zip(p[i][: width - f], q[i][: width - f], strict=True)]
            assert cells == [(full[g, c], full[h, c]) for c in met]


def test_frequencies_are_exact():
    rng = random.Random(5)
    for top in (10, 10**6, 10**12, 2**52, 2**61):
        whole = [rng.randrange(3, top) for _ in range(300)] + [3]
        count = [rng.randrange(0, w - 1) for w in whole[:-1]] + [1]
        got = divergence.frequency(np.array(count), np.array(whole)).tolist()
        assert got == [1 + 10**9 * (c + 2) // w for c, w in zip(count, whole, strict=True)]


def test_query_against_sql(spark, folder):
    assert difference(divergence.op13_divergence(spark, folder), connect(folder), divergence.ORACLE) is None


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
