from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from thinjoin.llm import suffix_dedup
from thinjoin.llm.suffix_dedup import merge, remove_repeats, repeated_starts, shard_transform

N = suffix_dedup.LENGTH


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + N] for r in raw for i in range(len(r) - N + 1))
    rows = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - N + 1):
            if seen[r[i : i + N]] > 1:
                gone[i : i + N] = b"\x01" * N
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rows.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(rng.randrange(20, 150))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(3, 60)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[a:b], word()]
        rng.shuffle(parts)
        texts.append("\n".join(parts))
    texts += [texts[0], texts[1], texts[1] + "x", "y" + texts[2], "z" * 150, "z" * 199, "z" * 200, "z" * 201, "ab " * 400, "ab " * 90 + "!"]
    texts += ["", None, None, "", "q" * 250, "abc def " * 3000 + texts[3]]
    texts.append("".join(rng.choice("xyz") for _ in range(9000)) + passage[0])
    near = passage[1] + passage[2]
    for _ in range(6):
        i = rng.randrange(len(near))
        texts.append(near[:i] + "#" + near[i + 1 :])
    return texts


def found(spark, rows, schema="doc_id bigint, text string"):
    result = remove_repeats(spark.createDataFrame(rows, schema))
    return sorted((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result.collect())


@pytest.mark.parametrize("group", [1 << 18, 1])
def test_against_all_windows(spark, monkeypatch, group):
    """Once through the merged transforms, once with every open minimiser counted as a frequent one."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    texts = corpus(group)
    want = sorted((i, *w) for i, w in enumerate(brute(texts)))
    assert found(spark, list(enumerate(texts))) == want


def test_repeated_rows_and_other_columns(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    rows = [(None, text, 1, "r"), (None, text, 1, "r"), (5, "unlike", 2, None), (5, None, 3, None)]
    result = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, id int, row string"), with_text=True)
    got = sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in result.collect())
    assert got == [(0, 0, b""), (6, 0, b"unlike"), (300, 300, b""), (300, 300, b"")]
    assert found(spark, []) == []


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    texts = corpus(9)
    assert found(spark, list(enumerate(texts))) == sorted((i, *w) for i, w in enumerate(brute(texts)))


@pytest.mark.parametrize("group", [1 << 18, 20_000])
def test_many_long_runs(spark, monkeypatch, group):
    """Runs of one byte are one domain each; a group's bytes, not its members, decide where it is compared."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    rng = random.Random(6)
    texts = ["a" * rng.randrange(10_000, 16_000) + rng.choice("bc") * rng.randrange(250) for _ in range(8)]
    texts += ["ab" * 6000 + "c", "c" + "ab" * 5500, "d" * 11_000, "x" * 199 + "y" * 12_000]
    assert found(spark, list(enumerate(texts))) == sorted((i, *w) for i, w in enumerate(brute(texts)))


def test_merged_order_is_the_sorted_order():
    rng = np.random.default_rng(3)
    codes = [rng.integers(1, 3, n).astype(np.int64) for n in (130, 90, 61, 55, 200)]
    parts = [codes[:2], codes[2:]]
    shards = [shard_transform(p, 3) for p in parts]
    for passes in (1, 2, 3):
        shard, block = merge([s[0] for s in shards], passes)
        at, keys = [0, 0], []
        for k in shard:
            _, string, place = (x[at[k]] for x in shards[k])
            at[k] += 1
            chain = list(parts[k][string][place :: suffix_dedup.STEP]) if place < len(parts[k][string]) else []
            keys.append(tuple((chain + [0])[:passes]))
        assert keys == sorted(keys)
        for i in range(1, len(keys)):
            if 0 not in keys[i]:
                assert (keys[i] == keys[i - 1]) == (block[i] == block[i - 1])


def test_repeated_starts_of_strings():
    rng = random.Random(2)
    base = bytes(rng.randrange(97, 100) for _ in range(400))
    strings = [base[:260], base[50:300], b"x" + base[:230], base[100:390], b"a" * 300, base[:200]]
    sizes = [len(s) - N + 1 for s in strings]
    seen = Counter(s[i : i + N] for s, n in zip(strings, sizes, strict=True) for i in range(n))
    for s, n, got in zip(strings, sizes, repeated_starts(strings, sizes, [False] * 6), strict=True):
        assert got.tolist() == [i for i in range(n) if seen[s[i : i + N]] > 1]
