"""Operators that judge texts one by one: defined results, brute-force counts and held-out accuracy."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from thinjoin.llm import contamination, language_id, line_dedup, mixing, quality_crf, quality_rules, toxicity_gru
from thinjoin.llm.common import labelled_sample, packed, table, unpacked
from thinjoin.llm.queries import ORACLES, QUERIES

ODD = [
    (1, None, "en", 1),
    (1, None, "en", 1),
    (2, "", None, 2),
    (3, " \t\n\x0b ", "fr", 3),
    (None, "Some words here, and more of them.\nSome words here, and more of them.", "en", 4),
    (None, "Some words here, and more of them.\nSome words here, and more of them.", "en", 4),
    (5, "12 34 ** !! ||", "de", 5),
    (6, "é" * 9 + "\n" + "É" * 12, "fr", 6),
    (7, "word " * 120_000, "en", 7),
    (8, "x" * 300_000, "de", 8),
    (9, "line one is here\n\n\nline one is here\n Line One Is Here \n", "en", 9),
    (9, "line one is here", "es", 9),
]
SCHEMA = "doc_id bigint, text string, lang string, row int"


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def test_every_operator_takes_odd_rows_and_keeps_other_columns(spark):
    docs = docs_of(spark)
    items = spark.createDataFrame([(1, "line one is here"), (1, "word"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")
    runs = {
        "rules": lambda d: quality_rules.line_first(d),
        "language": lambda d: language_id.identify(d, language_id.learn(d)),
        "quality": lambda d: quality_crf.quality(d, None),
        "toxicity": lambda d: toxicity_gru.toxicity(d, None),
        "lines": lambda d: line_dedup.line_dedup(d),
        "benchmark": lambda d: contamination.decontaminate(d, items),
        "mixing": lambda d: mixing.mix(d),
    }
    for name, run in runs.items():
        found = run(docs)
        back = unpacked(found, docs.columns)
        assert back.columns == docs.columns, name
        assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect())), name
        assert run(docs.where("false")).collect() == [], name


# ---------------------------------------------------------------- quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(covered), failed


def test_base_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").unionByName(docs_of(spark).drop("row"))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "ç|", "d#"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    extra = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    for r in quality_rules.line_first(docs.unionByName(extra)).collect():
        got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]
        assert got == brute_counts(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_many_distinct_words_are_counted_in_ranks():
    words = [f"w{i}".encode() for i in range(9000)]
    assert quality_rules.repeated_words(words + words[10:20]) == 20


def test_line_rules():
    fault = lambda line: quality_rules.line_fault(line.encode(), line.encode().split())
    assert fault("A plain sentence of ordinary words stands here.") is None
    assert fault("Home | About | Contact | Login") == "navigation"
    assert fault("This### is*** all$$$ symbols%%% here&&&") == "symbols"
    assert fault("WHAT IS ALL THIS SHOUTING FOR") == "capitals"
    assert fault("no!! more!! of!! this!!") == "punctuation"
    assert fault("This work is licensed under some licence or other.") == "boilerplate"
    assert fault("so so so so so so so so so so so so") == "repetition"


def test_long_lines_do_not_fail_by_their_length():
    rng = random.Random(5)
    prose = " ".join(f"w{rng.randrange(1000)}" for _ in range(20_000))
    for text in (prose, prose[: len(prose) // 2] + " See our privacy policy or click here. " + prose[len(prose) // 2 :]):
        found = quality_rules.judge(text.encode())
        assert found[6] and found[8] == 0 and found[10] == text
    fault = lambda text: quality_rules.line_fault(text.encode(), text.encode().split())
    assert fault("so " * 5000) == "repetition"
    assert fault(" ".join(prose.split()[:150]) + " so" * 400) == "repetition"
    assert fault((" ".join(f"v{i}" for i in range(90)) + " ") * 50) == "repetition"
    assert fault(" ".join(f"v{i}" for i in range(30)) + " click here") == "boilerplate"


def test_documents_that_lose_too_much_go(spark):
    rng = random.Random(4)
    sentence = lambda: "The " + " ".join(f"{rng.choice('abcde')}{rng.randrange(99)}" for _ in range(9)) + "."
    good = "\n".join(sentence() for _ in range(4))
    bad = "\n".join([good.split("\n")[0], *[" | ".join(f"Item{i}{j}" for j in range(6)) for i in range(9)]])
    rows = quality_rules.line_first(docs_of(spark, [(1, good, "en", 0), (2, bad, "en", 0)])).collect()
    kept = {r["row"]["doc_id"]: (r["kept"], r["clean"]) for r in rows}
    assert kept[1] == (True, good)
    assert kept[2][1] == good.split("\n")[0]
    assert not kept[2][0]


# ---------------------------------------------------------------- classifiers


def test_numerals_are_no_letters():
    for text in ("½ ²", "Ⅷ 12", "12 ①", "一二 3", "é", "12 a"):
        assert language_id.has_letter(text.encode()) == any(unicodedata.category(c).startswith("L") for c in text), text


def accuracy(found, docs, labels, score, label):
    rows = found.join(labels, "doc_id").where("held_out").select(score, label).collect()
    return np.mean([r[0] == r[1] for r in rows]), len(rows)


def test_held_out_languages(spark):
    found = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    share, n = accuracy(found, None, docs, "lang_pred", "lang")
    assert n > 250
    assert share > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_of_texts_without_letters(spark):
    model = language_id.fit([("en", b"the house and the garden"), ("de", b"das haus und der garten")] * 3)
    texts = [None, "", "12 !?", "das haus", "È"]
    names, scores = language_id.score_texts([t if t is None else t.encode() for t in texts], *model)
    assert names[:4] == ["und", "und", "und", "de"]
    assert names[4] in ("en", "de")
    assert scores[:3] == [0.0] * 3


def test_language_kernel_is_the_presence_kernel():
    a, b = b"the house", b"the horse"
    x, y = ({(n, (t + b"    ")[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(t) + 1)} for t in (a, b))
    vectors = language_id.presence([a, b])
    alone = language_id.presence([b])
    assert np.array_equal(vectors[1], alone[0])
    expected = len(x & y) / np.sqrt(len(x) * len(y))
    assert float(vectors[0] @ vectors[1]) == pytest.approx(expected, abs=0.06)


def test_held_out_quality(spark):
    found = QUERIES["op3_quality_crf"](spark, "/root/testdata/sf0.01")
    share, n = accuracy(found, None, table(spark, "/root/testdata/sf0.01", "labels"), "predicted", "quality")
    assert n > 50
    assert share > 0.95
    assert found.where("score is null or score < 0 or score > 1").count() == 0


def brute_marginals(score, step):
    """By summing over all label sequences."""
    n, total, good = len(score), 0.0, np.zeros(len(score))
    for code in range(2**n):
        y = [(code >> t) & 1 for t in range(n)]
        weight = np.exp(sum(s for s, v in zip(score, y, strict=True) if v) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += weight
        good += weight * np.array(y)
    return good / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    step = rng.normal(size=(2, 2))
    scores = [rng.normal(size=n) for n in (1, 4, 7)]
    there = np.arange(7) < np.array([1, 4, 7])[:, None]
    padded = np.zeros((3, 7))
    padded[there] = np.concatenate(scores)
    good, _ = quality_crf.forward_backward(padded, there, step)
    for row, score in zip(good, scores, strict=True):
        assert row[: len(score)] == pytest.approx(brute_marginals(score, step), abs=1e-9)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if i % 2:
            words[rng.randrange(len(words))] = rng.choice(["vile", f"grunk{rng.choice('abcdefgh')}"])
        rows.append((i % 2, " ".join(words).encode()))
    net = toxicity_gru.fit(rows)
    texts = [b"w1 w2 VILE w3", b"w1 grunkz w2", b" ".join([b"w5"] * 400 + [b"vile"]), b"w1 w2 w3 w9 w40 w80 w17 w33", b" ".join([b"w7"] * 400), b"", None]
    scores = net.scores(texts)
    assert (scores[:3] >= toxicity_gru.THRESHOLD).all()
    assert (scores[3:] < 0.3).all()
    assert scores[5] == scores[6] == 0.0
    alone = np.array([net.scores([t])[0] for t in texts])
    assert alone == pytest.approx(scores, abs=1e-4)


def test_gru_gradients():
    net = toxicity_gru.Network({b"a": 1})
    rng = np.random.default_rng(0)
    ids, there = rng.integers(0, 5, (3, 7)), np.arange(7) < np.array([7, 4, 1])[:, None]
    inputs, y = rng.normal(size=(2, 5, 24)), np.array([1, 0, 1.0])

    def loss():
        logit = net.forward(inputs, ids, there)
        return (np.log1p(np.exp(logit)) - y * logit).sum()

    logit, cache = net.forward(inputs, ids, there, keep=True)
    grad, of_inputs = net.backward(inputs, ids, there, cache, toxicity_gru.sigmoid(logit) - y)
    for values, slopes in ((inputs, of_inputs), *((net.dense[k], grad[k]) for k in ("state", "look", "look_bias", "pick", "out"))):
        flat, at = values.reshape(-1), rng.integers(values.size)
        kept = flat[at]
        flat[at] = kept + 1e-6
        up = loss()
        flat[at] = kept - 1e-6
        down = loss()
        flat[at] = kept
        assert slopes.reshape(-1)[at] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def test_windows_overlap_and_cover():
    text, start, size = toxicity_gru.windows_of(np.array([0, 1, 32, 33, 100]))
    for i, n in enumerate([0, 1, 32, 33, 100]):
        covered = {p for s, m in zip(start[text == i], size[text == i], strict=True) for p in range(s, s + m)}
        assert covered == set(range(n))


def test_sample_is_the_same_for_the_same_table(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    one, two = (labelled_sample(docs, labels.repartition(n), "quality", 20) for n in (1, 5))
    assert one == two
    assert 10 < len(one) < 90


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(pattern, (text or "").translate(lower))
    hit, names = set(), set()
    for item, t in items:
        w = re.findall(pattern, (t or "").translate(lower))
        n = min(window, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(item))
    return len(words), len(hit), sorted(names)


def test_contamination_against_all_windows(spark):
    rng = random.Random(8)
    some = lambda n, k=4: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, some(rng.randrange(1, 40), rng.choice([2, 3, 8]))) for i in range(25)] + [(30, None), (31, "!!"), (3, "A-b, C"), (40, some(90, 2))]
    docs = [(i, some(rng.randrange(80), rng.choice([2, 3, 8])) + rng.choice(["", " É-b.C", " " + items[3][1]])) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " ".join(t for _, t in items if t))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (10**6, 60):
        found = contamination.decontaminate(frame, bench, block_words=block_words).collect()
        assert len(found) == len(docs)
        for r in found:
            want = brute_hits(r["text"], items)
            assert (r["n_words"], r["n_hit"], sorted(r["items"])) == want
            assert r["contaminated"] == (want[1] > 0 and 20 * want[1] >= want[0])


def test_contaminated_spans_are_cut(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before it. {passage.upper()}! After it."), (2, "é clean")], "doc_id bigint, text string")
    found = contamination.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id bigint, text string"))
    clean = {r["row"]["doc_id"]: r["clean"] for r in found.collect()}
    assert clean == {1: "Before it. \n! After it.", 2: "é clean"}


def test_long_spans_are_cut_whatever_the_coverage(spark):
    passage, prose = " ".join(f"p{i}" for i in range(20)), " ".join(f"w{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, f"{prose} {passage}. End yes sir"), (2, f"{prose} yes sir")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, passage), (2, "yes sir")], "item_id bigint, text string")
    found = {r["row"]["doc_id"]: r for r in contamination.decontaminate(docs, bench).collect()}
    assert [found[i]["contaminated"] for i in (1, 2)] == [False, False]
    assert [found[i]["n_hit"] for i in (1, 2)] == [22, 2]
    assert found[1]["clean"] == f"{prose} \n. End yes sir"
    assert found[2]["clean"] == f"{prose} yes sir"


def test_items_without_id_count(spark, tmp_path):
    passage = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = [(1, passage("a", 20)), (2, f"{passage('a', 20)} {passage('b', 20)} {passage('c', 3)}"), (3, passage("z", 30))]
    items = [(None, passage("a", 20)), (None, passage("c", 3)), (7, passage("b", 20)), (8, None)]
    frames = {"documents": (docs, "doc_id bigint, text string"), "benchmark": (items, "item_id bigint, text string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    made = contamination.decontaminate(spark.createDataFrame(*frames["documents"]), spark.createDataFrame(*frames["benchmark"]), block_words=20)
    found = {r["row"]["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in made.collect()}
    assert found[1] == (20, [None], True)
    assert (found[2][0], set(found[2][1]), len(found[2][1])) == (43, {"7", None}, 2)
    assert found[3] == (0, [], False)
    connection = connect(str(tmp_path))
    for name in frames:
        connection.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert difference(QUERIES["op7_decontamination"](spark, str(tmp_path)), connection, ORACLES["op7_decontamination"]) is None


# ---------------------------------------------------------------- lines and mixing


def brute_lines(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    result = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        result.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    pool = [rng.choice(["A line of text", " a LINE of text\t", "short", "", "Élan vital de ligne", "élan vital de ligne"]) + rng.choice(["", f" {i % 9}"]) for i in range(40)]
    rows = [(rng.randrange(60), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 200)))) for _ in range(90)]
    rows += [(None, pool[0]), (None, pool[0]), (3, None), (4, ""), *rows[:5]]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in found), key=str)
    assert got == brute_lines(rows)


def test_raking_meets_all_margins(spark):
    rng = random.Random(1)
    rows = [(s, g, t, rng.randrange(1, 5000)) for s in "abcd" for g in ("en", "fr", "(none)") for t in ("x", "y")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    wish = {"source": {"a": 5, "b": 1, "c": 2, "d": 2, "zz": 7}, "lang": {"en": 1, "fr": 1, "(none)": 2}, "topic": {"x": 3.0, "y": 1.0}}
    targets = {m: spark.createDataFrame([(k, float(v)) for k, v in w.items()], "category string, target double") for m, w in wish.items()}
    fitted = mixing.rake(cells, targets)
    for m, w in wish.items():
        there = {k: v for k, v in w.items() if k != "zz"}
        for r in fitted.groupBy(m).agg(F.sum("weight").alias("w")).collect():
            assert r["w"] == pytest.approx(there[r[m]] / sum(there.values()), abs=1e-8)
    chances = {tuple(r)[:3]: r["probability"] for r in mixing.probabilities(fitted).collect()}
    assert max(chances.values()) == pytest.approx(1.0)
    drawn = {r[:3]: chances[r[:3]] * r[3] for r in rows}
    total = sum(drawn.values())
    assert sum(v for k, v in drawn.items() if k[0] == "a") / total == pytest.approx(0.5, abs=1e-6)


def test_targets_that_cannot_be_met_are_told(spark):
    """Each source holds one language, and their targets differ by 0.2."""
    cells = spark.createDataFrame([("a", "en", "x", 100), ("b", "fr", "x", 300)], "source string, lang string, topic string, tokens bigint")
    wish = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.3, "fr": 0.7}, "topic": {"x": 1.0}}
    frame = lambda w: spark.createDataFrame(list(w.items()), "category string, target double")
    with pytest.warns(UserWarning, match="targets not met"):
        fitted = mixing.rake(cells, {m: frame(w) for m, w in wish.items()})
    assert [r["margin_gap"] for r in fitted.collect()] == [pytest.approx(0.2)] * 2
    wish["lang"] = {"en": 0.5, "fr": 0.5}
    met = mixing.rake(cells, {m: frame(w) for m, w in wish.items()})
    assert max(r["margin_gap"] for r in met.collect()) < 1e-9


def test_sampled_tokens_follow_the_probabilities(spark):
    found = mixing.mix(table(spark, "/root/testdata/sf0.01", "documents"))
    row = found.agg(F.sum(F.col("sampled").cast("int")), F.sum("probability"), F.sum(F.expr("probability * (1 - probability)")), F.max("probability")).first()
    assert abs(row[0] - row[1]) < 5 * row[2] ** 0.5
    assert row[3] == pytest.approx(1.0)
    assert packed(table(spark, "/root/testdata/sf0.01", "documents")).columns == ["row", "text"]


def test_factors_and_joins_rake_alike(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(f"s{i}", rng.choice("abc"), rng.choice("xyz"), rng.randrange(400)) for i in range(30) for _ in range(4)]
    held = {r[:3]: r for r in rows}
    cells = spark.createDataFrame(list(held.values()), "source string, lang string, topic string, tokens bigint")
    targets = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    weights = lambda: {(r["source"], r["lang"], r["topic"], r["tokens"]): r["weight"] for r in mixing.rake(cells, targets).collect()}
    by_factors = weights()
    monkeypatch.setattr(mixing, "PAIRS", 0)
    by_joins = weights()
    assert by_factors == pytest.approx(by_joins, abs=1e-9) and len(by_factors) == len(held)


def test_texts_without_words_are_not_sampled(spark):
    docs = spark.createDataFrame([(1, "", "a", "en"), (2, None, None, None)], "doc_id bigint, text string, source string, lang string")
    assert [(r["probability"], r["sampled"]) for r in mixing.mix(docs).collect()] == [(0.0, False)] * 2


@pytest.mark.parametrize("name", ["op5_mixing", "op7_decontamination", "op8_line_dedup"])
def test_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None
