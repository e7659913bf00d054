"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as overlapping windows of ``WINDOW`` words. A word's input joins a vector of the word itself (known
words; one vector stands for all others), the mean of vectors of its character n-grams, and the strongest evidence that
any of these n-grams has in the labels (n-grams are hashed, so that unseen forms of a known stem are recognised). Two
gated recurrent layers read the window from either end, attention pools their states, and a logistic output scores the
window. A text's score is that of its most toxic window.

Training uses about ``PER_CLASS`` labelled documents of either class, the documented bound on what the driver holds.
Labels are per document, so each epoch trains on the window of a toxic document that the network finds most toxic, and
on the most toxic and one other window of a clean one. Scoring reads every window of the whole text.

Defined results: texts without a word (null, empty, blank) have score 0. If either class has no labelled row, texts with
words score 0.5. Rows are judged one by one: repeated rows, null ids and ties need no rule. Other columns pass through.
Scores do not depend on which rows share a batch beyond the last bits of 32-bit arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import folded_crc, labelled_sample, map_text, packed, table

PER_CLASS = 1200
WINDOW, STRIDE = 32, 16
#: Sizes: word vector, character vector, state per direction, attention.
WORD, CHAR, STATE, LOOK = 8, 8, 8, 8
VOCABULARY = 20_000
BUCKETS = 1 << 16
NGRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 8, 128, 0.01
THRESHOLD = 0.3
#: Windows scored, distinct words looked up, and documents of the sample read, at once.
BLOCK, PART, DOCUMENTS = 4096, 8192, 100
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def char_ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): word i has the n-gram buckets from bounds[i] to bounds[i + 1]."""
    read = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(read))  # characters from here to the word's end
    code = np.zeros(len(read), np.uint32)
    owners, buckets = [], []
    for k in range(max(NGRAMS)):
        code[: len(read) - k] = code[: len(read) - k] * np.uint32(1000003) + read[k:] + np.uint32(1)
        if k + 1 in NGRAMS:
            fits = left >= k + 1
            owners.append(word[fits])
            buckets.append(((code[fits] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(words) + 1))
    return np.concatenate(buckets)[order], bounds


def means(vectors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Means of the runs of rows between bounds; zero for empty runs."""
    total = np.zeros((len(vectors) + 1, vectors.shape[1]))
    np.cumsum(vectors, axis=0, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of all windows; the last one ends with the text."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    count = np.where(lengths > 0, 1 + more, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * STRIDE, np.maximum(lengths[text] - WINDOW, 0))
    return text, start, np.minimum(lengths[text], WINDOW)


class Network:
    """Parameters and passes. ``vocabulary`` maps known words to rows of ``word``; row 0 is any other word."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.vocabulary = vocabulary
        self.word = draw.normal(0, 0.1, (len(vocabulary) + 1, WORD))
        self.char = draw.normal(0, 0.1, (BUCKETS, CHAR))
        self.hint = np.zeros(BUCKETS)
        self.dense = {
            "input": np.stack([scale(WORD + CHAR + 1, 3 * STATE) for _ in range(2)]),
            "bias": np.zeros((2, 3 * STATE)),
            "state": np.stack([scale(STATE, 3 * STATE) for _ in range(2)]),
            "look": scale(2 * STATE, LOOK),
            "look_bias": np.zeros(LOOK),
            "pick": scale(LOOK),
            "out": scale(2 * STATE),
            "out_bias": np.zeros(1),
        }

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, word rows, char buckets, bounds) of distinct words."""
        rows = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        buckets, bounds = char_ngrams(words)
        hints = np.maximum.reduceat(np.r_[self.hint[buckets], 0.0], bounds[:-1]) * (np.diff(bounds) > 0)
        return np.hstack([self.word[rows], means(self.char[buckets], bounds), hints[:, None]]), rows, buckets, bounds

    def gate_inputs(self, words: list[bytes]) -> np.ndarray:
        """What distinct words add to the gates of either direction, in 32 bits."""
        parts = [self.project(self.inputs(words[i : i + PART])[0], np.float32) for i in range(0, len(words), PART)]
        return np.concatenate(parts, axis=1)

    def forward(self, projected: np.ndarray, ids: np.ndarray, there: np.ndarray | None, keep: bool = False):
        """Logits of windows. ``projected`` (2, words, 3 * STATE) are the words' gate inputs, ``ids`` (windows, WINDOW)."""
        d = self.dense
        n, length = ids.shape
        kind = projected.dtype
        states = np.zeros((2, length + 1, n, STATE), kind)
        kept = [[None] * length, [None] * length]
        for way in range(2):
            weight = d["state"][way].astype(kind)
            gates = projected[way]
            for t in range(length):
                at = t if way == 0 else length - 1 - t
                before = states[way, t]
                x = gates[ids[:, at]]
                h = before @ weight
                zr = sigmoid(x[:, : 2 * STATE] + h[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                new = np.tanh(x[:, 2 * STATE :] + r * h[:, 2 * STATE :])
                after = new + z * (before - new)
                if there is not None:
                    after = np.where(there[:, at, None], after, before)
                states[way, t + 1] = after
                if keep:
                    kept[way][t] = (z, r, new, h[:, 2 * STATE :])
        both = np.concatenate([states[0, 1:], states[1, :0:-1]], axis=2)  # (length, windows, 2 * STATE)
        look = np.tanh(both @ d["look"].astype(kind) + d["look_bias"].astype(kind))
        score = look @ d["pick"].astype(kind)
        if there is not None:
            score = np.where(there.T, score, -1e9)
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", share, both)
        logit = pooled @ d["out"].astype(kind) + kind.type(d["out_bias"][0])
        return (logit, (states, kept, both, look, share, pooled)) if keep else logit

    def backward(self, projected, ids, there, cache, slope):
        """Gradients of the dense parameters, and of ``projected``, for the loss slopes of the logits."""
        d = self.dense
        states, kept, both, look, share, pooled = cache
        n, length = ids.shape
        grad = {k: np.zeros_like(v) for k, v in d.items()}
        grad["out"], grad["out_bias"] = pooled.T @ slope, np.array([slope.sum()])
        of_pooled = slope[:, None] * d["out"]
        of_share = np.einsum("tns,ns->tn", both, of_pooled)
        of_both = share[:, :, None] * of_pooled
        of_score = share * (of_share - (share * of_share).sum(axis=0))
        grad["pick"] = np.einsum("tn,tnl->l", of_score, look)
        of_look = of_score[:, :, None] * d["pick"] * (1 - look**2)
        grad["look"] = np.einsum("tns,tnl->sl", both, of_look)
        grad["look_bias"] = of_look.sum(axis=(0, 1))
        of_both = of_both + of_look @ d["look"].T
        of_projected = np.zeros_like(projected)
        for way in range(2):
            weight = d["state"][way]
            carry = np.zeros((n, STATE))
            for t in range(length - 1, -1, -1):
                at = t if way == 0 else length - 1 - t
                z, r, new, inner = kept[way][t]
                before = states[way, t]
                carry = carry + of_both[at][:, way * STATE : (way + 1) * STATE]
                live = there[:, at, None]
                here = np.where(live, carry, 0.0)
                of_new = here * (1 - z) * (1 - new**2)
                of_z = here * (before - new) * z * (1 - z)
                of_r = of_new * inner * r * (1 - r)
                np.add.at(of_projected[way], ids[:, at], np.hstack([of_z, of_r, of_new]))
                through = np.hstack([of_z, of_r, of_new * r])
                grad["state"][way] += before.T @ through
                carry = here * z + through @ weight.T + np.where(live, 0.0, carry)
        grad["bias"] = of_projected.sum(axis=1)
        return grad, of_projected

    def project(self, vectors: np.ndarray, kind=np.float64) -> np.ndarray:
        d = self.dense
        return np.stack([vectors @ d["input"][w] + d["bias"][w] for w in range(2)]).astype(kind)

    def window_logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, logit) of all windows of all texts."""
        numbers: dict[bytes, int] = {}
        lengths = np.array([len(w) for w in texts], np.int64)
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int32, int(lengths.sum()))
        text, start, size = windows_of(lengths)
        logit = np.zeros(len(text))
        if not len(text):
            return text, start, logit
        projected = self.gate_inputs(list(numbers))
        offset = (np.cumsum(lengths) - lengths)[text] + start
        place = np.arange(WINDOW)
        for whole in (True, False):
            these = np.flatnonzero((size == WINDOW) == whole)
            for at in range(0, len(these), BLOCK):
                some = these[at : at + BLOCK]
                there = None if whole else place < size[some, None]
                where = offset[some, None] + (place if whole else np.where(there, place, 0))
                logit[some] = self.forward(projected, ids[where], there)
        return text, start, logit

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        text, _, logit = self.window_logits([words_of(t) for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -700, 700))))


def evidence(rows: Iterable[tuple[int, list]]) -> dict:
    """Per key the log-odds of toxic documents among those that hold it, drawn towards 0 by 1.6 standard errors."""
    counts: dict = {}
    totals = [0, 0]
    for label, keys in rows:
        totals[label] += 1
        for k in set(keys):
            counts.setdefault(k, [0, 0])[label] += 1
    both = np.array(list(counts.values()), np.float64) + 0.5
    odds = np.log(both[:, 1] / (totals[1] + 1)) - np.log(both[:, 0] / (totals[0] + 1))
    sure = np.maximum(np.abs(odds) - 1.6 * np.sqrt((1 / both).sum(axis=1)), 0) * np.sign(odds)
    return dict(zip(counts, np.clip(sure, -2, 5).tolist(), strict=True))


def rank_windows(net: Network, texts: list[list[bytes]], learned: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, rank) of all windows: the network's logit, or before it has learned the sum of its words' evidence."""
    found = []
    for at in range(0, len(texts), DOCUMENTS):
        some = texts[at : at + DOCUMENTS]
        if learned:
            text, start, rank = net.window_logits(some)
        else:
            text, start, size = windows_of(np.array([len(w) for w in some]))
            distinct = list({w for words in some for w in words})
            weight = dict(zip(distinct, (net.inputs(distinct)[0][:, [0, -1]].sum(axis=1)).tolist(), strict=True))
            sums = [np.cumsum([0.0, *(weight[w] for w in words)]) for words in some]
            places = zip(text.tolist(), start.tolist(), size.tolist(), strict=True)
            rank = np.array([sums[i][s + n] - sums[i][s] for i, s, n in places])
        found.append((text + at, start, rank))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fit(rows: list[tuple[int, bytes]], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """A network from (label, text) rows; ``None`` if a class is missing."""
    texts = [(label, words_of(text)) for label, text in rows]
    texts = [(label, words) for label, words in texts if words]
    labels = np.array([label for label, _ in texts])
    if len(set(labels.tolist())) < 2:
        return None
    held: dict[bytes, int] = {}
    for _, words in texts:
        for w in set(words):
            held[w] = held.get(w, 0) + 1
    known = sorted((w for w, n in held.items() if n >= 3), key=lambda w: (-held[w], w))[:VOCABULARY]
    net = Network({w: i for i, w in enumerate(known, 1)}, seed)
    # the first dimension of a word starts as what the labels say of it by itself; n-grams give the hint in the same way
    sure = evidence(texts)
    for w, i in net.vocabulary.items():
        net.word[i, 0] = sure[w]
    held.clear()
    sure = evidence((label, np.unique(char_ngrams(sorted(set(words)))[0]).tolist()) for label, words in texts)
    net.hint[list(sure)] = list(sure.values())
    draw = np.random.default_rng(seed)
    dense = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.dense.items()}
    word_square, char_square = np.full(net.word.shape, 1e-3), np.full(net.char.shape, 1e-3)
    steps = 0
    for epoch in range(epochs):
        text, start, rank = rank_windows(net, [words for _, words in texts], learned=epoch > 0)
        order = np.lexsort((-rank, text))
        first = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        sizes = np.bincount(text)
        at = np.cumsum(sizes) - sizes
        other = order[at + (draw.random(len(sizes)) * sizes).astype(np.int64)]
        chosen = np.concatenate([first, other[labels == 0]])
        draw.shuffle(chosen)
        for begin in range(0, len(chosen), BATCH):
            some = chosen[begin : begin + BATCH]
            numbers: dict[bytes, int] = {}
            ids, there = np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW), bool)
            for row, w in enumerate(some.tolist()):
                words = texts[text[w]][1][start[w] : start[w] + WINDOW]
                ids[row, : len(words)] = [numbers.setdefault(x, len(numbers)) for x in words]
                there[row, : len(words)] = True
            vectors, rows_of, chars, bounds = net.inputs(list(numbers))
            projected = net.project(vectors)
            logit, cache = net.forward(projected, ids, there, keep=True)
            slope = (sigmoid(logit) - labels[text[some]]) / len(some)
            grad, of_projected = net.backward(projected, ids, there, cache, slope)
            grad["input"] = np.stack([vectors.T @ of_projected[w] for w in range(2)])
            of_vectors = sum(of_projected[w] @ net.dense["input"][w].T for w in range(2))
            steps += 1
            for k, g in grad.items():
                m, v = dense[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.dense[k] -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
            of_word = np.zeros_like(net.word)
            np.add.at(of_word, rows_of, of_vectors[:, :WORD])
            of_char = np.zeros_like(net.char)
            spread = of_vectors[:, WORD : WORD + CHAR] / np.maximum(np.diff(bounds), 1)[:, None]
            np.add.at(of_char, chars, np.repeat(spread, np.diff(bounds), axis=0))
            for table_, g, square in ((net.word, of_word, word_square), (net.char, of_char, char_square)):
                square += g * g
                table_ -= RATE * g / np.sqrt(square)
    return net


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """A network from the documents that ``labels`` (doc_id, toxic) marks."""
    return fit(labelled_sample(docs, labels, "toxic", per_class))


def toxicity(docs: DataFrame, network: Network | None) -> DataFrame:
    """(row, text, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work():
        net = shared.value

        def handle(texts):
            if net is None:
                return [pa.array([0.5 if words_of(t) else 0.0 for t in texts], pa.float64())]
            return [pa.array(net.scores(texts), pa.float64())]

        return handle

    return map_text(packed(docs), work, "score DOUBLE")


def op9_toxicity_gru(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(folded_crc(F.col("doc_id"), 4) != 2)
    found = toxicity(docs, learn(docs, labels))
    held = F.coalesce(folded_crc(F.col("row.doc_id"), 4) == 2, F.lit(False))
    return found.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
