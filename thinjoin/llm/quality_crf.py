"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's evidence is a vector of surface features of the line and of its two neighbours; transitions tie the labels of
adjacent lines. Forward-backward marginals, weighted by the lines' lengths, give the document's quality. Training uses
the document's label for each of its lines and maximises the conditional likelihood with Adam on about ``PER_CLASS``
labelled documents of either class, which is the documented bound on what the driver holds. Scoring reads whole texts.

Defined results: lines without a word take no part. A text without a word (null, empty, blank) has score 0. If either
class has no labelled row, every text with words scores 0.5. Rows are judged one by one, so repeated rows, null ids and
ties need no rule. Other columns pass through. Very long texts are one long chain, processed in steps over its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import folded_crc, labelled_sample, map_text, packed, table

PER_CLASS = 600
STEPS = 250
RATE = 0.05
PENALTY = 1e-3
THRESHOLD = 0.3
#: Padded cells (documents by lines) that forward-backward handles at once.
CELLS = 200_000
SYMBOLS = b"#*$%&|<>~^_=+@{}[]\\/"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
CONTINUATION = bytes(range(0x80, 0xC0))
#: Features of a line, and those of them that are also read from the lines before and after.
OWN = 13
SHARED = 8
WIDTH = OWN + 2 * SHARED + 3


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple:
    """Surface features of a line with words; the first ``SHARED`` are also given to its neighbours."""
    n, size = len(words), len(line)
    upper = size - len(line.translate(None, UPPER))
    lower = size - len(line.translate(None, LOWER))
    return (
        (size - len(line.translate(None, SYMBOLS))) / size,
        line.count(b"!") / n,
        line.count(b"|") / n,
        upper / (upper + lower + 1),
        1 - len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1.0 if words[-1][-1:] in b".!?" else 0.0,
        (size - len(line.translate(None, DIGITS))) / size,
        np.log1p(n),
        min(size / n, 30.0) / 10,
        (line.count(b".") + line.count(b",")) / n,
        float(repeated),
        1.0,
    )


def evidence(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in characters, document) of every line with words."""
    rows, sizes, owners = [], [], []
    for i, text in enumerate(texts):
        seen = set()
        for line in (text or b"").split(b"\n"):
            words = line.split()
            if words:
                rows.append(line_features(line, words, line in seen))
                sizes.append(len(line.translate(None, CONTINUATION)))
                owners.append(i)
                seen.add(line)
    own = np.array(rows, np.float64).reshape(-1, OWN)
    document = np.array(owners, np.int64)
    full = np.zeros((len(own), WIDTH))
    full[:, :OWN] = own
    if len(own):
        first = np.r_[True, document[1:] != document[:-1]]
        last = np.r_[document[1:] != document[:-1], True]
        after = np.flatnonzero(~first)
        full[after, OWN : OWN + SHARED] = own[after - 1, :SHARED]
        before = np.flatnonzero(~last)
        full[before, OWN + SHARED : OWN + 2 * SHARED] = own[before + 1, :SHARED]
        full[:, -3], full[:, -2], full[:, -1] = first, last, first & last
    return full, np.array(sizes, np.float64), document


def chains(document: np.ndarray) -> list[np.ndarray]:
    """Blocks of line numbers, (documents, lines) padded with -1, of documents of similar length."""
    if not len(document):
        return []
    starts = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
    lengths = np.diff(np.r_[starts, len(document)])
    order = np.argsort(lengths, kind="stable")
    blocks, at = [], 0
    while at < len(order):
        # lengths ascend, so a block's width is that of its last document
        end = at + 1
        while end < len(order) and lengths[order[end]] * (end + 1 - at) <= CELLS and lengths[order[end]] <= 2 * lengths[order[at]] + 8:
            end += 1
        some = order[at:end]
        place = np.arange(lengths[some].max())
        blocks.append(np.where(place < lengths[some, None], starts[some, None] + place, -1))
        at = end
    return blocks


def forward_backward(score: np.ndarray, there: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of good, expected transitions) of padded chains.

    ``score`` is the log-odds of good per line, ``step`` the 2 by 2 log-weights from a label to the next.
    """
    n, length = score.shape
    weight = np.exp(step - step.max())
    emit = np.stack([np.ones_like(score), np.exp(np.clip(score, -50, 50))], axis=2)
    emit /= emit.sum(axis=2, keepdims=True)
    ahead = np.zeros((length, n, 2))
    ahead[0] = emit[:, 0]
    for t in range(1, length):
        row = (ahead[t - 1] @ weight) * emit[:, t]
        row /= row.sum(axis=1, keepdims=True)
        ahead[t] = np.where(there[:, t, None], row, ahead[t - 1])
    back = np.ones((n, 2))
    good = np.zeros((n, length))
    moves = np.zeros((2, 2))
    for t in range(length - 1, -1, -1):
        both = ahead[t] * back
        good[:, t] = both[:, 1] / both.sum(axis=1)
        if t:
            right = emit[:, t] * back
            joint = ahead[t - 1][:, :, None] * weight * right[:, None, :]
            live = there[:, t]
            moves += (joint[live] / joint[live].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = np.where(live[:, None], right @ weight.T, back)
            back /= back.sum(axis=1, keepdims=True)
    return good, moves


class Model:
    def __init__(self, weights: np.ndarray, step: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.weights, self.step, self.centre, self.scale = weights, step, centre, scale

    def marginals(self, features: np.ndarray, document: np.ndarray) -> np.ndarray:
        score = ((features - self.centre) / self.scale) @ self.weights
        good = np.zeros(len(features))
        for block in chains(document):
            there = block >= 0
            found, _ = forward_backward(np.where(there, score[block], 0.0), there, self.step)
            good[block[there]] = found[there]
        return good

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        features, size, document = evidence(texts)
        good = self.marginals(features, document)
        total = np.bincount(document, size, len(texts))
        return np.clip(np.bincount(document, good * size, len(texts)) / np.maximum(total, 1e-300), 0, 1)


def fit(rows: list[tuple[int, bytes]], steps: int = STEPS) -> Model | None:
    """A model from (label, text) rows; ``None`` if a class is missing."""
    rows = [r for r in rows if r[1].split()]
    if len({label for label, _ in rows}) < 2:
        return None
    features, _, document = evidence([text for _, text in rows])
    centre, scale = features.mean(axis=0), features.std(axis=0)
    constant = scale < 1e-9
    centre[constant], scale[constant] = 0.0, 1.0
    x = (features - centre) / scale
    labels = np.array([label for label, _ in rows], np.float64)[document]
    counts = np.bincount(document)
    share = 1 / np.sqrt(counts)[document]  # a long document doesn't outweigh the rest
    blocks = chains(document)
    seen = np.zeros((2, 2))
    same = document[1:] == document[:-1]
    np.add.at(seen, (labels[:-1][same].astype(int), labels[1:][same].astype(int)), 1)
    weights, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    moment, square = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for k in range(1, steps + 1):
        score = x @ weights
        residual, moves = np.zeros(len(x)), np.zeros((2, 2))
        for block in blocks:
            there = block >= 0
            good, found = forward_backward(np.where(there, score[block], 0.0), there, step)
            residual[block[there]] = good[there]
            moves += found
        residual = (residual - labels) * share
        slope = np.r_[x.T @ residual / share.sum() + PENALTY * weights, ((moves - seen) / max(1, same.sum()) + PENALTY * step).ravel()]
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        change = RATE * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weights, step = weights - change[:-4], step - change[-4:].reshape(2, 2)
    return Model(weights, step, centre, scale)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from the documents that ``labels`` (doc_id, quality) marks."""
    return fit(labelled_sample(docs, labels, "quality", per_class))


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, text, score)."""

    def work():
        def handle(texts):
            if model is None:
                return [pa.array([0.5 if t and t.split() else 0.0 for t in texts], pa.float64())]
            return [pa.array(model.scores(texts), pa.float64())]

        return handle

    return map_text(packed(docs), work, "score DOUBLE")


def op3_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(folded_crc(F.col("doc_id"), 5) != 0)
    found = quality(docs, learn(docs, labels))
    held = F.coalesce(folded_crc(F.col("row.doc_id"), 5) == 0, F.lit(False))
    return found.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
