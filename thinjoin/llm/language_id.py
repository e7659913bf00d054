"""Language identification by a string kernel.

Texts are cut into chunks of about ``CHUNK`` bytes. The blended-spectrum presence kernel of two chunks is the number of
distinct n-grams (1 to 4 bytes of the normalised text) they share, over the geometric mean of their numbers. Landmarks
drawn from the learning rows give a Nyström approximation; one ridge regression per language is fitted on it. Because
the kernel is an inner product of presence vectors, landmarks and coefficients fold into one matrix, and a block of
chunks is scored by one matrix product. A text's scores are the mean over its chunks, weighted by their length.

Learning uses about ``per_language`` rows of each language, chosen by hash, and the first ``CHUNKS_PER_TEXT`` chunks
of each in a hashed order; both are the documented bound on what the driver holds. Scoring reads every byte.

Defined results: null texts, and texts without a letter, are ``und`` with score 0. So is every text when no row can be
learned from. Rows are judged one by one: repeated rows, null ids and other columns need no rule. Ties between languages
go to the first in alphabetical order. Very long texts are scored chunk by chunk.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import folded_crc, map_text, packed, shared_sample, table

CHUNK = 2000
NGRAMS = (1, 2, 3, 4)
#: Buckets of presence per n-gram length; n-grams are hashed, single bytes are not.
BUCKETS = 4096
SIZE = BUCKETS * len(NGRAMS)
BLOCK = 256
PER_LANGUAGE = 500
CHUNKS_PER_TEXT = 3
LANDMARKS = 256
RIDGE = 1e-2
#: Turns differences of regression outputs (about -1 to 1) into shares.
SHARPNESS = 4.0
#: Category L: numerals such as those for a half or the Roman eight are none.
LETTER = regex.compile(r"\p{L}")
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.uint32(2654435761)


def has_letter(raw: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", raw)) or bool(LETTER.search(raw.decode()))


def chunk_bounds(length: int) -> np.ndarray:
    """Cuts of a text of ``length`` bytes into equal chunks of at most about ``CHUNK`` bytes."""
    return np.linspace(0, length, max(1, -(-length // CHUNK)) + 1).astype(np.int64)


def presence(chunks: list[bytes]) -> np.ndarray:
    """Rows of 0/1 for the n-grams that each chunk holds, scaled to length one."""
    flags = np.zeros((len(chunks), SIZE), np.uint8)
    longest = len(NGRAMS)
    gap = b" " * longest
    read = np.frombuffer(b"".join(c.translate(NORMAL) + gap for c in chunks) + gap, np.uint8).astype(np.uint32)
    sizes = np.array([len(c) + longest for c in chunks], np.int64)
    own = np.ones(int(sizes.sum()), bool)
    for k in range(1, longest):
        own[np.cumsum(sizes) - k] = False  # these n-grams would reach into the next chunk
    starts = np.flatnonzero(own)
    row = np.repeat(np.arange(len(chunks), dtype=np.int64) * SIZE, sizes)[starts]
    code = np.zeros(len(own), np.uint32)
    for k in NGRAMS:
        code = code * np.uint32(257) + read[k - 1 : k - 1 + len(own)]
        bucket = code[starts] if k == 1 else (code[starts] * MIX) >> np.uint32(20)
        flags.reshape(-1)[row + ((k - 1) * BUCKETS + bucket.astype(np.int64))] = 1
    vectors = flags.astype(np.float32)
    vectors /= np.sqrt(np.maximum(vectors.sum(axis=1, keepdims=True), 1))
    return vectors


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(languages, folded weights) of the Nyström kernel ridge regression on (language, text) rows."""
    languages = sorted({lang for lang, _ in rows})
    chunks: list[tuple[int, bytes]] = []
    for lang, text in rows:
        cuts = chunk_bounds(len(text))
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        step = max(1, len(parts) // CHUNKS_PER_TEXT)
        chunks += [(languages.index(lang), p) for p in parts[::step][:CHUNKS_PER_TEXT] if has_letter_bytes(p)]
    if not chunks:
        return [], np.zeros((SIZE, 0), np.float32)
    share = max(1, landmarks // len(languages))
    chosen: list[bytes] = []
    for k in range(len(languages)):
        chosen += [c for lang, c in chunks if lang == k][:share]
    base = presence(chosen)
    among = (base @ base.T).astype(np.float64)
    left, right = ridge * among, np.zeros((len(base), len(languages)))
    for at in range(0, len(chunks), BLOCK):
        block = chunks[at : at + BLOCK]
        kernel = (presence([c for _, c in block]) @ base.T).astype(np.float64)
        target = -np.ones((len(block), len(languages)))
        target[np.arange(len(block)), [lang for lang, _ in block]] = 1
        left += kernel.T @ kernel
        right += kernel.T @ target
    alpha = np.linalg.lstsq(left + 1e-9 * np.eye(len(base)), right, rcond=None)[0]
    return languages, (base.T @ alpha).astype(np.float32)


def has_letter_bytes(part: bytes) -> bool:
    return bool(part.translate(NORMAL).strip())


def score_texts(texts: list[bytes | None], languages: list[str], weights: np.ndarray) -> tuple[list[str], list[float]]:
    chunks: list[bytes] = []
    owners: list[int] = []
    for i, text in enumerate(texts):
        if text and languages and has_letter(text):
            cuts = chunk_bounds(len(text)).tolist()
            chunks += [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            owners += [i] * (len(cuts) - 1)
    total = np.zeros((len(texts), len(languages)))
    length = np.zeros(len(texts))
    owner = np.array(owners, np.int64)
    for at in range(0, len(chunks), BLOCK):
        part, of = chunks[at : at + BLOCK], owner[at : at + BLOCK]
        size = np.array([len(c) for c in part], np.float64)
        np.add.at(total, of, (presence(part) @ weights) * size[:, None])
        np.add.at(length, of, size)
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    found = np.flatnonzero(length)
    if len(found):
        mean = total[found] / length[found, None]
        power = np.exp(SHARPNESS * (mean - mean.max(axis=1, keepdims=True)))
        best = mean.argmax(axis=1)
        share = power[np.arange(len(found)), best] / power.sum(axis=1)
        for i, b, s in zip(found.tolist(), best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = languages[b], s
    return names, scores


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """A model from (text, lang) of ``docs``; rows without either are left out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    found = shared_sample(rows, F.col("lang"), per_language, "doc_id", "text")
    order = found.select("_group", F.col("text").cast("binary").alias("raw"), F.xxhash64("doc_id", "text").alias("_order"))
    picked = sorted(order.collect(), key=lambda r: (r["_order"], r["raw"]))
    return fit([(r["_group"], bytes(r["raw"])) for r in picked])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(row, text, lang_pred, score)."""
    languages, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work():
        def handle(texts):
            names, scores = score_texts(texts, languages, shared.value)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return handle

    return map_text(packed(docs), work, "lang_pred STRING, score DOUBLE")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = folded_crc(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", F.coalesce(folded_crc(F.col("row.doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
