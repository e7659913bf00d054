"""Encoding and decoding by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from thinjoin.llm import pieces
from thinjoin.llm.common import table, unpacked

ODD = [
    None, "", " ", "  ", " " * 40, "a", " a", "a ", "  a   b ", "a\nb\tc\r\n", "a▁b", "▁", "▁ ▁", "</s> <s> <unk> <0x41>", "a\x00b",
    "�", "日本 語😀 \U0001f9ff", "a　b c", "x" * 30_000, "word " * 20_000, "é" * 300 + " " + "é" * 300, "\x01\x02 \x7f", " \n \n ", "é ́",
]


@pytest.fixture(scope="module")
def model():
    return pieces.model_file()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_odd_texts_as_the_library(model, library):
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in ODD:
        want = library.encode(text or "", add_eos=True)
        got = encoder([None if text is None else text.encode()])
        assert got.to_pylist()[0] == want, text
        assert decoder(got).to_pylist()[0] == library.decode(want), text


def test_random_texts_as_the_library(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 7)
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 20)
    rng = random.Random(8)
    alphabet = ["a", "the", " ", "  ", "▁", "ing", "\n", "é", "日", "😀", ".", "1", "\t", "B", "‍"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    got = encoder([t.encode() for t in texts])
    want = [library.encode(t, add_eos=True) for t in texts]
    assert got.to_pylist() == want
    assert decoder(got).to_pylist() == [library.decode(w) for w in want]


def test_bytes_that_are_not_utf8(model, library):
    rng = random.Random(9)
    raws = [b"a b\xffc\xe2\x82 d", b"\xed\xa0\x80 x", b"\xc0\xaf", *[bytes(rng.choices(b"a \xc3\xa9\xe2\x96\x81\xf0\x9f\xff", k=12)) for _ in range(500)]]
    assert pieces.Encoder(model, end=False)(raws).to_pylist() == [library.encode(r) for r in raws]


def test_any_ids_decode_as_the_library(model, library):
    rng = random.Random(10)
    size = library.get_piece_size()
    rows = [[rng.randrange(size if rng.random() < 0.5 else 260) for _ in range(rng.randrange(8))] for _ in range(3000)]
    decoder = pieces.Decoder(model)
    got = decoder(pa.array([*rows, None], pa.list_(pa.int32()))).to_pylist()
    assert got == [*(library.decode(r) for r in rows), None]
    with pytest.raises(IndexError):
        decoder.text(np.array([size]))


def test_chunks_are_segmented_once(model, monkeypatch):
    encoder, seen = pieces.Encoder(model), []
    whole = encoder.segment
    monkeypatch.setattr(encoder, "segment", lambda chunks: seen.extend(chunks) or whole(chunks))
    encoder([b"one two one two  two", b"two one"])
    assert sorted(seen) == sorted({"▁one", "▁two", "▁▁two"})


def test_models_whose_pieces_cross_markers_are_refused(model, monkeypatch):
    monkeypatch.setattr(pieces, "BORDER", pieces.re.compile("th"))
    with pytest.raises(ValueError, match="crosses"):
        pieces.vocabulary(model)


def test_query_against_the_library(spark, folder, library):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    rows = pieces.op12_pieces(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        want = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_other_columns_repeated_rows_and_empty_tables(spark, model):
    rows = [(i % 3, t, "x", [1]) for i, t in enumerate(ODD)] * 2 + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, ids array<int>")
    found = pieces.round_trip(docs, model)
    assert sorted(map(str, unpacked(found, docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert pieces.round_trip(docs.where("false"), model).collect() == []
    apart = pieces.decode(pieces.encode(docs, model), model)
    assert apart.exceptAll(found.select(apart.columns)).count() == 0
    assert found.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.regexp_replace("decoded", " ", " "))).where(~F.col("text").contains("▁")).count() == 0
