"""SentencePiece encoding and decoding with a table of distinct chunks.

The model turns every blank into a marker and puts one before the text. Where no piece holds a marker after another
character, no merge can cross the place where a marker follows one, so a text is a row of independent chunks: markers
and the characters up to the next marker. A task segments each distinct chunk once with the library, keeps its ids in a
table, and joins the ids back by position: a gather over the numbers of a text's chunks. Decoding gathers the bytes of
the pieces in the same way. No row is moved; what a task holds is one slice of texts, cut into windows of chunks, and a
table that is begun anew when it is full.

``vocabulary`` checks that a model has these properties and raises ``ValueError`` otherwise.

Defined results: a null text is encoded as an empty one, whose ids are the end id alone; null ids give a null text. Bytes
that are not UTF-8 count as U+FFFD each, as in the library. Ids beyond the model raise. Rows are encoded one by one, so
ties, repeated rows and null ids of documents need no rule. Other columns pass through. Very long texts are encoded
whole; a chunk of any length (a text without blanks) is segmented whole.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import map_text, packed, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
BORDER = re.compile(f"[^{MARK}]{MARK}")
#: Characters of a text whose chunks are looked up at a time.
WINDOW = 1 << 20
#: Chunks that are looked up together; distinct chunks, and ids of them, beyond which a task begins its table anew.
TABLE_CHUNKS = 1 << 19
TABLE_IDS = 1 << 22

codecs.register_error("each-byte", lambda error: ("�" * (error.end - error.start), error.end))


def model_file(name: str = MODEL) -> bytes:
    """The model of that name among the installed vocabularies."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def vocabulary(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The model, if its chunks are independent of each other."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    if pieces.normalize(" a  B\t ") != f"{MARK}{MARK}a {MARK}B\t{MARK}":
        raise ValueError("the model does more to a text than marking its blanks and its start")
    for i in range(pieces.get_piece_size()):
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i)) and BORDER.search(pieces.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a marker")
    return pieces


class Encoder:
    """Ids of texts, by a table of the distinct chunks seen so far."""

    def __init__(self, model: bytes, end: bool = True):
        self.pieces = vocabulary(model)
        self.end = [self.pieces.eos_id()] if end else []
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.sizes, self.ids = array("q"), array("q"), array("i")

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a marker before what it gets, so it gets the chunks without their first one."""
        found = self.pieces.encode([chunk[1:] for chunk in chunks], num_threads=1)
        if MARK in chunks:
            alone = self.pieces.piece_to_id(MARK)
            bytes_ = [self.pieces.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()]
            found[chunks.index(MARK)] = bytes_ if alone == self.pieces.unk_id() else [alone]
        return found

    def learn(self, chunks: list[str]) -> None:
        """Add the chunks that the table does not have."""
        new = list(set(chunks) - self.numbers.keys())
        if new:
            for chunk, ids in zip(new, self.segment(new), strict=True):
                self.numbers[chunk] = len(self.starts)
                self.starts.append(len(self.ids))
                self.sizes.append(len(ids))
                self.ids.extend(ids)

    def windows(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[str]]]:
        """(number of the text, chunks) for parts of the texts, in order."""
        for number, raw in enumerate(texts):
            marked = MARK + raw.decode("utf-8", "each-byte").replace(" ", MARK) if raw else ""
            at = 0
            while at < len(marked):
                border = BORDER.search(marked, at + WINDOW)
                to = border.start() + 1 if border else len(marked)
                yield number, CHUNK.findall(marked, at, to)
                at = to

    def looked_up(self, parts: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) of each part."""
        chunks = list(chain.from_iterable(part for _, part in parts))
        self.learn(chunks)
        numbers = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        # views of the table, which must not outlive this call: it grows
        starts, sizes, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.ids, np.int32)
        size = sizes[numbers]
        ends = np.cumsum(size)
        found = ids[np.repeat(starts[numbers] - ends + size, size) + np.arange(int(size.sum()))]
        at = 0
        for number, part in parts:
            to = at + len(part)
            yield number, found[int(ends[at] - size[at]) : int(ends[to - 1])]
            at = to
        if len(self.numbers) > TABLE_CHUNKS or len(self.ids) > TABLE_IDS:
            del starts, sizes, ids
            self.clear()

    def __call__(self, texts: list[bytes | None]) -> pa.ListArray:
        rows: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for number, chunks in chain(self.windows(texts), [(None, None)]):
            if held and (chunks is None or size + len(chunks) > TABLE_CHUNKS):
                for of, ids in self.looked_up(held):
                    rows[of].append(ids)
                held, size = [], 0
            if chunks:
                held.append((number, chunks))
                size += len(chunks)
        end = np.array(self.end, np.int32)
        parts = [[*row, end] for row in rows]
        offsets = np.cumsum([0, *(sum(map(len, row)) for row in parts)])
        ids = np.concatenate([part for row in parts for part in row]) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


class Decoder:
    """Texts of ids, by a table of the bytes of each piece."""

    def __init__(self, model: bytes):
        self.pieces = vocabulary(model)
        kinds = range(self.pieces.get_piece_size())
        self.plain = np.array([not (self.pieces.is_control(i) or self.pieces.is_unknown(i) or self.pieces.is_byte(i)) for i in kinds])
        self.byte = np.array([self.pieces.is_byte(i) for i in kinds])
        self.bytes = pa.array([self.surface(i) for i in kinds], pa.large_binary())

    def surface(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.byte[i]:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode() if self.plain[i] else b""

    def text(self, ids: np.ndarray) -> str:
        """The library's text of these ids: gathered if all are pieces or bytes that make up UTF-8, with an end id or none."""
        body = ids[:-1] if len(ids) and ids[-1] == self.pieces.eos_id() else ids
        inside = len(body) and 0 <= int(body.min()) and int(body.max()) < len(self.plain)
        if inside and self.plain[body[0]] and bool((self.plain[body] | self.byte[body]).all()):
            taken = self.bytes.take(pa.array(body))
            raw = b"".join(taken.to_pylist()) if taken.null_count or taken.offset else taken.buffers()[2].to_pybytes()
            raw = raw[: self.length(taken)]
            try:
                return raw.decode()[1 if raw[:1] == b" " else 0 :]
            except UnicodeDecodeError:
                pass
        return self.pieces.decode(ids.tolist())

    @staticmethod
    def length(taken: pa.Array) -> int:
        return int(np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[-1])

    def __call__(self, rows: pa.ListArray) -> pa.Array:
        values, offsets = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
        there = rows.is_valid().to_pylist()
        texts = [self.text(values[a:b]) if t else None for a, b, t in zip(offsets, offsets[1:], there, strict=False)]
        return pa.array(texts, pa.string())


def encode(docs: DataFrame, model: bytes, end: bool = True) -> DataFrame:
    """(row, text, ids) for every row of ``docs``; ``end`` adds the end id."""

    def work():
        encoder = Encoder(model, end)
        return lambda texts: [encoder(texts)]

    vocabulary(model)
    return map_text(packed(docs), work, "ids ARRAY<INT>")


def decode(tokens: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids in ``column``."""
    fields = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema.fields if f.name != 'decoded')}, decoded STRING"

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(model)
            ids = batch.column(batch.schema.get_field_index(column)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder(ids)], names=[*batch.schema.names, "decoded"])

    vocabulary(model)
    return tokens.drop("decoded").mapInArrow(run, fields)


def round_trip(docs: DataFrame, model: bytes, end: bool = True) -> DataFrame:
    """(row, text, ids, decoded) for every row of ``docs``, with both tables in one task."""

    def work():
        encoder, decoder = Encoder(model, end), Decoder(model)

        def handle(texts):
            ids = encoder(texts)
            return [ids, decoder(ids)]

        return handle

    vocabulary(model)
    return map_text(packed(docs), work, "ids ARRAY<INT>, decoded STRING")


def joined(ids: Column) -> Column:
    """Decimal ids joined by one blank."""
    return F.array_join(ids.cast("array<string>"), " ")


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = round_trip(table(spark, folder, "documents").select("doc_id", "text"), model_file())
    return found.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
