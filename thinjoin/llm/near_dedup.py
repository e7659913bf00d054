"""Near-duplicate documents by BagMinHash over five-word shingles.

A document is a multiset of word shingles. Its signature comes from Poisson processes: each shingle has one process per
dyadic weight level (0,1], (1,2], (2,4], ..., with a rate equal to the level's width, whose points fall on a random
signature slot at a random height; points above the shingle's count are thinned out. A slot keeps its first point, so
two documents agree in a slot with probability equal to their weighted Jaccard similarity. A process stops as soon as
its next point comes after the last slot's, which makes a signature cost little more than one point per shingle.

Texts with equal words are one class from the start (aggregated before the shuffle) and only one of them is compared.
Signatures are cut into bands; the members of a band's bucket are compared with the bucket's most central member, and
exact multiset overlap of the texts decides. Buckets whose members are then still in more than one component are compared
in full, block by block: a task counts the overlaps of all texts of two blocks by products of incidence matrices and
returns a spanning forest of the links, so no pair that shares a band is lost, rows grow with the members of a bucket
and not with its pairs, and no task holds more than two blocks. Connected documents form a class.

Defined results: words are what blanks separate. Texts of one to four words are a single shingle. Null texts and texts
without a word are in no class but their own, and so are rows without ``doc_id``. Repeated rows, and rows of one
``doc_id`` with different texts, are rows like others. A class is named by its smallest ``doc_id``. Extra columns pass
through. Very long texts are whole multisets; nothing is cut.

Bands: 20 of 4 slots. A pair of similarity 0.8 shares a band with probability 0.99997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from thinjoin.llm.common import identity, map_text, packed, table
from thinjoin.llm.components import components
from thinjoin.session import settle

SHINGLE = 5
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
SIMILAR = 0.8
#: Texts and words of a block; a task compares two.
BLOCK_TEXTS, BLOCK_WORDS = 512, 200_000
#: Columns of an incidence matrix at a time.
COLUMNS = 8192

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31, S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform values in (0, 1)."""
    return ((x >> S11).astype(np.float64) + 0.5) * 2.0**-53


def shingle_hashes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles of all documents, in order of document."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64)
    values = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    word = values[ids] if len(ids) else np.zeros(0, np.uint64)
    lengths = np.array([len(w) for w in texts], np.int64)
    code = np.zeros(len(word), np.uint64)
    for k in range(SHINGLE):
        n = max(0, len(word) - k)
        code[:n] = mix(code[:n] * GOLDEN + word[k:])
    documents, hashes, counts = [], [], []
    start = 0
    for i, n in enumerate(lengths.tolist()):
        if n >= SHINGLE:
            found, times = np.unique(code[start : start + n - SHINGLE + 1], return_counts=True)
        elif n:
            found, times = np.array([xxhash.xxh64_intdigest(b" ".join(texts[i]), seed=n)], np.uint64), np.array([1])
        else:
            found, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        documents.append(np.full(len(found), i, np.int64))
        hashes.append(found)
        counts.append(times)
        start += n
    return np.concatenate(documents), np.concatenate(hashes), np.concatenate(counts).astype(np.float64)


def signatures(n: int, document: np.ndarray, element: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The arrival times of each slot's first point: one row of ``slots`` per document; inf where it has no element."""
    first = np.full(n * slots, np.inf)
    low, level = 0.0, 0
    owner, seed, lows, widths, limits = [], [], [], [], []
    while len(element):
        high = 1.0 if level == 0 else low * 2
        owner.append(document)
        seed.append(mix(element + np.uint64(level + 1) * GOLDEN))
        lows.append(np.full(len(element), low))
        widths.append(np.full(len(element), high - low))
        limits.append(weight)
        more = weight > high
        document, element, weight = document[more], element[more], weight[more]
        low, level = high, level + 1
    if not owner:
        return first.reshape(n, slots)
    doc, state, bottom, width, limit = (np.concatenate(x) for x in (owner, seed, lows, widths, limits))
    time = np.zeros(len(doc))
    while len(doc):
        state = state + GOLDEN
        draw = mix(state)
        time = time - np.log(unit(draw)) / (slots * width)
        other = mix(draw ^ M1)
        slot = (other >> np.uint64(32)).astype(np.int64) * slots >> 32
        height = bottom + width * ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32
        held = height <= limit
        np.minimum.at(first, doc[held] * slots + slot[held], time[held])
        last = first.reshape(n, slots).max(axis=1)
        alive = time < last[doc]
        doc, state, bottom, width, limit, time = (x[alive] for x in (doc, state, bottom, width, limit, time))
    return first.reshape(n, slots)


def sketch_texts(texts: list[bytes | None]) -> list[pa.Array]:
    """node (hash of the words; null without words), size, bands of each text."""
    words = [t.split() if t else [] for t in texts]
    document, element, weight = shingle_hashes(words)
    bits = mix(signatures(len(texts), document, element, weight).view(np.uint64))
    grouped = bits.reshape(len(texts), BANDS, ROWS)
    bands = np.zeros((len(texts), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        bands = mix(bands ^ grouped[:, :, k])
    nodes = [xxhash.xxh128_digest(b" ".join(w)) if w else None for w in words]
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * BANDS
    return [
        pa.array(nodes, pa.binary()),
        pa.array([max(1, len(w) - SHINGLE + 1) if w else 0 for w in words], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64))),
    ]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, node, size, bands) of every row."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", identity(docs).alias("rid"), "text")
    fields = "node BINARY, size BIGINT, bands ARRAY<BIGINT>"
    found = map_text(packed(rows), lambda: sketch_texts, fields)
    return settle(found.select("row.doc_id", "row.rid", "node", "size", "bands"), "sketches")


def jaccard(a: bytes, b: bytes) -> float:
    """Exact multiset Jaccard similarity of the shingles of two texts that have words."""
    numbers: dict[bytes, int] = {}
    sides = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in (a, b)]
    if min(map(len, sides)) < SHINGLE:
        return float(sides[0] == sides[1])
    base = len(numbers)
    codes, top = [np.array(s, np.int64) for s in sides], base
    starts = [len(c) - SHINGLE + 1 for c in codes]
    ids = codes
    codes = [c[:n] for c, n in zip(codes, starts, strict=True)]
    for k in range(1, SHINGLE):
        if top * base >= 1 << 62:
            both = np.unique(np.concatenate(codes), return_inverse=True)[1]
            codes = [both[: starts[0]], both[starts[0] :]]
            top = int(both.max()) + 1
        codes = [c * base + i[k : k + n] for c, i, n in zip(codes, ids, starts, strict=True)]
        top *= base
    (x, nx), (y, ny) = (np.unique(c, return_counts=True) for c in codes)
    _, at, of = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(nx[at], ny[of]).sum())
    return shared / (starts[0] + starts[1] - shared)


@F.pandas_udf(BooleanType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts reach the similarity."""
    return pd.Series([jaccard(x, y) >= SIMILAR for x, y in zip(a, b, strict=True)], dtype=bool)


def overlaps(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shared shingles of every two different texts, shingles of each), counted as multisets."""
    document, element, count = shingle_hashes([t.split() for t in texts])
    times = count.astype(np.int64)
    size = np.bincount(document, times, len(texts))
    document = np.repeat(document, times)
    nth = np.arange(len(document)) - np.repeat(np.cumsum(times) - times, times)
    _, column, held = np.unique(mix(np.repeat(element, times) + nth.astype(np.uint64) * GOLDEN), return_inverse=True, return_counts=True)
    common = held[column] > 1
    document, column = document[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    document, column = document[order], column[order]
    shared = np.zeros((len(texts), len(texts)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        holds = np.zeros((len(texts), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        holds[document[a:b], column[a:b] - low] = 1
        shared += holds @ holds.T
    return shared, size


def forest(nodes: list[bytes], parts: list[bytes], side: list[int], texts: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links that connect the parts among two blocks as all their links would; texts of one part aren't compared."""
    if len(set(parts)) < 2:
        return []
    shared, size = overlaps(texts)
    close = shared >= SIMILAR * (size[:, None] + size[None, :] - shared) - 1e-3
    number = np.unique(np.array(parts, object), return_inverse=True)[1]
    sides = np.array(side)
    if len(set(side)) > 1:
        close &= sides[:, None] != sides[None, :]
    parent = list(range(int(number.max()) + 1))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, j in zip(*np.nonzero(np.triu(close & (number[:, None] != number[None, :]), 1)), strict=True):
        a, b = find(number[i]), find(number[j])
        if a != b and jaccard(texts[i], texts[j]) >= SIMILAR:
            parent[a] = b
            found.append((nodes[i], nodes[j]))
    return found


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups (band, i, j) of sorted rows; a group may span batches."""
    key, group, links = None, [], []
    for batch in batches:
        for *at, node, part, side, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != key:
                links += forest(*zip(*group, strict=True)) if group else []
                key, group = at, []
            group.append((node, part, side, text))
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], LINKS)
        links = []
    if group:
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in forest(*zip(*group, strict=True))], LINKS)


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links among the members (band, node, part, size) of each bucket that connect its parts."""
    sums = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("words") / BLOCK_WORDS)).alias("k")
    rows = members.join(settle(sums.select("band", blocks), "blocks"), "band")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("node", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "part", F.col("block").alias("side"))
    rows = rows.join(texts, "node").select("band", "i", "j", "node", "part", "side", "text")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return settle(dealt.mapInArrow(compare_blocks, "a BINARY, b BINARY").distinct(), "links")


def links(found: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): one row per distinct text with words, and verified pairs that connect all similar ones."""
    nodes = found.where(F.col("node").isNotNull()).groupBy("node")
    nodes = nodes.agg(F.min(F.struct("doc_id", "rid")).alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = settle(nodes, "nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = settle(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "buckets")
    members = settle(members.join(buckets, "band").select("band", "n", "node", "size"), "members")
    # the most central member of a bucket is the one that shares the most buckets with the most others
    central = settle(members.groupBy("node").agg(F.sum("n").alias("rank")), "central")
    # every text that is compared below is fetched here, once, by its document
    wanted = settle(nodes.join(central, "node").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.rid").alias("rid")), "wanted")
    rows = docs.select(F.col("doc_id").alias("id"), identity(docs).alias("of"), F.col("text").cast("binary").alias("text"))
    # by shuffle at every size: the texts asked for grow with the corpus
    texts = rows.join(wanted.hint("merge"), (F.col("id") == F.col("doc_id")) & (F.col("of") == F.col("rid"))).select("node", "text")
    texts = settle(texts.dropDuplicates(["node"]), "texts")
    ranked = members.join(central, "node")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("rank", "node", "size")).alias("top"))
    leaders = settle(leaders.select("band", F.col("top.node").alias("leader"), F.col("top.size").alias("of")), "leaders")
    pairs = members.join(leaders, "band").where(F.col("node") != F.col("leader"))
    sized = F.least("size", "of") >= F.greatest("size", "of") * F.lit(SIMILAR)
    pairs = pairs.where(sized).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    edges = settle(pairs.where(overlap("text_a", "text_b")).select("a", "b"), "links")
    parts = settle(components(edges), "parts")
    # what is still apart inside a bucket is compared in full
    label = F.coalesce("component", "node").alias("part")
    labelled = settle(members.join(parts, "node", "left").select("band", "node", "size", label), "labelled")
    apart = labelled.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    apart = settle(apart.where(F.col("low") != F.col("high")).select("band"), "apart")
    more = block_links(settle(labelled.join(apart, "band"), "open"), texts)
    return nodes, settle(edges.unionByName(more), "edges")


def near_classes(docs: DataFrame) -> DataFrame:
    """(row, text, class_id, n_copies, first) for every row of ``docs``.

    ``class_id`` is the smallest doc_id of the class, ``n_copies`` the number of rows with the same words. ``first`` marks the row that stands for the
    class, and rows equal to it in id and text.
    """
    found = sketches(docs)
    nodes, edges = links(found, docs)
    parts = components(edges)
    copies = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"))
    known = nodes.select("node", "rep").join(copies, "node").join(parts, "node", "left")
    known = settle(known.withColumn("part", F.coalesce("component", "node")), "known")
    names = settle(known.groupBy("part").agg(F.min("rep").alias("head")), "names")
    named = known.join(names, "part").select("node", "head", "n_copies")
    per_row = found.select("doc_id", "rid", "node").distinct().join(settle(named, "named"), "node")
    per_row = per_row.select(F.col("doc_id").alias("id"), F.col("rid").alias("of"), "head", "n_copies")
    rows = packed(docs).withColumn("rid", identity(docs))
    joined = rows.join(per_row.hint("merge"), (F.col("row.doc_id") == F.col("id")) & (F.col("rid") == F.col("of")), "left")
    own = (F.col("head.doc_id") == F.col("row.doc_id")) & (F.col("head.rid") == F.col("rid"))
    return joined.select(
        "row",
        "text",
        F.coalesce("head.doc_id", "row.doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(own, F.lit(True)).alias("first"),
    )


def representatives(docs: DataFrame) -> DataFrame:
    """(row, text): one row of each class, the one with the smallest id.

    Rows equal in id and text are one document. So are rows without an id, or without words, only if all that is equal.
    """
    heads = near_classes(docs).where("first").select("row", "text", F.col("row.doc_id").alias("id"), F.xxhash64("text").alias("of"))
    return heads.dropDuplicates(["id", "of"]).select("row", "text")


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_classes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "class_id", "n_copies")
