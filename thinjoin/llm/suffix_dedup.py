"""Removal of long strings that occur more than once, by merging Burrows-Wheeler transforms.

Texts are byte strings; a start is repeated if the ``LENGTH`` bytes from it also start anywhere else. Starts are put
into domains: runs of consecutive starts whose windows have the same smallest ``GRAM``-byte hash (a minimiser). Equal
windows have equal minimisers, so three steps decide all starts:

1. Minimisers are counted over the corpus. A domain whose minimiser occurs nowhere else has no repeated start.
2. Domains with equal bytes (compared by hash, aggregated before the shuffle) are repeated as a whole. Most of what
   copies share ends here, without moving a byte of text.
3. What is left are the domains at the borders of copied passages. Their bytes meet by minimiser, one of each content.
   A task reads them as strings of ``STEP``-byte symbols in all phases, builds a transform per shard, and merges the
   transforms: each pass carries the interleaving of the shards' suffixes one symbol further by a stable counting of
   the preceding symbols, without sorting suffixes again. Block borders that appear in pass d have a common prefix of
   d - 1 symbols; blocks that hold two starts after ``LENGTH / STEP`` passes are the repeated intervals.

Texts are hashed once; their domains are stored and counted from there. Minimisers whose open domains have more than
``GROUP_BYTES`` (the edge of a passage that stands in a large part of the corpus, a run of one byte) are decided exactly
in another way: their windows are counted by 128-bit hash across the cluster. So the bytes that a task merges are bounded.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing. Rows equal in all columns are two
documents, so all their windows repeat. Ids may be null or repeated. An empty table gives no rows. Extra columns pass
through. Very long texts are scanned in pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thinjoin.llm.common import map_text, packed, table
from thinjoin.session import settle

LENGTH = 200
GRAM = 100
#: Windows' starts over which a minimiser is taken.
SPAN = LENGTH - GRAM + 1
STEP = 50
SHARDS = 4
#: Bytes of one minimiser's open domains that a task merges; the windows of more are counted across the cluster.
GROUP_BYTES = 1 << 18
#: Bytes of open domains that are merged at once, at some hundred times their size in memory, and that a task is dealt.
MERGE_BYTES = 1 << 20
TASK_BYTES = 1 << 21
SLICE = 1 << 20
#: Bit of a place, above the size of any domain: the minimiser may stand in the domain twice.
TWICE = 1 << 23

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xD6E8FEB86659FD93)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all windows of ``length`` bytes; mixed."""
    current, power, size = data.astype(np.uint64) + np.uint64(1), base, 1
    found, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if found is None:
                    found = current
                else:
                    n = len(data) - done - size + 1
                    found = found[:n] * power + current[done : done + n]
                done += size
            if done == length:
                return mix(found)
            current = current[: len(current) - size] * power + current[size:]
            power, size = power * power, size * 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    low, covered = values, 1
    while covered < width:
        step = min(covered, width - covered)
        low = np.minimum(low[: len(low) - step], low[step:])
        covered += step
    return low


def domains(text: bytes) -> tuple[np.ndarray, ...]:
    """(start, size, minimiser, content hash, whether the minimiser may stand in it twice) of the domains of a text."""
    empty = np.zeros(0, np.int64)
    if len(text) < LENGTH:
        return empty, empty, empty, empty, empty
    data = np.frombuffer(text, np.uint8)
    grams = window_hashes(data, GRAM, A)
    low = sliding_min(grams, SPAN)
    whole = window_hashes(data, LENGTH, B)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[first, len(low)])
    with np.errstate(over="ignore"):
        content = mix(whole[first] * A + mix(whole[first + size - 1] + A) + size.astype(np.uint64))
    # bytes between the first and the last window count too where a domain is longer than both
    for i in np.flatnonzero(size > LENGTH):
        inner = text[first[i] : first[i] + size[i] + LENGTH - 1]
        content[i] = np.uint64(int.from_bytes(hashlib.blake2b(inner, digest_size=8).digest(), "little"))
    # a gram is a minimiser if it equals the largest minimum of the windows around it
    edge = np.zeros(SPAN - 1, np.uint64)
    least = TOP - sliding_min(TOP - np.r_[edge, low, edge], SPAN)
    held = np.flatnonzero(grams == least)
    twins = np.r_[0, np.cumsum(grams[held][1:] == grams[held][:-1])]
    begin = np.searchsorted(held, first)
    end = np.searchsorted(held, first + size - 1 + SPAN)
    twice = twins[np.maximum(end - 1, begin)] > twins[begin]
    return first, size, low[first].view(np.int64), content.view(np.int64), twice


def pieces(text: bytes | None) -> Iterator[tuple[int, bytes]]:
    """Parts of a text that overlap by a window less one byte, so that each start is in one part."""
    text = text or b""
    for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
        yield at, text[at : at + SLICE + LENGTH - 1]


def described(texts: list[bytes | None]) -> list[pa.Array]:
    """Per text its domains as three lists: minimiser, content, place (start, ``TWICE`` and size in one number)."""
    lists: list[list] = [[], [], []]
    for text in texts:
        found = ((at, domains(p)) for at, p in pieces(text))
        parts = [(g, c, ((at + s) << 24) + np.where(t, TWICE, 0) + n) for at, (s, n, g, c, t) in found]
        for kept, some in zip(lists, zip(*parts, strict=True), strict=True):
            kept.append(np.concatenate(some))
    return [pa.array(x, pa.list_(pa.int64())) for x in lists]


def shard_transform(codes: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(preceding symbol, string, position) of a shard's suffixes in suffix order.

    A string of n symbols in ``STEP`` phases is ``STEP`` chains; each chain ends with the terminator 0, which stands at
    position n + phase.
    """
    string = np.repeat(np.arange(len(codes)), [len(c) + STEP for c in codes])
    place = np.concatenate([np.arange(len(c) + STEP) for c in codes])
    symbol = np.concatenate([np.r_[c, np.zeros(STEP, np.int64)] for c in codes])
    ends = np.repeat([len(c) for c in codes], [len(c) + STEP for c in codes])
    n = len(symbol)
    after = np.where(place < ends, np.arange(n) + STEP, -1)
    rank, span = symbol + 1, 1
    while True:
        # ranks by the first ``span`` symbols double until all chains are read to their end
        following = np.where(after >= 0, rank[after], 0)
        rank = np.unique(rank * (int(rank.max()) + 1) + following, return_inverse=True)[1] + 1
        after, span = np.where(after >= 0, after[after], -1), span * 2
        if not (after >= 0).any():
            break
    order = np.lexsort((place % STEP, string, rank))
    before = np.where(place >= STEP, symbol[np.maximum(np.arange(n) - STEP, 0)], 0)
    return before[order], string[order], place[order]


def merge(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, block) of the merged suffixes: ordered, and put into blocks, by their first ``passes`` symbols."""
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(transforms)), sizes)
    block = np.zeros(len(shard), np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = np.concatenate(transforms)
    for _ in range(passes):
        nth = np.empty(len(shard), np.int64)
        for k, size in enumerate(sizes):
            nth[shard == k] = starts[k] + np.arange(size)
        symbol = joined[nth]
        order = np.argsort(symbol, kind="stable")
        shard, block, symbol = shard[order], block[order], symbol[order]
        block = np.cumsum(np.r_[0, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])])
    return shard, block


def repeated_starts(strings: list[bytes], sizes: list[int], several: list[bool]) -> list[np.ndarray]:
    """Per string, the starts below its size whose window occurs at another start of these strings.

    ``several`` marks strings that stand for more than one occurrence.
    """
    hashes = [window_hashes(np.frombuffer(s, np.uint8), STEP, A) for s in strings]
    values, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    codes = np.split(codes + 1, np.cumsum([len(h) for h in hashes])[:-1])
    groups = [g for g in (list(range(k, len(strings), SHARDS)) for k in range(SHARDS)) if g]
    shards = [shard_transform([codes[i] for i in g], len(values)) for g in groups]
    shard, block = merge([s[0] for s in shards], LENGTH // STEP)
    number, place = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for k, (g, (_, string, at)) in enumerate(zip(groups, shards, strict=True)):
        number[shard == k], place[shard == k] = np.array(g)[string], at
    starts = place < np.array(sizes)[number]
    weight = starts * (1 + np.array(several, np.int64)[number])
    held = np.bincount(block, weight)[block] > 1
    hit = starts & held
    order = np.lexsort((place[hit], number[hit]))
    return np.split(place[hit][order], np.searchsorted(number[hit][order], np.arange(1, len(strings))))


OPEN = "gram BIGINT, id BIGINT, rid BIGINT, start BIGINT, size BIGINT, several BOOLEAN, string BINARY"
FOUND = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("starts", pa.list_(pa.int64()))])


def merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts of sorted open domains; a group of one minimiser is never cut."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = repeated_starts([r[6] for r in held], [r[4] for r in held], [r[5] for r in held])
        rows = [(r[1], r[2], s + r[3]) for r, s in zip(held, found, strict=True) if len(s) and not r[5]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(FOUND)], schema=FOUND)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size >= MERGE_BYTES and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush()


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per start of each open domain: 128 bits of its window."""
    names = ["id", "rid", "start", "several", "w1", "w2"]
    for batch in batches:
        for _, id_, rid, start, size, several, string in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = np.frombuffer(string, np.uint8)
            w1, w2 = (window_hashes(data, LENGTH, b)[:size].view(np.int64) for b in (A, B))
            same = [pa.array(np.full(size, v)) for v in (id_, rid)]
            rest = [pa.array(start + np.arange(size)), pa.array(np.full(size, several)), pa.array(w1), pa.array(w2)]
            yield pa.RecordBatch.from_arrays([*same, *rest], names=names)


def cut(text: bytes | None, ranges: list, starts: list) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, runs removed) given repeated starts as (start, size) ranges and singly."""
    text = text or b""
    steps = np.zeros(len(text) + 1, np.int64)
    for place in ranges or ():
        begin, size = place >> 24, place & 0xFFFFFF
        steps[begin] += 1
        steps[begin + size + LENGTH - 1] -= 1
    if starts is not None and len(starts):
        single = np.asarray(starts, np.int64)
        np.add.at(steps, single, 1)
        np.add.at(steps, single + LENGTH, -1)
    gone = np.cumsum(steps[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))


RESULT = "n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept BINARY"


def finished(with_text: bool):
    """Rows (row, text, ranges, starts, open): results of those that are not open; open ones keep their text."""
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "ranges", "starts", "open")]
            rows, texts = [], []
            for text, ranges, starts, is_open in zip(*columns, strict=True):
                if is_open:
                    rows.append((None,) * 5)
                else:
                    kept, n_removed, n_spans = cut(text, ranges, starts)
                    rows.append((len(text or b""), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                texts.append(text if is_open else None)
            results = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
            fixed = [batch.column("row"), pa.array(texts, pa.binary()), batch.column("ranges"), batch.column("open")]
            yield pa.RecordBatch.from_arrays([*fixed, *results], names=["row", "text", "ranges", "open", *schema.names])

    return run


def close(rows: DataFrame, with_text: bool) -> DataFrame:
    fixed = StructType.fromDDL("text BINARY, ranges ARRAY<BIGINT>, open ARRAY<STRUCT<gram: BIGINT, place: BIGINT, several: BOOLEAN>>")
    schema = StructType([*rows.select("row").schema.fields, *fixed.fields, *StructType.fromDDL(RESULT).fields])
    columns = rows.select("row", F.col("text").cast("binary").alias("text"), "ranges", "starts", "open")
    return columns.mapInArrow(finished(with_text), schema)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept): what stays of each text; ``kept`` only if asked for."""
    keys = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("rid"), "text")
    held = map_text(packed(keys), lambda: described, "grams ARRAY<BIGINT>, contents ARRAY<BIGINT>, places ARRAY<BIGINT>")
    held = settle(held.select("row.id", "row.rid", "grams", "contents", "places").where(F.size("grams") > 0), "domains")
    counted = held.select(F.explode(F.arrays_zip("grams", "places")).alias("d"))
    weight = 1 + F.shiftright("d.places", 23).bitwiseAND(1)
    shared = counted.groupBy(F.col("d.grams").alias("gram")).agg(F.sum(weight).alias("n")).where(F.col("n") > 1).select("gram")
    shared = settle(shared, "shared-minimisers")
    each = held.select("id", "rid", F.explode(F.arrays_zip("grams", "contents", "places")).alias("d"))
    place = F.col("d.places").bitwiseAND(F.lit(~TWICE)).alias("place")
    each = each.select("id", "rid", F.col("d.grams").alias("gram"), F.col("d.contents").alias("content"), place)
    each = settle(each.join(shared.hint("merge"), "gram"), "shared-domains")
    contents = each.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rid", "place")).alias("first"))
    contents = settle(contents, "contents")
    repeated = settle(contents.where(F.col("n") > 1).select("gram", "content"), "repeated-contents")
    ranges = each.join(repeated, ["gram", "content"]).groupBy("id", "rid").agg(F.collect_set("place").alias("ranges"))
    size = F.col("first.place").bitwiseAND(0xFFFFFF) + (LENGTH - 1)
    open_grams = contents.groupBy("gram").agg(F.min("n").alias("least"), F.sum(size).alias("bytes"))
    open_grams = settle(open_grams.where(F.col("least") == 1).select("gram", "bytes"), "open-minimisers")
    asked = settle(contents.join(open_grams, "gram").select("gram", "n", "first"), "open-domains")
    wanted = asked.groupBy(F.col("first.id").alias("id"), F.col("first.rid").alias("rid")).agg(
        F.collect_set(F.struct("gram", F.col("first.place").alias("place"), (F.col("n") > 1).alias("several"))).alias("open")
    )
    notes = settle(ranges.join(wanted, ["id", "rid"], "full").withColumnsRenamed({"id": "of_id", "rid": "of_rid"}), "notes")
    rows = packed(docs).withColumns({"id": F.coalesce("row.doc_id", F.lit(-(1 << 63))), "rid": F.xxhash64("text")})
    # by shuffle at every size: what is asked about texts grows with the corpus
    noted = rows.join(notes.hint("merge"), (F.col("id") == F.col("of_id")) & (F.col("rid") == F.col("of_rid")), "left")
    none = F.lit(None).cast("array<bigint>").alias("starts")
    first = settle(close(noted.select("row", "text", "ranges", none, "open"), with_text), "closed-and-open")
    results = [c.split()[0] for c in RESULT.split(", ")]
    closed = first.where(F.col("open").isNull()).select("row", *results)
    still = first.where(F.col("open").isNotNull()).withColumns({"id": F.coalesce("row.doc_id", F.lit(-(1 << 63))), "rid": F.xxhash64(F.col("text").cast("string"))})
    starts = open_starts(still, open_grams)
    starts = settle(starts.groupBy("id", "rid").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "repeated-starts")
    starts = starts.withColumnsRenamed({"id": "of_id", "rid": "of_rid"})
    again = still.join(starts.hint("merge"), (F.col("id") == F.col("of_id")) & (F.col("rid") == F.col("of_rid")), "left")
    again = again.select("row", "text", "ranges", "starts", F.lit(None).cast(still.schema["open"].dataType).alias("open"))
    return closed.unionByName(close(again, with_text).select("row", *results))


def open_starts(still: DataFrame, open_grams: DataFrame) -> DataFrame:
    """(id, rid, starts): the repeated starts of open domains."""
    asked = still.dropDuplicates(["id", "rid"]).select("id", "rid", "text", F.explode("open").alias("o"))
    start, size = F.shiftright("o.place", 24), F.col("o.place").bitwiseAND(0xFFFFFF)
    string = F.substring(F.col("text"), (start + 1).cast("int"), (size + LENGTH - 1).cast("int"))
    strings = asked.select(F.col("o.gram").alias("gram"), "id", "rid", start.alias("start"), size.alias("size"), F.col("o.several").alias("several"), string.alias("string"))
    strings = settle(strings.join(open_grams, "gram"), "open-strings")
    small = strings.where(F.col("bytes") <= GROUP_BYTES).drop("bytes")
    total = small.agg(F.coalesce(F.sum(F.length("string")), F.lit(0))).first()[0]
    dealt = small.repartition(1 + total // TASK_BYTES, "gram").sortWithinPartitions("gram")
    merged = dealt.mapInArrow(merge_groups, "id BIGINT, rid BIGINT, starts ARRAY<BIGINT>")
    large = strings.where(F.col("bytes") > GROUP_BYTES).drop("bytes")
    windows = settle(large.mapInArrow(window_rows, "id BIGINT, rid BIGINT, start BIGINT, several BOOLEAN, w1 BIGINT, w2 BIGINT"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("n")).where(F.col("n") > 1)
    twice = settle(twice.select("w1", "w2"), "repeated-windows")
    counted = windows.where(~F.col("several")).join(twice, ["w1", "w2"]).groupBy("id", "rid").agg(F.collect_list("start").alias("starts"))
    return merged.unionByName(counted)


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
