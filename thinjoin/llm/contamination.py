"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items form one automaton. Each document's words stream through it: the current state is the
longest suffix read so far that stands in some item, so one pass finds every word inside a shared passage, however the
passage lies in item or document. Items are read in blocks of ``block_words`` words; each block is one broadcast of
known size and one pass over the documents, whatever the number of items.

Defined results: null and empty texts have no words and are never contaminated. An item without words matches nothing;
an item shorter than the window matches as a whole. Repeated items are all reported. Items without an id count like
others; all of them together are one null in ``items`` and add no name. Rows are judged one by one, so
repeated rows and null ids need no rule. Very long texts stream. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thinjoin.llm.common import map_text, packed, table

WINDOW = 13
#: Part of a document's words, in twentieths, from which it counts as contaminated.
COVERAGE = 20
BLOCK_WORDS = 1_000_000
#: Bytes to words: letters and digits and all of UTF-8 beyond ASCII stay, A-Z fall to lower case, the rest is blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that each window belongs to."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int):
        self.window, self.numbers = window, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        self.items: dict[int, list] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.least = window
        texts = []
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers)) for w in text.translate(NORMAL).split()]
            if words:
                texts.append((item, words))
                self.least = min(self.least, len(words))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        for item, words in texts:
            length = min(window, len(words))
            for state in self._windows(words, length):
                if len(words) >= window:
                    held = self.items.setdefault(state, [])
                    if not held or held[-1] != item:
                        held.append(item)
                else:
                    self.short.setdefault(state, []).append((length, item))
        self.nearest = self._nearest_short()

    def _add(self, edges: dict, size: int, link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """A copy of ``target`` for the words that end at ``at`` followed by ``word``."""
        copy = self._add(dict(self.next[target]), self.size[at] + 1, self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
        state, at = self._add({}, self.size[last] + 1, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[state] = target if self.size[target] == self.size[at] + 1 else self._split(at, word, target)
        return state

    def _nearest_short(self) -> list[int]:
        """Per state, the first state on its chain of suffixes (itself included) where a short item ends, else -1."""
        nearest = [-1] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            nearest[state] = state if state in self.short else nearest[self.link[state]]
        return nearest

    def walk(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        following, link, size = self.next, self.link, self.size
        state = length = 0
        for word in words:
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = following[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def _windows(self, words: list[int], length: int) -> Iterator[int]:
        for state, matched in self.walk(words):
            if matched >= length:
                yield self.shorten(state, length)

    def shorten(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what ``state`` stands for."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Runs [first, end) of words inside windows, and the items whose windows occur."""
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]])))
        runs: list[list[int]] = []
        found = set()
        window, nearest = self.window, self.nearest
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.least:
                continue
            for at, (state, length) in enumerate(self.walk(numbers[start:end].tolist()), start + 1):
                first = at
                if length >= window:
                    first = at - window
                    found.update(self.items.get(self.shorten(state, window), ()))
                ends = nearest[state]
                while ends >= 0:
                    for size, item in self.short[ends]:
                        if size <= length:
                            first = min(first, at - size)
                            found.add(item)
                    ends = nearest[self.link[ends]]
                if first < at:
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = at
                        while len(runs) > 1 and first <= runs[-2][1]:
                            runs[-2][1] = at
                            runs.pop()
                        runs[-1][0] = min(runs[-1][0], first)
                    else:
                        runs.append([first, at])
        return runs, found


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """(item_id as text, text) in blocks of about ``block_words`` words; one block at a time is on the driver."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    block, words = [], 0
    for row in rows.where(F.col("text").isNotNull()).toLocalIterator():
        block.append((row["item"], bytes(row["text"])))
        words += len(block[-1][1]) // 2 + 1
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def union(a: list, b: list) -> list[list[int]]:
    runs: list[list[int]] = []
    for first, end in sorted([*map(list, a), *map(list, b)]):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    return runs


def match_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, text, n_words, runs, items): word runs inside benchmark windows, and the ids of the items, as strings."""
    found = packed(docs)
    context = docs.sparkSession.sparkContext
    fields = "n_words BIGINT, runs ARRAY<ARRAY<BIGINT>>, items ARRAY<STRING>"
    types = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
    passes = []
    for block in item_blocks(items, block_words) if window > 0 else ():
        passes.append(context.broadcast(block))
    if not passes:
        passes.append(context.broadcast([]))
    for number, block in enumerate(passes):

        def work(block=block):
            automaton = Automaton(block.value, window)

            def handle(texts):
                counts, runs, names = [], [], []
                for text in texts:
                    words = text.translate(NORMAL).split() if text else []
                    matched, seen = automaton.match(words)
                    counts.append(len(words))
                    runs.append(matched)
                    names.append(sorted(seen, key=lambda item: (item is None, item or "")))
                return [pa.array(v, t) for v, t in zip((counts, runs, names), types, strict=True)]

            return handle

        if number:
            # the runs so far travel in the row and are merged after the pass
            before = F.struct(F.col("row").alias("row"), "runs", "items")
            later = map_text(found.select(before.alias("row"), "text"), work, fields)
            merged = F.udf(union, "array<array<bigint>>")
            found = later.select(
                "row.row",
                "text",
                "n_words",
                F.when(F.size("runs") == 0, F.col("row.runs")).otherwise(merged("row.runs", "runs")).alias("runs"),
                F.array_union("row.items", "items").alias("items"),
            )
        else:
            found = map_text(found, work, fields)
    return found


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_words: int = BLOCK_WORDS,
    longest: int | None = None,
) -> DataFrame:
    """(row, text, n_words, n_hit, items, contaminated, clean).

    ``contaminated``: at least one word, and one word in ``coverage``, lies in a window of an item. ``clean`` is the
    text without the bytes from the first to the last word of each run: of all runs for contaminated rows, of runs of
    ``longest`` words (the window, if not given) or more for the others, so that no long text keeps an item because of
    its length. Shorter runs, which only items shorter than the window leave by default, stay in those.
    """
    longest = window if longest is None else longest
    found = match_benchmark(docs, items, window, block_words)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    judged = found.withColumn("n_hit", n_hit)
    over = (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))
    gone = F.when(F.col("contaminated"), F.col("runs"))
    gone = gone.otherwise(F.filter("runs", lambda r: r[1] - r[0] >= longest))
    cut = F.when(F.size(gone) > 0, cut_runs("text", gone)).otherwise(F.col("text"))
    judged = judged.withColumn("contaminated", over)
    return judged.select("row", "text", "n_words", "n_hit", "items", "contaminated", cut.alias("clean"))


@F.pandas_udf(StringType())
def cut_runs(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """The text without the bytes of each run of words; a run leaves a line break."""

    def one(text, cuts):
        if text is None or cuts is None or not len(cuts):
            return text
        raw = text.encode()
        spans = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
        at, parts = 0, []
        for first, end in cuts:
            parts.append(raw[at : spans[first][0]])
            at = spans[end - 1][1]
        parts.append(raw[at:])
        return b"\n".join(parts).decode()

    return pd.Series([one(t, r) for t, r in zip(texts, runs, strict=True)])


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
wanted AS (SELECT DISTINCT n, win FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)
), hits AS (SELECT doc_id, n, i, win FROM places JOIN wanted USING (n, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN windows USING (n, win)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
