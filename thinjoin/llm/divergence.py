"""Divergence between the sources of a language, from a k-squared quadtree over the matrix of groups and terms.

A group is a (language, source); its row of the matrix counts the terms that the language keeps. A smoothed frequency
is ``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))`` and two of them differ by ``floor((p - q)^2 / (p + q))``. Most cells are
zero, and two groups differ by the same amount wherever both have zero. So the matrix is cut into quadrants, quadrants
into quadrants, down to leaves of ``LEAF`` cells a side, and only those that hold something are kept, as one bit per child
and ranks over the bits. Pairs of groups go down the tree together: where a quadrant is all zero for both, its columns
are priced at once, by their number; cells are compared where one of the two has a leaf.

The matrix is dealt to tasks as tiles of about ``TILE`` groups by blocks of about ``BLOCK`` terms; a task builds the
tree of two tiles and a block and adds up the pairs between them. What it holds is bounded by those numbers, whatever
the size of a group, a language or the vocabulary. Counts are summed within tasks before they are shuffled.

Defined results: null text, language and source are empty ones. A group without terms takes part with counts of zero;
a language without kept terms gives pairs of value 0. Repeated rows count as often as they occur, and as a document each.
Ties are ranked by the item's bytes. An empty table gives no rows. Columns other than those three are not read. Texts of any length
are counted whole. Totals of a group from 2^53 on are divided in Python's integers, others in 64 bits, with equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thinjoin.llm.common import table, text_bytes
from thinjoin.session import settle

SCALE = 1_000_000_000
#: Documents of a language that a kept term is found in.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
TILE = 128
BLOCK = 4096
#: Cells on a side of the tree's leaves.
LEAF = 16
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD_COUNTS = 200_000
#: Cells that pairs going down the tree may reach at a time.
FRONTIER = 1 << 20
#: Bytes that belong to terms stay, A-Z in lower case; all others are blanks.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
COUNTS = "lang STRING, source STRING, term BINARY, n BIGINT, documents BIGINT"
FOUND = "part STRING, lang STRING, source STRING, item STRING, value BIGINT, width BIGINT, zero BIGINT, terms BIGINT"


# ---------------------------------------------------------------- counts


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS``: terms of a group in this task, and one row without term for every group."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def handed_on() -> pa.RecordBatch:
        rows = [(lang, source, None, 0, 0) for lang, source in counts]
        rows += [(*group, term, n, held[term]) for group, (found, held) in counts.items() for term, n in found.items()]
        counts.clear()
        types = pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()
        names = "lang", "source", "term", "n", "documents"
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or b"").translate(TERM_BYTES).split()
            found, held = counts.setdefault((lang, source), (Counter(), Counter()))
            size -= len(found)
            found.update(words)
            held.update(set(words))
            size += len(found)
            if size > HELD_COUNTS:
                yield handed_on()
                size = 0
    yield handed_on()


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of every group and term; a row without term for each group."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = text_bytes(docs.select(*groups, "text"), "lang", "source")
    counted = rows.mapInArrow(count_terms, COUNTS).withColumn("term", F.col("term").cast("string"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


# ---------------------------------------------------------------- the tree


class Quadtree:
    """Nonzero quadrants of a matrix, level by level, as child bits with ranks; quadrants of ``LEAF`` cells a side at the end.

    A cell is (row, column, p); cells that are not given are zeros, whose p is that of their row in ``zero``. A leaf
    holds the p of all its cells.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, p: np.ndarray, zero: np.ndarray, width: int):
        self.width, self.zero = width, zero
        side = -(-max(len(zero), width, 1) // LEAF)
        self.levels = int(side - 1).bit_length()
        place = np.zeros(len(rows), np.int64)
        for bit in range(self.levels):
            place |= ((rows // LEAF >> bit & 1) << (2 * bit + 1)) | ((columns // LEAF >> bit & 1) << (2 * bit))
        below, leaf = np.unique(place, return_inverse=True)
        first = np.zeros((len(below), 2), np.int64)  # the leaves' first rows and columns
        first[leaf, 0], first[leaf, 1] = rows // LEAF * LEAF, columns // LEAF * LEAF
        own = first[:, :1] + np.arange(LEAF)
        self.p = np.repeat(np.append(zero, 1)[np.minimum(own, len(zero))][:, :, None], LEAF, axis=2)
        self.p[leaf, rows % LEAF, columns % LEAF] = p
        self.held = np.zeros(self.p.shape, bool)
        self.held[leaf, rows % LEAF, columns % LEAF] = True
        self.bits: list[np.ndarray] = []
        for _ in range(self.levels):
            nodes, parent = np.unique(below >> 2, return_inverse=True)
            bits = np.zeros(4 * len(nodes), bool)
            bits[4 * parent + (below & 3)] = True
            self.bits.append(bits)
            below = nodes
        self.ranks = [np.cumsum(bits) - 1 for bits in self.bits]
        self.empty = not len(rows)

    def child(self, level: int, node: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """The child of each node in quadrant ``digit``; -1 where there is none, or no node."""
        if self.empty:
            return node
        at = 4 * np.maximum(node, 0) + digit
        return np.where((node >= 0) & self.bits[level][at], self.ranks[level][at], -1)

    def row(self, leaf: np.ndarray, row: np.ndarray) -> np.ndarray:
        """p of the ``LEAF`` cells that a row has in a leaf; of as many zeros without one."""
        if self.empty:
            return np.repeat(self.zero[row][:, None], LEAF, axis=1)
        return np.where((leaf >= 0)[:, None], self.p[leaf, row % LEAF], self.zero[row][:, None])

    def together(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``one`` and ``two`` go down together, pair by pair.

        Returns the columns of each pair in quadrants that are all zero for both (a number), and for the leaves where
        one is not: the number of the pair, the first column and the leaf of either row (-1 for none).
        """
        zeros = np.zeros(len(one), np.int64)
        pair, column = np.arange(len(one)), np.zeros(len(one), np.int64)
        left = right = np.full(len(one), -1 if self.empty else 0, np.int64)
        for level in range(self.levels, -1, -1):
            if level < self.levels:
                pair, column = np.repeat(pair, 2), np.repeat(column * 2, 2)
                column[1::2] += 1
                side = column & 1
                left = self.child(level, np.repeat(left, 2), (one[pair] // LEAF >> level & 1) * 2 + side)
                right = self.child(level, np.repeat(right, 2), (two[pair] // LEAF >> level & 1) * 2 + side)
            uniform = (left < 0) & (right < 0)
            first = column[uniform] * LEAF << level
            np.add.at(zeros, pair[uniform], np.clip(self.width - first, 0, LEAF << level))
            pair, column, left, right = (a[~uniform] for a in (pair, column, left, right))
        return zeros, pair, column * LEAF, left, right


def frequency(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / whole)``, by long division in thousands; count + 2 is at most whole."""
    if len(whole) and int(whole.max()) >= 1 << 53:
        return np.array([1 + SCALE * (int(c) + 2) // int(w) for c, w in zip(count, whole, strict=True)], np.int64)
    found, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + digits
    return found + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare_tiles(key: tuple, unit: pa.Table) -> pa.Table:
    """Rows of ``FOUND`` of two tiles of groups and a block of terms.

    The unit has the cells (source, term, n), the totals of the groups (no term), and in a tile with itself the
    language's own counts (no source). Pairs are given once, with what they differ by over the terms seen here, the
    number of those terms and what they differ by where both are zero; the terms of a group, as many as may be ranked.
    """
    lang, low, high, _ = (k.as_py() for k in key)
    unit = unit.combine_chunks()
    is_head = pc.is_null(unit.column("term"))
    heads, cells = unit.filter(is_head), unit.filter(pc.invert(is_head))
    names, terms = heads.column("source").to_pylist(), heads.column("terms")[0].as_py()
    tile = heads.column("tile").to_numpy()
    whole = heads.column("n").to_numpy() + 2 * terms
    rows = pc.index_in(cells.column("source"), heads.column("source").combine_chunks()).to_numpy().astype(np.int64)
    counts = cells.column("n").to_numpy()
    coded = pc.dictionary_encode(cells.column("term").combine_chunks().cast(pa.binary()))
    seen, columns = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    # frequent terms first: zeros then lie together
    often = np.zeros(len(seen), np.int64)
    np.add.at(often, columns, counts)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(seen), np.int64)
    place[order] = np.arange(len(seen))
    columns, seen = place[columns], [seen[i] for i in order]
    width = len(seen)
    zero = frequency(np.zeros(len(names), np.int64), whole) if terms else np.ones(len(names), np.int64)
    tree = Quadtree(rows, columns, frequency(counts, whole[rows]), zero, width)

    groups = np.array([r for r, name in enumerate(names) if name is not None], np.int64)
    if low == high:
        a, b = np.triu_indices(len(groups), 1)
        one, two = groups[a], groups[b]
    else:
        left, right = groups[tile[groups] == low], groups[tile[groups] == high]
        one, two = np.repeat(left, len(right)), np.tile(right, len(left))
    apart = gap(zero[one], zero[two]) if terms else 0 * one
    inside = np.arange(LEAF)
    found: list[tuple] = []
    step = max(1, FRONTIER // max(1, width))
    for at in range(0, len(one), step):
        g, h, z = one[at : at + step], two[at : at + step], apart[at : at + step]
        zeros, pair, first, x, y = tree.together(g, h)
        value = zeros * z
        cell = gap(tree.row(x, g[pair]), tree.row(y, h[pair])) * (first[:, None] + inside < width)
        np.add.at(value, pair, cell.sum(axis=1))
        found += [("pair", lang, names[i], names[j], int(v), width, int(u), terms) for i, j, v, u in zip(g, h, value, z, strict=True)]
    if low == high and None in names and width:
        by_bytes = np.empty(width, np.int64)
        by_bytes[sorted(range(width), key=seen.__getitem__)] = np.arange(width)
        for at in range(0, len(groups), step):
            g = groups[at : at + step]
            own = np.full(len(g), names.index(None), np.int64)
            _, pair, first, x, y = tree.together(g, own)
            p, q = tree.row(x, g[pair]), tree.row(y, own[pair])
            more = (x >= 0)[:, None] & tree.held[x, g[pair] % LEAF] & (p > q)
            at_leaf, at_cell = np.nonzero(more)
            pair, column, value = pair[at_leaf], first[at_leaf] + at_cell, gap(p[more], q[more])
            order = np.lexsort((by_bytes[column], -value, pair))
            pair, column, value = pair[order], column[order], value[order]
            rank = np.arange(len(pair)) - np.searchsorted(pair, pair)
            for i in np.flatnonzero(rank < TOP_TERMS):
                found.append(("term", lang, names[g[pair[i]]], seen[column[i]].decode(), int(value[i]), 0, 0, terms))
    types = [pa.string()] * 4 + [pa.int64()] * 4
    columns = zip(*found, strict=True) if found else [()] * 8
    fields = [f.split()[0] for f in FOUND.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=fields)


# ---------------------------------------------------------------- the audit


def part_of(name: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(name), parts).cast("int")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) for the groups of ``docs``.

    Part ``pair``: the group's difference from each other source of the language, over all kept terms. Part ``term``: the
    ten kept terms that set it apart most from its language as a whole, of those that it uses more.
    """
    cells = settle(group_terms(docs), "group-terms")
    named = cells.where(F.col("term").isNotNull())
    kept = named.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("documents").alias("documents"))
    kept = settle(kept.where(F.col("documents") >= least).drop("documents"), "kept-terms")
    named = settle(named.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "kept-cells")
    totals = named.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = cells.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = settle(groups.fillna(0, ["n"]), "group-totals")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("whole"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(sizes, "lang", "left").fillna(0)
    langs = settle(
        langs.select(
            "lang",
            "terms",
            "whole",
            F.ceil(F.col("groups") / TILE).cast("int").alias("tiles"),
            F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)).cast("int").alias("blocks"),
        ),
        "langs",
    )
    parts = langs.select("lang", "terms", "tiles", "blocks")
    tile, block = part_of(F.col("source"), F.col("tiles")), part_of(F.col("term"), F.col("blocks"))
    none = F.lit(None).cast("string")
    tiles, blocks = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("tiles", "blocks"))
    unit = ["lang", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "block"]
    row = [*unit, "source", "term", "n", "tile", "terms"]

    def met(rows: DataFrame) -> DataFrame:
        """Every row once for each tile that its own is compared with."""
        return rows.withColumn("other", tiles).select(*row)

    held = met(named.join(parts, "lang").withColumn("tile", tile).withColumn("block", block))
    heads = met(groups.join(parts, "lang").withColumn("tile", tile).withColumn("block", blocks).withColumn("term", none))
    own = kept.join(parts, "lang").withColumnRenamed("whole", "n").withColumn("block", block).withColumn("source", none)
    whole = langs.withColumnRenamed("whole", "n").withColumn("block", blocks).withColumn("source", none).withColumn("term", none)
    own = [r.withColumn("tile", tiles).withColumn("other", F.col("tile")).select(*row) for r in (own, whole)]
    rows = held.unionByName(heads).unionByName(own[0]).unionByName(own[1])
    found = settle(rows.groupBy("lang", "low", "high", "block").applyInArrow(compare_tiles, FOUND), "compared")

    pairs = found.where(F.col("part") == "pair").groupBy("lang", "source", "item", "terms")
    pairs = pairs.agg(F.sum("value").alias("value"), F.sum("width").alias("width"), F.max("zero").alias("zero"))
    value = (F.col("value") + (F.col("terms") - F.col("width")) * F.col("zero")).alias("value")
    pairs = pairs.select("lang", "source", "item", value)
    back = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = pairs.unionByName(back).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    words = found.where(F.col("part") == "term").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(words).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents").select("text", "lang", "source"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text
  FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}
), langs AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang
), cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM texts
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS whole FROM groups g LEFT JOIN cells c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.whole + 2 * l.v) AS p,
         1 + ({SCALE}::HUGEINT * (k.n + 2)) // (l.whole + 2 * l.v) AS own
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs q ON q.lang = a.lang AND q.source = a.source AND q.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - own) * (p - own) // (p + own) FROM p WHERE n > 0 AND p > own
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
