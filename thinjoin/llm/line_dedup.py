"""Line dedup: keep each line only in the first document that holds it.

Lines are replaced by 128-bit hashes of their keys; no text is shuffled to find duplicates. A line's first document is
the minimum over its hash, and a join with it marks the later ones; the sort by range that stands before both is not read
as a stream. What comes back per document is a compressed bitmap of its lines; the text is only touched when a caller
applies it.

Defined results: a null or empty text is one empty line. Rows without ``doc_id`` count as no document and lose nothing.
Rows equal in ``doc_id`` and text share one bitmap; rows of one ``doc_id`` with different texts are one document with a
bitmap each. Ties cannot occur: all lines of a key stay in its smallest ``doc_id``. An empty table gives no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import identity, packed, table
from thinjoin.session import settle

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LENGTH = 10
#: Lines per entry of a bitmap.
WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased. Pure ASCII takes the fast way to the same letters."""
    stripped = F.btrim(line, F.lit(BLANK))
    plain = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, UPPER.lower()))


def line_hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, doc_id, rid, pos) of every line whose key has at least ``min_length`` code points."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", identity(docs).alias("rid"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "rid", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_length)
    hashes = (F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    return keyed.select(*hashes, "doc_id", "rid", "pos")


def drop_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per (doc_id, rid) with lines to drop: ``drops`` maps pos div 64 to a word of bits, ``n_dropped`` counts them.

    Words without a bit are left out, so a document costs what it loses, not what it holds.
    """
    hashes = settle(line_hashes(docs, min_length), "line-hashes")
    order = ["h1", "h2", "doc_id", "pos"]
    ordered = hashes.repartitionByRange(*order).sortWithinPartitions(*order)
    first = ordered.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # as a table of its own: the join below then stands on two plain exchanges, and Spark splits a line found everywhere
    first = settle(first.where(F.col("last") > F.col("first")).drop("last"), "first-lines")
    later = ordered.join(first, ["h1", "h2"]).where(F.col("doc_id") > F.col("first"))
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = later.groupBy("doc_id", "rid", F.expr(f"pos div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "rid").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"),
        F.sum(F.bit_count("bits")).alias("n_dropped"),
    )


def keeps(drops: Column, pos: Column) -> Column:
    word = F.coalesce(F.try_element_at(drops, F.floor(pos / WORD)), F.lit(0).cast("long"))
    return F.getbit(word, pos % WORD) == 0


def line_dedup(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per row of ``docs``: (row, text, n_lines, n_dropped, kept), kept being the lines that stay.

    A text that loses nothing is returned as it is, so null stays null.
    """
    rows = packed(docs).withColumn("rid", identity(docs))
    bitmaps = drop_bitmaps(docs, min_length).withColumnsRenamed({"doc_id": "id", "rid": "of_text"})
    same = (F.col("row.doc_id") == F.col("id")) & (F.col("rid") == F.col("of_text"))
    lines = lines_of(F.col("text"))
    kept = F.array_join(F.filter(lines, lambda _, i: keeps(F.col("drops"), i)), "\n")
    return rows.join(bitmaps, same, "left").select(
        "row",
        "text",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    return found.select("row.doc_id", "n_lines", "n_dropped", digest)


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
