"""Quality rules, line first: judge every line, take the failing lines out, then reject documents that lose too much.

A line goes if one of the line rules names it; a document goes if less than ``keep_share`` of its word characters is
left. Repetition is judged in windows of a line and boilerplate by its share, so that a line does not fail by its length.
Documents are judged in one pass over the whole text without a shuffle.

Defined results: a null or empty text has no words, fails the base test and keeps its (null or empty) text. Lines
without a word are neutral: they stay and count for nothing. Rows are judged one by one, so repeated rows, ties and null
ids need no rule. Other columns pass through. Very long texts are handled whole, at a few times their size in memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from thinjoin.llm.common import map_text, packed, table

BLANK = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
TERMINAL = (b".", b"!", b"?", b";", b":", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xe2\x80\x99", b"\xc2\xbb")
MIN_WORDS = 10
#: Per cent of words in repeated five-word windows above which the base test fails.
MAX_REPEATED = 20
#: Share of a document's word characters that must be left.
KEEP_SHARE = 0.4
#: A line longer than this is judged for repetition by windows of so many words.
REPETITION_WINDOW = 100
#: Words of a line for each word of boilerplate from which a phrase no longer fails the line.
BOILERPLATE_SHARE = 20
BOILERPLATE = re.compile(
    rb"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies"
    rb"|enable javascript|licen[sc]ed under|lorem ipsum|subscribe to our|sign up for|click here|powered by"
    rb"|copyright (?:\(c\)|\xc2\xa9|\d{4}))"
)
MENU = frozenset(b"home about contact login logout register search menu next previous back share print faq sitemap".split())
FIELDS = (
    "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, "
    "base_failed BOOLEAN, kept BOOLEAN, n_lines BIGINT, n_removed_lines BIGINT, removed_by MAP<STRING, BIGINT>, clean STRING"
)


def code_points(raw: bytes) -> int:
    """Characters of ``raw`` that are not blank."""
    return len(raw.translate(None, BLANK + CONTINUATION))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base = len(numbers)
    code, top = ids[:n].copy(), base
    for k in range(1, size):
        if top * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = int(code.max()) + 1
        code = code * base + ids[k : k + n]
        top *= base
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.searchsorted(twice, code)
    found = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == code)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + size, -1)
    return int(np.count_nonzero(np.cumsum(steps)))


def is_repetitive(words: list[bytes], size: int = REPETITION_WINDOW) -> bool:
    """Few distinct words for the number of words, which says nothing of a long line as a whole: there, windows decide.

    A long line fails if half of its words lie in windows with few distinct words, or if there are few in all of it
    and half of it is repeated literally (a long passage over and over).
    """
    n = len(words)
    few = lambda part: len(part) >= 10 and len(set(part)) * 4 < len(part)
    if n <= size:
        return few(words)
    parts = (words[i : i + size] for i in range(0, n, size))
    return sum(len(p) for p in parts if few(p)) * 2 >= n or (few(words) and repeated_words(words) * 2 >= n)


def is_boilerplate(line: bytes, n: int) -> bool:
    """Boilerplate phrases make up at least one in ``BOILERPLATE_SHARE`` of the line's ``n`` words."""
    return sum(len(m.group().split()) for m in BOILERPLATE.finditer(line.lower())) * BOILERPLATE_SHARE >= n


def line_fault(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with words fails, or ``None``."""
    n = len(words)
    size = sum(map(len, words))
    ended = words[-1].endswith(TERMINAL)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if line.count(b"|") * 3 >= n > 1 or (n <= 6 and sum(w.lower().strip(b".:,|") in MENU for w in words) * 2 >= n):
        return "navigation"
    if symbols * 10 > size:
        return "symbols"
    if n >= 4 and (line.count(b"!!") * 3 >= n or line.count(b"...") * 2 >= n):
        return "punctuation"
    if n < 3 and not ended:
        return "punctuation"
    letters = len(line) - len(line.translate(None, LETTERS))
    if n >= 5 and letters and (len(line) - len(line.translate(None, UPPER))) * 10 > letters * 7:
        return "capitals"
    if is_repetitive(words):
        return "repetition"
    if is_boilerplate(line, n):
        return "boilerplate"
    return None


def judge(raw: bytes | None, keep_share: float = KEEP_SHARE) -> tuple:
    """The values of ``FIELDS`` for one text."""
    text = raw or b""
    words = text.split()
    chars = code_points(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    stay, faults, left, doubles = [], {}, 0, 0
    for line in lines:
        of_line = line.split()
        if not of_line:
            stay.append(line)
            continue
        if line in seen:
            doubles += 1
        seen.add(line)
        fault = line_fault(line, of_line)
        if fault:
            faults[fault] = faults.get(fault, 0) + 1
        else:
            left += code_points(line)
            stay.append(line)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED * len(words)
    kept = not failed and left >= keep_share * chars
    clean = None if raw is None else b"\n".join(stay).decode() if faults else text.decode()
    removed = sum(faults.values())
    return len(words), chars, symbols, doubles, repeats, failed, kept, len(lines), removed, list(faults.items()), clean


def line_first(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(row, text) and ``FIELDS``: counts, the base test, the verdict, lines removed by rule, the text that is left."""
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.map_(pa.string(), pa.int64()), pa.string()]

    def work():
        def handle(texts):
            columns = zip(*[judge(t, keep_share) for t in texts], strict=True)
            return [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]

        return handle

    return map_text(packed(docs), work, FIELDS)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = line_first(table(spark, folder, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("row.doc_id", *counts, "base_failed", "kept", "n_lines", "n_removed_lines")
