"""Conversation structure repair by iterative-deepening A*.

A conversation should read ``(system? (user assistant)+)?``. Its rows, in order, are kept (cost 0), reroled to what is
expected (2) or deleted (3; blank rows and duplicates must go), and empty messages may be inserted anywhere (2); a
truncated row that stays costs 1. The cheapest edits are found depth first, in the ASCII order of their initials, under
a bound that rises by one; what the remaining rows cost at least prunes, and a table of failed states keeps the largest
budget that each has failed with. The first path that is accepted is the cheapest, and the least in ASCII.

Deepening over a long conversation would walk all of it again for every unit of cost, so it is searched in blocks of
``BLOCK`` rows. Blocks meet in one of four states of the grammar: each is searched from every state that may be on a
cheapest path to every state, and the paths are added up block by block. Inserts go before a row of their block, so
paths of one block have no prefix among them, and the order of joined paths is that of their parts. The result is the
same for any size of block.

Rows are sorted by range over (conversation, turn, role, text), so a conversation with a third of all rows is dealt to
many tasks, each of which sums up what it holds. Repeated rows are counted before they are dealt, and rows that repeat
an earlier turn are marked by a join. A conversation that lies within a task is finished there. Of others the symbols
of the rows, one byte each, are joined before the path is known; texts follow, piece by piece, into the digest.

Defined results: a null role or text is one blank. Rows of one turn stand in the order of their role and the md5 of their text, null
turns first; equal rows stand together and all but one are duplicates. Null conversation ids are a conversation. Only
the initial of a role counts. Gaps beyond 64 bits are given as the largest number. A conversation without rows has
zeros, an empty path and the digest of nothing. An empty table gives no rows. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import table

BLANK = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Rows of a conversation that are searched at a time.
BLOCK = 32
#: Rows and bytes of a conversation that a task holds; beyond, they are handed on as a piece.
PIECE_ROWS = 1 << 16
PIECE_BYTES = 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after a kept row of this initial; other rows cannot be kept.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that may come next whatever the rows say, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Symbols of rows: the role's initial (o: another), as a capital if truncated, and x for a row that must go.
MUST_GO = "x"


# ---------------------------------------------------------------- search


def least_costs(block: str, started: bool) -> list[int]:
    """What the rows from each place on cost at least, before or after the conversation has started."""
    found = [0] * (len(block) + 1)
    for i in range(len(block) - 1, -1, -1):
        symbol = block[i]
        if symbol == MUST_GO:
            cost = DELETE
        else:
            misfit = symbol in "oO" or (started and symbol in "sS")
            cost = min(DELETE, (REROLE if misfit else 0) + (TRUNCATED if symbol.isupper() else 0))
        found[i] = found[i + 1] + cost
    return found


def reachable(block: str, start: int, goal: int | None) -> bool:
    if goal is None or goal == start or (block and goal in (USER, ASSISTANT)):
        return True
    return start == START and goal == SYSTEM and any(symbol in "sS" for symbol in block)


@lru_cache(maxsize=1 << 16)
def search(block: str, start: int, goal: int | None) -> tuple[int, str] | None:
    """(cost, path) of the cheapest edits of ``block`` from state ``start``, the least in ASCII among them.

    They end in state ``goal`` with the last row; without a goal, where the conversation may end, after inserts if need be.
    """
    if not reachable(block, start, goal):
        return None
    fresh, started = least_costs(block, False), least_costs(block, True)
    failed: dict[tuple[int, int, bool], int] = {}

    def descend(i: int, state: int, left: int, may_insert: bool) -> str | None:
        """The first path from here that costs no more than ``left``."""
        if left < (fresh if state == START else started)[i]:
            return None
        if i == len(block) and (state == goal or (goal is None and state in (START, ASSISTANT))):
            return ""
        place = i, state, may_insert
        if left <= failed.get(place, -1):
            return None
        symbol = block[i] if i < len(block) else None
        if symbol is not None and left >= DELETE:
            rest = descend(i + 1, state, left - DELETE, True)
            if rest is not None:
                return "D" + rest
        if may_insert and left >= INSERT and (symbol is not None or goal is None):
            # a second insert only leads on from the start; elsewhere it leads back
            rest = descend(i, NEXT[state][1], left - INSERT, state in (START, SYSTEM))
            if rest is not None:
                return "I" + rest
        if symbol is not None and symbol != MUST_GO:
            left_then = left - (TRUNCATED if symbol.isupper() else 0)
            kept = KEEP.get((state, symbol.lower()))
            if kept is not None and left_then >= 0:
                rest = descend(i + 1, kept, left_then, True)
                if rest is not None:
                    return "K" + rest
            if kept != NEXT[state][1] and left_then >= REROLE:
                rest = descend(i + 1, NEXT[state][1], left_then - REROLE, True)
                if rest is not None:
                    return "R" + rest
        failed[place] = left
        return None

    bound = (fresh if start == START else started)[0]
    while True:
        path = descend(0, start, bound, True)
        if path is not None:
            return bound, path
        bound += 1


def worth_going_on(costs: dict[int, int]) -> list[int]:
    """States that may be on a cheapest path: what others can do in their place costs them more.

    After an assistant a conversation can go on like before its start, but for a system row (deleted instead), and like after a
    system row; after a user it can be brought there by an insert.
    """
    ready = min(costs.get(ASSISTANT, 1 << 62), costs.get(USER, 1 << 62) + INSERT)
    return [s for s, cost in costs.items() if not ((s == START and ready + DELETE < cost) or (s == SYSTEM and ready < cost))]


def cheapest(symbols: str, block: int | None = None) -> tuple[int, str]:
    """(cost, path) of the cheapest edits of a conversation, the least in ASCII among them."""
    size = block or BLOCK
    parts = [symbols[i : i + size] for i in range(0, len(symbols), size)] or [""]
    costs, order, steps = {START: 0}, {START: 0}, []
    for number, part in enumerate(parts):
        goals = STATES if number + 1 < len(parts) else (None,)
        best: dict = {}
        for goal in goals:
            for state, cost in costs.items():
                found = search(part, state, goal)
                if found is not None:
                    offer = cost + found[0], order[state], found[1], state
                    best[goal] = min(best.get(goal, offer), offer)
        costs = {goal: best[goal][0] for goal in best}
        costs = {s: costs[s] for s in worth_going_on(costs)}
        order = {s: n for n, s in enumerate(sorted(costs, key=lambda s: best[s][1:3]))}
        steps.append({s: best[s][2:] for s in costs})
    state, paths = None, []
    for step in reversed(steps):
        path, state = step[state]
        paths.append(path)
    return costs[None], "".join(reversed(paths))


def repaired(symbols: str, path: str, stay: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """The messages (role, text) of a conversation after its edits. ``stay`` gives the rows that need not go, in order."""
    state, at = START, 0
    for edit in path:
        if edit == "I":
            role, state = NEXT[state]
            yield role, b""
            continue
        symbol, at = symbols[at], at + 1
        if symbol == MUST_GO:
            continue
        role, text = next(stay)
        if edit == "K":
            state = KEEP[state, symbol.lower()]
            yield role, text
        elif edit == "R":
            role, state = NEXT[state]
            yield role, text


# ---------------------------------------------------------------- counts


class Counts:
    """What is counted in the rows of a conversation, or of a piece of it; pieces add up in their order."""

    def __init__(self, values: list | None = None):
        (self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last, self.last_turn) = (
            values or [0] * 5 + [None] * 5
        )
        self.first_turn = self.low

    def values(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last, self.last_turn]

    def row(self, turn: int | None, initial: str) -> None:
        """One more row, after the others."""
        if self.last is not None and (chr(self.last) + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.first = ord(initial) if self.first is None else self.first
        self.last = ord(initial)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn

    def add(self, after: Counts) -> None:
        """The counts of the piece that follows."""
        self.blank += after.blank
        self.duplicate += after.duplicate
        self.truncated += after.truncated
        self.illegal += after.illegal
        if self.last is not None and after.first is not None and (chr(self.last) + chr(after.first)) not in ("su", "ua", "au"):
            self.illegal += 1
        self.first = after.first if self.first is None else self.first
        self.last = self.last if after.last is None else after.last
        if after.low is not None:
            self.turns += after.turns - (self.last_turn == after.low)
            self.low = after.low if self.low is None else self.low
            self.high = self.last_turn = after.high

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


class Piece:
    """Rows of one conversation that a task holds: their symbols, and role and text of those that need not go."""

    def __init__(self):
        self.symbols: list[str] = []
        self.stay: list[tuple[str, bytes]] = []
        self.counts = Counts()
        self.bytes = 0

    def full(self) -> bool:
        return len(self.symbols) >= PIECE_ROWS or self.bytes >= PIECE_BYTES

    def row(self, turn: int | None, role: str, text: bytes, blank: bool, whole: bool, duplicate: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.counts.row(turn, initial)
        if blank or duplicate:
            self.symbols.append(MUST_GO)
            self.counts.blank += blank
            self.counts.duplicate += not blank
            return
        self.counts.truncated += not whole
        self.symbols.append(initial if whole else initial.upper())
        self.stay.append((role, text))
        self.bytes += len(text) + len(role)


# ---------------------------------------------------------------- tasks

VERDICT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLACE = "kind TINYINT, part INT, piece BIGINT"
HELD = (
    f"{PLACE}, symbols STRING, counts ARRAY<BIGINT>, stay ARRAY<STRUCT<role: STRING, text: BINARY>>, "
    f"{', '.join(f'{v} BIGINT' for v in VERDICT)}, path STRING, digest STRING"
)
MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.binary())]))
HELD_TYPES = [pa.int8(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), MESSAGES, *[pa.int64()] * 6, pa.string(), pa.string()]
HELD_NAMES = ["kind", "part", "piece", "symbols", "counts", "stay", *VERDICT, "path", "digest"]
#: Kinds of what a task hands on: a conversation's symbols come before its texts, both before its verdict.
SYMBOLS, TEXTS, DONE = range(3)
#: Kinds of what a task gets: the number of a conversation's rows, a mark that a row repeats an earlier turn, the row.
TOTAL, MARK, ROW = range(3)


def finished(counts: Counts, symbols: str, stay: Iterator[tuple[str, bytes]], messages: bool) -> Iterator[tuple]:
    """Values of ``HELD`` from ``piece`` on: the messages in pieces if asked for, then the verdict."""
    cost, path = cheapest(symbols)
    digest, piece, held, size = hashlib.sha256(), 0, [], 0
    for number, (role, text) in enumerate(repaired(symbols, path, stay)):
        digest.update((b"\n" if number else b"") + role.encode() + b":" + text)
        if messages:
            held.append({"role": role, "text": text})
            size += len(role) + len(text) + 16
            if size >= PIECE_BYTES:
                yield (piece, None, None, held, *[None] * 6, None, None)
                piece, held, size = piece + 1, [], 0
    verdict = counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost
    yield (piece, None, None, held, *verdict, path, digest.hexdigest())


def batches_of(rows: Iterable[tuple], key: pa.DataType, at_a_time: int = 1000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
            size += sum(len(m["text"]) for m in row[6] or ())
        if held and (row is None or len(held) >= at_a_time or size >= PIECE_BYTES):
            columns = zip(*held, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, [key, *HELD_TYPES], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", *HELD_NAMES])
            held, size = [], 0


def values_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def within_task(rows: Iterable[tuple], part: int, messages: bool) -> Iterator[tuple]:
    """Finished conversations of a task, and pieces of those that reach beyond it.

    ``rows`` are sorted: (conversation, turn, role, md5, kind, text, copies, blank, whole).
    """
    for key, group in groupby(rows, lambda r: r[0]):
        held, total, seen, number, marked = Piece(), None, 0, 0, None

        def handed_on(piece: Piece, number: int, key=key) -> Iterator[tuple]:
            stay = [{"role": role, "text": text} for role, text in piece.stay]
            yield (key, SYMBOLS, part, number, "".join(piece.symbols), piece.counts.values(), None, *[None] * 8)
            if stay:
                yield (key, TEXTS, part, number, None, None, stay, *[None] * 8)

        for _, turn, role, digest, kind, text, n, blank, whole in group:
            if kind == TOTAL:
                total = n
                continue
            if kind == MARK:
                marked = turn, role, digest
                continue
            seen += n
            again = marked == (turn, role, digest)
            for copy in range(n):
                if held.full():
                    yield from handed_on(held, number)
                    held, number = Piece(), number + 1
                held.row(turn, role, text, blank, whole, again or copy > 0)
        if not number and total == seen:
            for values in finished(held.counts, "".join(held.symbols), iter(held.stay), messages):
                yield (key, DONE, part, *values)
        elif seen:
            yield from handed_on(held, number)


def across_tasks(rows: Iterable[tuple], messages: bool) -> Iterator[tuple]:
    """All conversations, finished: those of one task as they come, pieces of others put together.

    ``rows`` are sorted by conversation, kind, part and piece.
    """
    for key, group in groupby(rows, lambda r: r[0]):
        counts, symbols, rest = None, [], None
        for row in group:
            if row[1] == DONE:
                yield row
            elif row[1] == SYMBOLS:
                counts = counts or Counts()
                counts.add(Counts(row[5]))
                symbols.append(row[4])
            else:
                rest = row
                break
        if counts is not None:
            texts = (m for row in chain([rest] if rest else [], group) for m in row[6])
            for values in finished(counts, "".join(symbols), ((m["role"], m["text"]) for m in texts), messages):
                yield (key, DONE, 0, *values)


# ---------------------------------------------------------------- the operator


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with equal rows as one, and what is told from a text alone."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced, "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    digest = F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5")
    blank, whole = (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(*ENDS).alias("whole")
    return rows.select("conv_id", "turn", "role", digest, F.col("text").cast("binary").alias("text"), "n", blank, whole)


def repeats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, md5) of rows whose role and text stand in an earlier turn, too."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    light = rows.where(~F.col("blank")).select("conv_id", "turn", "role", "md5", place.alias("place"))
    of = light.groupBy("conv_id", "role", "md5").agg(F.min("place").alias("first"), F.max("place").alias("final"))
    of = of.where(F.col("first") < F.col("final")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("md5").alias("m"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("md5") == F.col("m"))
    return light.join(of, same).where(F.col("place") > F.col("first")).select("conv_id", "turn", "role", "md5")


def repair(rows: DataFrame, conversations: DataFrame, messages: bool = True) -> DataFrame:
    """The repaired conversations, in pieces: (conv_id, piece, messages, ``VERDICT``, path, digest).

    ``rows`` has conv_id, turn, role, text and copies, the number of times that a row stands there; ``conversations``
    the ids that are to have a result, also without rows. Messages (role, text) follow each other over the pieces of a
    conversation; its last piece has the counts, the cost, the path of edits and the SHA-256 of the messages as ``role:text``
    joined by newlines. Without ``messages`` that one row is all.
    """
    key = rows.schema["conv_id"].dataType
    held = prepared(rows)
    sizes = conversations.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("n"))
    sizes = sizes.unionByName(held.select("conv_id", "n")).groupBy("conv_id").agg(F.sum("n").alias("n"))

    def like_rows(found: DataFrame, kind: int) -> DataFrame:
        there = set(found.columns)
        kinds = held.schema
        columns = [F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
        return found.select(*columns, F.lit(kind).cast("tinyint").alias("kind"))

    order = ["conv_id", "turn", "role", "md5"]
    both = like_rows(held, ROW).unionByName(like_rows(repeats(held), MARK)).unionByName(like_rows(sizes, TOTAL))
    both = both.repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    both = both.select(*order, "kind", "text", "n", "blank", "whole")
    schema = f"conv_id {key.simpleString()}, {HELD}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field(0).type
            part = TaskContext.get().partitionId()
            yield from batches_of(within_task(values_of(chain([batch], batches)), part, messages), ids)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field(0).type
            yield from batches_of(across_tasks(values_of(chain([batch], batches)), messages), ids)

    place = ["conv_id", "kind", "part", "piece"]
    found = both.mapInArrow(first, schema).repartition("conv_id").sortWithinPartitions(*place).mapInArrow(second, schema)
    text = F.transform("stay", lambda m: F.struct(m["role"].alias("role"), m["text"].cast("string").alias("text")))
    return found.select("conv_id", "piece", text.alias("messages"), *VERDICT, "path", "digest")


# ---------------------------------------------------------------- the query


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the contract damages them, with ``copies``: drop, empty, cut the ends off, repeat, set the role."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    rows = rows.where(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows), rows, messages=False).where(F.col("path").isNotNull())
    return found.select("conv_id", *VERDICT, F.col("path").alias("audit"), F.col("digest").alias("repaired_sha256"))
