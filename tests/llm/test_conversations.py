"""Conversation repair against a plain shortest path and against the contract worked out by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from thinjoin.llm import conversations
from thinjoin.llm.common import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost int, kind string"
FULL_STOP = re.compile("[.!?]")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def shortest(symbols):
    """(cost, path): the least pair per grammar state, row by row; inserts in at most two steps at every place."""
    best = {"": (0, "")}
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    expected = {"": "u", "s": "u", "u": "a", "a": "u"}

    def offer(into, state, cost, path):
        into[state] = min(into.get(state, (cost, path)), (cost, path))

    def inserts(now):
        for _ in range(2):
            for state, (cost, path) in list(now.items()):
                offer(now, expected[state], cost + 2, path + "I")
        return now

    for symbol in symbols:
        then = {}
        for state, (cost, path) in inserts(best).items():
            offer(then, state, cost + 3, path + "D")
            if symbol != "x":
                extra = symbol.isupper()
                if (state, symbol.lower()) in after:
                    offer(then, after[state, symbol.lower()], cost + extra, path + "K")
                offer(then, expected[state], cost + 2 + extra, path + "R")
        best = then
    return min(value for state, value in inserts(best).items() if state in ("", "a"))


def all_edits(symbols, most):
    """Every (cost, path) up to the cost ``most`` that gives an accepted conversation."""
    found, todo = [], [(0, "", 0, "")]
    while todo:
        cost, path, at, roles = todo.pop()
        if cost > most:
            continue
        if at == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, path))
        todo += [(cost + 2, path + "I", at, roles + r) for r in "ua"]
        if at < len(symbols):
            symbol = symbols[at]
            todo.append((cost + 3, path + "D", at + 1, roles))
            if symbol != "x":
                extra = symbol.isupper()
                todo.append((cost + extra, path + "K", at + 1, roles + symbol.lower()))
                todo += [(cost + 2 + extra, path + "R", at + 1, roles + r) for r in "ua"]
    return min(found)


def test_shortest_path_is_the_contract():
    rng = random.Random(1)
    for _ in range(60):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(4)))
        cost, path = shortest(symbols)
        assert all_edits(symbols, min(cost, 7)) == (cost, path) if cost <= 7 else True


@pytest.mark.parametrize("block", [1, 2, 3, 7, 32])
def test_search_is_the_shortest_path(block):
    rng = random.Random(block)
    for _ in range(400):
        letters = rng.choice(["suaoSUAOx", "ua", "uaua", "suax", "ss", "uuuaS", "x", "xs"])
        symbols = "".join(rng.choice(letters) for _ in range(rng.randrange(24)))
        assert conversations.cheapest(symbols, block) == shortest(symbols), symbols


def test_a_long_conversation():
    rng = random.Random(3)
    symbols = "s" + "".join(c if rng.random() > 0.2 else rng.choice("uaxUAoS") for c in "ua" * 3000)
    assert conversations.cheapest(symbols) == shortest(symbols)


def by_hand(rows):
    """The contract over rows of (conv_id, turn, role, text)."""
    told = lambda v: " " if v is None else str(v)
    there, found = {}, {}
    for conv, turn, role, text in rows:
        held = there.setdefault(conv, [])
        role, text = told(role), told(text)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = FULL_STOP.sub("", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, held in there.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, symbols, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, text in held:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if FULL_STOP.match(solid[-1]) else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:], strict=False)]
        cost, path = shortest(symbols)
        state, at, out = "", 0, []
        for edit in path:
            expected = "assistant" if state == "u" else "user"
            role, text = (None, None) if edit == "I" else held[at][1:]
            at += edit != "I"
            if edit != "D":
                role, text = (expected, "") if edit == "I" else (expected if edit == "R" else role, text)
                state = role[0]
                out.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found[conv] = (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, path, digest)
    return found


def results(found):
    rows = found.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def repaired_query(rows):
    found = conversations.repair(conversations.damaged(rows), rows, messages=False)
    return found.where("path is not null").select("conv_id", *conversations.VERDICT, "path", "digest")


def random_rows(seed, hot=300):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "", " \t", "open end", "Fine! ", "e…", "same.", None, "Ünï.", "a\nb", "x." * 50]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "system", None, "tool", "", "USER"]) if rng.random() < 0.3 else ("assistant" if turn % 2 else "user")
            rows.append((conv, rng.choice([turn, turn, turn, turn, None, 0, turn * 3]), role, rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    for turn in range(hot):  # one conversation with most of the rows, one text all over it, one row over and over
        rows.append((7, turn, "user" if turn % 2 else "assistant", "the same." if turn % 3 == 0 else f"t{turn}"))
        rows.append((7, 5, "user", "again and again"))
    rows += rows[:40] + [(99, None, None, None), (98, -(1 << 63), "user", "a."), (98, (1 << 63) - 1, "assistant", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def test_query_by_hand(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert results(conversations.op11_conversation_repair(spark, folder)) == by_hand(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_by_hand(spark, seed):
    rows = random_rows(seed)
    assert results(repaired_query(frame(spark, rows))) == {c: (min(v[0], (1 << 63) - 1), *v[1:]) for c, v in by_hand(rows).items()}


def test_conversations_over_many_tasks_by_hand(spark, monkeypatch):
    rows = random_rows(3, 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = results(repaired_query(frame(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {c: (min(v[0], (1 << 63) - 1), *v[1:]) for c, v in by_hand(rows).items()}


def test_pieces_add_up(monkeypatch):
    """Sorted rows dealt to tasks at every place, in pieces of three rows."""
    rng = random.Random(4)
    rows, kinds = [], ["", "end.", "open", "end."]
    for turn in range(40):
        for text in sorted({rng.choice(kinds) + (str(turn) + "." if rng.random() < 0.5 else "") for _ in range(2)}):
            rows.append((1, rng.choice([turn, turn, None]) if turn == 0 else turn, rng.choice(["user", "assistant"]), text.encode(), conversations.ROW, text.encode(), rng.choice([1, 1, 5]), not text, text.endswith(".")))
    total = (1, None, None, None, conversations.TOTAL, None, sum(r[6] for r in rows), None, None)
    whole = list(conversations.within_task([total, *rows], 0, False))
    assert len(whole) == 1
    monkeypatch.setattr(conversations, "PIECE_ROWS", 3)
    for cut in range(len(rows)):
        parts = [*conversations.within_task([total, *rows[:cut]], 0, False), *conversations.within_task(rows[cut:], 1, False)]
        parts.sort(key=lambda r: (r[1], r[2], r[3]))
        assert [r[7:] for r in conversations.across_tasks(parts, False)] == [whole[0][7:]]


def test_messages_and_their_digest(spark, monkeypatch):
    rows = frame(spark, random_rows(5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversations.repair(conversations.damaged(rows), rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    messages, digests = {}, {}
    for r in sorted(found, key=lambda r: r["piece"]):
        messages.setdefault(r["conv_id"], []).extend(f"{m['role']}:{m['text']}" for m in r["messages"])
        if r["path"] is not None:
            digests[r["conv_id"]] = r["digest"]
    for conv, lines in messages.items():
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digests[conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired_query(empty).collect() == []
