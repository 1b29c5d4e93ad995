"""Repairs against a plain shortest-path search over all edits."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from burstgraph.llm.conversation_repair import damaged, repair_reports, repaired_turns, search, suffix_bounds
from burstgraph.llm.queries import QUERIES

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, role initials) by best-first search on (cost, audit) over every allowed sequence of edits."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heappop(heap)
        last = roles[-1:]
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(turns) and last in ("", "a"):
            return cost, audit, roles

        def put(more, letter, step, role, cost=cost, audit=audit, at=at, roles=roles):
            if re.fullmatch("(s?(ua)*u?)?", roles + role):
                heappush(heap, (cost + more, audit + letter, at + step, roles + role))

        for role in "ua":
            put(3, "I", 0, role)
        if at < len(turns):
            initial, fault = turns[at]
            put(4, "D", 1, "")
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if initial:
                    put(more, "K", 1, initial)
                for role in "ua":
                    put(3 + more, "R", 1, role)


def brute(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    after = brute_damage(rows)
    for conv in {r[0] for r in after}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, turns = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role[:1], fault))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, roles = cheapest(turns)
        named, lines, at, k = {"u": "user", "a": "assistant"}, [], 0, 0
        for letter in audit:
            if letter == "I":
                lines.append(named[roles[k]] + ":")
            elif letter in "KR":
                lines.append((mine[at][2] if letter == "K" else named[roles[k]]) + ":" + mine[at][3])
            k += letter != "D"
            at += letter != "I"
        counts = [sum(f == name for _, f in turns) for name in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema).repartition(3)
    found = repair_reports(damaged(table), table).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r[1:]) for r in found}


def test_search_against_best_first():
    rng = random.Random(5)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(3000):
        turns = [(rng.choice("suuaax "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(9))]
        cost, audit, _ = cheapest([(i, names[f]) for i, f in turns])
        assert search(turns) == (cost, audit), turns
        assert suffix_bounds(turns)[0][0] <= cost


def test_long_conversations_stay_linear():
    rng = random.Random(6)
    turns = [(rng.choice("uas"), rng.choice([0, 0, 1, 3])) for _ in range(30_000)]
    cost, audit = search(turns)
    assert len(audit) >= 30_000 and cost == suffix_bounds(turns)[0][0]


def test_random_conversations(spark):
    rng = random.Random(7)
    texts = ["Hello.", "Hello", "What?  ", " \n", "", "No!\t", "a.b", "é?", "x ", None]
    rows = []
    for conv in range(250):
        roles = ["system"] * (rng.random() < 0.3) + [rng.choice(["user", "assistant", "user", "system", "tool", "", None]) if rng.random() < 0.2 else ("user", "assistant")[k % 2] for k in range(rng.randrange(1, 10))]
        start = rng.randrange(3)
        for turn, role in enumerate(roles, start):
            if rng.random() < 0.9:
                rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"{conv} {turn}."))
    assert report(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "user", "a."), (None, None, "assistant", "b."), (1, None, "system", "c."), (1, None, None, None), (1, 2, "user", "d.")]
    rows += [(2, 5, "user", "same."), (2, 5, "user", "same."), (2, 5, "assistant", "other."), (2, 9, "user", "same."), (2, 5, "user", "another.")]
    rows += [(3, None, None, None)] + [(4, t, "user", "u.") for t in (-3, 0, 7)]
    assert report(spark, rows) == brute(rows)


def test_conversations_that_lose_all_rows(spark):
    lost = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert lost
    found = report(spark, [(k, 0, "user", "a.") for k in lost])
    assert set(found.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, t, r, x, 5, "z", b"k", 0, "d") for t, (r, x) in enumerate([("system", "s."), ("user", "u."), ("assistant", "a.")])]
    table = spark.createDataFrame(rows, SCHEMA + ", kind INT, audit STRING, digest BINARY, part INT, known STRING")
    turns = repaired_turns(table).orderBy("position").collect()
    assert [(t.role, t.text) for t in turns] == [("system", "s."), ("user", "u."), ("assistant", "a.")]
    assert repair_reports(table).collect()[0].audit == "KKK"
    assert repair_reports(table.where("turn < 0")).isEmpty() and damaged(table.where("turn < 0")).isEmpty()


def test_repaired_turns_are_legal(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "assistant", "long " * 5000), (1, 2, "user", "c."), (2, 0, "system", "only."), (3, 0, "user", "")]
    found = {}
    for t in repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect():
        found[t.conv_id] = found.get(t.conv_id, "") + t.role[0]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in found.values()) and 1 in found and 2 not in found


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op13_conversation_repair"](spark, folder)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute(rows)
